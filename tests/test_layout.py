"""Chunked layouts against plain pandas, with chunk sizes small enough to cross many edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import evaluate as EV
from seriesforge.operators import layout as L

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(s, t, float(RNG.normal())) for s, n in ((1, 57), (2, 1), (3, 300)) for t in range(n)]
    return spark.createDataFrame(rows, "series_id long, t int, value double")


def frame(df, *by):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)


def test_index_matches_a_plain_rank(spark):
    pdf = pd.DataFrame({"k": RNG.integers(0, 3, 400), "x": RNG.permutation(400)})
    got = frame(L.index_series(spark.createDataFrame(pdf), "k", ["x"], F.floor(F.col("x") / 7)), "k", "x")
    want = pdf.sort_values(["k", "x"]).groupby("k").cumcount().to_numpy()
    assert (got["t"].to_numpy() == want).all()


def test_framed_window_crosses_chunks(points):
    got = frame(L.framed(points, 3, 2, {"m": lambda w: F.avg("value").over(w(-3, 2)), "p": lambda w: F.lag("value").over(w())}, size=8), "series_id", "t")
    p = frame(points, "series_id", "t")
    for s, g in p.groupby("series_id"):
        x = g["value"].to_numpy()
        want = [x[max(0, i - 3):i + 3].mean() for i in range(len(x))]
        np.testing.assert_allclose(got[got.series_id == s]["m"], want)
        np.testing.assert_allclose(got[got.series_id == s]["p"].to_numpy(float)[1:], x[:-1])


def test_running_sums(points):
    got = frame(L.running_sums(points, {"c": F.col("value")}, size=8), "series_id", "t")
    p = frame(points, "series_id", "t")
    np.testing.assert_allclose(got["c"], p.groupby("series_id")["value"].cumsum())


def test_clamped_fold_matches_the_loop(points, monkeypatch):
    monkeypatch.setattr(L, "FOLD", 7)
    got = frame(L.fold_clamped_affine(points, F.lit(0.7), F.col("value"), hi=F.lit(1.0), lo=F.lit(-0.5), start=F.lit(0.2)), "series_id", "t")
    p = frame(points, "series_id", "t")
    for s, g in p.groupby("series_id"):
        y, out = None, []
        for x in g["value"]:
            y = 0.2 if y is None else min(max(0.7 * y + x, -0.5), 1.0)
            out.append(y)
        np.testing.assert_allclose(got[got.series_id == s]["y"], out)


def test_asof_carries_over_empty_chunks(spark):
    left = spark.createDataFrame([(1, t) for t in range(0, 100, 9)], "series_id long, t int")
    right = spark.createDataFrame([(1, 4, 10.0), (1, 27, 20.0), (1, 95, 30.0)], "series_id long, t int, q double")
    got = frame(L.asof(left, right, ["q"], size=5), "t")
    want = [None if t < 4 else 10.0 if t < 27 else 20.0 if t < 95 else 30.0 for t in got["t"]]
    assert [None if x != x else x for x in got["q"]] == want


def test_neighbours_over_empty_chunks(spark):
    pos = [0, 3, 50, 51, 99]
    df = spark.createDataFrame([(1, p, f"s{p}") for p in pos], "series_id long, start_index int, segment_id string")
    got = frame(L.neighbours(df, "start_index", ["segment_id"], size=8), "start_index")
    assert list(got["prev_segment_id"].where(got["prev_segment_id"].notna(), None)) == [None, "s0", "s3", "s50", "s51"]
    nxt = frame(L.neighbours(df, "start_index", ["segment_id"], size=8, back=False), "start_index")
    assert list(nxt["next_segment_id"].where(nxt["next_segment_id"].notna(), None)) == ["s3", "s50", "s51", "s99", None]


def segs(spark, cuts, n, lab="abc"):
    edges = [0, *cuts, n]
    return spark.createDataFrame([(1, i, a, b - 1, lab[i % len(lab)]) for i, (a, b) in enumerate(zip(edges, edges[1:]))],
                                 "series_id long, segment_id int, start_index int, end_index int, label string")


def test_interval_join_has_no_duplicates(spark, points):
    s = segs(spark, [5, 30, 31], 57)
    got = L.attach_segments(points.where("series_id = 1"), s, width=4)
    assert got.count() == 57
    assert got.where("not (t between start_index and end_index)").count() == 0
    padded = L.attach_segments(points.where("series_id = 1"), s, pad=3, width=4)
    want = sum(min(56, b + 3) - max(0, a - 3) + 1 for a, b in ((0, 4), (5, 29), (30, 30), (31, 56)))
    assert padded.count() == want


def test_overlaps_found_once(spark):
    g, p = segs(spark, [10, 20], 40), segs(spark, [5, 25], 40)
    o = EV.overlaps(g, p, width=3).toPandas()
    assert len(o) == 5 and o["intersection"].sum() == 40


def test_band_match_is_greedy_in_order(spark):
    mk = lambda xs: spark.createDataFrame([(1, x) for x in xs], "series_id long, boundary int")
    rng = np.random.default_rng(0)
    for _ in range(3):
        g, p = sorted(set(rng.integers(1, 120, 25).tolist())), sorted(set(rng.integers(1, 120, 25).tolist()))
        free, tp = list(g), 0
        for b in p:
            hit = next((x for x in free if abs(x - b) <= 3), None)
            if hit is not None:
                free.remove(hit)
                tp += 1
        assert EV.match_boundaries(mk(g), mk(p), 3).first()["tp"] == tp


def test_known_good_and_known_bad_segmentations(spark):
    g = segs(spark, [4, 8], 12)
    same = EV.boundary_f1(g, g).first()
    assert (same["precision"], same["recall"], same["f1"]) == (1.0, 1.0, 1.0)
    assert EV.macro_iou(g, g).first()["macro_iou"] == 1.0 and EV.covering(g, g).first()["covering"] == 1.0
    bad = segs(spark, [2, 4, 6, 8, 10], 12)
    assert EV.over_segmentation(g, bad).first()["over_segmentation_rate"] == 1.0
    assert EV.macro_iou(g, bad).first()["macro_iou"] < 1.0
