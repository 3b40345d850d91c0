"""Neighbours by routed blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import distance, metric_join


def table(spark, x, labels):
    return spark.createDataFrame([(i, labels[i], None if v is None else v.tolist()) for i, v in enumerate(x)], "id long, label string, v array<double>")


def brute(x, labels, k, metric, rule):
    out = {}
    for i in range(len(x)):
        ok = [j for j in range(len(x)) if (rule == "any") or (rule == "other" and j != i) or (rule == "unlike" and labels[j] != labels[i])]
        d = np.sqrt(((x[ok] - x[i]) ** 2).sum(1)) if metric == "l2" else np.abs(x[ok] - x[i]).sum(1)
        out[i] = [(ok[j], d[j]) for j in np.lexsort((ok, d))[:k]]
    return out


@pytest.mark.parametrize("rule, metric", [("other", "l2"), ("unlike", "l1")])
def test_clusters_copies_and_ties(spark, rule, metric):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5)) * 10
    x = centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 5))
    x[:100] = x[0]                                      # a third of the rows are copies
    labels = ["a" if v < 3 else "b" for v in ((x[:, None] - centres) ** 2).sum(-1).argmin(1)]
    df = table(spark, x, labels)
    got = {}
    for r in distance.nearest(df, df, 3, metric, rule, pivots=12, block=16).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["nn_id"], r["distance"])
    want = brute(x, labels, 3, metric, rule)
    for i, own in want.items():
        assert [got[i][n + 1][0] for n in range(len(own))] == [j for j, _ in own]
        np.testing.assert_allclose([got[i][n + 1][1] for n in range(len(own))], [d for _, d in own], atol=1e-9)


def test_no_base_row_goes_where_nobody_asked(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(12, 6)) * 30)[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 6))
    df = table(spark, x, ["a"] * len(x))
    seen, real = [], metric_join.with_copies

    def watched(asks, blocks, block):
        q, b = real(asks, blocks, block)
        seen.append((q, b))
        return q, b
    monkeypatch.setattr(metric_join, "with_copies", watched)
    assert distance.nearest(df.where("id < 60"), df, 3, block=40).count() == 180
    place = [*metric_join.PLACE, "chunk"]
    copies = 0
    for q, b in seen:
        asked = q.select(*metric_join.PLACE).distinct()
        assert b.join(asked, metric_join.PLACE, "left_anti").count() == 0
        copies += b.count()
        assert b.groupBy(*place).count().agg(F.max("count")).first()[0] <= 120
    assert len(seen) == 2 and copies < 3 * len(x)


def test_few_rows_nulls_and_nothing(spark):
    df = table(spark, [np.array([0.0, 1.0]), np.array([0.0, 1.0]), None, np.array([3.0, 1.0])], ["a", "a", "a", None])
    got = sorted((r["id"], r["rank"], r["nn_id"], r["distance"]) for r in distance.nearest(df, df, 2).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 3, 3.0), (1, 1, 0, 0.0), (1, 2, 3, 3.0), (3, 1, 0, 3.0), (3, 2, 1, 3.0)]
    assert distance.nearest(df, df.limit(0), 2).count() == 0 and distance.nearest(df.limit(0), df, 2).count() == 0


def test_band_follows_each_querys_length(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=10 if i % 2 else 30) for i in range(40)]
    df = table(spark, x, ["a" if i % 4 < 2 else "b" for i in range(40)]).withColumn("target", F.col("label"))
    got = {r["id"]: r for r in distance.ynn_dtw(df, df, 3, band=0.2).collect()}
    alone = {r["id"]: r for n in (0, 1) for r in distance.ynn_dtw(df.where(f"id % 2 = {n}"), df.where(f"id % 2 = {n}"), 3, band=0.2).collect()}
    assert got == alone and len(got) == 40


def test_each_series_takes_the_periods_that_fit_it(spark):
    from seriesforge.operators import fits
    t = np.arange(60)
    y = np.sin(2 * np.pi * t / 4) + 0.1 * t
    rows = [(1, int(i), float(v)) for i, v in zip(t, y)] + [(2, int(i), float(v)) for i, v in zip(t[:12], y)] + [(3, int(i), float(v)) for i, v in zip(t[:5], y)]
    df = spark.createDataFrame(rows, "series_id long, t int, value double")
    both = {(r.series_id, r.t): (r.trend, r.seasonal_4, r.seasonal_20, r.residual) for r in fits.multi_seasonal(df, [20, 4, 500]).collect()}
    for one, periods in ((1, [4, 20]), (2, [4])):
        for r in fits.multi_seasonal(df.where(F.col("series_id") == one), periods).collect():
            got = both[one, r.t]
            assert got[0] == pytest.approx(r.trend) and got[1] == pytest.approx(r.seasonal_4) and got[3] == pytest.approx(r.residual)
            assert got[2] == (pytest.approx(r.seasonal_20) if one == 1 else None)
    assert all(both[3, i] == (None, None, None, float(y[i])) for i in range(5))


@pytest.mark.parametrize("rule, metric", [("other", "l2"), ("unlike", "l1"), ("target", "l2")])
def test_rows_without_clusters_meet_in_large_chunks(spark, monkeypatch, rule, metric):
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(400, 24)), [("a", "b", "c")[i % 3] for i in range(400)]
    df = table(spark, x, labels)
    rounds, real = [], metric_join.with_copies
    monkeypatch.setattr(metric_join, "with_copies", lambda *a: rounds.append(1) or real(*a))
    monkeypatch.setattr(metric_join, "CHUNK_BYTES", 8 * 24 * 150)
    q = df.withColumn("target", F.col("label")) if rule == "target" else df
    got = {}
    for r in distance.nearest(q, df, 4, metric, rule, block=32).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["nn_id"], r["distance"])
    for i in range(len(x)):
        ok = [j for j in range(len(x)) if (rule == "other" and j != i) or (rule == "unlike" and labels[j] != labels[i]) or (rule == "target" and labels[j] == labels[i])]
        d = np.sqrt(((x[ok] - x[i]) ** 2).sum(1)) if metric == "l2" else np.abs(x[ok] - x[i]).sum(1)
        best = np.lexsort((ok, d))[:4]
        assert [got[i][n + 1][0] for n in range(4)] == [ok[j] for j in best]
        np.testing.assert_allclose([got[i][n + 1][1] for n in range(4)], d[best], atol=1e-9)
    assert len(rounds) == 1                             # no second round of queries by block


def test_batched_warping_and_bounds_equal_one_by_one():
    from seriesforge.functions import kernels as N
    rng = np.random.default_rng(6)
    q, b, banned = rng.normal(size=(9, 20)).cumsum(1), rng.normal(size=(150, 20)).cumsum(1), rng.random((9, 150)) < 0.3
    banned[3] = True
    for metric, fast in (("dtw", N.near_dtw), ("lb_keogh", N.near_keogh)):
        for k, r in ((1, 2), (4, 5), (200, 3)):
            want = {i: sorted(zip(d, j))[:k] for i, j, d in N.nearest_rows(q, b, k, metric, lambda i: ~banned[i], r)}
            got: dict = {}
            for i, j, d in zip(*fast(q, b, k, banned, r)):
                got.setdefault(i, []).append((d, j))
            assert {i: sorted(x)[:k] for i, x in got.items()} == want and 3 not in want


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e6), (1e-25, 0.0), (1e20, 0.0), (0.0, 3.0)])
def test_warping_without_clusters_works_few_pairs_out_exactly(monkeypatch, scale, offset):
    """Unit vectors without clusters, where no Keogh bound prunes; labels as masks, copies as ties."""
    from seriesforge.functions import kernels as N
    rng = np.random.default_rng(9)
    x = rng.normal(size=(460, 32))
    x = x / np.sqrt((x * x).sum(1, keepdims=True)) * scale + offset
    q, b, label = x[:60], np.concatenate([x[60:], x[60:80]]), rng.integers(0, 3, 480)
    worked, real = [], N.dtw_within
    monkeypatch.setattr(N, "dtw_within", lambda a, *rest: worked.append(len(a)) or real(a, *rest))
    for banned in (None, label[None, 60:] == label[:60, None], rng.random((60, 420)) < 0.2):
        for k, r in ((1, 4), (3, 4), (2, None)):
            worked.clear()
            got: dict = {}
            for i, j, d in zip(*N.near_dtw(q, b, k, banned, r)):
                got.setdefault(i, []).append((d, j))
            assert scale != 1.0 or offset or sum(worked) < 60 * 420 / 4
            for i in range(0, 60, 7):
                ok = np.arange(420) if banned is None else np.flatnonzero(~banned[i])
                d = N.dtw(np.repeat(q[i][None], len(ok), 0), b[ok], r)
                assert sorted(got[i])[:k] == sorted(zip(d, ok))[:k]


def test_keogh_blocks_grow_with_the_rows(spark):
    """Copies of each row: 8 up to 16 blocks' rows, 19 for 615384 (151 with blocks of 4096); answers hang on no block size."""
    assert [-(-n // distance.rows_together(n, metric_join.BLOCK, "lb_keogh")) for n in (2000, 102564, 615384)] == [1, 8, 19]
    x = np.random.default_rng(4).normal(size=(90, 12))
    df = table(spark, x, ["a", "b", "c"] * 30)
    few, many = ({(r["id"], r["rank"]): (r["nn_id"], r["distance"]) for r in distance.nearest(df, df, 3, "lb_keogh", "other", 2, block=b).collect()} for b in (1, 2048))
    assert few == many and len(few) == 270
