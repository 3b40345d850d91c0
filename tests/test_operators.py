"""Closed-form cases and identities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.functions import kernels as N
from seriesforge.functions import vectors as V
from seriesforge.operators import boundaries as B
from seriesforge.operators import component_edits as CE
from seriesforge.operators import distance as D
from seriesforge.operators import edits as E
from seriesforge.operators import fits as T
from seriesforge.operators import shapes as H
from seriesforge.operators import stats as S
from seriesforge.operators import sessions as J
from seriesforge.operators import validation as X
from seriesforge.plans import pipelines as L
from seriesforge.streaming.stateful import LogDet


def series(spark, *xs):
    return spark.createDataFrame([(i, 0, t, float(x)) for i, s in enumerate(xs) for t, x in enumerate(s)], "series_id long, segment_id int, t int, value double")


def rows(spark, *xs):
    return spark.createDataFrame([(i, 0, [float(v) for v in x]) for i, x in enumerate(xs)], "series_id long, segment_id int, v array<double>")


def test_statistics_of_a_ramp(spark):
    p = series(spark, range(10))
    seg = spark.createDataFrame([(0, 0, 2, 7, "trend")], "series_id long, segment_id int, start_index int, end_index int, label string")
    r = S.segment_statistics(p, seg).first()
    assert r["segment_length"] == 6 and r["slope"] == pytest.approx(1.0) and r["sign_consistency"] == 1.0
    assert r["residual_to_line"] == pytest.approx(0.0, abs=1e-9) and r["variance"] == pytest.approx(np.var(np.arange(6)))
    # Equal side contexts cancel, so the boundary jumps decide.
    assert r["context_contrast"] == pytest.approx(abs(4.5 - (0.5 + 8.5) / 2) or 1.0)


def test_periodicity_and_constant(spark):
    sine = [math.sin(2 * math.pi * t / 6) for t in range(24)]
    r = {x["series_id"]: x["periodicity_score"] for x in S.periodicity_score(series(spark, sine, [1.0] * 12)).collect()}
    assert r[0] > 0.99 and r[1] == 0.0


def test_edit_identities(spark):
    x = list(np.random.default_rng(1).normal(size=20))
    d = rows(spark, x)
    out = d.select(E.reverse(E.reverse(F.col("v"))).alias("a"), E.scale(F.col("v"), 1.0).alias("b"), E.resample_step(F.col("v"), 1.0).alias("c"),
                   E.circular_shift(F.col("v"), 0).alias("e"), E.crossfade(F.col("v"), F.col("v"), 4).alias("f")).first()
    for k in "abcef":
        np.testing.assert_allclose(out[k], x, atol=1e-12)


def test_components_sum_to_the_signal(spark):
    x = np.random.default_rng(2).normal(size=30).cumsum()
    p = series(spark, x)
    f = T.reassemble(T.etm(p, steps=[10], transients=[(5, 3, "both")], periods=[7]))
    r = f.first()
    np.testing.assert_allclose(r["signal"], x, atol=1e-8)
    A = np.column_stack([np.ones(30), np.arange(30), np.arange(30) >= 10, np.log1p(np.maximum(0, (np.arange(30) - 5) / 3)), np.exp(-np.maximum(0, (np.arange(30) - 5) / 3)),
                         np.sin(2 * np.pi * np.arange(30) / 7), np.cos(2 * np.pi * np.arange(30) / 7)])
    c = np.linalg.lstsq(A, x, rcond=None)[0]
    np.testing.assert_allclose(r["coefficients"]["step_at_10"], c[2], rtol=1e-6)


def test_change_slope_of_a_two_piece_trend(spark):
    d = rows(spark, [0, 1, 2, 5, 5, 5]).select("series_id", "segment_id", F.lit("LandTrendr").alias("method"), F.create_map(F.lit("trend"), F.col("v")).alias("components"),
                                               F.create_map(F.lit("breakpoint"), F.lit(3.0), F.lit("slope_1"), F.lit(1.0), F.lit("intercept_1"), F.lit(0.0), F.lit("slope_2"), F.lit(0.0), F.lit("intercept_2"), F.lit(5.0)).alias("coefficients"))
    up = T.reassemble(CE.change_slope(d, 2.0)).first()["signal"]
    assert up == [0, 2, 4, 5, 5, 5]
    flat = T.reassemble(CE.change_slope(d, 0.0)).first()["signal"]
    assert flat == pytest.approx([3.0] * 6)


@pytest.mark.parametrize("rule,metric", [("other", "l2"), ("unlike", "l2"), ("any", "l1"), ("other", "dtw")])
def test_neighbours_match_brute_force(spark, rule, metric):
    rng = np.random.default_rng(5)
    n, d = 60, 8
    x, lab = rng.normal(size=(n, d)), rng.integers(0, 3, n)
    x[:20] = x[0] + rng.normal(size=(20, d)) * 1e-3  # a third of the rows are near copies
    df = spark.createDataFrame([(i, str(lab[i]), x[i].tolist()) for i in range(n)], "id long, label string, v array<double>")
    got = {(r["id"], r["rank"]): r["distance"] for r in D.nearest(df, df, 3, metric, rule, 2 if metric == "dtw" else None, pivots=5, block=7).collect()}
    for i in range(n):
        ok = [j for j in range(n) if (rule == "any") or (rule == "other" and j != i) or (rule == "unlike" and lab[j] != lab[i])]
        dist = (np.sqrt(((x[ok] - x[i]) ** 2).sum(1)) if metric == "l2" else np.abs(x[ok] - x[i]).sum(1) if metric == "l1"
                else N.dtw(np.repeat(x[i][None], len(ok), 0), x[ok], 2))
        np.testing.assert_allclose([got[i, k] for k in (1, 2, 3)], np.sort(dist)[:3], rtol=1e-9, atol=1e-12)


def test_dtw_by_recursion():
    a, b = np.random.default_rng(6).normal(size=(2, 9))
    c = np.full((10, 10), np.inf)
    c[0, 0] = 0
    for i in range(1, 10):
        for j in range(1, 10):
            if abs(i - j) <= 2:
                c[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(c[i - 1, j - 1], c[i - 1, j], c[i, j - 1])
    assert N.dtw(a[None], b[None], 2)[0] == pytest.approx(math.sqrt(c[9, 9]))
    u, l = N.envelopes(b[None], 2)
    assert N.lb_matrix(a[None], u, l)[0, 0] <= N.dtw(a[None], b[None], 2)[0] + 1e-12


def test_interval_splitting_matches_a_loop(spark):
    rng = np.random.default_rng(7)
    prof = rng.random(60).round(2)
    got = sorted((r["boundary"], r["score"]) for r in B.binary_segmentation(
        spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(prof)], "series_id long, t int, profile double"), 4, 6).collect())
    open_, cuts = [(0, 60)], []
    while len(cuts) < 4:
        best = None
        for a, b in open_:
            lo, hi = a + 6, b - 6
            if lo < hi:
                i = lo + int(np.argmax(prof[lo:hi]))
                if best is None or prof[i] > best[1]:
                    best = (i, prof[i], (a, b))
        if best is None or best[1] <= 0:
            break
        cuts.append((best[0], float(best[1])))
        open_.remove(best[2])
        open_ += [(best[2][0], best[0]), (best[0], best[2][1])]
    assert got == sorted(cuts)


def test_breaks_changes_and_pursuit(spark):
    rng = np.random.default_rng(8)
    level = np.where(np.arange(80) < 40, 0.0, 5.0) + rng.normal(size=80) * 0.1
    kink = np.interp(np.arange(80), [0, 30, 79], [0, 6, 1])
    p = series(spark, level, kink).drop("segment_id")
    s = {r["series_id"]: r["boundary"] for r in B.penalised_splits(p.where("series_id = 0"), 1, 5).collect()}
    assert s[0] == 40
    b = T.trend_breaks(p.where("series_id = 0"), max_depth=1).first()
    assert b["break_at"] == 40
    t = {r["series_id"]: r for r in T.trajectory(p, 4).collect()}
    assert 30.0 in t[1]["vx"] and t[1]["sse"] < 1e-9
    prob = B.change_probabilities(p.where("series_id = 0"), 50.0).toPandas().sort_values("t")["prob"].to_numpy()
    assert ((prob >= 0) & (prob <= 1)).all()
    tt = np.arange(120)
    y = 3 * np.log1p(np.maximum(0, (tt - 40) / 10.0))
    taus = [1.0, 3.0, 10.0, 30.0, 100.0]
    q = T.pursuit(series(spark, y).drop("segment_id"), 3, taus, 10).first()

    def basis(k, r, tau):
        pos = np.maximum(0, (tt - r) / tau)
        return (tt >= r) * 1.0 if k == "step" else np.log1p(pos) if k == "log" else np.exp(-pos)
    A = np.column_stack([np.ones(120), tt])
    r0 = y - A @ np.linalg.lstsq(A, y, rcond=None)[0]
    r, feats = r0.copy(), []
    for _ in range(3):
        jump = np.abs(np.diff(r))
        onsets = set(np.argsort(-np.append(jump, jump[-1]), kind="stable")[:10].tolist()) | {0, 119}
        atoms = [(k, t, u) for k in ("log", "exp", "step") for t in onsets for u in (taus if k != "step" else [1.0])
                 if not any(f[0] == k and abs(f[1] - t) <= 6 and (k == "step" or abs(u / f[2] - 1) <= 0.1) for f in feats)]
        best = max((a for a in atoms if basis(*a) @ basis(*a) > 1e-12), key=lambda a: abs(basis(*a) @ r) / np.linalg.norm(basis(*a)))
        b = basis(*best)
        r = r - (b @ r) / (b @ b) * b
        feats.append(best)
    D_ = np.stack([basis(*f) for f in feats], 1)
    x = np.linalg.lstsq(D_, r0, rcond=None)[0]
    assert [(f["type"], f["t_ref"], f["tau"]) for f in q["features"]] == [(k, float(t), u) for k, t, u in feats]
    np.testing.assert_allclose([f["amplitude"] for f in q["features"]], x, rtol=1e-6)
    assert q["explained"] == pytest.approx(1 - np.linalg.norm(r0 - D_ @ x) / np.linalg.norm(r0), rel=1e-6)


def test_stationarity_verdict(spark):
    rng = np.random.default_rng(9)
    noise, walk = rng.normal(size=(1, 200)), rng.normal(size=(1, 200)).cumsum(1)
    v = X.stationarity_verdict(series(spark, *noise).drop("segment_id"), series(spark, *walk).drop("segment_id")).first()
    assert v["verdict"] == "edit_introduced_nonstationarity"


def test_surrogates_keep_values(spark):
    x = np.random.default_rng(10).normal(size=32).cumsum()
    r = rows(spark, x).select(X.surrogate(F.col("v"), F.lit(5).cast("long")).alias("s"), X.surrogate(F.col("v"), F.lit(5).cast("long")).alias("u")).first()
    np.testing.assert_allclose(sorted(r["s"]), sorted(x))
    assert r["s"] == r["u"]


def test_batched_entropy_equals_the_column_form(spark):
    x = np.round(np.random.default_rng(14).normal(size=(20, 24)), 1)
    cols = [r["q"] for r in rows(spark, *x).select(X.ordinal_entropy(F.col("v")).alias("q")).collect()]
    np.testing.assert_allclose(sorted(cols), sorted(X.ordinal_entropies(x)), atol=1e-12)


def test_surrogate_test_tells_order_from_noise(spark):
    noise = np.random.default_rng(15).normal(size=64)
    d = spark.createDataFrame([(1, 0, noise.tolist(), np.sort(noise).tolist()), (2, 0, noise.tolist(), noise.tolist())],
                              "series_id int, segment_id int, v array<double>, edited array<double>")
    p = {r["series_id"]: r["p_value"] for r in X.surrogate_test(d, 39).collect()}
    assert p[1] == pytest.approx(1 / 40) and p[2] > 0.05


def test_bootstrap_interval_covers_the_mean(spark):
    rng = np.random.default_rng(11)
    p = series(spark, *rng.normal(size=(50, 40))).drop("segment_id")
    c = X.bootstrap_ci(X.stationary_bootstrap(p, 2.0, 100), F.avg("value"))
    assert c.where("ci_lower <= 0 and ci_upper >= 0").count() / 50 >= 0.85


def test_bootstrap_blocks_are_geometric(spark):
    p = spark.range(4000).selectExpr("1 AS series_id", "CAST(id AS int) AS t", "CAST(id AS double) AS value")
    v = X.stationary_bootstrap(p, 5.0, 6).orderBy("rep", "t").toPandas()
    lengths = []
    for _, r in v.groupby("rep"):
        x = r.value.to_numpy()
        cuts = np.flatnonzero((np.diff(x) != 1) & (np.diff(x) != -3999)) + 1
        lengths += np.diff(np.concatenate([[0], cuts])).tolist()
    share = lambda k: np.mean(np.array(lengths) == k)
    for k in range(1, 8):
        assert abs(share(k) - 0.2 * 0.8 ** (k - 1)) < 0.02
    assert abs(np.mean(lengths) - 5) < 0.3


def test_bootstrap_interval_covers_the_mean_of_dependent_series(spark):
    rng = np.random.default_rng(12)
    e = rng.normal(size=(60, 400))
    x = np.zeros_like(e)
    for t in range(1, 400):
        x[:, t] = 0.5 * x[:, t - 1] + e[:, t]
    c = X.bootstrap_ci(X.stationary_bootstrap(series(spark, *x).drop("segment_id"), 20.0, 100), F.avg("value"))
    assert c.where("ci_lower <= 0 and ci_upper >= 0").count() / 60 >= 0.85


def test_block_permutation_uses_every_value_once(spark):
    rng = np.random.default_rng(13)
    rows_of = lambda a: spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(a)], "edit_id int, i int, value double")
    same, far = rng.normal(size=60), rng.normal(size=60)
    assert X.donor_shift(rows_of(same[:20]), rows_of(same[20:]), 39).first()["p_value"] > 0.05
    assert X.donor_shift(rows_of(far[:20] + 6), rows_of(far[20:]), 39).first()["p_value"] <= 0.05


def test_f_tail():
    from seriesforge.operators.metrics import _betainc
    # F(2, d) has the closed tail (1 + 2 f / d) ** (-d / 2).
    f, d = 3.0, 20.0
    x = 2 * f / (2 * f + d)
    assert 1 - _betainc(x, 1.0, d / 2) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-9)


def smooth_loop(segs, limits, default=2):
    size = lambda s: s[1] - s[0] + 1
    segs = [list(s) for s in segs]
    changed = True
    while changed and len(segs) > 1:
        changed = False
        for i, s in enumerate(segs):
            if size(s) >= limits.get(s[2], default):
                continue
            def fit(nb):
                return (0.5 if nb[2] == s[2] else 0.0) + nb[3] * 0.05 + min(size(nb), 10) * 0.001
            if i == 0:
                k = 1
            elif i == len(segs) - 1:
                k = i - 1
            else:
                k = i - 1 if fit(segs[i - 1]) >= fit(segs[i + 1]) else i + 1
            nb = segs[k]
            n, m = size(nb), size(s)
            new = [min(nb[0], s[0]), max(nb[1], s[1]), nb[2], round((nb[3] * n + s[3] * m) / (n + m), 6)]
            segs = sorted([x for j, x in enumerate(segs) if j not in (i, k)] + [new])
            changed = True
            break
    return [tuple(s) for s in segs]


def test_duration_smoothing_matches_the_loop(spark):
    rng = np.random.default_rng(12)
    limits = {"a": 3, "b": 5, "c": 1}
    for _ in range(4):
        edges = np.concatenate([[0], np.cumsum(rng.integers(1, 8, 25))])
        s = [(int(a), int(b - 1), "abc"[rng.integers(3)], round(float(rng.random()), 3)) for a, b in zip(edges, edges[1:])]
        df = spark.createDataFrame([(1, *x, None) for x in s], "series_id long, start_index int, end_index int, label string, confidence double, label_scores map<string,double>")
        got = [(r["start_index"], r["end_index"], r["label"], r["confidence"]) for r in L.smooth_durations(df, limits).orderBy("start_index").collect()]
        assert got == smooth_loop(s, limits)


def test_shape_classifier_accuracy(spark):
    rng = np.random.default_rng(13)
    out = []
    for k in range(30):
        n = 60
        t = np.arange(n)
        z = rng.normal(size=n)
        pre, post = rng.normal(size=10) * 0.01, rng.normal(size=10) * 0.01
        out += [("plateau", 1 + z * 0.01, 1 + pre, 1 + post), ("trend", t * 0.1 + z * 0.05, pre, 6 + post),
                ("step", np.where(t < 30, 0.0, 2.0) + z * 0.03, pre, 2 + post), ("cycle", np.sin(2 * np.pi * t / 12 + k) + z * 0.05, pre, post)]
        spike = rng.normal(size=12) * 0.05
        spike[6] += 5
        out.append(("spike", spike, pre, post))
    df = spark.createDataFrame([(i, 0, a, [float(x) for x in v], [float(x) for x in p], [float(x) for x in q]) for i, (a, v, p, q) in enumerate(out)],
                               "series_id long, segment_id int, truth string, v array<double>, pre array<double>, post array<double>")
    r = H.classify(df)
    assert r.where("shape = truth").count() / len(out) >= 0.85


def test_resample_and_softmax(spark):
    r = rows(spark, [0, 1, 4]).select(V.resample(F.col("v"), 5).alias("a"), V.softmax(F.col("v")).alias("b")).first()
    np.testing.assert_allclose(r["a"], np.interp(np.linspace(0, 2, 5), range(3), [0, 1, 4]))
    np.testing.assert_allclose(sum(r["b"]), 1.0)


def test_log_determinant_of_repeated_vectors_stays_exact():
    rng = np.random.default_rng(4)
    few = rng.normal(size=(6, 3))
    vectors = [few[i % 6] + 1e-9 * rng.normal(size=3) for i in range(240)]
    for reg in (1e-6, 1e-13):
        state = LogDet(reg)
        got = [state.add(v) for v in vectors]
        x = np.array(vectors)
        kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * state.bw ** 2)) + reg * np.eye(len(x))
        want = np.linalg.slogdet(kernel)[1]
        assert got[0] is None and np.isfinite(got[1:]).all() and np.isfinite(state.root).all()
        assert got[-1] == pytest.approx(want, rel=1e-6 if reg > 1e-9 else 0.05)


def test_trailing_rate_counts_events_of_equal_time_together(spark):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-05 00:00:00", "2024-01-08 00:00:00", "2024-01-08 00:00:00", "2024-01-08 00:00:01"]
    ok = [True, False, True, False, False, True]
    r = spark.createDataFrame([("s", a, v) for a, v in zip(at, ok)], "session_id string, ts string, is_valid boolean").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((str(x.ts), x.n_window, round(x.rate, 6)) for x in J.trailing_rate(r).collect())
    assert got == [(at[0], 2, 0.5), (at[1], 2, 0.5), (at[2], 3, 0.666667), (at[3], 5, 0.4), (at[4], 5, 0.4), (at[5], 4, 0.5)]


def test_leading_share_takes_the_smaller_matrix(spark):
    import numpy as np
    from seriesforge.operators import packs
    rng = np.random.default_rng(4)
    rows = [(0, s, t, float(rng.normal())) for s in range(60) for t in range(3 + s % 3)] + [(1, s, t, float(rng.normal())) for s in range(3) for t in range(40)] + [(2, 7, t, float(t)) for t in range(5)]
    df = spark.createDataFrame(rows, "network int, station int, t int, value double")
    got = {r["network"]: r["leading_share"] for r in packs.leading_share(df).collect()}
    for n, stations, times in ((0, 60, 5), (1, 3, 40)):
        x = np.full((stations, times), np.nan)
        for w, s, t, v in rows:
            if w == n:
                x[s, t] = v
        x = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))
        e = np.linalg.eigvalsh(x @ x.T)
        assert abs(got[n] - e[-1] / e.sum()) < 1e-9
    assert got[2] == 0.0
    sums = packs.product_sums(df, packs.network_sizes(df))
    assert {r["network"]: r["count"] for r in sums.groupBy("network").count().collect()} == {0: 15, 1: 6, 2: 1}


def test_bootstrap_broadcasts_no_repeated_rows(spark):
    import re
    rng = np.random.default_rng(4)
    p = series(spark, *rng.normal(size=(40, 30))).select("series_id", "t", "value")
    for df in (X.stationary_bootstrap(p, 5.0, 20), X.bootstrap_moments(p, 5.0, 20)):
        q = df._jdf.queryExecution()
        assert q.toRdd().count() == (40 * 30 * 20 if "t" in df.columns else 40 * 20)
        final = q.executedPlan().toString().split("== Initial Plan ==")[0]
        assert not re.search(r"Broadcast(HashJoin|NestedLoopJoin) \[[^\]]*(_src|\bt|\bu)#", final)
