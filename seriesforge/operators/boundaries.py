"""Boundary selection and change-point search."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..streaming.kernels import RunLengths
from .layout import CHUNK, boundaries_to_segments, cut_lineage, framed, index_series, running_sums, with_halo
from .scan import Recursion, run_ordered
from . import windows as X


def spaced_top_k(cands: DataFrame, k: int, spacing: int, score: str = "score", pos: str = "pos",
                 key: str = "series_id") -> DataFrame:
    """Greedy choice by score of at most k positions at least ``spacing`` apart.

    A chosen position has fewer than k * (2 * spacing - 1) + k better rivals, so
    keeping that many best per chunk and then per series is exact and bounds the
    list one series hands to the final fold.  A k that grows with the series bounds
    nothing: then ``spaced`` chooses by chunks and the k best are taken by rank.
    """
    need = k * (2 * spacing - 1) + k
    if need > CHUNK:
        kept = index_series(spaced(cands, spacing, score, pos, key).withColumn("_neg", -F.col(score)), key, ["_neg", pos], F.floor(F.col("_neg") * CHUNK), "_r")
        return kept.where(F.col("_r") < k).select(key, pos, score)
    best = [F.col(score).desc(), F.col(pos)]
    c = cands.withColumn("_c", F.floor(F.col(pos) / CHUNK))
    c = c.withColumn("_r", F.row_number().over(W.partitionBy(key, "_c").orderBy(*best))).where(F.col("_r") <= need)
    c = c.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*best))).where(F.col("_r") <= need)
    item = F.struct((-F.col(score)).alias("neg"), F.col(pos).cast("int").alias("p"))
    g = c.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    empty = F.array().cast("array<struct<neg:double,p:int>>")
    chosen = F.aggregate("_l", empty, lambda acc, x: F.when(
        (F.size(acc) < k) & ~F.exists(acc, lambda y: F.abs(y["p"] - x["p"]) < spacing),
        F.concat(acc, F.array(x))).otherwise(acc))
    return g.select(key, F.explode(chosen).alias("_e")).select(
        key, F.col("_e.p").alias(pos), (-F.col("_e.neg")).alias(score))


def spaced(cands: DataFrame, spacing: int, score: str = "score", pos: str = "pos", key: str = "series_id", size: int = CHUNK) -> DataFrame:
    """All positions that the greedy choice by score keeps, at least ``spacing`` apart, without a fold over the series.

    A choice hangs on better rivals within ``spacing`` alone, so a chunk with a halo settles nearly all of its positions;
    one that a rival outside the halo might decide stays open.  Taken and open positions run again in chunks twice as wide
    until none is open; only a chain of falling scores or ties through many chunks takes more than a few rounds.
    """
    kind = dict(cands.dtypes)[key]
    rows = cands.select(key, F.col(pos).cast("int").alias(pos), F.col(score).cast("double").alias(score), F.lit(False).alias("_taken"))
    size = max(size, 16 * spacing)
    while True:
        halo = size // 4

        def settle(pdf):
            import numpy as np
            pdf = pdf.sort_values(pos)
            p, c = pdf[pos].to_numpy(np.int64), int(pdf["chunk"].iloc[0])
            lo, hi = np.searchsorted(p, p - spacing, "right").tolist(), np.searchsorted(p, p + spacing, "left").tolist()
            begin, end = c * size - halo, (c + 1) * size + halo
            blind = ((begin > 0) & (p - spacing < begin - 1)) | (p + spacing > end)
            state = bytearray(len(p))                           # 1 taken, 2 gone, 3 open
            taken = pdf["_taken"].to_numpy(bool)
            for i in np.flatnonzero(taken).tolist():
                state[lo[i]:hi[i]] = b"\x02" * (hi[i] - lo[i])
                state[i] = 1
            for i in np.lexsort((p, -pdf[score].to_numpy())).tolist():
                if state[i]:
                    continue
                if blind[i] or state.find(3, lo[i], hi[i]) >= 0:
                    state[i] = 3
                else:
                    state[lo[i]:hi[i]] = b"\x02" * (hi[i] - lo[i])
                    state[i] = 1
            s = np.frombuffer(state, np.uint8)
            keep = pdf["home"].to_numpy(bool) & (s != 2)
            return pdf[keep].assign(_taken=s[keep] == 1)[[key, pos, score, "_taken"]]

        rows = cut_lineage(with_halo(rows, halo, halo, size, pos).groupBy(key, "chunk").applyInPandas(settle, f"{key} {kind}, {pos} int, {score} double, _taken boolean"))
        if rows.where("not _taken").isEmpty():
            return rows.drop("_taken")
        size *= 2


def candidate_boundaries(scores: DataFrame, threshold: float = 0.35, min_length: int = 5,
                         max_boundaries: int = 8) -> DataFrame:
    """Local maxima of the boundary score, best first, spaced, capped by the caller's limit."""
    p = framed(scores, 1, 1, {"_p": lambda w: F.lag("score").over(w()), "_n": lambda w: F.lead("score").over(w())})
    s = F.col("score")
    peaks = p.where((s >= threshold) & (s >= F.col("_p")) & (s >= F.col("_n")))
    picked = spaced_top_k(peaks.select("series_id", (F.col("t") + 1).alias("pos"), "score"), max_boundaries, min_length)
    return picked.select("series_id", F.col("pos").alias("boundary"), "score")


def propose(points: DataFrame, window: int = 6, min_length: int = 5, threshold: float = 0.35,
            max_boundaries: int = 8):
    """(scores, boundaries, segments) of the window-score proposer."""
    scores = X.boundary_scores(points, window, min_length)
    bounds = candidate_boundaries(scores, threshold, min_length, max_boundaries)
    lens = points.groupBy("series_id").agg((F.max("t") + 1).cast("int").alias("series_length"))
    return scores, bounds, boundaries_to_segments(bounds, lens)


def strongest(cands: DataFrame, k: int, score: str = "score", pos: str = "boundary") -> DataFrame:
    """The k strongest change points of each series, pre-cut per chunk."""
    order = [F.col(score).desc(), F.col(pos)]
    c = cands.withColumn("_c", F.floor(F.col(pos) / CHUNK))
    c = c.withColumn("_r", F.row_number().over(W.partitionBy("series_id", "_c").orderBy(*order))).where(F.col("_r") <= k)
    c = c.withColumn("_r", F.row_number().over(W.partitionBy("series_id").orderBy(*order))).where(F.col("_r") <= k)
    return c.drop("_c", "_r")


def onset_candidates(residual: DataFrame, top_k: int, min_spacing: int) -> DataFrame:
    """Positions of the largest jumps, spaced, plus both ends of the series; the last point repeats the last jump."""
    p = framed(residual, 1, 1, {"_n": lambda w: F.abs(F.lead("value").over(w()) - F.col("value")),
                                "_p": lambda w: F.abs(F.col("value") - F.lag("value").over(w()))})
    jumps = p.select("series_id", F.col("t").alias("pos"), F.coalesce("_n", "_p", F.lit(0.0)).alias("score"))
    picked = spaced_top_k(jumps, top_k, max(1, min_spacing)).select("series_id", F.col("pos").alias("t_ref"))
    ends = residual.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    both = ends.select("series_id", F.explode(F.array(F.col("a").cast("int"), F.col("b").cast("int"))).alias("t_ref"))
    return picked.unionByName(both).distinct()


def binary_segmentation(profile: DataFrame, max_cps: int, min_length: int, value: str = "profile") -> DataFrame:
    """Repeatedly take the best point inside the open intervals of each series.

    Each round is one pre-aggregated pass over (series, interval); the cut list
    of a series holds at most max_cps entries and rides along as an array.
    """
    profile = cut_lineage(profile.select("series_id", "t", value))
    n = profile.groupBy("series_id").agg((F.max("t") + 1).cast("int").alias("_n"))
    # An interval is (order of creation, start, end); ties between intervals go to the earlier one.
    state = n.select("series_id", F.array(F.struct(F.lit(0).alias("o"), F.lit(0).alias("a"), F.col("_n").alias("b"))).alias("open"),
                     F.array().cast("array<struct<p:int,s:double>>").alias("cuts"), F.lit(False).alias("done"))
    state = cut_lineage(state)
    for i in range(max_cps):
        live = profile.join(state.where("not done").select("series_id", "open"), "series_id")
        hit = F.filter("open", lambda x: (F.col("t") >= x["a"] + min_length) & (F.col("t") < x["b"] - min_length))
        best = (live.withColumn("_i", F.get(hit, F.lit(0))).where("_i is not null").groupBy("series_id").agg(
            F.max(F.struct(F.col(value).alias("s"), (-F.col("_i.o")).alias("o"), (-F.col("t")).alias("t"),
                           F.col("_i.a").alias("a"), F.col("_i.b").alias("b"))).alias("_b")))
        j = state.join(best, "series_id", "left")
        go = ~F.col("done") & F.col("_b").isNotNull() & (F.col("_b.s") > 0)
        p = (-F.col("_b.t")).cast("int")
        rest = F.filter("open", lambda x: x["a"] != F.col("_b.a"))
        grown = F.concat(rest, F.array(
            F.struct(F.lit(2 * i + 1).alias("o"), F.col("_b.a").alias("a"), p.alias("b")),
            F.struct(F.lit(2 * i + 2).alias("o"), p.alias("a"), F.col("_b.b").alias("b"))))
        state = cut_lineage(j.select(
            "series_id", F.when(go, grown).otherwise(F.col("open")).alias("open"),
            F.when(go, F.concat("cuts", F.array(F.struct(p.alias("p"), F.col("_b.s").cast("double").alias("s"))))).otherwise(
                F.col("cuts")).alias("cuts"), (~go).alias("done")))
    return state.select("series_id", F.explode("cuts").alias("_e")).select(
        "series_id", F.col("_e.p").alias("boundary"), F.col("_e.s").alias("score"))


def penalised_splits(points: DataFrame, max_cps: int = 8, min_length: int = 10, penalty: float = 1.0) -> DataFrame:
    """Binary splitting on squared-error gain; a split is kept while its gain beats penalty * variance * ln n.

    Prefix sums give the gain of every split of every open interval in one
    pre-aggregated pass per round.
    """
    pre = running_sums(points.select("series_id", "t", "value"), {"s1": F.col("value"), "s2": F.col("value") * F.col("value")})
    pre = cut_lineage(pre.select("series_id", "t", "s1"))
    ends = points.groupBy("series_id").agg((F.max("t") + 1).cast("int").alias("n"), F.sum("value").alias("s"),
                                           F.var_pop("value").alias("v"))
    iv = lambda a, sa, b, sb: F.struct(a.cast("int").alias("a"), sa.alias("sa"), b.cast("int").alias("b"), sb.alias("sb"))
    state = cut_lineage(ends.select(
        "series_id", (penalty * F.col("v") * F.ln("n")).alias("pen"),
        F.array(iv(F.lit(0), F.lit(0.0), F.col("n"), F.col("s"))).alias("open"),
        F.array().cast("array<struct<p:int,s:double>>").alias("cuts"), F.lit(False).alias("done")))
    for _ in range(max_cps):
        live = pre.join(state.where("not done").select("series_id", "open"), "series_id")
        b = F.col("t") + 1
        hit = F.get(F.filter("open", lambda x: (b >= x["a"] + min_length) & (b <= x["b"] - min_length)), F.lit(0))
        live = live.withColumn("_i", hit).where("_i is not null")
        na, nb = b - F.col("_i.a"), F.col("_i.b") - b
        diff = (F.col("s1") - F.col("_i.sa")) / na - (F.col("_i.sb") - F.col("s1")) / nb
        gain = na * nb / (na + nb) * diff * diff
        best = live.groupBy("series_id").agg(F.max(F.struct(gain.alias("g"), (-b).alias("nb"), F.col("s1"), F.col("_i"))).alias("_b"))
        j = state.join(best, "series_id", "left")
        go = ~F.col("done") & F.col("_b").isNotNull() & (F.col("_b.g") > F.col("pen"))
        p, old = -F.col("_b.nb"), F.col("_b._i")
        grown = F.concat(F.filter("open", lambda x: x["a"] != F.col("_b._i.a")), F.array(
            iv(old["a"], old["sa"], p, F.col("_b.s1")), iv(p, F.col("_b.s1"), old["b"], old["sb"])))
        state = cut_lineage(j.select(
            "series_id", "pen", F.when(go, grown).otherwise(F.col("open")).alias("open"),
            F.when(go, F.concat("cuts", F.array(F.struct(p.cast("int").alias("p"), F.col("_b.g").alias("s"))))).otherwise(
                F.col("cuts")).alias("cuts"), (~go).alias("done")))
    return state.select("series_id", F.explode("cuts").alias("_e")).select(
        "series_id", F.col("_e.p").alias("boundary"), F.col("_e.s").alias("gain"))


def cross_match_profile(points: DataFrame, window: int, k: int = 3) -> DataFrame:
    """Share of sampled windows whose nearest window lies on the other side of t.

    At each t at most k evenly spaced windows on either side are compared; the
    kernel runs per (series, chunk) with the halo those windows need.
    """
    reach = (2 * k + 1) * window
    n = points.groupBy("series_id").agg((F.max("t") + 1).cast("int").alias("_n"))
    rows = with_halo(points.select("series_id", "t", "value"), reach, reach + window).join(n, "series_id")

    def kernel(pdf):
        import numpy as np
        import pandas as pd
        pdf = pdf.sort_values("t")
        first, last = int(pdf["t"].iloc[0]), int(pdf["_n"].iloc[0]) - window
        home = pdf.loc[pdf["home"], "t"].to_numpy()
        share = np.zeros(len(home))
        inner = (home >= window) & (home <= last)
        t = home[inner].astype(np.int64)
        if len(t):
            # starts of the sampled windows: one column per sample, left of t and then from t on
            begin = np.stack([np.maximum(t - (2 * k + 1) * window, 0), t], axis=1)
            spare = np.stack([t - window, np.minimum(t + 2 * k * window, last)], axis=1) - begin
            taken = np.minimum(spare + 1, k)
            step = spare / np.maximum(taken - 1, 1)
            no = np.arange(k)
            starts = (begin[:, :, None] + np.rint(no * step[:, :, None]).astype(np.int64)).reshape(len(t), 2 * k)
            real = (no < taken[:, :, None]).reshape(len(t), 2 * k)
            side = np.repeat([False, True], k)
            windows = np.lib.stride_tricks.sliding_window_view(pdf["value"].to_numpy(), window)
            pool = windows[np.where(real, starts, begin[:, :1]) - first]
            for i in range(2 * k):      # nearest other sample of sample i, for all t at once
                apart = ((pool - pool[:, i:i + 1]) ** 2).sum(axis=2)
                apart[~real] = np.inf
                apart[:, i] = np.inf
                share[inner] += real[:, i] & (side[apart.argmin(axis=1)] != side[i])
            share[inner] /= real.sum(axis=1)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "t": home.astype("int32"), "profile": share})

    sid = dict(points.dtypes)["series_id"]
    return rows.groupBy("series_id", "chunk").applyInPandas(kernel, f"series_id {sid}, t int, profile double")


def change_probabilities(points: DataFrame, mean_run_length: float = 50.0, chunk: int = CHUNK) -> DataFrame:
    """Bayesian online change probability (constant hazard, normal-inverse-gamma).

    At most five mean run lengths are open at a time, each with the moments of the points it covers, so what lies further
    back only reaches a state through the weights and fades; a long series runs by chunks (see ``scan``), entry weights
    equal to nine decimals.
    """
    hazard = 1.0 / mean_run_length
    fresh = lambda row: RunLengths(hazard)
    mark = lambda s: json.dumps([[round(x, 9) + 0.0 for x in part] for part in s.dump()])
    lengths = Recursion("prob double", fresh, lambda row: [RunLengths(hazard)], lambda s, row: [(s.step(row.value),)], lambda s: json.dumps(s.dump()),
                        lambda text: RunLengths(hazard).load(json.loads(text)), mark)
    halo = math.ceil(20 * mean_run_length)
    return run_ordered(points.select("series_id", "t", "value"), ["series_id"], lengths, chunk=max(chunk, halo), halo=halo)
