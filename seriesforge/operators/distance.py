"""Nearest-neighbour joins, exact and without pair tables.

Vectors are (id, label, v).  Base rows are cut into blocks and query rows into
chunks of bounded size; a (block, chunk) pair is one task that emits only its k
best rows per query, and a second step keeps the k best overall.  Metric
distances route each query to the blocks its bound reaches (``metric_join``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import kernels as N
from ..functions import vectors as V
from .metric_join import BLOCK, metric_join

MASKED = 1 << 24                # pairs of rows whose mask is held at once


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", rule: str = "other",
            radius: int | None = None, pivots: int | None = None, block: int = BLOCK, band: float | None = None) -> DataFrame:
    """k nearest base rows of each query row: id, nn_id, nn_label, distance, rank.

    ``rule``: 'other' skips the row itself, 'unlike' takes other labels only,
    'target' takes base rows whose label equals the query's ``target``, 'any'
    takes all.  Metrics 'l2' and 'l1' go through ``metric_join``; 'lb_keogh' and
    'dtw' scan all blocks and compare rows of one length, ``band`` being the
    radius as a share of it.
    """
    if metric in ("l2", "l1"):
        return top_per_id(metric_join(queries, base, k, metric, rule, pivots, block), k)
    q = queries.select("id", "label", *(["target"] if rule == "target" else []), "v")
    # Fresh attributes: query and base rows often come from one table.
    b = base.select(*[F.col(c).alias(c) for c in ("id", "label", "v")])
    n = b.agg(F.count(F.lit(1))).first()[0]
    block = rows_together(n, block, metric)
    m = q.agg(F.count(F.lit(1))).first()[0]
    nb, nq = max(1, math.ceil(n / block)), max(1, math.ceil(m / block))
    h = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    b = b.withColumn("slot", h(nb)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = q.withColumn("chunk", h(nq)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def pair(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for n, own in qs.groupby(qs["v"].map(len)):
            same = bs[bs["v"].map(len) == n]
            if not len(same):
                continue
            qv, bv = np.stack(own["v"].to_numpy()), np.stack(same["v"].to_numpy())
            bid, bl = same["id"].to_numpy(), same["label"].to_numpy()
            qid, ql = own["id"].to_numpy(), own["label"].to_numpy()
            tgt = own["target"].to_numpy() if "target" in own else None
            r = radius if band is None else max(1, round(band * n))
            step = max(1, MASKED // len(bid))           # the mask of a whole block of queries would be its square
            for s in range(0, len(qid), step):
                one = slice(s, s + step)
                no = {"other": lambda: qid[one, None] == bid[None], "unlike": lambda: ~(bl[None] != ql[one, None]).astype(bool), "any": lambda: None,
                      "target": lambda: ~(bl[None] == tgt[one, None]).astype(bool)}[rule]()
                i, j, d = N.near_dtw(qv[one], bv, k, no, r) if metric == "dtw" else N.near_keogh(qv[one], bv, k, no, r or 1)
                out = pd.DataFrame({"_i": i, "id": qid[one][i], "nn_id": bid[j], "nn_label": bl[j], "distance": d}).sort_values(["_i", "distance", "nn_id"])
                parts.append(out[out.groupby("_i").cumcount() < k].drop(columns="_i"))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("id", "nn_id", "nn_label", "distance")}, dtype=object)

    keys = ["slot", "chunk"]
    tq, tb = dict(queries.dtypes), dict(base.dtypes)
    # as many tasks as pairs of blocks: the rows are few for the work, and would be put together into a few tasks
    q, b = (x.repartition(min(nb * nq, 1024), *keys) for x in (q, b))
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(
        pair, f"id {tq['id']}, nn_id {tb['id']}, nn_label {tb['label']}, distance double")
    return top_per_id(found, k)


def rows_together(n: int, block: int, metric: str) -> int:
    """Rows of one side that meet in one task.  Each row is copied once per block of the other side, and each block answers
    with its own k best, so the cheap Keogh bound takes blocks that grow with the rows as far as a task can hold them."""
    if metric == "dtw":
        return min(2 * block, max(128, math.ceil(n / 16)))
    return max(2 * block, min(16 * block, math.ceil(n / 8)))


def top_per_id(found: DataFrame, k: int) -> DataFrame:
    """k best rows per id; candidates are first cut inside salted parts, so one id never floods a task."""
    order = [F.col("distance"), F.col("nn_id")]
    part = F.pmod(F.xxhash64("nn_id"), F.lit(32))
    pre = (found.withColumn("_p", part)
           .withColumn("_r", F.row_number().over(W.partitionBy("id", "_p").orderBy(*order))).where(F.col("_r") <= k))
    return (pre.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(*order)))
            .where(F.col("rank") <= k).drop("_p", "_r"))


def unlike_neighbour(vectors: DataFrame, metric: str = "l2", radius: int | None = None) -> DataFrame:
    """Least distance of each vector to one of another label."""
    return nearest(vectors, vectors, 1, metric, "unlike", radius).select("id", "distance")


def ynn(queries: DataFrame, base: DataFrame, k: int = 5, rule: str = "other") -> DataFrame:
    """Share of the k nearest base rows carrying the query's target class (L2)."""
    nn = nearest(queries.drop("target"), base, k, "l2", rule)
    j = nn.join(queries.select("id", "target"), "id")
    return j.groupBy("id").agg(F.avg((F.col("nn_label") == F.col("target")).cast("double")).alias("ynn"),
                               F.count(F.lit(1)).alias("n_neighbours"))


def ynn_dtw(queries: DataFrame, base: DataFrame, k: int = 5, band: float = 0.1, multiplier: int = 4,
            rule: str = "other") -> DataFrame:
    """Keogh-bound shortlist of multiplier * k rows, exact banded DTW on the shortlist, class share of the k best; the band
    is a share of each query's own length."""
    short = nearest(queries.drop("target"), base, multiplier * k, "lb_keogh", rule, band=band).select("id", "nn_id", "nn_label")
    pairs = (short.join(queries.select("id", "target", F.col("v").alias("a")), "id")
             .join(base.select(F.col("id").alias("nn_id"), F.col("v").alias("b")), "nn_id"))
    d = pairs.select("id", "nn_id", "nn_label", "target", dtw_distance("a", "b", band=band).alias("distance"))
    best = top_per_id(d, k)
    return best.groupBy("id").agg(F.avg((F.col("nn_label") == F.col("target")).cast("double")).alias("ynn"),
                                  F.count(F.lit(1)).alias("n_neighbours"))


def dtw_distance(a: str, b: str, radius: int | None = None, band: float | None = None) -> Column:
    """Banded DTW of two array columns, vectorised over each Arrow batch; ``band`` is a radius as a share of the length of
    ``a``."""
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        shape = pd.Series(list(zip(x.map(len), y.map(len))))
        for (n, _), idx in shape.groupby(shape).groups.items():
            i = np.asarray(idx)
            out[i] = N.dtw(np.stack(x.iloc[i].to_numpy()), np.stack(y.iloc[i].to_numpy()), radius if band is None else max(1, round(band * n)))
        return pd.Series(out)
    return F.pandas_udf(run, "double")(F.col(a), F.col(b))


def donors(targets: DataFrame, library: DataFrame) -> DataFrame:
    """Least-DTW library row of each target's class; equal-length series."""
    nn = nearest(targets, library, 1, "dtw", "target")
    return nn.join(library.select(F.col("id").alias("nn_id"), F.col("v").alias("donor")), "nn_id").select(
        "id", F.col("nn_id").alias("donor_id"), "distance", "donor")


def class_shapelets(library: DataFrame, length: int | None = None, sample: int = 200) -> DataFrame:
    """Medoid of z-normalised sliding subsequences per class, over a hash sample of ``sample`` of them."""
    m = F.lit(length) if length else F.greatest(F.lit(4), F.floor(F.size("v") / 4).cast("int"))
    subs = library.withColumn("pos", F.explode(F.sequence(F.lit(1), F.size("v") - m + 1))).select(
        "label", "id", "pos", V.znorm(F.slice("v", F.col("pos"), m)).alias("s"))
    h = F.xxhash64("id", "pos")
    pre = subs.withColumn("_p", F.pmod(h, F.lit(64)))
    pre = pre.withColumn("_r", F.row_number().over(W.partitionBy("label", "_p").orderBy(h, "id", "pos"))).where(F.col("_r") <= sample)
    top = pre.withColumn("_r", F.row_number().over(W.partitionBy("label").orderBy(h, "id", "pos"))).where(F.col("_r") <= sample)

    def medoid(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["s"].to_numpy())
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).sum(1)
        i = int(np.lexsort((pdf["pos"], pdf["id"], d.round(9)))[0])
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "shapelet": [x[i].tolist()], "total_distance": [d[i]]})
    return top.groupBy("label").applyInPandas(medoid, "label string, shapelet array<double>, total_distance double")


def discords(points: DataFrame, m: int, block: int = BLOCK) -> DataFrame:
    """Subsequence of each series with the largest distance to its nearest non-trivial match.

    z-normalised windows are compared block against block within a series; a
    pair of blocks is one bounded task.
    """
    from .layout import framed
    w = framed(points.select("series_id", "t", "value"), 0, m - 1, {"_w": lambda w: F.collect_list("value").over(w(0, m - 1))})
    subs = w.where(F.size("_w") == m).select("series_id", "t", V.znorm(F.col("_w")).alias("v"))
    size = points.groupBy("series_id").agg(F.floor(F.max("t") / block).cast("int").alias("_last"))
    rows = subs.join(size, "series_id").withColumn("own", F.floor(F.col("t") / block).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_last")))
    left = rows.select("series_id", "t", "v", F.col("own").alias("a"), every.alias("b"))
    right = rows.select(*[F.col(c).alias(c) for c in ("series_id", "t", "v")], F.col("own").alias("b"), every.alias("a"))
    zone = math.ceil(m / 4)

    def pair(ls, rs):
        if not len(ls) or not len(rs):
            return pd.DataFrame({"series_id": [], "t": [], "distance": []})
        lv, rv = np.stack(ls["v"].to_numpy()), np.stack(rs["v"].to_numpy())
        lt, rt = ls["t"].to_numpy(), rs["t"].to_numpy()
        best = np.full(len(lt), np.inf)
        for i in range(len(lt)):
            far = np.abs(rt - lt[i]) > zone
            if far.any():
                best[i] = np.sqrt(((rv[far] - lv[i]) ** 2).sum(1).min())
        return pd.DataFrame({"series_id": ls["series_id"].to_numpy(), "t": lt, "distance": best})

    sid = dict(points.dtypes)["series_id"]
    keys = ["series_id", "a", "b"]
    near = (left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, f"series_id {sid}, t int, distance double")
            .groupBy("series_id", "t").agg(F.min("distance").alias("distance")).where(F.col("distance") < float("inf")))
    # Two windows may be each other's nearest match; the earlier one is the discord.
    return near.groupBy("series_id").agg(F.max(F.struct(F.round("distance", 9).alias("distance"), (-F.col("t")).alias("n"))).alias("m")).select(
        "series_id", (-F.col("m.n")).cast("int").alias("t"), F.col("m.distance").alias("distance"))


def local_outlier_factor(queries: DataFrame, train: DataFrame, k: int = 20) -> DataFrame:
    """LOF of query vectors against a training set: k-distance, reachability density, density ratio."""
    tt = nearest(train, train, k, "l2", "other")
    kd = tt.groupBy("id").agg(F.max("distance").alias("kdist"))

    def density(nn):
        j = nn.join(kd.select(F.col("id").alias("nn_id"), "kdist"), "nn_id")
        return j.groupBy("id").agg((1.0 / (F.avg(F.greatest("distance", "kdist")) + 1e-10)).alias("lrd"))
    lrd_t = density(tt)
    qt = nearest(queries, train, k, "l2", "any")
    lrd_q = density(qt)
    j = qt.join(lrd_t.select(F.col("id").alias("nn_id"), F.col("lrd").alias("lrd_n")), "nn_id").join(lrd_q, "id")
    return j.groupBy("id").agg((F.avg("lrd_n") / F.max("lrd")).alias("lof"))
