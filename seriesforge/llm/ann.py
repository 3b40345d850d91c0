"""Nearest neighbours by inner product over balanced posting lists.

Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows taken by hash).  Inner products become distances by
one more coordinate, which lifts every vector to the largest norm.  Every vector is posted to its nearest centroid and,
when it lies near a boundary, to others whose distance is within ``POST`` times the nearest, at most ``REPLICAS``
lists.  A query walks an in-memory graph of the centroids best-first and selects the lists within ``PROBE`` times the
distance of the nearest, at least ``LISTS``.  Long lists are divided into blocks of ``BLOCK`` rows, so lists are
balanced whatever the data; equal query vectors are searched once.  Scores are exact on the original vectors.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those whose length is not the
most frequent one.  Repeated rows are candidates each; ties go to the smaller id (null last).
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved, with_uid

SAMPLE, CENTROIDS = 20_000, 8192
POST, REPLICAS = 1.12, 4
PROBE, LISTS = 1.15, 48
BLOCK = 4096
NEIGHBOURS = 24


def valid_vectors(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """_uid, id, v array<double> of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = with_uid(df.select(F.col(id_col).alias("id"), v.alias("v")))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull()).where(~odd & F.exists("v", lambda x: x != 0.0))
    rows = saved(rows)
    size = rows.agg(F.mode(F.size("v")).alias("n")).first().n
    return rows.where(F.size("v") == F.lit(size if size is not None else -1))


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """Vectors with one more coordinate, all of the same norm."""
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x * x).sum(axis=1), 0.0))[:, None]])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (x @ c.T), 0.0))


def fit(sample: np.ndarray, rows: int, norm2: float, rounds: int = 8) -> dict:
    """Centroids and their graph."""
    s = lifted(sample, norm2)
    k = int(min(CENTROIDS, len(s), max(1, round(2 * rows ** 0.5))))
    rng = np.random.default_rng(0)
    c = s[rng.choice(len(s), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([distances(s[i:i + 4096], c).argmin(axis=1) for i in range(0, len(s), 4096)])
        order = np.argsort(own, kind="stable")
        present, at = np.unique(own[order], return_index=True)
        c[present] = np.add.reduceat(s[order], at, axis=0) / np.diff(np.append(at, len(order)))[:, None]
        empty = np.setdiff1d(np.arange(k), present)
        c[empty] = s[rng.choice(len(s), len(empty))]
    near = np.concatenate([np.argsort(distances(c[i:i + 1024], c), axis=1, kind="stable")[:, :NEIGHBOURS + 1] for i in range(0, k, 1024)])
    links: list[set] = [set(row.tolist()) - {i} for i, row in enumerate(near)]
    for i, row in enumerate(near):          # both ways
        for j in row.tolist():
            if j != i:
                links[j].add(i)
    for i in range(k):                      # a ring keeps the graph in one piece
        links[i].add((i + 1) % k)
    width = max(map(len, links))
    graph = np.array([sorted(x) + [i] * (width - len(x)) for i, x in enumerate(links)], np.int32).reshape(k, width)
    return {"c": c, "graph": graph, "norm2": norm2}


def post(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the postings of each vector."""
    d = distances(lifted(x, m["norm2"]), m["c"])
    some = min(REPLICAS, d.shape[1])
    near = np.argpartition(d, some - 1, axis=1)[:, :some]
    dn = np.take_along_axis(d, near, axis=1)
    ok = dn <= POST * dn.min(axis=1, keepdims=True) + 1e-12
    row, at = np.nonzero(ok)
    return row, near[row, at]


def probe(q: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) selected by a best-first walk of the graph, for a batch of queries."""
    c, graph = m["c"], m["graph"]
    x = np.hstack([q, np.zeros((len(q), 1))])
    x *= np.sqrt(m["norm2"]) / np.linalg.norm(x, axis=1, keepdims=True)     # only the direction of a query matters
    n, k = len(x), len(c)
    seen = np.full((n, k), np.inf)
    done = np.zeros((n, k), bool)
    entry = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
    seen[:, entry] = distances(x, c[entry])
    live = np.arange(n)
    while len(live):
        front = np.where(done[live], np.inf, seen[live])
        at = front.argmin(axis=1)
        best = front[np.arange(len(live)), at]
        near = seen[live].min(axis=1)
        enough = np.partition(seen[live], min(LISTS, k) - 1, axis=1)[:, min(LISTS, k) - 1]
        go = np.isfinite(best) & (best <= np.maximum(PROBE * near, enough))
        live, at = live[go], at[go]
        if not len(live):
            break
        done[live, at] = True
        nb = graph[at]
        d = np.sqrt(np.maximum(((c[nb] - x[live][:, None, :]) ** 2).sum(axis=2), 0.0))
        rows = np.repeat(live, nb.shape[1])
        seen[rows, nb.reshape(-1)] = d.reshape(-1)
    limit = np.maximum(PROBE * seen.min(axis=1), np.partition(seen, min(LISTS, k) - 1, axis=1)[:, min(LISTS, k) - 1])
    return np.nonzero((seen <= limit[:, None]) & np.isfinite(seen))


def nearest(df: DataFrame, is_query, k: int = 20, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank, id, score: the k nearest other rows found for each row where ``is_query`` (a Column over ``id``)."""
    spark = df.sparkSession
    rows = valid_vectors(df, vector, id_col)
    kind = rows.schema["id"].dataType.simpleString()
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    out = f"query_id {kind}, rank int, id {kind}, score double"
    if not stats.n:
        return spark.createDataFrame([], out)
    share = min(1.0, SAMPLE / stats.n)
    picked = rows.where(F.pmod(F.xxhash64("_uid"), F.lit(2**30)) <= share * 2**30).select("v").limit(2 * SAMPLE).toPandas()
    model = fit(np.array(picked.v.tolist()) if len(picked) else np.array([rows.first().v]), stats.n, stats.norm2)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))     # at most CENTROIDS vectors
    state: dict = {}

    def get() -> dict:
        if "m" not in state:
            state["m"] = pickle.loads(shared.value)
        return state["m"]

    def postings(frames):
        for pdf in frames:
            for i in range(0, len(pdf), 2048):
                p = pdf.iloc[i:i + 2048]
                if len(p):
                    row, to = post(np.array(p.v.tolist()), get())
                    yield pd.DataFrame({"list": to, "_uid": p._uid.to_numpy()[row], "id": p.id.to_numpy()[row], "v": p.v.to_numpy()[row]})

    def probes(frames):
        for pdf in frames:
            for i in range(0, len(pdf), 256):
                p = pdf.iloc[i:i + 256]
                if len(p):
                    row, to = probe(np.array(p.q.tolist()), get())
                    yield pd.DataFrame({"list": to, "qid": p.qid.to_numpy()[row], "q": p.q.to_numpy()[row]})

    posted = saved(rows.mapInPandas(postings, f"list int, _uid long, id {kind}, v array<double>"))
    asked = saved(rows.where(is_query).select(F.col("id").alias("query_id"), F.col("_uid").alias("own"), F.col("v").alias("q")))
    distinct = saved(asked.groupBy("q").agg(F.min("own").alias("qid")))
    wanted = saved(distinct.repartition("qid").mapInPandas(probes, "list int, qid long, q array<double>"))
    blocks = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    groups = wanted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nq"))
    plan = saved(blocks.join(groups, "list"))                      # one row per list
    left = (posted.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("_uid"), F.col("nb")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("list", "block", "part", "_uid", "id", "v"))
    right = (wanted.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("nq")).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("list", "block", "part", "qid", "q"))

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "_uid": [], "id": [], "score": []}).astype({"qid": "int64", "_uid": "int64", "score": "float64"})
        if not len(p) or not len(q):
            return empty
        order = np.argsort(p.id.to_numpy(), kind="stable") if p.id.notna().all() else p.id.reset_index(drop=True).sort_values(na_position="last").index.to_numpy()
        p = p.iloc[order]
        x, y, take = np.array(p.v.tolist()), np.array(q.q.tolist()), k + 1
        found = []
        for i in range(0, len(y), 256):
            s = y[i:i + 256] @ x.T
            if s.shape[1] > take:
                least = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take]
                row, at = np.nonzero(s >= least[:, None] - 1e-9 * (1.0 + np.abs(least[:, None])))
            else:
                row, at = np.nonzero(np.ones_like(s, bool))
            exact = np.concatenate([(x[at[j:j + 65536]] * y[i + row[j:j + 65536]]).sum(axis=1) for j in range(0, len(row), 65536)])
            o = np.lexsort((at, -exact, row))
            row, at, exact = row[o], at[o], exact[o]
            first = np.searchsorted(row, row, side="left")
            ok = np.arange(len(row)) - first < take
            found.append(pd.DataFrame({"qid": q.qid.to_numpy()[i + row[ok]], "_uid": p._uid.to_numpy()[at[ok]], "id": p.id.to_numpy()[at[ok]], "score": exact[ok]}))
        return pd.concat(found)

    hits = left.groupBy("list", "block", "part").cogroup(right.groupBy("list", "block", "part")).applyInPandas(search, f"qid long, _uid long, id {kind}, score double")
    best = W.partitionBy("qid").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "_uid")
    top = saved(hits.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    mine = asked.join(distinct, "q").select("qid", "query_id", "own")
    per = W.partitionBy("own").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "_uid")
    return (mine.join(top, "qid").where("own != _uid").withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))
