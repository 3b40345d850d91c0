"""Exact k nearest neighbours in a metric space, routed by bounds.

Base rows are cut around pivots, about the square root of their number, found through a coarser level so that placing a row
costs a fourth root of them.  A cell is cut again into rings of distance to its pivot and, where a ring is crowded, by
hash; such a block holds a bounded number of rows.  A query first asks the one block it would lie in; the k-th distance
found there, or a bound from the cells' innermost rows, tells which cells and rings can hold anything nearer, and only
those blocks are asked in the second round.  A base row is copied once for every bounded chunk of queries that asked for
its block and never otherwise.  Where bounds prune too little (many dimensions without clusters), asking by block would
move every query to nearly every block; then large chunks of queries meet large chunks of base rows instead, each row
moved once per chunk of the other side, and the first round's bounds keep what a pair returns small.  Equal vectors of a
label travel as one row with their smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as N
from .layout import cut_lineage

BLOCK = 2048
MOST_PIVOTS = 16384             # bounds what the driver and every task hold; beyond it cells grow and are cut more
LEAST_CELL = 256                # rows of a cell, on average, below which routing costs more than it saves
STEP = 512                      # queries whose bounds are worked out together
CHUNK_BYTES = 8 << 20           # vectors of one side that meet in one task where bounds do not prune
TRIED = 512                     # queries, about, by which the second round is estimated
PLACE = ["cell", "ring", "part"]
WANT = ["_cell", "_first", "_last"]


def distances(x: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Rows of ``x`` against rows of ``p``."""
    out = np.empty((len(x), len(p)))
    for j, row in enumerate(p):
        out[:, j] = np.sqrt(((x - row) ** 2).sum(1)) if metric == "l2" else np.abs(x - row).sum(1)
    return out


def allowed(rule: str, labels: np.ndarray, own) -> np.ndarray:
    if rule == "unlike":
        return labels != own
    return labels == own if rule == "target" else np.ones(len(labels), bool)


class Pivots:
    """Two levels of pivots: each fine pivot belongs to its nearest coarse one."""

    def __init__(self, fine: np.ndarray, metric: str):
        self.fine, self.metric = fine, metric
        self.coarse = fine[:math.ceil(math.sqrt(len(fine)))]
        owner = distances(fine, self.coarse, metric).argmin(1)
        self.members = [np.flatnonzero(owner == c) for c in range(len(self.coarse))]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, coarse cell, distance to its pivot) of each row."""
        far = distances(x, self.coarse, self.metric)
        c = far.argmin(1)
        cell, d = np.empty(len(x), np.int64), np.empty(len(x))
        for g in np.unique(c):
            rows = np.flatnonzero(c == g)
            near = distances(x[rows], self.fine[self.members[g]], self.metric)
            best = near.argmin(1)
            cell[rows], d[rows] = self.members[g][best], near[np.arange(len(rows)), best]
        return cell, d, c, far[np.arange(len(x)), c]


def groups_of(base: DataFrame, k: int) -> DataFrame:
    """(label, v, ids): equal vectors of a label with their k + 1 smallest ids.  Ranks up to a limit are cut before the
    shuffle, so copies of one vector do not meet in one task."""
    b = base.withColumn("_r", F.row_number().over(W.partitionBy("label", "v").orderBy("id"))).where(F.col("_r") <= k + 1)
    return b.groupBy("label", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def heads(members: DataFrame, k: int) -> tuple[dict, dict]:
    """For fine and coarse cells, the k smallest pivot distances of the two labels that come nearest."""
    level = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("cell"), F.col("d")), F.struct(F.lit(1).alias("level"), F.col("coarse").alias("cell"), F.col("far").alias("d"))))
    own = members.select("label", F.xxhash64("ids").alias("_h"), level.alias("x")).select("label", "_h", "x.*")
    own = own.withColumn("_r", F.row_number().over(W.partitionBy("level", "cell", "label").orderBy("d", "_h"))).where(F.col("_r") <= k)
    own = own.groupBy("level", "cell", "label").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    own = own.withColumn("_o", F.row_number().over(W.partitionBy("level", "cell").orderBy(F.get("ds", F.lit(0)), "label"))).where("_o <= 2")
    out: tuple[dict, dict] = ({}, {})
    for r in own.collect():
        out[r["level"]].setdefault(r["cell"], []).extend((x, r["label"]) for x in r["ds"])
    return out


class Routes:
    """What a query needs to know: radii and inner rows of both levels, rings of the cells."""

    def __init__(self, pivots: Pivots, cells: dict, near: dict, coarse_near: dict, k: int, rule: str):
        self.pivots, self.need, self.rule = pivots, k + (rule == "other"), rule
        n = len(pivots.fine)
        self.radius, self.rings = np.full(n, -np.inf), np.ones(n, np.int64)
        for c, (size, radius, rings) in cells.items():
            self.radius[c], self.rings[c] = radius, rings
        self.coarse_radius = np.full(len(pivots.coarse), -np.inf)
        to_coarse = [distances(pivots.fine[m], pivots.coarse[g:g + 1], pivots.metric)[:, 0] for g, m in enumerate(pivots.members)]
        for g, (m, d) in enumerate(zip(pivots.members, to_coarse)):
            self.coarse_radius[g] = (self.radius[m] + d).max(initial=-np.inf)
        self.near = [(c, d, l) for c, own in near.items() for d, l in own]
        flat = [(c, d, l) for c, own in coarse_near.items() for d, l in own]
        self.head_cell = np.array([x[0] for x in flat], np.int64)
        self.head_d = np.array([x[1] for x in flat])
        self.head_label = np.array([x[2] for x in flat], object)
        self.of_cell: dict[int, list] = {}
        for c, d, l in self.near:
            self.of_cell.setdefault(c, []).append((d, l))

    def ring(self, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        r, n = self.radius[cell], self.rings[cell]
        with np.errstate(invalid="ignore", divide="ignore"):
            at = np.where(r > 0, np.floor(d / r * n), 0)
        return np.clip(np.nan_to_num(at), 0, n - 1).astype(np.int64)

    def bounds(self, far: np.ndarray, home: np.ndarray, x: np.ndarray, labels) -> np.ndarray:
        """Upper bounds of each query's k-th distance from inner rows: through all coarse pivots and the fine ones of its
        home."""
        out = np.full(len(x), np.inf)
        for i in range(len(x)):
            ok = allowed(self.rule, self.head_label, labels[i])
            ups = far[i, self.head_cell[ok]] + self.head_d[ok]
            if len(ups) >= self.need:
                out[i] = np.partition(ups, self.need - 1)[self.need - 1]
        for g in np.unique(home):
            cells = self.pivots.members[g]
            own = [(j, d, l) for j, c in enumerate(cells) for d, l in self.of_cell.get(int(c), ())]
            if not own:
                continue
            at, d, l = np.array([o[0] for o in own]), np.array([o[1] for o in own]), np.array([o[2] for o in own], object)
            rows = np.flatnonzero(home == g)
            fine = distances(x[rows], self.pivots.fine[cells], self.pivots.metric)
            for i, row in zip(rows, fine):
                ok = allowed(self.rule, l, labels[i])
                ups = row[at[ok]] + d[ok]
                if len(ups) >= self.need:
                    out[i] = min(out[i], np.partition(ups, self.need - 1)[self.need - 1])
        return out

    def asks(self, x: np.ndarray, far: np.ndarray, bound: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(cell, first ring, last ring) that may hold something within each query's bound."""
        out: list[list] = [[] for _ in range(len(x))]
        slack = bound * (1 + 1e-9) + 1e-12
        hit = far - self.coarse_radius <= slack[:, None]
        for g in np.flatnonzero(hit.any(0)):
            rows, cells = np.flatnonzero(hit[:, g]), self.pivots.members[g]
            d = distances(x[rows], self.pivots.fine[cells], self.pivots.metric)
            for i, row in zip(rows, d):
                for j in np.flatnonzero(row - self.radius[cells] <= slack[i]):
                    c, s = cells[j:j + 1], slack[i]
                    if np.isfinite(self.radius[c[0]]):
                        first, last = self.ring(c, np.maximum(row[j:j + 1] - s, 0)), self.ring(c, np.minimum(row[j:j + 1] + s, self.radius[c]))
                        out[i].append((int(c[0]), int(first[0]), int(last[0])))
        return out


def stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(float)


def with_copies(asks: DataFrame, blocks: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(asks, base rows) by block and chunk: a block has a copy for each ``block`` queries that asked for it."""
    asked = cut_lineage(asks.groupBy(*PLACE).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_chunks")))
    q = asks.join(asked, PLACE).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")).drop("_chunks")
    return q, blocks.join(asked, PLACE).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")


def metric_join(queries: DataFrame, base: DataFrame, k: int, metric: str, rule: str, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """Candidates (id, nn_id, nn_label, distance) among which are the k nearest allowed base rows of each query; ties go to
    the smaller id."""
    sc = queries.sparkSession.sparkContext
    q = queries.select("id", "label", *(["target"] if rule == "target" else []), "v").where("v is not null")
    own = "target" if rule == "target" else "label"
    kinds = {**{f.name: f.dataType for f in q.schema.fields}, "nn_label": base.schema["label"].dataType, "nn_id": base.schema["id"].dataType}
    found = T.StructType([T.StructField("id", kinds["id"]), T.StructField("nn_id", kinds["nn_id"]), T.StructField("nn_label", kinds["nn_label"]), T.StructField("distance", T.DoubleType())])
    b = cut_lineage(groups_of(base.where("v is not null").select(*(F.col(c).alias(c) for c in ("id", "label", "v"))), k))    # attributes of its own in a self-join
    n = b.count()
    if not n:
        return queries.sparkSession.createDataFrame([], found)
    wanted = pivots or min(MOST_PIVOTS, math.ceil(math.sqrt(n)), math.ceil(n / LEAST_CELL))
    need = k + 1

    def pair(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(bs):
            return pd.DataFrame({c: [] for c in found.names}, dtype=object)
        kinds_of, _ = pd.factorize(pd.concat([qs[own], bs["label"]], ignore_index=True), use_na_sentinel=False)
        ql, bl = kinds_of[:len(qs)], kinds_of[len(qs):]
        no = {"unlike": lambda lo, hi: ql[lo:hi, None] == bl[None], "target": lambda lo, hi: ql[lo:hi, None] != bl[None]}.get(rule, lambda lo, hi: None)
        most = qs["bound"].fillna(np.inf).to_numpy(float) if "bound" in qs else None
        i, j, d = N.near_pairs(stacked(qs), stacked(bs), need, metric, no, most)
        ids, labels = bs["ids"].to_numpy(), bs["label"].to_numpy()
        lens = np.array([len(ids[x]) for x in j], int)
        i, j, d = np.repeat(i, lens), np.repeat(j, lens), np.repeat(d, lens)
        nn = np.concatenate([ids[x] for x in j[np.cumsum(lens) - 1]]) if len(j) else np.empty(0, int)
        out = pd.DataFrame({"_i": i, "id": qs["id"].to_numpy()[i], "nn_id": nn, "nn_label": labels[j], "distance": d})
        if rule == "other":
            out = out[out["id"] != out["nn_id"]]
        out = out.sort_values(["_i", "distance", "nn_id"])
        return out[out.groupby("_i").cumcount() < k][found.names]

    def answered(asks: DataFrame, blocks: DataFrame, queries_together: int) -> DataFrame:
        left, right = with_copies(asks, blocks, queries_together)
        keys = [*PLACE, "chunk"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, found)

    if n <= block and not pivots:                           # one block: everybody asks it
        here = {c: F.lit(0) for c in PLACE}
        return cut_lineage(answered(q.withColumns(here), b.withColumns(here), LEAST_CELL))
    tree = Pivots(np.array([r["v"] for r in b.orderBy(F.xxhash64("v"), "label").limit(wanted).select("v").collect()], float), metric)
    shared = sc.broadcast(tree)
    placed = T.StructType([*b.schema.fields, T.StructField("cell", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("coarse", T.LongType()), T.StructField("far", T.DoubleType())])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**dict(zip(("cell", "d", "coarse", "far"), shared.value.place(stacked(pdf)))))

    b = cut_lineage(b.mapInPandas(place, placed))
    # at most MOST_PIVOTS rows of statistics, and 2 (k + 1) inner distances each
    cells = {r["cell"]: (r["n"], r["r"], max(1, math.ceil(r["n"] / block))) for r in b.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect()}
    routes = sc.broadcast(Routes(tree, cells, *heads(b, need), k, rule))

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=["d", "coarse", "far"]).assign(ring=routes.value.ring(pdf["cell"].to_numpy(), pdf["d"].to_numpy()))

    kept = [f for f in placed.fields if f.name not in ("d", "coarse", "far")]
    ringed = b.mapInPandas(rings, T.StructType([*kept, T.StructField("ring", T.LongType())]))
    parts = cut_lineage(ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts")))
    blocks = cut_lineage(ringed.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("_parts")).cast("int")).drop("_parts"))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                r = routes.value
                cell, d, _, _ = r.pivots.place(stacked(pdf))
                yield pdf.assign(cell=cell, ring=r.ring(cell, d))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), STEP):
                part = pdf.iloc[s:s + STEP]
                r, x = routes.value, stacked(part)
                far = distances(x, r.pivots.coarse, metric)
                bound = np.fmin(r.bounds(far, far.argmin(1), x, part[own].to_numpy()), part["bound"].to_numpy(float))
                want = [np.array(w, np.int64).reshape(-1, 3) for w in r.asks(x, far, bound)]
                yield part.drop(columns=["bound"]).assign(**{c: [w[:, i] for w in want] for i, c in enumerate(WANT)}).reset_index(drop=True)

    first = q.mapInPandas(home, T.StructType([*q.schema.fields, T.StructField("cell", T.LongType()), T.StructField("ring", T.LongType())]))
    first = first.join(parts, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    near = cut_lineage(answered(first, blocks, block))
    bound = near.groupBy("id").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).drop("_n")
    asking = T.StructType([*q.schema.fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in WANT)])
    bounded = q.join(bound, "id", "left")
    if not pivots:
        m = q.count()
        tried = bounded.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, m // TRIED))) == 0).mapInPandas(further, asking)
        rings_asked = F.aggregate(F.zip_with("_first", "_last", lambda x, y: y - x + 1), F.lit(0).cast("long"), lambda x, y: x + y)
        asked = tried.agg(F.avg(rings_asked)).first()[0] or 0.0
        chunk = max(block, CHUNK_BYTES // (8 * max(1, tree.fine.shape[1])))
        base_chunks, query_chunks = math.ceil(n / chunk), max(1, math.ceil(m / chunk))
        if asked * m > m * base_chunks + n * query_chunks:
            part_of = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
            every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
            left = bounded.withColumn("part", part_of("id", query_chunks)).withColumn("chunk", every(base_chunks))
            right = b.select("label", "v", "ids", part_of("ids", base_chunks).alias("chunk")).withColumn("part", every(query_chunks))
            left, right = (x.repartition(base_chunks * query_chunks, "part", "chunk") for x in (left, right))
            return cut_lineage(left.groupBy("part", "chunk").cogroup(right.groupBy("part", "chunk")).applyInPandas(pair, found))
    second = cut_lineage(bounded.mapInPandas(further, asking))
    second = second.select(*q.columns, F.explode(F.arrays_zip(*WANT)).alias("w")).select(*q.columns, F.col("w._cell").alias("cell"), F.explode(F.sequence("w._first", "w._last")).alias("ring"))
    second = second.join(parts, ["cell", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    asked_before = first.select("id", F.lit(True).alias("_asked"), *PLACE)
    second = second.join(asked_before, ["id", *PLACE], "left_anti")
    return cut_lineage(near.unionByName(answered(second, blocks, block)))
