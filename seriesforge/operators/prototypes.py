"""Class prototypes and scoring against them."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import vectors as V
from ..streaming.stateful import MemoryBuffer
from .layout import CHUNK, index_series
from .scan import Recursion, run_ordered

MANY = 4096      # labels one scalar subquery may carry; beyond it the scoring joins on label buckets
BUCKET_LABELS = 256


def build(vectors: DataFrame, keys=("label",)) -> DataFrame:
    """Unit mean of unit vectors per class; sums are pre-aggregated per (class, position)."""
    u = vectors.select(*keys, F.posexplode(V.unit(F.col("v"))).alias("pos", "x"))
    m = u.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    g = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_i"))
    return g.select(*keys, V.unit(F.col("_i.x")).alias("prototype"))


def means(vectors: DataFrame) -> DataFrame:
    """Plain mean vector per class."""
    m = vectors.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    g = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_i"))
    return g.select("label", F.col("_i.x").alias("prototype"))


def _score(v: Column, p: Column, how: str, temperature: float) -> Column:
    if how == "neg_sq_l2":
        return -F.aggregate(F.zip_with(v, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return V.dot(v, p) / temperature


def classify(vectors: DataFrame, prototypes: DataFrame, how: str = "cosine", temperature: float = 0.2,
             id_col: str = "id") -> DataFrame:
    """Best label, its score and softmax confidence for each vector.

    The prototype table is counted first: a small one becomes a scalar subquery
    (one array, no shuffle of the vectors); a large one is bucketed by label and
    joined on the bucket, with partial softmax sums combined per vector.
    """
    n = prototypes.select(F.count(F.lit(1))).first()[0]
    item = F.struct("label", "prototype")
    if n <= MANY:
        packed = prototypes.agg(F.array_sort(F.collect_list(item)).alias("_p")).scalar()
        parts = vectors.withColumn("_p", packed)
    else:
        nb = math.ceil(n / BUCKET_LABELS)
        buckets = prototypes.groupBy(F.pmod(F.xxhash64("label"), F.lit(nb)).alias("_b")).agg(F.collect_list(item).alias("_p"))
        parts = vectors.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).cast("long")).join(buckets, "_b")
    scored = parts.withColumn("_s", F.transform("_p", lambda p: F.struct(
        _score(F.col("v"), p["prototype"], how, temperature).alias("s"), p["label"].alias("label"))))
    best = F.array_max("_s")
    part = scored.select(id_col, best["s"].alias("m"), best["label"].alias("l"), F.col("_s.s").alias("ss")).withColumn(
        "z", V.let(F.struct(F.col("ss").alias("v"), F.col("m").alias("m")), lambda q: F.aggregate(
            q["v"], F.lit(0.0), lambda a, x: a + F.exp(x - q["m"]))))
    if n > MANY:
        top = part.groupBy(id_col).agg(F.max(F.struct("m", "l")).alias("b"), F.collect_list(F.struct("m", "z")).alias("zs"))
        part = top.select(id_col, F.col("b.m").alias("m"), F.col("b.l").alias("l"), V.let(
            F.struct(F.col("zs").alias("v"), F.col("b.m").alias("m")), lambda q: F.aggregate(
                q["v"], F.lit(0.0), lambda a, x: a + x["z"] * F.exp(x["m"] - q["m"]))).alias("z"))
    return part.select(id_col, F.col("l").alias("label"), F.col("m").alias("score"), (1.0 / F.col("z")).alias("confidence"))


def chunk_probabilities(vectors: DataFrame, prototypes: DataFrame, labels=C.CHUNK_TYPES, temperature: float = 0.2,
                        missing: float = -1.0, id_col: str = "id") -> DataFrame:
    """Softmax over a fixed label list of cosine / temperature; a label without prototype gets ``missing``."""
    packed = prototypes.where(F.col("label").isin(*labels)).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "prototype"))).alias("_m")).scalar()
    sims = F.array(*[F.coalesce(V.dot(F.col("v"), F.try_element_at("_m", F.lit(l))), F.lit(missing)) / temperature
                     for l in labels])
    p = vectors.withColumn("_m", packed).withColumn("_p", V.softmax(sims))
    names = F.array(*[F.lit(l) for l in labels])
    top = F.array_position("_p", F.array_max("_p")).cast("int")
    return p.select(id_col, F.element_at(names, top).alias("label"), F.array_max("_p").alias("confidence"),
                    F.map_from_arrays(names, "_p").alias("probabilities"))


def drift(new: DataFrame, old: DataFrame) -> DataFrame:
    """Norm of the prototype change per label; 0 when there is no older one."""
    j = new.join(old.select("label", F.col("prototype").alias("_o")), "label", "left")
    return j.select("label", F.coalesce(V.l2(F.col("prototype"), F.col("_o")), F.lit(0.0)).alias("drift"))


def rounded_probabilities(p: Column) -> Column:
    """Probabilities rounded to 6 places; the remainder to 1 goes to the dominant entry."""
    r = F.transform_values(p, lambda k, v: F.bround(v, 6))
    def fix(s):
        total = F.round(V.vsum(F.map_values(s["r"])), 6)
        top = F.array_max(F.map_values(s["r"]))
        dom = F.get(F.filter(F.map_entries(s["r"]), lambda e: e["value"] == top), F.lit(0))["key"]
        return V.let(F.struct(s["r"].alias("r"), total.alias("t"), dom.alias("d")), lambda q: F.transform_values(
            q["r"], lambda k, v: F.when((q["t"] != 1.0) & (k == q["d"]),
                                        F.greatest(F.lit(0.0), F.round(v + (1.0 - q["t"]), 6))).otherwise(v)))
    return V.let(F.struct(r.alias("r")), fix)


def default_support(spark, length: int = 24) -> DataFrame:
    """One template series per chunk type."""
    mid, q = length // 2, max(2, length // 4)
    i = F.sequence(F.lit(0), F.lit(length - 1))
    core = max(1, length - 2 * q - 1)
    shapes = {
        "trend": lambda x: x / max(1, length - 1), "plateau": lambda x: F.lit(0.25),
        "spike": lambda x: F.when(x == mid - 1, 3.0).otherwise(0.0),
        "event": lambda x: F.when((x >= q) & (x < length - q), 1.0).otherwise(0.0),
        "transition": lambda x: F.when(x < q, 0.0).when(x < length - q, (x - q) / core).otherwise(1.0),
        "periodic": lambda x: F.sin(x * (2 * math.pi / 6))}
    base = spark.range(1)
    template = lambda f: F.transform(i, lambda x: f(x).cast("double"))
    cells = F.array(*[F.struct(F.lit(l).alias("label"), template(f).alias("v")) for l, f in shapes.items()])
    return base.select(F.inline(cells))


# --- memory of accepted corrections --------------------------------------------

def support_snapshots(accepted: DataFrame, gate: float = 0.7, cap: int = 50, every: int = 5) -> DataFrame:
    """Prototype snapshots of a support buffer and their largest drift.

    ``accepted`` is (session_id, seq, label, confidence, v).  After each
    ``every``-th correction that passes the gate, every class keeps its last
    ``cap`` vectors.  A vector therefore serves a bounded run of snapshots,
    found from its rank in its class, and snapshots are plain aggregates.
    """
    from .layout import index_series
    ok = accepted.where((F.col("confidence") >= gate) & F.col("label").isin(*C.SHAPES))
    bucket = F.floor(F.col("seq") / 4096)
    r = index_series(ok, "session_id", ["seq"], bucket, "n").withColumn("n", F.col("n") + 1)
    r = index_series(r, ["session_id", "label"], ["seq"], bucket, "_k")
    leave = r.select("session_id", "label", (F.col("_k") - cap).alias("_k"), F.col("n").alias("gone_n"))
    r = r.join(leave, ["session_id", "label", "_k"], "left")
    last = r.groupBy("session_id").agg(F.floor(F.max("n") / every).cast("int").alias("snaps"))
    first = F.ceil(F.col("n") / every).cast("int")
    until = F.least(F.coalesce(F.ceil(F.col("gone_n") / every).cast("int") - 1, F.col("snaps")), F.col("snaps"))
    live = r.join(last, "session_id").where(first <= until).withColumn("snapshot", F.explode(F.sequence(first, until)))
    p = build(live.select("session_id", "snapshot", "label", "v"), ("session_id", "snapshot", "label"))
    prev = p.select("session_id", (F.col("snapshot") + 1).alias("snapshot"), "label", F.col("prototype").alias("_o"))
    j = p.join(prev, ["session_id", "snapshot", "label"], "left").withColumn(
        "_d", V.l2(F.col("prototype"), F.col("_o")))
    return j.groupBy("session_id", "snapshot").agg(
        F.coalesce(F.max("_d"), F.lit(0.0)).alias("drift"), F.count(F.lit(1)).alias("n_labels"))


def update_memory(accepted: DataFrame, gate: float = 0.75, cap: int = 8, max_drift: float = 0.45, chunk: int = CHUNK) -> DataFrame:
    """Bounded prototype memory per (session, label): gate, last ``cap`` vectors, drift guard.

    Each step depends on the state before it, ``cap`` vectors; a long session runs by chunks (see ``scan``).
    """
    keys = ["session_id", "label"]
    rows = index_series(accepted.select(*keys, "seq", "confidence", "v"), keys, ["seq"], F.floor(F.col("seq") / CHUNK), "_n")

    def load(text: str) -> MemoryBuffer:
        buffer = MemoryBuffer(gate, cap, max_drift)
        buffer.rows = [np.array(x) for x in json.loads(text)]
        return buffer
    memory = Recursion("applied boolean, reason string, drift double, buffer_size int", lambda row: MemoryBuffer(gate, cap, max_drift), lambda row: [MemoryBuffer(gate, cap, max_drift)],
                       lambda b, row: [b.update(row.v, row.confidence)], lambda b: json.dumps([x.tolist() for x in b.rows]), load)
    return run_ordered(rows, keys, memory, "seq", "_n", chunk=chunk)
