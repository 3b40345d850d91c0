"""Keyed streaming queries and their sinks.

Counters are plain streaming aggregates.  Recursions need their rows in order
and run on ``ordered``: a watermark and a reorder buffer per key, late rows in
a table of their own.  ``run_once`` drives a stream over what is available into
a table, with its checkpoint beside it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .kernels import RunLengths
from .ordered import DELAY, Step, run_in_order
from .stateful import Band, LogDet, SupportBuffer, TipState


def scratch(spark: SparkSession) -> str:
    """Fresh folder under the cluster's shared checkpoint folder; a temporary one only where none is set, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return os.path.join(base, f"stream-{uuid.uuid4().hex}") if base else tempfile.mkdtemp(prefix="spark-stream-")


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """File stream of one table; the schema is the table's, timestamps cast to the session zone."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    s = (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            s = s.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return s


def run_once(stream: DataFrame, mode: str = "append", batch=None) -> DataFrame:
    """Run over the available input into Parquet and read it back.

    Append writes one folder per batch id, so a replayed batch replaces its own
    output; complete mode keeps the last result only.
    """
    spark = stream.sparkSession
    root = scratch(spark)
    out = os.path.join(root, "out")

    def write(df, batch_id):
        d = batch(df) if batch else df
        path = out if mode == "complete" else os.path.join(out, f"batch={batch_id}")
        d.write.mode("overwrite").parquet(path)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(root, "checkpoint"))
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    r = spark.read.parquet(out)
    return r.drop("batch") if "batch" in r.columns else r


# --- counters --------------------------------------------------------------------------

def coverage_counts(chips: DataFrame) -> DataFrame:
    """Running count per (session, shape)."""
    s = chips.select("session_id", F.explode(F.array_distinct(F.array_compact(F.array("old_shape", "new_shape")))).alias("shape"))
    return s.where(F.col("shape").isin(*C.SHAPES)).groupBy("session_id", "shape").count()


def validity_counts(results: DataFrame) -> DataFrame:
    """Running validity rate per session."""
    return results.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("is_valid").alias("n_valid"))


def fan_out(chips_and_results: DataFrame, root: str):
    """One source feeding two counters: the batch function merges each micro-batch into both tables."""
    spark = chips_and_results.sparkSession

    def batch(df, batch_id):
        df.persist()
        try:
            coverage_counts(df).write.mode("overwrite").parquet(os.path.join(root, "coverage", f"batch={batch_id}"))
            validity_counts(df).write.mode("overwrite").parquet(os.path.join(root, "validity", f"batch={batch_id}"))
        finally:
            df.unpersist()
    q = (chips_and_results.writeStream.option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True)
         .foreachBatch(batch).start())
    q.awaitTermination()
    cov = spark.read.parquet(os.path.join(root, "coverage")).groupBy("session_id", "shape").agg(F.sum("count").alias("count"))
    val = spark.read.parquet(os.path.join(root, "validity")).groupBy("session_id").agg(F.sum("n_total").alias("n_total"), F.sum("n_valid").alias("n_valid"))
    return cov, val


# --- ordered queries -----------------------------------------------------------------------
# Each gives (results, late rows) of the available input; see ``ordered``.

Found = tuple[DataFrame, DataFrame]


def ordered(stream: DataFrame, key: str, order: list[str], step: Step, delay: str) -> Found:
    return run_in_order(stream, scratch(stream.sparkSession), key, order, step, delay)


def recent_validity(results: DataFrame, window: int = 10, delay: str = DELAY) -> Found:
    """Rate over the last ``window`` results after each event."""
    def step(st, r):
        st.append(bool(r.is_valid))
        del st[:-window]
        return [(r.event_id, sum(st) / len(st) if len(st) >= window else None)]
    return ordered(results, "session_id", ["ts", "event_id"], Step("recent array<boolean>", "event_id long, recent_rate double", list, list, lambda st: (st,), step), delay)


def trailing_validity(results: DataFrame, days: int = 7, delay: str = DELAY) -> Found:
    """Count and rate over the trailing span; counts per distinct time are kept, and those that leave the span go."""
    span = days * 86_400_000_000

    def step(st, r):
        if st and st[-1][0] == r.ts:
            st[-1] = (r.ts, st[-1][1] + 1, st[-1][2] + bool(r.is_valid))
        else:
            st.append((r.ts, 1, int(bool(r.is_valid))))
        while st[0][0] < r.ts - span:
            st.popleft()
        n = sum(x[1] for x in st)
        return [(r.event_id, n, sum(x[2] for x in st) / n)]
    kind = "at array<long>, n array<long>, valid array<long>"
    return ordered(results, "session_id", ["ts", "event_id"], Step(kind, "event_id long, n_window long, rate double", deque, lambda *a: deque(zip(*a)),
                   lambda st: tuple(map(list, zip(*st))), step), delay)


def online_band(values: DataFrame, delay: str = DELAY) -> Found:
    """Half-width after each value; the residual is the step from the value before.  Needs a column q0."""
    def step(st, r):
        band = st.setdefault("band", Band(r.q0) if "band" not in st else None)
        q = band.step(abs(r.value - st["prev"]))
        st["prev"], st["t"] = r.value, st["t"] + 1
        return [(st["t"], q)]
    return ordered(values, "series_id", ["ts", "event_id"], Step("q double, errors array<double>, prev double, t int", "t int, q double", lambda: {"prev": 0.0, "t": -1},
                   lambda q, errors, prev, t: {"band": Band(q, errors=errors), "prev": prev, "t": t}, lambda st: (st["band"].q, st["band"].errors, st["prev"], st["t"]), step), delay)


def online_baseflow(values: DataFrame, bfi_max: float = 0.8, a: float = 0.98, delay: str = DELAY) -> Found:
    """Recursive filter with one value per key."""
    d = 1.0 - a * bfi_max

    def step(st, r):
        b = r.value * bfi_max if st["b"] is None else min(((1 - bfi_max) * a * st["b"] + (1 - a) * bfi_max * r.value) / d, r.value)
        st.update(b=b, t=st["t"] + 1)
        return [(st["t"], b)]
    return ordered(values, "series_id", ["ts", "event_id"], Step("b double, t int", "t int, baseflow double", lambda: {"b": None, "t": -1}, lambda b, t: {"b": b, "t": t},
                   lambda st: (st["b"], st["t"]), step), delay)


def online_change(values: DataFrame, mean_run_length: float = 50.0, delay: str = DELAY) -> Found:
    """Change probability of each value; at most five mean run lengths are kept per key."""
    hazard = 1.0 / mean_run_length

    def step(st, r):
        st["t"] += 1
        return [(st["t"], st["r"].step(r.value))]
    parts = ", ".join(f"{c} array<double>" for c in ("log_r", "mu", "kappa", "alpha", "beta"))
    return ordered(values, "series_id", ["ts", "event_id"], Step(f"{parts}, t int", "t int, prob double", lambda: {"r": RunLengths(hazard), "t": -1},
                   lambda *p: {"r": RunLengths(hazard).load(p[:-1]), "t": p[-1]}, lambda st: (*st["r"].dump(), st["t"]), step), delay)


def online_prototypes(accepted: DataFrame, gate: float = 0.7, cap: int = 50, every: int = 5, delay: str = DELAY) -> Found:
    """Drift after each prototype rebuild."""
    def load(labels, rows, names, prototypes, accepted_so_far):
        st = SupportBuffer(gate, cap, every)
        st.buffers, st.prototypes, st.accepted = {l: list(r) for l, r in zip(labels, rows)}, dict(zip(names, prototypes)), accepted_so_far
        return st

    def step(st, r):
        d = st.accept(r.label, r.v, r.confidence)
        return [] if d is None else [(st.accepted // every, d)]
    kind = "labels array<string>, rows array<array<array<double>>>, names array<string>, prototypes array<array<double>>, accepted int"
    return ordered(accepted, "session_id", ["ts", "seq"], Step(kind, "snapshot int, drift double", lambda: SupportBuffer(gate, cap, every), load,
                   lambda st: (list(st.buffers), list(st.buffers.values()), list(st.prototypes), list(st.prototypes.values()), st.accepted), step), delay)


def online_tips(fired: DataFrame, max_tips: int = 3, delay: str = DELAY) -> Found:
    """Tips shown per edit; one row per edit with its ranked candidates in ``c``."""
    def load(rules, severities, modalities):
        recent = [[list(x) for x in zip(a, b)] for a, b in zip(rules, severities)]
        return TipState(max_tips, recent=recent, modalities=modalities)

    def dump(st):
        return [[x[0] for x in shown] for shown in st.recent], [[x[1] for x in shown] for shown in st.recent], st.modalities

    def step(st, r):
        return [(r.seq, *t) for t in st.emit(list(zip(r.rules, r.modalities, r.severities)))]
    told = fired.select("session_id", "ts", "seq", F.col("c.rule_id").alias("rules"), F.col("c.modality").alias("modalities"), F.col("c.severity").cast("array<int>").alias("severities"))
    return ordered(told, "session_id", ["ts", "seq"], Step("rules array<array<string>>, severities array<array<int>>, modalities array<string>",
                   "seq long, rule_id string, modality string, severity int", lambda: TipState(max_tips), load, dump, step), delay)


def online_diversity(accepted: DataFrame, delay: str = DELAY) -> Found:
    def step(st, r):
        return [(r.seq, st.add(r.v))]

    def load(rows, root, log_det, bandwidth):
        return LogDet(rows=rows, root=root or None, log_det=log_det, bandwidth=bandwidth)
    return ordered(accepted, "session_id", ["ts", "seq"], Step("rows array<array<double>>, root array<array<double>>, log_det double, bandwidth double", "seq long, log_det double", LogDet, load,
                   lambda st: ([r.tolist() for r in st.rows], [] if st.root is None else st.root.tolist(), st.log_det, st.bw), step), delay)


def sequence_numbers(events: DataFrame, delay: str = DELAY) -> Found:
    """Per-session sequence; output is keyed by event id, so a replay writes the same rows."""
    def step(st, r):
        st["n"] += 1
        return [(r.event_id, st["n"])]
    return ordered(events, "session_id", ["ts", "event_id"], Step("n int", "event_id long, sequence int", lambda: {"n": 0}, lambda n: {"n": n}, lambda st: (st["n"],), step), delay)
