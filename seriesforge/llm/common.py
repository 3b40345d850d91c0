"""Shared pieces: row ids, written intermediate tables, text buffers of Arrow batches, connected classes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2_000_000      # text bytes that one vectorised step holds; a longer single text is a step of its own
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a local one of our own only where the session names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost no recompute."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_uid(df: DataFrame, uid: str = "_uid") -> DataFrame:
    """Unique row number, the same whenever a task over the same input files is run again."""
    return df.withColumn(uid, F.monotonically_increasing_id())


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Splittable 64-bit mixing of an array (public constants of the splitmix generator)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch whose ``column`` holds about ``limit`` bytes or one text; nulls count nothing."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = buffer(batch.column(column))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield batch.slice(start, stop - start)
        start = stop


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; offsets start at 0, a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.type in (pa.large_string(), pa.large_binary())
    _, off, data = texts.buffers()
    n = len(texts)
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[o[0]:o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return b, o - o[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def classes(nodes: DataFrame, links: DataFrame, node: str = "_uid", a: str = "a", b: str = "b") -> DataFrame:
    """(node, class): smallest node reachable over ``links``.

    Star contraction: every node of the larger label hooks to the smallest label seen among its neighbours, then labels
    are shortened by pointer jumping.  Each round is one join and one aggregate over the remaining links; links inside
    one class drop out, so rounds shrink.  Rounds follow the logarithm of the longest chain.
    """
    edges = saved(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi")).distinct())
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        # each label takes the smallest neighbour, if smaller than itself
        hook = edges.groupBy(F.col("_hi").alias("_k")).agg(F.min("_lo").alias("_v"))
        hook = saved(hook)
        # two jumps shorten chains of hooks
        for _ in range(2):
            up = hook.select(F.col("_k").alias("_v"), F.col("_v").alias("_w"))
            hook = hook.join(up, "_v", "left").select("_k", F.coalesce("_w", "_v").alias("_v"))
        hook = saved(hook)
        maps.append(hook)
        lo = hook.select(F.col("_k").alias("_lo"), F.col("_v").alias("_l2"))
        hi = hook.select(F.col("_k").alias("_hi"), F.col("_v").alias("_h2"))
        nxt = (edges.join(lo, "_lo", "left").join(hi, "_hi", "left")
               .select(F.coalesce("_l2", "_lo").alias("x"), F.coalesce("_h2", "_hi").alias("y")).where("x != y")
               .select(F.least("x", "y").alias("_lo"), F.greatest("x", "y").alias("_hi")).distinct())
        edges = saved(nxt)
    out = links.select(F.explode(F.array(a, b)).alias(node)).distinct().withColumn("class", F.col(node))
    for m in maps:
        out = out.join(m.select(F.col("_k").alias("class"), "_v"), "class", "left").select(node, F.coalesce("_v", "class").alias("class"))
    return nodes.select(node).join(saved(out), node, "left").select(node, F.coalesce("class", node).alias("class"))
