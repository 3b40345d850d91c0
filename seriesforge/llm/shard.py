"""Uniform sharding with exact sizes: hypergeometric communication matrix.

Shard sizes differ by at most one row (law ``rows``).  How many rows of each source partition go to each shard is drawn
exactly: a multivariate hypergeometric draw without replacement, in two levels so that no task draws more than
``BLOCK`` partitions.  Each partition permutes its rows and deals them by its row of the matrix; after the exchange
each shard permutes again, in buckets of bounded size, which yields gapless slots.  Every assignment of rows to
shards and every order inside a shard is equally likely.

A null text counts 16 bytes and has the checksum of no bytes; null doc_ids are sharded as any other row; repeated rows are told apart by
their place in the input.  An empty table gives no rows.  Draws are seeded, so a task run again repeats them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved, with_uid

BLOCK = 1024            # source partitions drawn by one task
BUCKET_ROWS = 50_000    # rows of a shard that are permuted together


def _draw(counts: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Matrix with row sums ``counts`` and column sums ``sizes``, as if rows were dealt after a full shuffle."""
    left, out = sizes.astype(np.int64).copy(), []
    for n in counts:
        take = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= take
        out.append(take)
    return np.array(out, dtype=np.int64).reshape(len(counts), len(sizes))


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, upto array<long>: running counts over the shards, from (part, n)."""
    blocks = (counts.groupBy(F.floor(F.col("part") / BLOCK).cast("long").alias("block")).agg(F.sum("n").alias("n")).orderBy("block").toPandas())
    total = int(blocks.n.sum()) if len(blocks) else 0
    sizes = np.array([total // shards + (j < total % shards) for j in range(shards)], dtype=np.int64)
    top = _draw(blocks.n.to_numpy() if len(blocks) else np.empty(0), sizes, np.random.default_rng([seed, 0]))
    spark = counts.sparkSession
    per_block = spark.createDataFrame([(int(b), r.tolist()) for b, r in zip(blocks.block, top)], "block long, sizes array<long>")

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        m = _draw(pdf.n.to_numpy(), np.array(pdf["sizes"].iloc[0]), np.random.default_rng([seed, 1, int(pdf.block.iloc[0])]))
        return pd.DataFrame({"part": pdf.part.to_numpy(), "upto": list(np.cumsum(m, axis=1))})

    return (counts.withColumn("block", F.floor(F.col("part") / BLOCK).cast("long")).join(per_block, "block")
            .groupBy("block").applyInPandas(inner, "part long, upto array<long>"))


def shuffle_shards(rows: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Add shard int and slot long to ``rows``, which must have a unique, repeatable long ``_uid`` of
    :func:`with_uid`; the high bits of that number name the source partition."""
    parts = rows.withColumn("_part", F.shiftright("_uid", 33))
    counts = saved(parts.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n")))
    matrix = communication_matrix(counts, shards, seed).withColumnRenamed("part", "_part")
    local = F.row_number().over(W.partitionBy("_part").orderBy(F.xxhash64("_uid", F.lit(seed)), "_uid"))
    dealt = (parts.withColumn("_r", local).join(matrix, "_part")
             .withColumn("shard", F.aggregate("upto", F.lit(0), lambda a, c: a + (c < F.col("_r")).cast("int")))
             .drop("upto", "_r", "_part"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    order = F.xxhash64("_uid", F.lit(seed), F.lit("slot"))
    dealt = saved(dealt.withColumns({"_o": order, "_b": F.pmod(F.shiftrightunsigned(order, 20), F.lit(buckets))}))
    sizes = dealt.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "_b", before.alias("_off"))
    at = F.row_number().over(W.partitionBy("shard", "_b").orderBy("_o", "_uid"))
    return (dealt.withColumn("_at", at).join(offsets, ["shard", "_b"])
            .withColumn("slot", F.col("_off") + F.col("_at") - 1).drop("_off", "_at", "_b", "_o"))


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One slim row per document: doc_id, size, text_crc32, shard, slot (texts do not move)."""
    t = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = with_uid(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(t).alias("text_crc32")))
    return shuffle_shards(saved(slim), shards, seed).drop("_uid")
