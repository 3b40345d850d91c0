"""Exact dedup by content-defined chunk recipes.

Texts are normalised (each run of the given white space becomes one space) and cut where a rolling hash of the last 16
bytes says so, so equal passages are cut alike wherever they stand.  A document then is a recipe: the ordered list of
its chunk identifiers.  Chunk bytes move once, to be deduplicated and to prove that one fingerprint stands for one
content; where it does not, the contents get different identifiers.  Documents are compared by whole recipes only.

Null text is empty; an empty text has an empty recipe and equals other empty texts.  Of equal texts the smallest
doc_id stays (null doc_id last); of rows repeated with that doc_id exactly one is marked kept.  Other columns,
whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import buffer, fresh, mix64, saved, slices, with_uid

SPACE = re.compile(rb"[\t-\r][ \t-\r]*| [ \t-\r]+")  # all runs but a single blank, which stays as it is
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 11, 16384
GEAR = mix64(np.arange(256), 7).astype(np.uint32)


def normalise(text: bytes) -> bytes:
    return SPACE.sub(b" ", text)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the 16 bytes before them asks for a cut."""
    if len(data) < 17:
        return np.empty(0, np.int64)
    h = GEAR[data]
    for w in (1, 2, 4, 8):
        h[w:] += h[:-w] << np.uint32(w)  # numpy evaluates the right side first
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_ends(candidates: np.ndarray, start: int, stop: int) -> list[int]:
    """Cuts of one text inside [start, stop), respecting the smallest and largest chunk."""
    ends, at = [], start
    cand = candidates[np.searchsorted(candidates, start):np.searchsorted(candidates, stop)]
    for c in cand.tolist():
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK:
            ends.append(c)
            at = c
    while stop - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < stop:
        ends.append(stop)
    return ends


def _texts(batches, bits: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[tuple[int, bytes]]]]]:
    """Slices with their normalised texts and, per text, (fingerprint, bytes) of each chunk."""
    shift = 64 - bits
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, off = buffer(batch.column("text"))
            raw = raw.tobytes()
            texts = [normalise(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            joined = b"".join(texts)
            cand = cut_points(np.frombuffer(joined, np.uint8))
            at, out = 0, []
            for t in texts:
                one = []
                stop = at + len(t)
                for e in chunk_ends(cand, at, stop):
                    c = joined[at:e]
                    one.append((xxhash.xxh3_64_intdigest(c) >> shift, c))
                    at = e
                out.append(one)
            yield batch, texts, out


def recipes(docs: DataFrame, bits: int = 63) -> DataFrame:
    """uid, doc_id, recipe array<long>, text_sha256."""
    def run(batches):
        for batch, texts, chunks in _texts(batches, bits):
            yield pa.RecordBatch.from_arrays(
                [batch.column("_uid"), batch.column("doc_id"), pa.array([[f for f, _ in c] for c in chunks], pa.list_(pa.int64())),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                ["_uid", "doc_id", "recipe", "text_sha256"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_uid long, doc_id {kind}, recipe array<long>, text_sha256 string")


def chunks(docs: DataFrame, bits: int = 63, where: bool = False) -> DataFrame:
    """fp, chunk of each task's texts, repeats inside a slice left out; with ``where`` every occurrence and its place."""
    def run(batches):
        for batch, _, lists in _texts(batches, bits):
            if where:
                uid = batch.column("_uid").to_pylist()
                rows = [(u, p, f, c) for u, one in zip(uid, lists) for p, (f, c) in enumerate(one)]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                                  pa.array(cols[3], pa.binary())], ["_uid", "pos", "fp", "chunk"])
            else:
                seen = list({x for one in lists for x in one})
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.binary())], ["fp", "chunk"])
    return docs.mapInArrow(run, ("_uid long, pos int, " if where else "") + "fp long, chunk binary")


def verified_recipes(docs: DataFrame, bits: int = 63) -> DataFrame:
    """Recipes whose identifiers each stand for one content.

    Fingerprints shared by different contents (next to none at 63 bits) are told apart by the rank of the content.
    """
    rec = saved(recipes(docs, bits))
    store = chunks(docs, bits).distinct()
    clash = saved(store.groupBy("fp").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("fp"))
    if clash.isEmpty():
        return rec.withColumn("variants", F.array().cast("array<long>"))
    named = (store.join(clash, "fp").withColumn("variant", F.row_number().over(W.partitionBy("fp").orderBy("chunk")) - 1)
             .where("variant > 0"))
    # only the places whose content is not the first of its fingerprint need a mark
    marks = (chunks(docs, bits, where=True).join(named, ["fp", "chunk"])
             .groupBy("_uid").agg(F.array_sort(F.collect_list(F.col("pos").cast("long") * F.lit(2**20) + F.col("variant"))).alias("variants")))
    return rec.join(marks, "_uid", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<long>")))


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = 63) -> DataFrame:
    """One row per row of ``docs``: _uid, doc_id, keep_id, group_size, kept, text_sha256.

    The groups are aggregated before the shuffle and joined back by recipe; the join may split a hot group.
    """
    base = with_uid(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")))
    rec = saved(verified_recipes(base, bits))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_uid"))
    # written, so that the join has exchanges of its own, whose hot partitions it may split
    groups = saved(rec.groupBy("recipe", "variants").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("group_size")))
    return (rec.join(groups, ["recipe", "variants"])
            .select("_uid", "doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size",
                    (F.col("_uid") == F.col("_first._uid")).alias("kept"), "text_sha256"))


def drop_exact(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that stay, all columns as they came."""
    kept = exact_groups(docs, text, id_col).where("kept").select("_uid")
    uid = fresh("_row", docs)
    return with_uid(docs, uid).join(kept.withColumnRenamed("_uid", uid), uid, "left_semi").drop(uid)
