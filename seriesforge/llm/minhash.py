"""Near-duplicate classes by DartMinHash and banded joining.

A text is a bag of five-word shingles, each weighing the times it occurs; similarity is the weighted Jaccard share.
Every unit of weight of an element is a region into which hashed darts are thrown: they arrive in rank order after
exponential gaps drawn from hashes of the region, so any text that holds the region sees the same darts.  A text only
looks at darts below the rank where about k ln k + 3 k of them are expected over its whole weight, however long it is,
and keeps the earliest dart per coordinate; texts that miss a coordinate look further.  A pair agrees in a coordinate
with probability equal to its similarity.  Bands of ``ROWS`` coordinates are the join keys: a pair of similarity 0.8
shares none of them with probability below 1e-5.

Texts with the same bag are first one node.  In each bucket a leader is compared with all members (exact similarity of
the bags); classes are merged; buckets that still hold several classes repeat this with other leaders.  The texts of
buckets that hold several classes even then are joined by their rarest units, which is exact, and pairs of different
classes that can be alike enough are compared.  So no link between candidates is lost, and large groups never yield
all their pairs.

Null or empty texts and texts without a word are classes of their own; a text under five words is one shingle; repeated
rows share a class.  Class ids are the smallest doc_id (null last); extra columns of the input play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import classes, fresh, mix64, saved, slices, with_uid
from .words import shingle_hashes, word_hashes

ROWS, BANDS = 7, 50
THRESHOLD = 0.8
MAP = 16                    # words of a bag's parity map
GAP = np.uint64(0xD6E8FEB86659FD93)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(units, offsets per text): one unit per shingle occurrence, sorted within a text; equal bags give equal units."""
    h, off = shingle_hashes(*word_hashes(texts)[:2])
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        h[a:b].sort()
    n = len(h)
    if not n:
        return h, off
    new = np.ones(n, bool)
    new[1:] = h[1:] != h[:-1]
    new[off[:-1][off[:-1] < n]] = True
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    with np.errstate(over="ignore"):
        return mix64(h + (np.arange(n) - first).astype(np.uint64) * GAP, 11), off


def dart_signatures(units: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """Identity of the earliest dart per (text, coordinate); texts without units stay 0."""
    n = len(off) - 1
    weight = np.diff(off)
    best, ident = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    todo, look = np.flatnonzero(weight > 0), k * (np.log(k) + 3.0)
    while len(todo):
        best.reshape(n, k)[todo] = np.inf
        own = np.repeat(todo, weight[todo])
        at = np.concatenate([np.arange(off[t], off[t + 1]) for t in todo.tolist()]) if len(todo) < n else np.arange(len(units))
        limit = (look / np.maximum(weight, 1))[own]
        u, rank, step = units[at], np.zeros(len(at)), 0
        ranks, keys, names = [], [], []
        while len(u):
            with np.errstate(over="ignore"):
                dart = mix64(u + np.uint64(step) * GAP, 3)
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53)
            live = rank < limit
            u, rank, limit, own, dart = u[live], rank[live], limit[live], own[live], dart[live]
            ranks.append(rank)
            keys.append(own * k + (mix64(dart, 9) % np.uint64(k)).astype(np.int64))
            names.append(dart)
            step += 1
        ranks, keys, names = np.concatenate(ranks), np.concatenate(keys), np.concatenate(names)
        np.minimum.at(best, keys, ranks)
        won = ranks == best[keys]
        ident[keys[won]] = names[won]
        todo = todo[np.isinf(best.reshape(n, k)[todo]).any(axis=1)]
        look *= 2.0
    return ident.reshape(n, k)


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), bands, rows)
        h = np.zeros((len(signatures), bands), np.uint64)
        for i in range(rows):
            h = mix64(h ^ parts[:, :, i], i)
        return mix64(h + np.arange(bands, dtype=np.uint64) * GAP, 21).view(np.int64)


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """_uid, doc_id, bag binary(16) (null without a word), keys array<long>."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                units, off = bags(batch.column("text"))
                keys = band_keys(dart_signatures(units, off, rows * bands), rows, bands)
                some = np.diff(off) > 0
                digest = [xxhash.xxh3_128_digest(units[a:b].tobytes()) if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("_uid"), batch.column("doc_id"), pa.array(digest, pa.binary()), lists],
                                                 ["_uid", "doc_id", "bag", "keys"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_uid long, doc_id {kind}, bag binary, keys array<long>")


def bag_table(docs: DataFrame) -> DataFrame:
    """_uid, units binary."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                units, off = bags(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("_uid"), pa.array([units[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())],
                                                 ["_uid", "units"])
    return docs.mapInArrow(run, "_uid long, units binary")


def similarities(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b, sim): exact weighted Jaccard of each pair."""
    def run(batches):
        for batch in batches:
            sims = []
            for x, y in zip(batch.column("ua"), batch.column("ub")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(both / (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    left = units.select(F.col("_uid").alias("a"), F.col("units").alias("ua"))
    right = units.select(F.col("_uid").alias("b"), F.col("units").alias("ub"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long, sim double")


def near_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: _uid, doc_id, class_id, class_size, kept."""
    base = with_uid(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    sig = saved(signatures(base))
    nodes = saved(sig.where("bag is not null").groupBy("bag").agg(F.min("_uid").alias("node")))
    rep = sig.join(nodes.select(F.col("node").alias("_uid")), "_uid", "left_semi")
    flat = rep.select(F.explode("keys").alias("key"), F.col("_uid").alias("x"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = saved(flat.join(shared, "key"))
    needed = saved(members.select(F.col("x").alias("_uid")).distinct())
    units = saved(bag_table(base.join(needed.hint("merge"), "_uid", "left_semi").select("_uid", "text")))

    links = seen = None
    label = needed.select(F.col("_uid").alias("x"), F.col("_uid").alias("c"))
    open_ = members.join(label, "x")
    for r in range(rounds + 1):
        # one order of all texts per round, so that the buckets of a large group mostly share their leader
        several = saved(open_.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct(F.xxhash64("x", F.lit(r)).alias("h"), F.col("x"), F.col("c"))).alias("lead"))
                        .where("c0 < c1").select("key", F.col("lead.x").alias("lead"), F.col("lead.c").alias("lead_c")))
        inside = saved(open_.join(several, "key"))
        if r == rounds:
            break
        pairs = inside.where("c != lead_c").select(F.least("x", "lead").alias("a"), F.greatest("x", "lead").alias("b")).distinct()
        new = saved(similarities(saved(pairs if seen is None else pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")), units))
        seen = new if seen is None else seen.unionByName(new)
        links = seen.where(F.col("sim") >= threshold)
        label = saved(classes(needed, links).select(F.col("_uid").alias("x"), F.col("class").alias("c")))
        open_ = members.join(label, "x")
    last = _remaining(inside, units, threshold)
    if last is not None:
        more = saved(similarities(saved(last.join(seen.select("a", "b"), ["a", "b"], "left_anti")), units)).where(F.col("sim") >= threshold)
        label = saved(classes(needed, links.unionByName(more)).select(F.col("_uid").alias("x"), F.col("class").alias("c")))
    named = nodes.join(label, nodes.node == label.x, "left").select("bag", F.coalesce("c", "node").alias("c"))
    full = saved(sig.select("_uid", "doc_id", "bag").join(saved(named), "bag", "left").select("_uid", "doc_id", F.coalesce("c", "_uid").alias("c")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_uid"))
    groups = saved(full.groupBy("c").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("class_size")))
    return full.join(groups, "c").select("_uid", "doc_id", F.col("_first.doc_id").alias("class_id"), "class_size", (F.col("_uid") == F.col("_first._uid")).alias("kept"))


def _remaining(inside: DataFrame, units: DataFrame, threshold: float) -> DataFrame | None:
    """All pairs of different classes, among the texts of buckets that still hold several, that can be alike enough.

    Exact prefix join: alike bags share one of their rarest units, of which a bag of n needs n - ceil(threshold n) + 1;
    units that no other text has count first and never match, so texts with too many of them drop out.  The places of
    the shared unit in both orders, and the bits in which parity maps of the bags differ, bound the shared part of a
    pair from above before it is emitted.
    """
    if inside.isEmpty():
        return None
    left = inside.select("x", "c").distinct()

    def spread(batches):
        for batch in batches:
            for x, own in zip(batch.column("x"), batch.column("units")):
                u = np.frombuffer(own.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), x.as_py())), pa.array(u)], ["x", "u"])

    def maps(batches):
        for batch in batches:
            odd = []
            for own in batch.column("units"):
                u = np.frombuffer(own.as_buffer(), np.uint64)
                bits = np.bincount((u >> np.uint64(20)).astype(np.int64) % (64 * MAP), minlength=64 * MAP) & 1
                odd.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("c"), pa.array([len(o) // 8 for o in batch.column("units").to_pylist()], pa.int32()), pa.array(odd, pa.list_(pa.int64()))],
                                             ["x", "c", "n", "map"])

    bags_ = saved(left.join(units.withColumnRenamed("_uid", "x").hint("merge"), "x"))
    about = saved(bags_.mapInArrow(maps, "x long, c long, n int, map array<long>"))
    rows = saved(bags_.mapInArrow(spread, "x long, u long"))
    often = rows.groupBy("u").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = rows.join(often, "u")
    known = rows.groupBy("x").agg(F.count(F.lit(1)).cast("int").alias("m"))
    about = about.join(known, "x").withColumn("own", F.col("n") - F.col("m"))
    rows = rows.join(about, "x")
    need = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - F.col("own")
    rows = rows.where(need > 0).withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("df", "u"))).where(F.col("r") <= need)
    rows = saved(rows.select("x", "c", "n", (F.col("n") - F.col("own") - F.col("r") + 1).alias("left"), "map", "u"))
    other = rows.select(F.col("x").alias("y"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("map").alias("map2"), "u")
    least = threshold / (1.0 + threshold) * (F.col("n") + F.col("n2")) - 1e-9       # units that must be shared
    apart = sum((F.bit_count(F.col("map")[i].bitwiseXOR(F.col("map2")[i])) for i in range(MAP)), F.lit(0))
    can = ((F.col("x") < F.col("y")) & (F.col("c") != F.col("c2")) & (F.least("left", "left2") >= least)
           & (F.col("n") + F.col("n2") - apart >= 2.0 * least))
    return rows.join(other, "u").where(can).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def drop_near(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that stay: one of each class, all columns as they came."""
    kept = near_classes(docs, text, id_col).where("kept").select("_uid")
    uid = fresh("_row", docs)
    return with_uid(docs, uid).join(kept.withColumnRenamed("_uid", uid), uid, "left_semi").drop(uid)
