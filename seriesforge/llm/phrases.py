"""Phrases whose words stand together more often than apart, mined by sampling with a negative border.

A sample of the texts proposes frequent phrases at a lowered threshold.  One full pass counts, exactly, all words and
every longer phrase whose two parts without the last and without the first word are proposed: the proposals and their
negative border, the phrases just beyond them.  A frequent phrase that was not proposed is a border failure; then an
expansion pass counts what may lie behind it: phrases of every length that no counted phrase rules out and that were not
counted yet.  As it takes all lengths at once, one expansion closes the set.

Proposals travel as a bit table of hashes (at most ``MOST_BITS``).  A false bit only makes a pass count more; so does a
table that gets full.  Counts are keyed by the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffer, mix64, saved, slices

LEAST, LONGEST, TOP = 100, 5, 2000
RATE = 8                        # one text in so many is in the sample
STEP_BYTES = 2_000_000          # text bytes counted together before rows leave a task
MOST_BITS = 1 << 28
SALTS = 64
BLANK, STOP = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]] = STOP
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
COUNTS = "lang string, k int, phrase string, c long"
WORDS_OF = "split(phrase, ' ')"


class Words:
    """Words of a buffer of texts of one language: their numbers, hashes and which places lie in one piece."""

    def __init__(self, texts: pa.Array, lang: str):
        data, off = buffer(texts)
        n = len(data)
        kind = KIND[data]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind == 0
        start, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
        both = edge[inside[edge] & inside[edge + 1]]            # a word ends with its text
        start[both] = True
        end[both] = True
        s, e = np.flatnonzero(start[:n]), np.flatnonzero(end)
        breaks = np.zeros(n + 1, np.int32)
        breaks[:n] = kind == STOP
        breaks[off[:-1]] += 1       # texts of no bytes share one place
        self.piece = np.cumsum(breaks[:n], dtype=np.int32)[s] if n else np.empty(0, np.int32)
        at = np.zeros(len(s) + 1, np.int64)
        np.cumsum(e - s, out=at[1:])
        packed = np.ascontiguousarray(LOWER[data[kind == 0]])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
        self.ids, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        seed = xxhash.xxh3_64_intdigest(lang)
        own = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.names.to_pylist()], np.uint64)
        self.h = own[self.ids] if len(s) else np.empty(0, np.uint64)

    def longer(self, h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of phrases one word longer than ``h``, which begin at ``at`` and get the word ``k`` places on."""
        with np.errstate(over="ignore"):
            return mix64(h[at] * np.uint64(0xD6E8FEB86659FD93) + self.h[at + k])

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """Words from ``at`` on, joined by a blank."""
        parts = [self.names.take(pa.array(self.ids[at + j])) for j in range(k)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
        return joined.cast(pa.binary()).cast(pa.string())


class Bits:
    """Set of hashes as a table of bits, two to a hash."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for x in (h & self.mask, (h >> np.uint64(32) ^ h << np.uint64(13)) & self.mask):
            out &= (self.bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bits_of(hashes: DataFrame) -> Bits:
    """Bit table of column ``h``, joined by an aggregate over its words: sixteen bits a hash until the bound."""
    m = hashes.count()
    size = min(MOST_BITS, max(1 << 16, 1 << math.ceil(math.log2(16 * m + 1))))
    place = F.array(F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseXOR(F.shiftleft("h", 13)).bitwiseAND(size - 1))
    words = (hashes.select(F.explode(place).alias("x")).select(F.shiftright("x", 6).alias("w"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("b"))
             .groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow())
    table = np.zeros(size // 64, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return Bits(table.view(np.uint8))


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts of it) in steps of bounded size."""
    langs = batch.column("lang")
    for lang in sorted(langs.unique().to_pylist()):
        for part in slices(batch.filter(pc.equal(langs, lang)), "text", STEP_BYTES):
            yield lang, part.column("text")


def next_places(w: Words, live: np.ndarray, k: int) -> np.ndarray:
    """Places of phrases of ``k`` words, in one piece, whose two parts of ``k - 1`` words are live."""
    n = len(live) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(live[:n] & live[1:n + 1] & (w.piece[:n] == w.piece[k - 1:]))


def proposals(w: Words, longest: int, pairs: Bits | None) -> Iterator[np.ndarray]:
    """Hashes of the sample's phrases: of one and two words, or of more whose pairs are all in ``pairs``."""
    live, h = np.ones(len(w.h), bool), w.h
    if pairs is None:
        yield h
    for k in range(2, longest + 1):
        at = next_places(w, live, k)
        longer = np.zeros(len(h), np.uint64)
        longer[at] = w.longer(h, at, k - 1)
        live = np.zeros(len(h), bool)
        live[at] = True
        h = longer
        if pairs is None:
            yield h[at]
            return
        if k == 2:
            live[at] = pairs(h[at])
        else:
            yield h[at]


def counted(w: Words, longest: int, proposed: Bits, frequent: Bits | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first places, counts) of the phrases that a pass counts.

    Without ``frequent``: all words, and phrases whose parts are proposed.  With it, the expansion: phrases not counted
    so, none of whose parts was counted and found rare.
    """
    n = len(w.h)
    dense, h = w.ids, w.h
    own = proposed(h)
    live = own if frequent is None else frequent(h)
    if frequent is None and n:
        first = np.empty(len(w.names), np.int64)
        first[w.ids[::-1]] = np.arange(n - 1, -1, -1)
        yield 1, first, np.bincount(w.ids)
    for k in range(2, longest + 1):
        at = next_places(w, live, k)
        if not len(at):
            return
        codes, names = pd.factorize(dense[at] * len(w.names) + w.ids[at + k - 1])
        dense = np.zeros(n, np.int64)
        dense[at] = codes
        longer = np.zeros(n, np.uint64)
        longer[at] = w.longer(h, at, k - 1)
        h = longer
        done = own[at] & own[at + 1]
        own = np.zeros(n, bool)
        own[at] = done & proposed(h[at])
        if frequent is None:
            live, emit = own, np.ones(len(names), bool)
        else:
            live = np.zeros(n, bool)
            live[at] = ~done | frequent(h[at])
            emit = np.zeros(len(names), bool)
            emit[codes[~done]] = True
        first = np.empty(len(names), np.int64)
        first[codes[::-1]] = at[::-1]
        yield k, first[emit], np.bincount(codes, minlength=len(names))[emit]


def count_pass(docs: DataFrame, longest: int, least: int, proposed: Bits, frequent: Bits | None = None) -> DataFrame:
    """(lang, k, phrase, c) of the frequent phrases of a pass; the first also has all words of a language (k = 0)."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((proposed.bits, frequent and frequent.bits))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        a, b = Bits(a), None if b is None else Bits(b)
        for batch in batches:
            for lang, texts in by_lang(batch):
                w = Words(texts, lang)
                if b is None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([len(w.h)])], ["lang", "k", "phrase", "c"])
                for k, at, c in counted(w, longest, a, b):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(c), np.int64))), pa.array(np.full(len(c), k, np.int32)), w.phrases(at, k), pa.array(c)], ["lang", "k", "phrase", "c"])

    rows = docs.mapInArrow(go, COUNTS)
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c")).where((F.col("k") == 0) | (F.col("c") >= least))


def proposed_phrases(docs: DataFrame, longest: int, least: int, rate: int) -> Bits:
    """Hashes of phrases frequent in the sample: words and pairs first, then longer ones of frequent pairs."""
    sample = docs.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rate)) == 0)
    expected = least / rate
    lowered = max(1, math.floor(expected - 2.5 * math.sqrt(expected)))

    def hashes(pairs: Bits | None) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(pairs and pairs.bits)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None if shared.value is None else Bits(shared.value)
            for batch in batches:
                for lang, texts in by_lang(batch):
                    for h in proposals(Words(texts, lang), longest, known):
                        codes, names = pd.factorize(h)
                        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(codes, minlength=len(names)))], ["h", "c"])

        return saved(sample.mapInArrow(go, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= lowered).select("h"))

    short = hashes(None)
    if longest < 3:
        return bits_of(short)
    return bits_of(short.unionByName(hashes(bits_of(short))))


def phrase_hashes(counts: DataFrame) -> DataFrame:
    """Column ``h`` of each phrase, as its places in texts have it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in by_lang(batch):
                w = Words(texts, lang)
                first = np.searchsorted(w.piece, np.unique(w.piece))
                size = np.diff(np.append(first, len(w.piece)))
                h = w.h.copy()
                out = w.h[first]
                for k in range(2, int(size.max(initial=0)) + 1):
                    at = first[size >= k]
                    h[at] = w.longer(h, at, k - 1)
                    out[size >= k] = h[at]
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["h"])

    return counts.where("k > 0").select("lang", F.col("phrase").alias("text")).mapInArrow(go, "h long")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, rate: int = RATE) -> tuple[DataFrame, int]:
    """((lang, k, phrase, c) of all phrases of 1 to ``longest`` words that stand ``least`` times or more, with the words of
    a language at k = 0; passes over all rows)."""
    own = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    proposed = proposed_phrases(own, longest, least, rate)
    first = saved(count_pass(own, longest, least, proposed))
    hashes = saved(phrase_hashes(first))
    bits = docs.sparkSession.sparkContext.broadcast(proposed.bits)

    def failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(bits.value)
        for batch in batches:
            yield batch.filter(pa.array(~known(batch.column("h").to_numpy().view(np.uint64))))

    if hashes.mapInArrow(failed, "h long").isEmpty():
        return first, 1
    return first.unionByName(saved(count_pass(own, longest, least, proposed, bits_of(hashes)))), 2


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, rate: int = RATE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language.

    A to Z are lowered; a text is cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``.  With n
    words in the language and a phrase that stands ``a`` times, each cut into first and rest, standing l and r times, has
    the score floor(1000 a n / (l r)); the lowest counts, ties to the shortest first part.  A phrase that stands only
    inside one longer candidate (equal counts) is left out.  Ranked by score, then a, both falling, then phrase by bytes.
    A null text is empty, a null language ``und``; repeated rows count each; an empty table gives no rows; other columns
    are not read.
    """
    counts, _ = frequent_phrases(docs, text, lang, least, longest, rate)
    found = counts.where("k > 1")
    part = lambda a, size: F.array_join(F.slice(F.expr(WORDS_OF), a, size), " ")
    inner = (found.where("k > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), "c").distinct())
    kept = found.join(inner, ["lang", "phrase", "c"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("c").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("_first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_rest"))
    known = counts.where("k > 0")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_first"), F.col("c").alias("l")), ["lang", "_first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("_rest"), F.col("c").alias("r")), ["lang", "_rest"])
    salted = counts.where("k = 0").select("lang", F.col("c").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    cuts = cuts.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"])
    score = F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = Window.partitionBy("lang", "_salt").orderBy(*order)
    best = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top).drop("_salt")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
