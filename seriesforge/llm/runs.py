"""Periodic runs of words: maximal stretches of consecutive words that repeat with a period.

Longest common extensions come from two Ukkonen suffix trees, of the words and of their reversal.  A tour of a tree gives
its leaves in order with the depth of the lowest common ancestor of neighbours; a range minimum over those depths is the
depth of the lowest common ancestor of any two leaves in constant time.  Every run has a Lyndon root, the longest Lyndon
word at some place under the order of words or its reverse, so each place gives two candidates, extended both ways.

A run of four periods repeats each of its four-grams.  Words outside such places cannot be in a run, so trees are built
only over the stretches that remain when this is applied until nothing changes; no run is lost by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, slices
from .common import buffer as text_buffer

SPACE = np.zeros(257, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
GRAM = 4
LEAST_WORDS, LEAST_PERIODS = 6, 4
RUN = "array<struct<start:long,length:long,period:long>>"


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte start, byte end of each word, word offsets per text); a word ends with its text."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    start, end = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    both = edge[inside[edge] & inside[edge + 1]]
    start[both] = True
    end[both] = True
    s = np.flatnonzero(start[:n])
    return s, np.flatnonzero(end), np.searchsorted(s, off)


def word_ids(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One number per distinct word, by its bytes."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1                  # no two words begin or end at one byte
    packed = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode().indices.to_numpy().astype(np.int64)


def repeated_stretches(ids: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges [from, to) outside which no run of four periods and six words can lie; a range stays in one text."""
    count = np.maximum(np.diff(off) - GRAM + 1, 0)
    at = np.repeat(off[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    group = np.repeat(np.arange(len(count)), count)
    if not len(at):
        return []
    gram = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            gram = mix64(gram + ids[at + k].astype(np.uint64), k)
    while True:
        with np.errstate(over="ignore"):
            h = mix64(gram + mix64(group, 9))
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return []
        found = np.searchsorted(twice, h)
        keep = twice[np.minimum(found, len(twice) - 1)] == h
        left, was = at[keep], group[keep]
        first = np.ones(len(left), bool)
        first[1:] = (left[1:] != left[:-1] + 1) | (was[1:] != was[:-1])
        number = np.cumsum(first) - 1
        long = (np.bincount(number) >= LEAST_WORDS - GRAM + 1)[number]
        if long.all() and len(left) == len(at):
            begin = left[first]
            return list(zip(begin.tolist(), (np.append(left[np.flatnonzero(first)[1:] - 1], left[-1]) + GRAM).tolist()))
        at, group, gram = left[long], number[long], gram[keep][long]
        if not len(at):
            return []


class SuffixTree:
    """Ukkonen's suffix tree of a list of small numbers, closed by an end mark that no word has."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, -1]
        n = len(s)
        self.symbols, self.size = s, n
        start, end, link, kids, suffix = [0], [0], [0], [{}], [-1]
        node = length = rest = edge = 0
        for i, c in enumerate(s):
            last = 0
            rest += 1
            while rest:
                if not length:
                    edge = i
                below = kids[node]
                kid = below.get(s[edge])
                if kid is None:
                    below[s[edge]] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    suffix.append(i - rest + 1)
                    if last:
                        link[last] = node
                    last = 0
                else:
                    a = start[kid]
                    span = end[kid] - a
                    if length >= span and kids[kid] is not None:
                        edge += span
                        length -= span
                        node = kid
                        continue
                    if s[a + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)          # inner node, then the new leaf
                    below[s[edge]] = split
                    start += (a, i)
                    end += (a + length, n)
                    link += (0, 0)
                    kids += ({s[a + length]: kid, c: split + 1}, None)
                    suffix += (-1, i - rest + 1)
                    start[kid] = a + length
                    if last:
                        link[last] = split
                    last = split
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.start, self.end, self.kids, self.suffix = start, end, kids, suffix

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in leaf order, depth of the lowest common ancestor of each leaf and the one before)."""
        start, end, kids, suffix = self.start, self.end, self.kids, self.suffix
        leaves, depths = [], []
        leaf, depth_of = leaves.append, depths.append
        stack = [(0, 0)]
        push, pop = stack.append, stack.pop
        while stack:
            node, above = pop()
            depth_of(above)             # of the first leaf below; its own place in the order is next
            while (below := kids[node]) is not None:
                above += end[node] - start[node]
                if len(below) == 2:
                    c, d = below
                    if c > d:
                        c, d = d, c
                    push((below[d], above))
                    node = below[c]
                    continue
                order = sorted(below)
                node = below[order[0]]
                stack += [(below[c], above) for c in order[:0:-1]]
            leaf(suffix[node])
        return np.array(leaves), np.array(depths)

    def falling(self) -> np.ndarray:
        """Suffixes in leaf order when words fall; the end mark stays the smallest."""
        kids, suffix = self.kids, self.suffix
        leaves, stack = [], [0]
        leaf, push, pop = leaves.append, stack.append, stack.pop
        while stack:
            node = pop()
            while (below := kids[node]) is not None:
                if len(below) == 2:
                    c, d = below
                    if c == -1 or d >= 0 and c > d:
                        c, d = d, c
                    push(below[c])
                    node = below[d]
                    continue
                order = sorted(below)
                if order[0] == -1:
                    order = [*order[1:], -1]
                stack += [below[c] for c in order[:-1]]
                node = below[order[-1]]
            leaf(suffix[node])
        return np.array(leaves)


class Extensions:
    """Longest common extension of any two suffixes: least depth between their leaves, over a table of powers of two."""

    def __init__(self, leaves: np.ndarray, depths: np.ndarray):
        n = len(leaves)
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.levels = [depths.astype(np.int32)]
        while (step := 1 << (len(self.levels) - 1)) * 2 <= n:
            up = self.levels[-1]
            self.levels.append(np.minimum(up[:-step], up[step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        out = np.zeros(len(lo), np.int64)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.levels[k][lo[m]], self.levels[k][hi[m] - (1 << k) + 1])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """Place of the next smaller suffix: the longest Lyndon word at i ends before it."""
    out, open_ = [0] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while open_ and open_[-1][0] > r:
            out[open_.pop()[1]] = i
        open_.append((r, i))
    return np.array(out)        # the end mark is smaller than all and closes every word


def find_runs(ids: np.ndarray, periods: int = LEAST_PERIODS, words: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, length, period) by start, then period: all runs of at least ``words`` words and ``periods`` periods
    (two at least)."""
    n = len(ids)
    if n < 2:
        return np.empty((0, 3), np.int64)
    symbols = np.unique(ids, return_inverse=True)[1]
    tree = SuffixTree(symbols.tolist())
    ahead = Extensions(*tree.tour())
    back = Extensions(*SuffixTree(symbols[::-1].tolist()).tour())
    falling = np.empty(n + 1, np.int64)
    falling[tree.falling()] = np.arange(n + 1)
    del tree
    places = np.arange(n)
    found = []
    for rank in (ahead.rank, falling):
        j = next_smaller(rank)[:n]
        q = j - places
        right = np.where(j < n, ahead(places, j), 0)
        left = np.zeros(n, np.int64)
        some = places > 0
        left[some] = back(n - places[some], n - j[some])
        length = left + q + right
        good = (length >= max(2, periods) * q) & (length >= words)
        found.append(np.stack([places - left, length, q], 1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of_each(parts: list[np.ndarray], periods: int, words: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each part from the trees of all, between marks that stand once and so are in no run."""
    if not parts:
        return []
    most = max(int(x.max()) for x in parts) + 1
    at = np.cumsum([0, *(len(x) + 1 for x in parts)])
    joined = np.concatenate([y for k, x in enumerate(parts) for y in (x, [most + k])])
    out: list[list] = [[] for _ in parts]
    for start, length, q in find_runs(joined, periods, words).tolist():
        k = int(np.searchsorted(at, start, side="right")) - 1
        out[k].append((start - int(at[k]), length, q))
    return out


def collapse(data: np.ndarray, s: np.ndarray, e: np.ndarray, wo: np.ndarray, off: np.ndarray, drop: np.ndarray) -> pa.Array:
    """Texts of the words that are not dropped, joined by one space."""
    kept = ~drop
    cum = np.concatenate([[0], np.cumsum(kept)])
    total = cum[wo[1:]]                                         # kept words up to the end of the text
    more = kept & (cum[1:] < np.repeat(total, np.diff(wo)))     # another kept word of the text follows
    out = data.copy()
    out[e[more]] = 32
    edge = np.zeros(len(data) + 2, np.int32)
    edge[s[kept]] += 1
    edge[e[kept] + more[kept]] -= 1
    mask = np.cumsum(edge[:len(data)]) > 0
    upto = np.concatenate([[0], np.cumsum(mask)])[off].astype(np.int32)
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(out[mask])))


def of_texts(texts: pa.Array, periods: int, words: int) -> tuple[list[list[tuple[int, int, int]]], pa.Array]:
    """(runs of each text, collapsed texts)."""
    data, off = text_buffer(texts)
    s, e, wo = words_of(data, off)
    runs: list[list] = [[] for _ in range(len(texts))]
    drop = np.zeros(len(s), bool)
    if len(s):
        ids = word_ids(data, s, e)
        places: dict[bytes, list[int]] = {}
        for a, b in repeated_stretches(ids, wo):
            places.setdefault(ids[a:b].tobytes(), []).append(a)
        for where, found in zip(places.values(), runs_of_each([np.frombuffer(k, np.int64) for k in places], periods, words)):
            for a in where:
                t = int(np.searchsorted(wo, a, side="right")) - 1
                for start, length, q in found:
                    drop[a + start + q:a + start + length] = True
                    runs[t].append((a + start - int(wo[t]), length, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs], collapse(data, s, e, wo, off, drop)


def periodic_runs(df: DataFrame, text: str = "text", periods: int = LEAST_PERIODS, words: int = LEAST_WORDS) -> DataFrame:
    """Columns of ``df`` plus ``runs`` (by start, then period) and ``collapsed``, the text in which of each run only the
    first period stays, words joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text and numbered from 0.  A run is a stretch with smallest period q
    that no neighbouring word extends, of at least ``words`` words and ``periods`` periods (at least four and six: the
    places looked at rest on that).  A null or empty text has no runs and an empty collapsed text; equal rows have equal results; an
    empty table gives an empty table; input columns named ``runs`` or ``collapsed`` are replaced.
    """
    if periods < LEAST_PERIODS or words < LEAST_WORDS:
        raise ValueError(f"at least {LEAST_PERIODS} periods and {LEAST_WORDS} words")
    carried = [c for c in df.columns if c not in ("runs", "collapsed")]
    own = df.select(*(F.col(f"`{c}`") for c in carried), F.col(text).alias("_words of")) if text != "_words of" else df
    schema = T.StructType([*df.select(*(F.col(f"`{c}`") for c in carried)).schema.fields, T.StructField("runs", T._parse_datatype_string(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_words of"):
                found, left = of_texts(part.column("_words of"), periods, words)
                rows = pa.array([[{"start": a, "length": b, "period": q} for a, b, q in r] for r in found], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carried))), rows, left], [*carried, "runs", "collapsed"])

    return own.mapInArrow(go, schema)


def strongest(runs: Column) -> Column:
    """Run of the greatest length over period; ties to the smallest start, then the smallest period; null without runs.

    Lengths and periods below 2^26 have a quotient of their own in double precision.
    """
    best = F.array_max(F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    return F.when(best.isNotNull(), F.struct((-best["s"]).alias("start"), best["n"].alias("length"), (-best["p"]).alias("period")))


def planted_period(doc_id: Column, text: Column) -> Column:
    """``text`` with a periodic tail in a tenth of the rows, chosen by crc32 of ``doc_id``; a null id changes nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")

    bound = F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit("")))[0]
    return F.when(F.pmod(h, F.lit(10)) == 0, bound).otherwise(text)
