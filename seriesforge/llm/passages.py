"""Substring dedup by compact windows.

The tokens of a text are its five-word shingles; ``GRAM`` of them in a row, ten words, are hashed together.  The Cartesian
tree of these hashes splits the subsequences of a text into compact windows (l, c, r): all that lie in [l, r] and hold c
have gram c as their minimum.  Only windows that hold all grams of ``RUN`` tokens matter, about one in eight tokens is a
centre; the centres are the minima of sliding windows, and left and right ends follow from the tree over these alone.

Windows meet by signature, the minimum alone, so two texts with ``RUN`` equal tokens in a row always meet.  A passage of 0.8
has such a run: a changed, new or lost word costs nine tokens at least (of both sides together), one gap leaves 41 equal
tokens of 46, and m gaps leave 36 m in m + 1 runs.  (Where tokens repeat inside a passage a gap may cost less, and a passage
without such a run is then not promised.)

Each signature links its windows to its first documents, one after another; then equal stretches meet by their full hash,
and what is still open meets every other document of its signature whose text is new and that has ``RUN`` equal tokens
there.  Pairs are verified on their tokens: from each signature an alignment grows both ways over small edits, and a
passage counts from 50 words and a similarity of 0.8 (Jaccard share of its shingles).

Null and empty texts and texts below 50 words have no window and yield no rows, nor do passages repeated inside one
text alone.  The document that comes first in the input is the source; repeated rows count as documents of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix64, ragged, saved, slices, with_uid
from .pretokens import _powers
from .words import IS_WORD, SHINGLE, shingle_hashes, word_hashes

WORDS = 50
LEAST = WORDS - SHINGLE + 1
GRAM = SHINGLE + 1          # tokens of a gram: two shingles side by side
RUN = 21                    # equal tokens in a row that every passage has
SIDE = (RUN - GRAM + 2) // 2    # equal tokens that such a run has on one side of its gram at least
ROUNDS = 3                  # documents of a signature that later ones are aligned with one after another, before all others
THRESHOLD = 0.8
GAP = 3 * SHINGLE           # tokens that an edit may disturb inside a passage
REACH = 8 * LEAST           # tokens around a gram by which pairs are told apart before they are aligned
PART = 512                  # sources of a stretch that a task holds


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i:i+width] for each i; the tail repeats shorter windows."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def compact_windows(g: np.ndarray, off: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of all compact windows of at least ``least`` tokens; positions in the buffer."""
    n = len(g)
    none = np.empty(0, np.int64)
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(off)
    fit = size >= least
    np.add.at(ok, off[:-1][fit], 1)
    np.add.at(ok, off[1:][fit] - least + 1, -1)
    whole = np.cumsum(ok)[:n] > 0               # a window starting here stays in its text
    if not whole.any():
        return none, none, none
    low = np.where(whole, _slide(g, least, np.minimum), np.uint64(0))
    high = low.copy()                           # largest minimum of the windows that hold a place
    have = 1
    while have < least:
        step = min(have, least - have)
        high[step:] = np.maximum(high[step:], high[:-step].copy())
        have += step
    c = np.flatnonzero((high == g) & (g > 0))
    text = np.searchsorted(off, c, side="right") - 1
    values, own = g[c].tolist(), text.tolist()
    left, right, stack, now = [0] * len(c), [0] * len(c), [], -1
    at, begin, end = c.tolist(), off[:-1].tolist(), off[1:].tolist()
    for k, v in enumerate(values):
        if own[k] != now:
            for s in stack:
                right[s] = end[now] - 1
            stack, now = [], own[k]
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = at[k] - 1
        left[k] = at[stack[-1]] + 1 if stack else begin[now]
        stack.append(k)
    for s in stack:
        right[s] = end[now] - 1
    return c, np.array(left, np.int64), np.array(right, np.int64)


def grams(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram and gram offsets per text; gram i of a text starts at its token i."""
    n = np.maximum(np.diff(off) - GRAM + 1, 0)
    at = ragged(off[:-1], n)
    with np.errstate(over="ignore"):
        return mix64(sh[at] + mix64(sh[at + SHINGLE], 7), 100), np.append(0, np.cumsum(n))


def windows(docs: DataFrame) -> DataFrame:
    """key, _uid, c, l, r: the signature of each window and its interval of grams in the text."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                g, off = grams(*shingle_hashes(*word_hashes(batch.column("text"))[:2]))
                uid = batch.column("_uid").to_numpy(zero_copy_only=False)
                c, l, r = compact_windows(g, off, RUN - GRAM + 1)
                t = np.searchsorted(off, c, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(g[c].view(np.int64)), pa.array(uid[t]), *(pa.array((x - off[t]).astype(np.int32)) for x in (c, l, r))],
                                                 ["key", "_uid", "c", "l", "r"])
    return docs.mapInArrow(run, "key long, _uid long, c int, l int, r int")


def shared_windows(docs: DataFrame) -> DataFrame:
    """Windows whose signature stands in two documents at least."""
    several = saved(windows(docs).groupBy("key").agg(F.min("_uid").alias("x"), F.max("_uid").alias("y")).where("x < y").select("key"))
    return saved(windows(docs).join(several, "key"))


def opened(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """``rows`` with ``open``: whether the centre lies outside all passages already found (``settled``: _uid, spans)."""
    inside = F.exists("spans", lambda x: (x["s"] <= F.col("c")) & (F.col("c") < x["e"]))
    return rows.join(settled, "_uid", "left").withColumn("open", ~F.coalesce(inside, F.lit(False))).drop("spans")


def linked(members: DataFrame, settled: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of each signature's first document with all later ones, and the windows of those later ones.

    Windows inside a passage already found seek no source any more, but stay as sources of others; a signature that
    nobody seeks goes."""
    if settled is not None:
        marked = saved(opened(members, settled))
        seeks = saved(marked.where("open").select("key").distinct())
        members = marked.join(seeks, "key")
    lead = (members.groupBy("key").agg(F.min(F.struct("_uid", "c")).alias("f"), F.min(F.struct("_uid", -F.col("c"))).alias("g"), F.max("_uid").alias("last"))
            .where("last > f._uid").select("key", F.col("f._uid").alias("a"), F.col("f.c").alias("ca0"), (-F.col("g.col2")).alias("ca1")))
    rest = saved(members.join(saved(lead), "key").where("_uid > a"))
    seek = (rest if settled is None else rest.where("open")).withColumn("cs", F.array("c"))
    return _pairs(seek), rest.select("key", "_uid", "c", "l", "r")


class Around:
    """Tokens of many sources around one gram: each token with its source and with how many different tokens of the source lie
    between it and the gram, itself included (negative before the gram, 0 inside)."""

    def __init__(self, held: list[np.ndarray], at: list[int], once: list[bool]):
        far = []
        for x, g in zip(held, at):
            new = np.zeros(len(x), np.int32)
            new[np.unique(x, return_index=True)[1]] = 1
            far.append(np.concatenate([-np.cumsum(new[:g][::-1])[::-1], np.zeros(len(x[g:g + GRAM]), np.int32), np.cumsum(new[g + GRAM:])]))
        all_, far = np.concatenate(held), np.concatenate(far)
        order = np.lexsort((-np.abs(far), all_))
        self.n, self.once = len(held), np.array(once)
        self.ranked, self.far, self.owner = all_[order], far[order], np.repeat(np.arange(len(held)), [len(x) for x in held])[order]

    def hopeful(self, x: np.ndarray, at: int, rest: tuple[int, int]) -> np.ndarray:
        """Which sources may have a passage through the gram at ``at`` of the tokens ``x``.

        A passage begins and ends with a token of the source, its shared tokens are ``THRESHOLD`` of all, and never more than
        ``GAP`` side by side are none of the source's.  ``rest`` counts the tokens before and after ``x``, which may all be
        equal.  Repeated tokens count once at most where they are lost, and where the source has the gram many times
        (not ``once``) what it loses is not counted."""
        lo, hi = np.searchsorted(self.ranked, x, "left"), np.searchsorted(self.ranked, x, "right")
        hit = ragged(lo, hi - lo)
        own, place, far = self.owner[hit], np.repeat(np.arange(len(x)), hi - lo), self.far[hit]
        good = np.zeros((self.n, len(x)), bool)
        good[own, place] = True
        away = np.full((self.n, len(x)), np.inf, np.float32)
        fits = ((place < at) & (far < 0)) | ((place >= at + GRAM) & (far > 0))
        away[own[fits], place[fits]] = np.abs(far[fits])        # of many the nearest comes last
        new = np.zeros(len(x), bool)
        new[np.unique(x, return_index=True)[1]] = True

        def side(cols: slice, turn: int, more: int) -> np.ndarray:
            """Best balance of shared and lost tokens of the stretches of k tokens at least, for each k, outwards."""
            ok, lost, away_ = good[:, cols][:, ::turn], (~good & new)[:, cols][:, ::turn], away[:, cols][:, ::turn]
            size = ok.shape[1]
            far = np.arange(1, size + 1)
            dead = far - np.maximum.accumulate(np.where(ok, far, 0), axis=1) > GAP
            dead = np.logical_or.accumulate(dead, axis=1)
            shared, gone = np.cumsum(ok, axis=1, dtype=np.float32), np.cumsum(lost, axis=1, dtype=np.float32)
            loose = (1 - THRESHOLD) * shared - THRESHOLD * gone
            out = np.full((self.n, max(size + 1, LEAST - GRAM + 1) + 1), -np.inf, np.float32)
            out[:, 0] = 0
            out[:, 1:size + 1] = np.where(dead | ~ok, -np.inf, np.where(self.once[:, None], shared - THRESHOLD * (gone + away_), loose))
            if more:                                # stretches that leave x count as long enough
                out[:, -1] = np.where(dead[:, -1], -np.inf, loose[:, -1] + (1 - THRESHOLD) * more) if size else (1 - THRESHOLD) * more
            return np.maximum.accumulate(out[:, ::-1], axis=1)[:, ::-1]

        left, right = side(slice(0, at), -1, rest[0]), side(slice(at + GRAM, None), 1, rest[1])
        i = np.arange(LEAST - GRAM + 1)
        return (left[:, i] + right[:, LEAST - GRAM - i]).max(axis=1) + GRAM * (1 - THRESHOLD) >= -1e-3


def remaining(left: DataFrame, settled: DataFrame, tok: DataFrame) -> DataFrame:
    """Pairs (a, b) of the windows still open with all earlier documents of their signature, whatever their number, that may
    have a passage there.

    Of documents with equal tokens the first stands for all.  A run of ``RUN`` tokens that holds the gram has ``SIDE``
    tokens before or after it, so windows meet by these as well.  Stretches of one token alone (a word written many times)
    do not meet: what is equal for ``LEAST`` tokens is found as that, and two runs around a gap hold 36 different tokens, so
    one of them goes through such stretches and their surroundings meet.

    Sources of a stretch are dealt into parts of about ``PART``; every open window meets every part, and only pairs that
    ``Around.hopeful`` leaves become rows."""
    marked = saved(opened(left, settled))
    marked = marked.join(saved(marked.where("open").select("key").distinct()), "key")
    own = tok.join(saved(marked.select("_uid").distinct()).hint("merge"), "_uid", "left_semi")
    text = saved(own.select("_uid", F.sha2("tokens", 256).alias("h")))
    first = saved(text.groupBy("h").agg(F.min("_uid").alias("_uid")).select("_uid", F.lit(True).alias("new")))
    size = (F.octet_length("tokens") / 4).cast("int")
    part = lambda lo, n: F.substring(F.col("tokens"), lo * 4 + 1, F.lit(n * 4))
    wide = lambda lo: F.when((lo >= 0) & (lo + GRAM + SIDE <= size) & (part(lo, GRAM + SIDE - 1) != part(lo + 1, GRAM + SIDE - 1)), F.xxhash64(part(lo, GRAM + SIDE)))
    sides = F.array(F.struct(F.lit(0).alias("side"), wide(F.col("c") - SIDE).alias("h")), F.struct(F.lit(1).alias("side"), wide(F.col("c")).alias("h")))
    rows = marked.join(tok, "_uid").join(first, "_uid", "left").select("key", "_uid", "c", "l", "r", "open", "new", F.explode(sides).alias("x"))
    rows = saved(rows.where("x.h is not null").select("key", "x.side", "x.h", "_uid", "c", "l", "r", "open", "new"))
    place = ["key", "side", "h"]        # a text may hold a stretch many times
    source = saved(rows.where("new").groupBy(*place, F.col("_uid").alias("a")).agg(F.min("c").alias("c"), F.max("c").alias("last")))
    several = saved(source.groupBy(*place).agg(F.min("a").alias("a"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
                    .join(rows.where("open").groupBy(*place).agg(F.max("_uid").alias("b")).hint("merge"), place).where("a < b").select(*place, "a", "parts"))
    seek = rows.where("open").join(several.hint("merge"), place).where("a < _uid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    source = source.join(several.drop("a").hint("merge"), place).withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int"))
    cut = lambda lo, hi: F.substring(F.col("tokens"), lo * 4 + 1, (hi - lo) * 4)
    seek = seek.withColumns({"lo": F.greatest(F.col("c") - REACH, F.lit(0)), "hi": F.col("c") + GRAM + REACH, "last": F.col("c"), "seeks": F.lit(True)})
    source = source.withColumns({"lo": F.greatest(F.col("c") - 2 * REACH, F.lit(0)), "hi": F.col("last") + GRAM + 2 * REACH, "l": F.lit(0), "r": F.lit(0), "seeks": F.lit(False)}).withColumnRenamed("a", "_uid")
    group = [*place, "part"]
    cols = [*group, "seeks", "_uid", "c", "last", "l", "r", "lo"]
    both = seek.select(*cols, "hi").unionByName(source.select(*cols, "hi")).hint("merge").join(tok, "_uid").select(*cols, size.alias("size"), cut(F.col("lo"), F.col("hi")).alias("t"))
    both = both.repartition(*group).sortWithinPartitions(*group, "seeks")

    def run(batches):
        now, uid, spans, held, index = None, [], [], [], None
        for batch in batches:
            out = []
            names = [batch.column(c).to_pylist() for c in [*group, "seeks", "_uid", "c", "last", "l", "r", "lo", "size"]]
            for *g, seeks, u, c, last, l, r, lo, n, t in zip(*names, batch.column("t")):
                if g != now:
                    now, uid, spans, held, index = g, [], [], [], None
                x = np.frombuffer(t.as_buffer(), np.uint32)
                if not seeks:
                    uid.append(u)
                    spans.append((c, last, c - lo))
                    held.append(x.copy())
                    continue
                if not uid:
                    continue
                if index is None:
                    index, ids = Around(held, [p[2] for p in spans], [p[0] == p[1] for p in spans]), np.array(uid, np.int64)
                for k in np.flatnonzero(index.hopeful(x, c - lo, (lo, n - lo - len(x))) & (ids < u)).tolist():
                    out.append((uid[k], u, *spans[k][:2], c, l, r))
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k < 2 else pa.int32()) for k, v in enumerate(columns)], ["a", "_uid", "ca0", "ca1", "c", "l", "r"])

    met = saved(both.mapInArrow(run, "a long, _uid long, ca0 int, ca1 int, c int, l int, r int"))
    return _pairs(met.withColumn("cs", F.array("c")))


def _pairs(met: DataFrame) -> DataFrame:
    got = met.groupBy("a", F.col("_uid").alias("b")).agg(F.min("ca0").alias("a0"), F.max("ca1").alias("a1"), F.min("l").alias("bl"), F.max("r").alias("br"),
                                                         F.array_distinct(F.flatten(F.collect_list("cs"))).alias("cs"))
    return saved(got.withColumns({"b0": F.array_min("cs"), "b1": F.array_max("cs")}))


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the equal run at the start of both."""
    have, step, most = 0, 64, min(len(a), len(b))
    while have < most:
        upto = min(have + step, most)
        x = a[have:upto] != b[have:upto]
        if x.any():
            return have + int(x.argmax())
        have, step = min(have + step, most), step * 4
    return most


def _grow(a: np.ndarray, b: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, length) that follow each other from the start of both, gaps up to ``gap``."""
    out, i, j = [], 0, 0
    while True:
        n = _run(a[i:], b[j:])
        if n:
            out.append((i, j, n))
            i, j = i + n, j + n
        same = a[i:i + gap + 1, None] == b[None, j:j + gap + 1]
        if not same.any():
            return out
        x, y = np.nonzero(same)
        k = int((x + y).argmin())
        i, j = i + int(x[k]), j + int(y[k])


def _balance(runs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the runs; for each run as the last and as the first of a stretch, the balance of shared and other tokens up to
    there: a stretch holds ``threshold`` shared ones if it is no less at its last run than at its first."""
    ends = runs[:, :2] + runs[:, 2:]
    loss = np.append(0, (runs[1:, :2] - ends[:-1]).sum(axis=1) * threshold)
    upto = np.cumsum((1.0 - threshold) * runs[:, 2] - loss)
    return ends, upto, np.append(0.0, upto[:-1]) - loss


def _longest(runs: np.ndarray, ends: np.ndarray, upto: np.ndarray, before: np.ndarray, lo: int, hi: int, s: int, e: int) -> tuple[int, int] | None:
    """Longest stretch inside [lo, hi) that begins by run ``s`` and ends from run ``e`` on and holds enough shared tokens."""
    high = np.maximum.accumulate(upto[e:hi][::-1])[::-1]        # falls, so the last run that still pays is found by bisection
    last = hi - np.searchsorted(high[::-1], before[lo:s + 1] - 1e-9, side="left") - 1
    last = np.where(last >= np.maximum(np.arange(lo, s + 1), e), last, -1)
    size = np.where(last >= 0, ends[last, 1] - runs[lo:s + 1, 1], -1)
    k = int(size.argmax())
    return (lo + k, int(last[k]) + 1) if size[k] >= 0 else None


def _best(runs: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Longest stretches of runs, first to last, whose shared tokens are ``threshold`` of all; the longest goes first."""
    ends, upto, before = _balance(runs, threshold)
    out, todo = [], [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        s, e = _longest(runs, ends, upto, before, lo, hi, hi - 1, lo)
        out.append((s, e))
        todo += [(lo, s), (e, hi)]
    return out


def _passage(a: np.ndarray, b: np.ndarray, runs: np.ndarray, least: int, threshold: float) -> tuple[int, int, int, int, float] | None:
    """The stretch from the first to the last of ``runs``, if it is long and similar enough."""
    (a0, b0), (a1, b1) = runs[0, :2].tolist(), (runs[-1, :2] + runs[-1, 2]).tolist()
    if b1 - b0 < least or a1 - a0 < least:
        return None
    x, y = np.unique(a[a0:a1]), np.unique(b[b0:b1])
    both = len(np.intersect1d(x, y, assume_unique=True))
    sim = both / (len(x) + len(y) - both)
    return (a0, a1, b0, b1, sim) if sim >= threshold else None


def passages(a: np.ndarray, b: np.ndarray, anchors: np.ndarray | None = None, least: int = LEAST, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, float]]:
    """(start, end) in a and in b, in tokens, and similarity of the passages that ``b`` repeats from ``a``.

    From each place of b in ``anchors`` (all, unless given) and every place of that token in a the alignment grows both
    ways, over edits of up to ``GAP`` tokens."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    anchors = np.arange(len(b)) if anchors is None else np.unique(anchors)
    first, last = np.searchsorted(ranked, b[anchors], "left"), np.searchsorted(ranked, b[anchors], "right")
    out: list[tuple[int, int, int, int, float]] = []
    seen: set[tuple[int, int]] = set()          # (place in b, diagonal) of anchors inside alignments that were tried
    at = dict(zip(anchors.tolist(), zip(first.tolist(), last.tolist())))
    for j, (lo, hi) in at.items():
        if any(p[2] <= j < p[3] for p in out):
            continue
        for i in order[lo:hi].tolist():
            if (j, i - j) in seen:
                continue
            back = [(i + 1 - x - n, j + 1 - y - n, n) for x, y, n in _grow(a[i::-1], b[j::-1], GAP)][::-1]
            runs = back[:-1] + [(back[-1][0], back[-1][1], back[-1][2] + _run(a[i + 1:], b[j + 1:]))]
            end_a, end_b = runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]
            runs += [(end_a + x, end_b + y, n) for x, y, n in _grow(a[end_a:], b[end_b:], GAP)]
            for x, y, n in runs:
                own = anchors[np.searchsorted(anchors, y):np.searchsorted(anchors, y + n)]
                seen.update((k, x - y) for k in own.tolist())
            if runs[-1][1] + runs[-1][2] - runs[0][1] < least:
                continue
            runs = np.array(runs, np.int64)
            out += [p for s, e in _best(runs, threshold) if (p := _passage(a, b, runs[s:e], least, threshold))]
            if not any(p[2] <= j < p[3] for p in out):          # the longest may lie beside the anchor and overlap one through it
                k = int(np.searchsorted(runs[:, 1], j, "right")) - 1
                through = _longest(runs, *_balance(runs, threshold), 0, len(runs), k, k)
                if through and (p := _passage(a, b, runs[through[0]:through[1]], least, threshold)):
                    out.append(p)
            if any(p[2] <= j < p[3] for p in out):
                break
    return sorted(set(out), key=lambda p: p[2])


def tokens(docs: DataFrame) -> DataFrame:
    """_uid, tokens binary: the upper 32 bits of the shingle hashes in text order (a passage needs 46 of them)."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sh, off = shingle_hashes(*word_hashes(batch.column("text"))[:2])
                low = (sh >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([batch.column("_uid"), pa.array([low[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())],
                                                 ["_uid", "tokens"])
    return docs.mapInArrow(run, "_uid long, tokens binary")


FOUND = "a long, b long, source_start int, source_end int, start_word int, end_word int, similarity double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.float64()])],
                                      ["a", "b", "source_start", "source_end", "start_word", "end_word", "similarity"])


def verified(pairs: DataFrame, tok: DataFrame) -> DataFrame:
    """Passages of each pair around its signatures; places inside a passage that ``b`` has from a document met before are
    not tried again."""
    # past its outermost runs of ``RUN`` tokens a passage goes on for less than twice what they hold
    reach = F.lit(4 * LEAST)
    wide = 2 * (F.col("b1") - F.col("b0")) + reach
    near = pairs.withColumns({"lo_b": F.greatest(F.col("bl") - wide, F.lit(0)), "hi_b": F.col("br") + GRAM + wide})
    near = near.withColumns({"lo_a": F.greatest(F.col("a0") - F.ceil((F.col("b1") - F.col("lo_b")) * 1.25).cast("int") - reach, F.lit(0)),
                             "hi_a": F.col("a1") + F.ceil((F.col("hi_b") - F.col("b0")) * 1.25).cast("int") + reach})
    cut = lambda lo, hi: F.substring(F.col("tokens"), F.col(lo) * 4 + 1, (F.col(hi) - F.col(lo)) * 4)
    with_a = near.join(tok.withColumnRenamed("_uid", "a"), "a").select("a", "b", "lo_a", "lo_b", "hi_b", "cs", cut("lo_a", "hi_a").alias("ta"))
    with_b = with_a.hint("merge").join(tok.withColumnRenamed("_uid", "b"), "b").select("a", "b", "lo_a", "lo_b", "cs", "ta", cut("lo_b", "hi_b").alias("tb")).sortWithinPartitions("b", "a")

    def run(batches):
        now, spans = None, []
        for batch in batches:
            rows = []
            for a, b, lo_a, lo_b, cs, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "lo_a", "lo_b", "cs", "ta", "tb"))):
                x, y = np.frombuffer(ta.as_buffer(), np.uint32), np.frombuffer(tb.as_buffer(), np.uint32)
                da, db = lo_a.as_py(), lo_b.as_py()
                if b.as_py() != now:
                    now, spans = b.as_py(), []
                at = np.array(cs.as_py(), np.int64)
                for p, q in spans:
                    at = at[(at < p) | (at >= q)]
                for a0, a1, b0, b1, sim in passages(x, y, at - db) if len(at) else []:
                    spans.append((b0 + db, b1 + db))
                    rows.append((a.as_py(), b.as_py(), a0 + da, a1 + da + SHINGLE - 1, b0 + db, b1 + db + SHINGLE - 1, sim))
            yield _found(rows)

    return saved(with_b.mapInArrow(run, FOUND))


def spans_of(found: DataFrame) -> DataFrame:
    """_uid, spans: the token intervals [s, e) of each document's passages."""
    one = F.struct(F.col("start_word").alias("s"), (F.col("end_word") - SHINGLE + 1).alias("e"))
    return saved(found.groupBy(F.col("b").alias("_uid")).agg(F.collect_list(one).alias("spans")))


def equal_stretches(members: DataFrame, tok: DataFrame, settled: DataFrame) -> DataFrame:
    """Equal passages that are not yet inside a found one, whatever other documents share their signatures.

    A stretch of ``LEAST`` tokens has one smallest gram, so it belongs to one window; the stretches of windows whose
    signature still has an open one are joined by the hash of all their tokens."""
    held = LEAST - GRAM + 1
    members = members.where(F.col("r") - F.col("l") + 1 >= held)

    def starts(w):
        c, l, r = (np.array([x[k] for x in w], np.int64) for k in ("c", "l", "r"))
        lo, hi = np.maximum(l, c - held + 1), np.minimum(c, r - held + 1)
        n = np.maximum(hi - lo + 1, 0)
        return ragged(lo, n), np.repeat(np.array([x["key"] for x in w], np.int64), n)

    def uncovered(at, spans):
        out = np.ones(len(at), bool)
        for x in spans or []:
            out &= ~((at >= x["s"]) & (at + LEAST <= x["e"]))
        return out

    def keys(batches):
        for batch in batches:
            for w, spans in zip(batch.column("w"), batch.column("spans")):
                at, key = starts(w.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[uncovered(at, spans.as_py())]))], ["key"])

    def hashes(batches):
        for batch in batches:
            for uid, w, spans, t in zip(*(batch.column(c) for c in ("_uid", "w", "spans", "tokens"))):
                at, _ = starts(w.as_py())
                x = np.frombuffer(t.as_buffer(), np.uint32).astype(np.uint64)
                power, inverse = _powers(len(x))
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(x) + 1, np.uint64)
                    np.cumsum(mix64(x, 31) * power, out=sums[1:])
                    h = mix64((sums[at + LEAST] - sums[at]) * inverse[at], 33)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(at), uid.as_py(), np.int64)), pa.array(at.astype(np.int32)), pa.array(uncovered(at, spans.as_py()))],
                                                 ["h", "_uid", "i", "open"])

    # the first document of a signature has nothing before it
    leads = saved(members.groupBy("key").agg(F.min("_uid").alias("a")))
    seeks = members.join(leads, "key").where("_uid > a")
    seeks = seeks.groupBy("_uid").agg(F.collect_list(F.struct("key", "c", "l", "r")).alias("w"))
    open_ = saved(seeks.join(settled, "_uid", "left").mapInArrow(keys, "key long").distinct())
    part = members.join(open_, "key").groupBy("_uid").agg(F.collect_list(F.struct("key", "c", "l", "r")).alias("w"))
    rows = saved(part.join(settled, "_uid", "left").join(tok, "_uid").mapInArrow(hashes, "h long, _uid long, i int, open boolean"))
    first = rows.groupBy("h").agg(F.min(F.struct("_uid", "i")).alias("f"), F.max("_uid").alias("last")).where("last > f._uid").select("h", F.col("f._uid").alias("a"), F.col("f.i").alias("ia"))
    met = rows.where("open").join(saved(first), "h").where("_uid > a").groupBy("a", F.col("_uid").alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "ia"))).alias("at"))

    def joined(batches):
        for batch in batches:
            out = []
            for a, b, at in zip(*(batch.column(c) for c in ("a", "b", "at"))):
                i, ia = (np.array([x[k] for x in at.as_py()], np.int64) for k in ("i", "ia"))
                cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(ia) != 1)) + 1
                for s, e in zip(np.append(0, cut).tolist(), np.append(cut, len(i)).tolist()):
                    n = e - s + WORDS - 1
                    out.append((a.as_py(), b.as_py(), int(ia[s]), int(ia[s]) + n, int(i[s]), int(i[s]) + n, 1.0))
            yield _found(out)

    return saved(met.mapInArrow(joined, FOUND))


def repeated_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per passage that a document repeats from an earlier one: _uid, doc_id, start_word, end_word, source_id,
    source_start, source_end, similarity (word positions, ends excluded)."""
    base = with_uid(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    members = shared_windows(base)
    needed = saved(members.select("_uid").distinct())
    tok = saved(tokens(base.join(needed.hint("merge"), "_uid", "left_semi").select("_uid", "text")))
    found = settled = None
    left = members
    for _ in range(rounds):
        pairs, left = linked(left, settled)
        new = verified(pairs, tok)
        found = new if found is None else found.unionByName(new)
        settled = spans_of(found)
    found = found.unionByName(equal_stretches(members, tok, settled))
    settled = spans_of(found)
    found = found.unionByName(verified(remaining(left, settled, tok), tok))
    ids = base.select("_uid", "doc_id")
    return (found.join(ids.select(F.col("_uid").alias("a"), F.col("doc_id").alias("source_id")), "a")
            .join(ids.withColumnRenamed("_uid", "b"), "b")
            .select(F.col("b").alias("_uid"), "doc_id", "start_word", "end_word", "source_id", "source_start", "source_end", "similarity"))


def cut_passages(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the passages that an earlier document has; a document that loses all its words goes.

    ``n_chars``, if there, is counted anew for changed texts; all other columns stay as they came."""
    uid = fresh("_row", docs)
    spans = repeated_passages(docs, text, id_col).groupBy(F.col("_uid").alias(uid)).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("_spans"))
    spans = saved(spans)
    tagged = with_uid(docs, uid)

    def run(batches):
        for batch in batches:
            out = []
            for t, s in zip(batch.column("_text"), batch.column("_spans")):
                out.append(remove(t.as_py() or "", [(x["start_word"], x["end_word"]) for x in s.as_py()]))
            yield pa.RecordBatch.from_arrays([batch.column(uid), pa.array(out, pa.string())], [uid, "_new"])

    changed = saved(tagged.select(uid, F.col(text).alias("_text")).join(spans, uid).mapInArrow(run, f"{uid} long, _new string"))
    new = fresh("_new", docs)
    left = tagged.join(changed.withColumnRenamed("_new", new), uid, "left").where(F.col(new).isNull() | (F.col(new) != ""))
    fixed = {text: F.coalesce(new, text)}
    if "n_chars" in docs.columns:
        fixed["n_chars"] = F.when(F.col(new).isNotNull(), F.char_length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumns(fixed).drop(uid, new)


def remove(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words of the spans and what stands between them; empty if no word is left."""
    data = text.encode()
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_WORD[np.frombuffer(data, np.uint8)]
    s = np.flatnonzero(inside[1:] & ~inside[:-1])
    e = np.flatnonzero(inside[:-1] & ~inside[1:])
    gone = np.zeros(len(s), bool)
    for a, b in spans:
        gone[a:b] = True
    if gone.all():
        return ""
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(data[at:s[a]])
        at = e[b - 1]
    out.append(data[at:])
    return b"".join(out).decode()
