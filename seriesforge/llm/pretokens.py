"""Pre-token boundaries of byte-level vocabularies, found for a whole buffer of texts at once.

The boundaries are those of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``:
runs of letters, numbers, other signs and white space; a run takes one blank before it; the last white space before
a sign stands alone; an apostrophe that begins a run takes one of seven endings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import regex

from .common import ragged

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
LONG = 64                    # longer pre-tokens are looked up one by one
BASE = np.uint64(0x9FB21C651E98DF25)
_tables: dict = {}


def classes() -> np.ndarray:
    """Class of every code point."""
    if "classes" not in _tables:
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        everything = "".join(map(chr, points))
        at = np.array(points)
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, everything):
                out[at[m.start():m.end()]] = kind
        _tables["classes"] = out
    return _tables["classes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        for name, base in (("pow", BASE), ("inv", inverse)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _tables[name] = np.cumprod(a)
    return _tables["pow"][:n], _tables["inv"][:n]


def boundaries(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens in code points ``cp``; ``bounds`` are the text offsets (n + 1)."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    cls = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    run = first[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(run)
    mask = np.zeros(n + 1, bool)
    space = cls[at] == SPACE
    mask[at[space]] = True
    other = at[~space]
    after = other[(~first[other]) & (cls[other - 1] == SPACE)]
    mask[other] = True
    mask[after - 1] = True
    mask[after[cp[after - 1] == 32]] = False
    # contractions: an apostrophe that starts a pre-token and is followed by letters
    q = np.flatnonzero((cp[:-1] == 39) & mask[:n - 1] & (cls[1:] == LETTER) & ~first[1:n])
    if len(q):
        a = cp[q + 1]
        b = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        q, size = q[one | two], np.where(one, 1, 2)[one | two]
        mask[q + 1] = False
        end = q + 1 + size
        inside = end[(end < n)]
        inside = inside[~first[inside] & (cls[inside] == LETTER)]
        mask[inside] = True
    return np.flatnonzero(mask[:n])


def encode_buffer(text: str, bounds: np.ndarray, lookup: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids uint32, id offsets per text) of joined texts.

    ``lookup`` gives the ids of distinct pre-tokens as packed uint32 bytes.  Equal pre-tokens of the buffer share one
    lookup by a 64-bit hash of at most 64 code points; longer ones are not hashed.
    """
    if not text:
        return np.empty(0, np.uint32), np.zeros(len(bounds), np.int64)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = boundaries(cp, bounds)
    ends = np.append(starts[1:], len(cp))
    power, inverse = _powers(len(cp))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts]
        h ^= h >> np.uint64(32)
        long = np.flatnonzero(ends - starts > LONG)
        h[long] = long.astype(np.uint64)  # a key of their own
    codes, uniques = pd.factorize(h)
    rep = np.empty(len(uniques), np.int64)
    rep[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    words = [text[i:j] for i, j in zip(starts[rep].tolist(), ends[rep].tolist())]
    packed = lookup(words)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    pool = np.frombuffer(b"".join(packed), np.uint32)
    begin = np.cumsum(sizes) - sizes
    ids = pool[ragged(begin[codes], sizes[codes])]
    upto = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(sizes[codes], out=upto[1:])
    return ids, upto[np.searchsorted(starts, bounds)]


class Cache:
    """Packed ids of pre-tokens seen by this worker; emptied when it holds ``most`` entries, which only costs time."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 400_000):
        self.encode, self.most, self.known = encode, most, {}

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = [w for w in words if w not in known]
        fresh = {}
        if new:
            fresh = dict(zip(new, self.encode(new)))
            known.update((w, p) for w, p in fresh.items() if len(w) <= LONG)
        return [known[w] if w in known else fresh[w] for w in words]
