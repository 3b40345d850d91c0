"""Words and word shingles of whole buffers of texts, as 64-bit hashes.

A word is a run of letters, digits and underscores in lower case; every character outside ASCII counts as a letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffer, mix64
from .pretokens import _powers

SHINGLE = 5
IS_WORD = np.zeros(257, bool)
IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), ord("_"), *range(128, 256)]] = True
FOLD = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word offsets per text, byte start and end of each word in the lowered buffer)."""
    data, off = buffer(pc.utf8_lower(texts))
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64), z, z
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_WORD[data]
    start = inside[1:] & ~inside[:-1]           # of n + 1 places
    end = inside[:-1] & ~inside[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    both = edge[inside[edge] & inside[edge + 1]]    # a word may not run into the next text
    start[both] = True
    end[both] = True
    s, e = np.flatnonzero(start[:n]), np.flatnonzero(end)
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        h = mix64((sums[e] - sums[s]) * inverse[s])
    return h, np.searchsorted(s, off), s, e


def shingle_hashes(h: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, shingle offsets per text); a text of fewer words is one shingle, one without words none."""
    n = np.diff(off)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    padded = np.zeros(len(h) + size, np.uint64)
    padded[:len(h)] = h
    with np.errstate(over="ignore"):
        total = np.zeros(len(h), np.uint64)
        for i in range(size):
            total += padded[i:i + len(h)] * FOLD[i]
        short = np.flatnonzero((n > 0) & (n < size))
        for t in short.tolist():
            total[off[t]] = (h[off[t]:off[t + 1]] * FOLD[:n[t]]).sum(dtype=np.uint64)
    at = np.arange(out[-1]) + np.repeat(off[:-1] - out[:-1], count)
    return mix64(total[at], 5), out
