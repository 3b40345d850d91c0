"""Byte-level BPE with a hierarchical-bitmap rank queue.

Pairs that can merge wait in buckets, one per merge rank, that hold positions of a linked list.  A two-level bitmap
says which buckets have entries: two find-first-set steps give the lowest rank.  Entries whose pair has changed since
are stale and skipped.  A pre-token of n bytes takes O(n) queue steps, however long it is.

Null text is empty and has no ids; special-token strings are ordinary text; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer, ragged, slices
from .pretokens import Cache, encode_buffer

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
_loaded: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions in buckets by rank; a two-level bitmap finds the lowest bucket that has any."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, positions: list[int]) -> None:
        b = self.bucket.get(rank)
        if b is None:
            self.bucket[rank] = positions
            word = rank >> 8
            self.low[word] |= 1 << (rank & 255)
            self.top |= 1 << word
        else:
            b += positions

    def pop(self) -> tuple[int, list[int]]:
        """Lowest rank and its positions, leftmost first; the bucket is then empty."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        rank = word << 8 | ((bits & -bits).bit_length() - 1)
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.top &= self.top - 1
        positions = self.bucket.pop(rank)
        positions.sort()
        return rank, positions


class Encoder:
    """Merges a buffer of pre-tokens at once: one linked list and one queue, and no pair spans two pre-tokens."""

    STEP = 200_000              # bytes of pre-tokens that share a buffer; a longer one has its own

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pair = np.full(65536, -1, np.int64)
        for t, r in ranks.items():
            if len(t) == 2:
                self.pair[t[0] << 8 | t[1]] = r
        self.queue = RankQueue(max(ranks.values()) + 1)

    def merge(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids up to each end) of the pre-tokens that lie one after another in ``data``."""
        n, ranks, queue, longest, bucket = len(data), self.ranks, self.queue, self.longest, self.queue.bucket
        raw = np.frombuffer(data, np.uint8)
        first = np.full(n, -1, np.int64)
        first[:-1] = self.pair[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        first[ends - 1] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        values, cuts = np.unique(first[at], return_index=True)
        for r, positions in zip(values.tolist(), np.split(at, cuts[1:])):
            queue.push(r, positions.tolist())
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[np.append(0, ends[:-1])] = -1
        make = (lambda x: x.tolist()) if n <= 2 * self.STEP else (lambda x: array("q", x.tobytes()))
        rank, nxt, prv, stop, token = make(first), make(after), make(before), make(np.arange(1, n + 1)), make(self.byte[raw])
        alive = bytearray(b"\1") * n
        get = ranks.get
        while queue.top:
            r, positions = queue.pop()
            for done, i in enumerate(positions):
                if rank[i] != r:
                    continue                    # stale
                j = nxt[i]
                k = nxt[j]
                end = stop[i] = stop[j]
                token[i], nxt[i], rank[j], alive[j] = r, k, -1, 0
                lower = False
                if k >= 0:
                    prv[k] = i
                    q = get(data[i:stop[k]], -1) if stop[k] - i <= longest else -1
                    rank[i] = q
                    if q >= 0:
                        if (b := bucket.get(q)) is not None:
                            b.append(i)
                        else:
                            queue.push(q, [i])
                        lower = q <= r
                else:
                    rank[i] = -1
                p = prv[i]
                if p >= 0:
                    q = get(data[p:end], -1) if end - p <= longest else -1
                    rank[p] = q
                    if q >= 0:
                        if (b := bucket.get(q)) is not None:
                            b.append(p)
                        else:
                            queue.push(q, [p])
                        lower = lower or q <= r
                if lower:                       # the queue decides again
                    if rest := positions[done + 1:]:
                        queue.push(r, rest)
                    break
        live = np.frombuffer(alive, np.uint8).astype(bool)
        return np.array(token, np.int64)[live].astype(np.uint32), np.cumsum(live)[ends - 1]

    def packed(self, words: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(words)
        todo, size = [], 0

        def flush() -> None:
            nonlocal todo, size
            if todo:
                ends = np.cumsum([len(d) for _, d in todo])
                ids, upto = self.merge(b"".join(d for _, d in todo), ends)
                flat, at = ids.tobytes(), 0
                for (i, _), e in zip(todo, (upto * 4).tolist()):
                    out[i], at = flat[at:e], e
            todo, size = [], 0

        for i, w in enumerate(words):
            data = w.encode()
            if (whole := self.ranks.get(data)) is not None:
                out[i] = whole.to_bytes(4, "little")
                continue
            if size and size + len(data) > self.STEP:
                flush()
            todo.append((i, data))
            size += len(data)
        flush()
        return out


class Decoder:
    """Bytes of ids, gathered from one pool."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.begin[ids], self.size[ids])]


def tools(path: str) -> tuple[Cache, Decoder]:
    """Of this worker; the vocabulary is read once."""
    if path not in _loaded:
        ranks = load_ranks(path)
        _loaded[path] = Cache(Encoder(ranks).packed), Decoder(ranks)
    return _loaded[path]


def encode_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str = VOCABULARY, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids array<int> (left out with ``ids=False``), ids_sha256, decoded_sha256."""
    def run(batches):
        lookup, decode = tools(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, off = buffer(batch.column("text"))
                texts = [t or "" for t in batch.column("text").to_pylist()]
                bounds = np.zeros(len(texts) + 1, np.int64)
                np.cumsum([len(t) for t in texts], out=bounds[1:])
                got, upto = encode_buffer("".join(texts), bounds, lookup)
                back = decode(got).tobytes()
                ends = np.zeros(len(got) + 1, np.int64)
                np.cumsum(decode.size[got], out=ends[1:])
                at = ends[upto].tolist()
                flat, cut = got.tobytes(), (upto * 4).tolist()
                cols = [batch.column("doc_id"), pa.array(np.diff(upto), pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(got.astype(np.int32))))
                cols += [pa.array([hashlib.sha256(flat[i:j]).hexdigest() for i, j in zip(cut, cut[1:])], pa.string()),
                         pa.array([hashlib.sha256(back[i:j]).hexdigest() for i, j in zip(at, at[1:])], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, {'ids array<int>, ' * ids}ids_sha256 string, decoded_sha256 string")
