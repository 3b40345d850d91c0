"""Best-fit packing by a grouping genetic algorithm on islands.

Texts become token ids plus an end id; only documents longer than a sequence are cut, the remainder first, so all later
pieces fill a sequence each.  All other pieces are dealt by hash into cells of bounded size, whose number grows with
the data.  Every cell is evolved on several islands.  A solution is a list of bins.  Crossover injects whole well-filled
bins of one parent into the other, takes out bins that then hold a piece twice, and places the displaced pieces anew by
best fit, longest first; mutation does the same with the worst-filled bins.  Between epochs each island sends its best
solution to the next one of its ring by a join; at the end the best island of a cell gives its sequences.

Null text is empty and packs its end id alone; empty tables give no rows; rows repeated with one doc_id are packed each.
Draws are seeded by cell, island and epoch, so a task run again repeats its result.
"""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, with_uid
from .pretokens import Cache, encode_buffer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE, END_ID = 2048, 0
CELL = 8192                 # pieces evolved together
ISLANDS, EPOCHS, CHILDREN, POPULATION = 2, 2, 10, 4
_loaded: dict = {}


def lookup(path: str) -> Cache:
    """Ids of distinct pre-tokens by the tokenizer file; a pre-token's ids do not depend on its neighbours."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True

        def packed(words: list[str]) -> list[bytes]:
            out = []
            for i in range(0, len(words), 4096):
                out += [np.array(e.ids, np.uint32).tobytes() for e in t.encode_batch(words[i:i + 4096], add_special_tokens=False)]
            return out
        _loaded[path] = Cache(packed)
    return _loaded[path]


def pieces(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = SEQUENCE, path: str = VOCABULARY) -> DataFrame:
    """_uid, doc_id, piece, start, length, ids_crc32 of every piece."""
    def run(batches):
        find = lookup(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                bounds = np.zeros(len(texts) + 1, np.int64)
                np.cumsum([len(t) for t in texts], out=bounds[1:])
                ids, upto = encode_buffer("".join(texts), bounds, find)
                flat, upto = ids.tobytes(), upto.tolist()
                end = int(END_ID).to_bytes(4, "little")
                row, no, start, size, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(upto, upto[1:])):
                    own, n = flat[4 * a:4 * b] + end, b - a + 1
                    at, k = 0, 0
                    while at < n:
                        step = length if at or n % length == 0 else n % length
                        row.append(i)
                        no.append(k)
                        start.append(at)
                        size.append(step)
                        crc.append(zlib.crc32(own[4 * at:4 * (at + step)]))
                        at, k = at + step, k + 1
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_uid").take(take), batch.column("doc_id").take(take), pa.array(no, pa.int32()),
                                                  pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                                                 ["_uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    slim = with_uid(docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """One solution: bins of piece numbers and their fill; a bin's list is never changed in place once shared."""

    def __init__(self, sizes: list[int], room: int, bins: list[list[int]] = (), fill: list[int] = ()):
        self.sizes, self.room, self.bins, self.fill = sizes, room, list(bins), list(fill)

    def place(self, items: list[int]) -> None:
        """Best fit: each piece, in the order given, goes to the fullest bin that still takes it."""
        sizes, bins, fill, room = self.sizes, self.bins, self.fill, self.room
        slots: list[list[int]] = [[] for _ in range(room + 1)]
        free = 0
        for b, f in enumerate(fill):
            if f < room:
                slots[room - f].append(b)
                free |= 1 << (room - f)
        owned = set()
        for i in items:
            size = sizes[i]
            fits = free >> size
            if fits:
                left = size + (fits & -fits).bit_length() - 1
                b = slots[left].pop()
                if not slots[left]:
                    free &= ~(1 << left)
                if b in owned:
                    bins[b].append(i)
                else:
                    bins[b] = bins[b] + [i]
                    owned.add(b)
                fill[b] += size
            else:
                b, left = len(bins), room
                bins.append([i])
                fill.append(size)
                owned.add(b)
            left -= size
            if left:
                slots[left].append(b)
                free |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum(f * f for f in self.fill)


def best_fit(sizes: list[int], room: int, order: list[int]) -> Bins:
    out = Bins(sizes, room)
    out.place(order)
    return out


def crossover(a: Bins, b: Bins, rng: random.Random, share: float = 0.15) -> Bins:
    """Well-filled bins of ``b`` enter ``a`` whole; what they displace is best-fitted again."""
    full = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    full = full[:max(1, len(full) // 2)]
    injected = rng.sample(full, max(1, min(len(full), int(share * len(b.bins)))))
    inside = {i for k in injected for i in b.bins[k]}
    bins, fill, displaced = [b.bins[k] for k in injected], [b.fill[k] for k in injected], []
    for items, f in zip(a.bins, a.fill):
        if inside.isdisjoint(items):
            bins.append(items)
            fill.append(f)
        else:
            displaced += [i for i in items if i not in inside]
    child = Bins(a.sizes, a.room, bins, fill)
    child.place(sorted(displaced, key=lambda i: -a.sizes[i]))
    return child


def mutate(a: Bins, rng: random.Random, share: float = 0.05) -> Bins:
    """The worst-filled bins and a few others are dissolved."""
    n = max(1, int(share * len(a.bins)))
    worst = set(sorted(range(len(a.bins)), key=lambda k: a.fill[k])[:n]) | set(rng.sample(range(len(a.bins)), n))
    child = Bins(a.sizes, a.room, [x for k, x in enumerate(a.bins) if k not in worst], [f for k, f in enumerate(a.fill) if k not in worst])
    child.place(sorted((i for k in worst for i in a.bins[k]), key=lambda i: -a.sizes[i]))
    return child


def decode(sizes: list[int], room: int, where: list[int]) -> Bins:
    bins: list[list[int]] = [[] for _ in range(max(where, default=-1) + 1)]
    for i, b in enumerate(where):
        bins[b].append(i)
    return Bins(sizes, room, bins, [sum(sizes[i] for i in b) for b in bins])


def evolve(sizes: list[int], room: int, elites: list[list[int]], seed: str, children: int = CHILDREN) -> list[int]:
    """Bin number of each piece in the best solution found."""
    rng = random.Random(seed)
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [decode(sizes, room, e) for e in elites]
    people.append(best_fit(sizes, room, down))
    while len(people) < POPULATION:     # longest first, but shaken
        people.append(best_fit(sizes, room, sorted(down, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.2))))
    bound = -(-sum(sizes) // room)
    for _ in range(children):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].bins) == bound:
            break                       # no packing has fewer
        a, b = rng.sample(people, 2)
        child = crossover(a, b, rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        if child.fitness() > people[-1].fitness():
            people[-1] = child
    best = max(people, key=Bins.fitness)
    out = [0] * len(sizes)
    for k, items in enumerate(best.bins):
        for i in items:
            out[i] = k
    return out


def pack(cut: DataFrame, length: int = SEQUENCE, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces."""
    names = [c for c in cut.columns if c != "_uid"]
    full = cut.where(F.col("length") >= length).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < length)
    cells = max(1, -(-rest.count() // cell))
    item = F.struct("_uid", *names)
    groups = saved(rest.groupBy(F.pmod(F.xxhash64("_uid", "piece", F.lit(seed)), F.lit(cells)).alias("cell"))
                   .agg(F.array_sort(F.collect_list(item)).alias("items")))     # a cell holds about ``cell`` pieces
    state = groups.select("cell", F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                          F.array().cast("array<array<int>>").alias("elites"))
    for epoch in range(epochs):
        def run(frames, epoch=epoch):
            for pdf in frames:
                pdf["place"] = [evolve([int(x) for x in s], length, [[int(x) for x in e] for e in el], f"{seed}/{c}/{i}/{epoch}")
                                for c, s, i, el in zip(pdf["cell"], pdf["sizes"], pdf["island"], pdf["elites"])]
                yield pdf[["cell", "island", "place"]]

        spread = state.repartition(max(1, 2 * cells), "cell", "island")
        found = saved(spread.mapInPandas(run, "cell long, island int, place array<int>"))
        if epoch + 1 < epochs:          # the best of an island moves to the next one and stays at home too
            moved = found.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("place").alias("guest"))
            state = (found.join(moved, ["cell", "island"]).join(groups.select("cell", F.col("items.length").alias("sizes")), "cell")
                     .select("cell", "sizes", "island", F.array("place", "guest").alias("elites")))
    best = found.groupBy("cell").agg(F.min_by("place", F.struct(F.array_max("place"), F.col("island"))).alias("place"))

    def lay(frames):
        for pdf in frames:
            offsets = []
            for sizes, place in zip(pdf["sizes"], pdf["place"]):
                at: dict[int, int] = {}
                one = []
                for s, b in zip(sizes, place):
                    one.append(at.get(b, 0))
                    at[b] = one[-1] + int(s)
                offsets.append(one)
            pdf["offset"] = offsets
            yield pdf[["cell", "place", "offset"]]

    laid = (best.join(groups.select("cell", F.col("items.length").alias("sizes")), "cell").select("cell", "sizes", "place")
            .mapInPandas(lay, "cell long, place array<int>, offset array<long>"))
    packed = (groups.join(laid, "cell").select("cell", F.explode(F.arrays_zip("items", "place", "offset")).alias("z"))
              .select(*[F.col(f"z.items.{c}").alias(c) for c in names], (F.col("cell") * F.lit(2**24) + F.col("z.place")).alias("sequence_id"),
                      F.col("z.offset").alias("offset")))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(saved(pieces(docs, text, id_col, length)), length)
