"""Language ID by prediction by partial matching.

Every language has a context tree of bytes up to ``ORDER`` deep, counted once and then frozen.  A byte costs
-log2 of its share among what followed the longest context; a byte not seen there costs an escape and is looked up in
the next shorter context, down to a uniform byte (escape method C; contexts a language never saw cost nothing).  The
language with the shortest code for the whole text wins, ties going to the smaller name.

The trees of all languages share one table (context, byte) -> code lengths, so that texts are scored by two array
look-ups per byte.  Training reads labelled rows with a non-null text.  Its size is bounded by ``train_bytes`` per
language: beyond it parts of texts are taken by a hash of row and part number at the rate that meets the bound, so that
neither long texts nor copies decide whether a language is learned; longest contexts beyond ``contexts`` keep the most
frequent, as part of the model.

Null text, empty text and text without a letter give ``und`` with score 0.  Without any training row everything is
``und``.  Long texts are scored whole.  Repeated rows are scored alike; further columns pass through.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer, fresh, mix64, ragged, slices, with_uid

ORDER = 3
UNIFORM = 8.0               # bits of a byte without any model
FOREIGN = 12.0              # bits a byte that a text of a learned language may cost where no labelled text was held out
TAIL, BINS, ENOUGH = 0.999, 32, 1000    # quantile, histogram bins a bit, and texts that a length class is judged by at least
PART = 4096                 # bytes of a part of a text that the training sample takes or leaves
CHUNK = 1024                # contexts whose code lengths are worked out at once
EVIDENCE = 64               # bytes of evidence that a score counts at most
_models: dict = {}


@dataclass
class Counts:
    """Frozen statistics: per language and order arrays of (context key, byte code, count)."""

    langs: list[str]
    codes: np.ndarray                                   # byte -> code, 0 for bytes never seen
    rows: dict = field(default_factory=dict)            # (language, order) -> (contexts, codes, counts)
    contexts: int = 20_000
    ident: str = ""


def count_grams(data: np.ndarray, offsets: np.ndarray, order: int, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of order + 1 bytes inside texts that start at a byte of ``use`` (all, unless given) and their
    counts; the last byte is the lowest."""
    if len(data) <= order:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.zeros(len(data) - order, np.int64)
    for k in range(order + 1):
        key = key << 8 | data[k:len(data) - order + k]
    inside = np.ones(len(data) + 1, bool)
    for k in range(1, order + 1):
        inside[np.maximum(offsets[1:] - k, 0)] = False
    # a text shorter than the gram has no start at all
    short = np.flatnonzero(np.diff(offsets) <= order)
    for s in short.tolist():
        inside[offsets[s]:offsets[s + 1]] = False
    if use is not None:
        inside[:-1] &= use
    return np.unique(key[inside[:len(key)]], return_counts=True)


def drawn_parts(uid: np.ndarray, off: np.ndarray, share: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the parts of ``size`` bytes that a hash of row and part number draws at each row's share."""
    n = -(-np.diff(off) // size)
    row = np.repeat(np.arange(len(n)), n)
    part = ragged(np.zeros(len(n), np.int64), n)
    with np.errstate(over="ignore"):
        h = mix64(mix64(uid[row].astype(np.uint64), 41) + part.astype(np.uint64), 42)
    ok = (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < share[row]
    row, start = row[ok], off[:-1][row[ok]] + part[ok] * size
    return row, start, np.minimum(start + size, off[1:][row])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, train_bytes: int = 4_000_000,
          contexts: int = 20_000) -> Counts:
    rows = with_uid(docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), (F.lit(True) if where is None else where).alias("_use")))
    rows = rows.where("_use and text is not null and lang is not null").drop("_use")
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect() if r.n}
    share = {k: min(1.0, train_bytes / n) for k, n in totals.items()}
    size = max(ORDER + 1, min(PART, train_bytes // 256))    # so many parts are drawn that no language goes without

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                names = np.array(batch.column("lang").to_pylist(), object)
                uids = batch.column("_uid").to_numpy(zero_copy_only=False)
                for name in sorted(set(names)):
                    own = names == name
                    data, off = buffer(batch.column("text").filter(pa.array(own)))
                    row, start, end = drawn_parts(uids[own], off, np.full(len(off) - 1, share.get(name, 0.0)), size)
                    if not len(row):
                        continue
                    # a gram belongs to the part it starts in and may reach into the next one
                    more = np.minimum(end + ORDER, off[1:][row])
                    cut = np.append(0, np.cumsum(more - start))
                    piece, use = data[ragged(start, more - start)], np.zeros(int(cut[-1]), bool)
                    use[ragged(cut[:-1], end - start)] = True
                    for k in range(ORDER + 1):
                        g, n = count_grams(piece, cut, k, use)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array([k] * len(g), pa.int32()), pa.array(g), pa.array(n)],
                                                         ["lang", "k", "gram", "n"])

    counted = rows.mapInArrow(run, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    got = counted.toPandas()    # bounded by train_bytes per language
    model = Counts(sorted(set(got.lang)), np.zeros(256, np.int32), contexts=contexts, ident=uuid.uuid4().hex)
    seen = np.unique(got.gram[got.k == 0].to_numpy(np.int64)) if len(got) else np.empty(0, np.int64)
    model.codes[seen] = np.arange(1, len(seen) + 1)
    base = len(seen) + 1
    for (name, k), g in got.groupby(["lang", "k"]):
        gram = g.gram.to_numpy(np.int64)
        ctx = np.zeros(len(gram), np.int64)
        for d in range(k, 0, -1):
            ctx = ctx * base + model.codes[(gram >> (8 * d)) & 255]
        model.rows[name, int(k)] = (ctx, model.codes[gram & 255].astype(np.int64), g.n.to_numpy(np.int64))
    return model


def tables(model: Counts) -> tuple[np.ndarray, np.ndarray]:
    """(node of each context of ``ORDER`` codes, code lengths [node * codes + code, language])."""
    if model.ident in _models:
        return _models[model.ident]
    base, langs = int(model.codes.max()) + 1, len(model.langs)
    none = (np.empty(0, np.int64),) * 3
    node_of, cost = np.zeros(1, np.int64), np.full((1, base, langs), UNIFORM)
    for k in range(ORDER + 1):
        rows = [model.rows.get((name, k), none) for name in model.langs]
        keep, n = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        if k == ORDER and len(keep) > model.contexts:
            size = np.bincount(n, weights=np.concatenate([r[2] for r in rows]))
            keep = np.sort(keep[np.lexsort((keep, -size))[:model.contexts]])
        found = []
        for ctx, code, count in rows:
            at = np.searchsorted(keep, ctx)
            ok = (at < len(keep)) & (keep[np.minimum(at, len(keep) - 1)] == ctx) if len(keep) else np.zeros(len(ctx), bool)
            at, code, count = at[ok], code[ok], count[ok]
            found.append((at, code, count, np.bincount(at, weights=count, minlength=len(keep)), np.bincount(at, minlength=len(keep))))
        # a context's parent leaves out its oldest byte
        parent = node_of[keep % base ** (k - 1)] if k else np.zeros(len(keep), np.int64)
        grown = np.empty((len(keep), base, langs), np.float32 if k == ORDER else np.float64)
        for lo in range(0, len(keep), CHUNK):   # the last order has most contexts; all at once in double precision cost a worker twice the table
            some = slice(lo, lo + CHUNK)
            part = cost[parent[some]]
            for j, (at, code, count, total, kinds) in enumerate(found):
                has = np.flatnonzero(total[some] > 0)
                part[has, :, j] += -np.log2(kinds[some][has] / (total[some] + kinds[some])[has])[:, None]
                own = (at >= lo) & (at < lo + CHUNK)
                part[at[own] - lo, code[own], j] = -np.log2(count[own] / (total + kinds)[at[own]])
            grown[some] = part
        if k == 0:
            cost, node_of = (grown if len(keep) else cost), np.zeros(1, np.int64)
        else:
            node = node_of[np.arange(base ** k) % base ** (k - 1)]      # unseen: what the shorter context has
            node[keep] = len(cost) + np.arange(len(keep))
            cost, node_of = np.concatenate([cost.astype(grown.dtype), grown]), node
    _models.clear()
    _models[model.ident] = node_of.astype(np.int32), np.ascontiguousarray(cost.reshape(-1, langs), np.float32)
    return _models[model.ident]


def code_lengths(model: Counts, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    node_of, cost = tables(model)
    base = int(model.codes.max()) + 1
    out = np.zeros((len(offsets) - 1, len(model.langs)))
    if not len(data):
        return out
    code = model.codes[data].astype(np.int64)
    ctx, size = np.zeros(len(code), np.int64), np.diff(offsets)
    begin = offsets[:-1][size > 0]
    for d in range(ORDER, 0, -1):       # older bytes are higher digits; before the text there is code 0
        c = np.zeros(len(code), np.int64)
        c[d:] = code[:-d] if d < len(code) else 0
        for e in range(d):
            c[np.minimum(begin + e, len(c) - 1)[begin + e < np.append(begin[1:], len(c))]] = 0
        ctx = ctx * base + c
    bits = cost[node_of[ctx].astype(np.int64) * base + code]
    out[size > 0] = np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: Counts, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (all of ``docs``, unless given) with lang_pred, score (posterior over the learned languages) and
    bits_per_byte of each row."""
    carry = docs.columns if carry is None else carry
    if not model.langs:
        return docs.select(*carry).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    state: dict = {}

    raw, letters = fresh("_text", docs), fresh("_letters", docs)

    def run(batches):
        if "model" not in state:
            state["model"] = pickle.loads(shared.value)
        m = state["model"]
        for whole in batches:
            for batch in slices(whole, raw, 250_000):
                data, off = buffer(batch.column(raw))
                bits = code_lengths(m, data, off)
                size = np.diff(off)
                mean = bits / np.maximum(size, 1)[:, None]
                best = mean.argmin(axis=1)
                p = np.exp2(-(mean - mean.min(axis=1, keepdims=True)) * np.minimum(size, EVIDENCE)[:, None])
                score = 1.0 / p.sum(axis=1)
                ok = np.array(batch.column(letters).to_pylist(), bool)
                names = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), ok.tolist())]
                rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in (raw, letters)]
                yield pa.RecordBatch.from_arrays(
                    rest + [pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(mean.min(axis=1), mask=~ok)],
                    [n for n in batch.schema.names if n not in (raw, letters)] + ["lang_pred", "score", "bits_per_byte"])
        state.clear()       # workers outlive the stage
        _models.clear()

    t = F.col(text).cast("string")
    named = docs.select(*[c for c in carry if c.lower() not in ("lang_pred", "score", "bits_per_byte")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    fed = docs.select(*named.columns, F.coalesce(t, F.lit("")).alias(raw), F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias(letters))
    return fed.mapInArrow(run, f"{schema}{', ' if schema else ''}lang_pred string, score double, bits_per_byte double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def foreign_bounds(docs: DataFrame, model: Counts, text: str = "text", lang: str = "lang", where: Column | None = None) -> list[float]:
    """Bits a byte above which a text is foreign, by length class (bits of its byte count), from all labelled texts of
    ``where`` that ``model`` has not seen: their ``TAIL`` quantile, and beyond it as much as it lies above the median,
    one bit at least.  A class of few texts is judged with its neighbours."""
    rows = docs.where(F.lit(True) if where is None else where).where(F.col(lang).isin(model.langs))
    rows = rows.select(F.col(text).cast("string").alias("text")).withColumn("n", F.octet_length("text"))
    told = predict(rows, model, carry=["n"]).where("lang_pred != 'und'")
    got = told.groupBy(F.length(F.bin("n")).alias("k"), F.round(F.col("bits_per_byte") * BINS).cast("int").alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not got:
        return []
    k, x, n = (np.array([r[i] for r in got], np.int64) for i in range(3))
    out = []
    for c in range(33):
        for reach in range(34):
            own = np.abs(k - c) <= reach
            if n[own].sum() >= ENOUGH:
                break
        order = np.argsort(x[own], kind="stable")
        upto = np.cumsum(n[own][order])
        mid, high = (x[own][order][np.searchsorted(upto, q * upto[-1])] / BINS for q in (0.5, TAIL))
        out.append(float(high + max(high - mid, 1.0)))
    return out


def keep_known(docs: DataFrame, model: Counts, text: str = "text", bounds: list[float] | None = None) -> DataFrame:
    """Rows of ``docs`` in a language the model knows: rejected are texts without a letter and those that every learned
    language codes above the bound of their length class (16 bits are allowed for the start of the text)."""
    aside = {c: fresh(f"_{c}", docs) for c in docs.columns if c.lower() in ("lang_pred", "score", "bits_per_byte")}
    own = docs.withColumnsRenamed(aside)
    told = predict(own, model, aside.get(text, text))
    n = F.octet_length(F.col(aside.get(text, text)).cast("string"))
    bound = F.element_at(F.array(*map(F.lit, bounds)), F.length(F.bin(n)).cast("int") + 1) if bounds else F.lit(FOREIGN)
    ok = told.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") * n <= bound * n + 16))
    return ok.select(*own.columns).withColumnsRenamed({new: c for c, new in aside.items()})
