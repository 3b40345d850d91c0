"""Operators over documents: odd inputs, brute force and round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from seriesforge.llm import bpe, exact, langid, license, minhash, packing, passages, shard
from seriesforge.llm.pretokens import encode_buffer

WORDS = re.compile(r"(?:[0-9a-z_]|[^\x00-\x7f])+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid string, class int, key string, _new string, _row int, score string"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def prose(seed, n, words=None):
    rng = random.Random(seed)
    words = words or vocabulary(0)
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None, "u", 1, "k", "n", 2, "s") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    base = prose(1, 120)
    return [None, "", " \t\n ", "?!", "a", base, base, base.replace(" ", "\n\t "), prose(2, 30000), base + " fin", "x" * 5000, "été <|endoftext|> 's 're '' 1 2"]


def test_exact_groups(spark, odd):
    docs = table(spark, odd + [odd[5]], list(range(len(odd))) + [None])
    rows = exact.exact_groups(docs).collect()
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for t in odd + [odd[5]]]
    got = {(r.doc_id, r.text_sha256): r for r in rows}
    assert len(rows) == len(norm)
    ids = list(range(len(odd))) + [None]
    for i, t in zip(ids, norm):
        r = got[i, hashlib.sha256(t.encode()).hexdigest()]
        same = [j for j, u in zip(ids, norm) if u == t]
        assert (r.keep_id, r.group_size, r.kept) == (min(j for j in same if j is not None), len(same), i == min(j for j in same if j is not None))
    assert exact.exact_groups(docs.limit(0)).count() == 0
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm))


def test_repeated_rows_keep_one(spark):
    docs = table(spark, ["same text"] * 4, [7, 7, 7, 8])
    assert [r.doc_id for r in exact.drop_exact(docs).collect()] == [7]


def test_colliding_fingerprints_are_told_apart(spark):
    texts = [prose(s, 900) for s in range(12)] + [prose(s, 900) for s in range(6)]
    rows = exact.exact_groups(table(spark, texts), bits=3).collect()
    assert {r.doc_id: r.keep_id for r in rows} == {i: texts.index(t) for i, t in enumerate(texts)}


def test_chunks_do_not_depend_on_neighbours():
    t = prose(3, 3000).encode()
    alone = exact.chunk_ends(exact.cut_points(np.frombuffer(t, np.uint8)), 0, len(t))
    both = b"prefix of another text" + t
    shifted = exact.chunk_ends(exact.cut_points(np.frombuffer(both, np.uint8)), 22, len(both))
    assert [x - 22 for x in shifted] == alone and len(alone) > 3


def brute_classes(texts, threshold=0.8):
    bags = []
    for t in texts:
        w = WORDS.findall((t or "").lower())
        bags.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    label = list(range(len(texts)))
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            both = sum((a & b).values())
            if both and both / (sum(a.values()) + sum(b.values()) - both) >= threshold:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def near_copies(seed, n, copies, edits):
    rng = random.Random(seed)
    words = prose(seed, n).split()
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(n)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_classes_equal_brute_force(spark, odd):
    texts = odd[:8] + near_copies(5, 200, 60, 6) + near_copies(6, 80, 12, 4) + [prose(s, 60) for s in range(20, 40)] + ["one two"] * 2
    rows = minhash.near_classes(table(spark, texts)).collect()
    want = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))
    assert sum(r.kept for r in rows) == len(set(want))
    assert minhash.near_classes(table(spark, texts).limit(0)).count() == 0


def test_weighted_signatures_agree_as_often_as_bags(spark):
    rng = random.Random(4)
    a = [f"w{rng.randrange(40)}" for _ in range(600)]
    b = a[:450] + [f"v{i}" for i in range(150)]
    units, off = minhash.bags(pa.array([" ".join(a), " ".join(b)]))
    x, y = set(units[:off[1]].tolist()), set(units[off[1]:].tolist())
    sig = minhash.dart_signatures(units, off, 4000)
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.03


def test_compact_windows_equal_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(60):
        g = rng.permutation(np.arange(1, 90)).astype(np.uint64)
        off = np.array([0, 20, 20, 23, len(g)])
        want = set()
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            for c in range(a, b):
                left, right = c, c
                while left > a and g[left - 1] > g[c]:
                    left -= 1
                while right + 1 < b and g[right + 1] > g[c]:
                    right += 1
                if right - left + 1 >= 6:
                    want.add((c, left, right))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(g, off, 6)))) == want


def test_passages_found_and_clean_left_alone(spark, odd):
    shared, near = prose(50, 70), prose(51, 120).split()
    edited = list(near)
    edited[60] = "changed"
    texts = odd[:5] + [prose(60, 200) + " " + shared + " " + prose(61, 90), prose(62, 40), shared.upper() + " " + prose(63, 300), prose(64, 100) + " " + " ".join(near),
                       " ".join(edited) + " " + prose(65, 50), prose(66, 400), prose(67, 60) + " " + " ".join(shared.split()[:40])]
    rows = passages.repeated_passages(table(spark, texts)).collect()
    assert {(r.doc_id, r.source_id) for r in rows} == {(7, 5), (9, 8)}
    r = next(r for r in rows if r.doc_id == 7)
    assert (r.start_word, r.end_word, r.source_start, r.source_end, r.similarity) == (0, 70, 200, 270, 1.0)
    r = next(r for r in rows if r.doc_id == 9)
    assert r.start_word == 0 and r.end_word == 120 and 0.8 <= r.similarity < 1
    docs = table(spark, texts)
    left = {r.doc_id: r.text for r in passages.cut_passages(docs).collect()}
    assert len(left) == len(texts) and left[7].strip() == prose(63, 300) and left[5] == texts[5] and left[9].strip() == prose(65, 50)
    assert passages.cut_passages(docs).columns == docs.columns
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_passage_whose_head_stands_earlier_in_the_source():
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 2**32, n, np.uint32)
    for n, head in ((56, 26), (46, 1), (46, 20)):
        p = draw(n)
        a, b = np.concatenate([draw(9), p[:head], draw(4), draw(40), p, draw(5)]), np.concatenate([draw(8), p, draw(3)])
        assert [x[:4] for x in passages.passages(a, b)] == [(53 + head, 53 + head + n, 8, 8 + n)]
        assert [x[:4] for x in passages.passages(a, b, np.array([8]))] == [(53 + head, 53 + head + n, 8, 8 + n)]


def test_short_passages_survive_one_edit_at_each_place(spark):
    """Passages that from first to last equal shingle have at least 50 words and similarity 0.8, one word inserted,
    deleted or replaced: at most one in fifty is missed."""
    texts, want = [], set()
    for n in (51, 60):
        for place in range(n):
            for kind in ("insert", "delete", "replace"):
                w = [f"w{n}x{place}{kind}{i}" for i in range(n)]
                e = w[:place] + {"insert": ["new", w[place]], "delete": [], "replace": ["new"]}[kind] + w[place + 1:]
                x, y = ([tuple(v[i:i + 5]) for i in range(len(v) - 4)] for v in (w, e))
                both = [q for q in x if q in set(y)]
                x, y = (v[v.index(both[0]):v.index(both[-1]) + 1] for v in (x, y))
                if min(len(x), len(y)) >= 46 and len(both) / (len(x) + len(y) - len(both)) >= 0.8:
                    want.add((len(texts) + 1, len(texts)))
                    texts += [f"{prose(len(texts) + k, 30)} {' '.join(v)} {prose(len(texts) + 2 * k, 30)}" for k, v in ((20000, w), (50001, e))]
    got = {(r.doc_id, r.source_id) for r in passages.repeated_passages(table(spark, texts)).collect()}
    assert len(want) > 250 and len(want - got) <= len(want) / 50, (len(want - got), len(want))


def test_equal_passages_are_not_hidden_by_earlier_parts_of_them(spark):
    """Earlier documents hold 49, 45 or 40 of the 50 words, or an edited passage; two later ones hold all of it."""
    rng, texts, want = random.Random(3), [], set()
    for trial in range(60):
        for kind in ("49", "45", "40", "edited", "many"):
            w = [f"p{trial}{kind}{i}" for i in range(50)]
            early = [w[:int(kind)]] if kind.isdigit() else [[f"e{j}" if j in x else v for j, v in enumerate(w)] for x in ([(15, 33)] if kind == "edited" else [(j, j + 9) for j in range(8, 32, 4)])]
            for v in early:
                texts.append(f"{prose(rng.random(), 30)} {' '.join(v)} {prose(rng.random(), 30)}")
            want.add((len(texts) + 1, len(texts)))
            texts += [f"{prose(rng.random(), 30)} {' '.join(w)} {prose(rng.random(), 30)}" for _ in range(2)]
    got = {(r.doc_id, r.source_id) for r in passages.repeated_passages(table(spark, texts)).collect() if r.similarity == 1 and r.end_word - r.start_word >= 50}
    assert want <= got, (len(want - got), len(want))


def test_edited_passages_are_not_hidden_by_many_earlier_parts_of_them(spark):
    """Five earlier documents hold two overlapping parts of a passage, a sixth all of it; a later one repeats it edited."""
    texts, want = [], set()
    for trial in range(12):
        w = [f"q{trial}w{i}" for i in range(60)]
        for k in range(5):
            texts.append(f"{prose(100 * trial + k, 30)} {' '.join(w[:35])} {prose(100 * trial + k + 7, 30)} {' '.join(w[25:])} {prose(100 * trial + k + 14, 30)}")
        want.add((len(texts) + 1, len(texts)))
        place = 10 + 3 * trial
        texts += [f"{prose(100 * trial + k, 30)} {' '.join(v)} {prose(100 * trial + k + 3, 30)}" for k, v in ((31, w), (42, w[:place] + ["new"] + w[place + 1:]))]
    got = {(r.doc_id, r.source_id) for r in passages.repeated_passages(table(spark, texts)).collect()}
    assert want <= got, (len(want - got), len(want))


def test_a_common_line_makes_no_pairs_without_a_passage(spark):
    """40 texts share a line of 35 words and nothing else; one of them repeats an edited passage around it from another."""
    line = [f"line{i}" for i in range(35)]
    texts = [f"{prose(900 + k, 60)} {' '.join(line)} {prose(950 + k, 60)}" for k in range(40)]
    whole = [*(f"h{i}" for i in range(20)), "old", *line, "old", *(f"t{i}" for i in range(20))]
    texts += [f"{prose(990 + k, 60)} {' '.join(whole).replace('old', ('old', 'new')[k])} {prose(995 + k, 60)}" for k in range(2)]
    docs = passages.with_uid(table(spark, texts).coalesce(1).select("doc_id", "text"))
    tok = passages.saved(passages.tokens(docs))
    settled = spark.createDataFrame([], "_uid long, spans array<struct<s: int, e: int>>")
    assert [(r.a, r.b) for r in passages.remaining(passages.shared_windows(docs), settled, tok).collect()] == [(40, 41)]


def test_pairs_with_a_passage_through_a_gram_are_hopeful():
    """Any stretch of enough shared tokens through the gram, found by growing, is one that the rough test lets pass."""
    rng, seen = np.random.default_rng(5), 0
    for _ in range(1500):
        a = rng.integers(1, 1 << 31, int(rng.integers(60, 900))).astype(np.uint32)
        if rng.random() < 0.3:
            a[rng.integers(0, len(a), 20)] = a[0]
        b, i = [], 0
        while i < len(a):
            n = int(rng.integers(4, 60))
            b += a[i:i + n].tolist() + rng.integers(1, 1 << 31, int(rng.integers(0, 12))).tolist()
            i += n + int(rng.integers(0, 12))
        b = np.array(b, np.uint32)
        for c in rng.integers(0, len(b) - passages.GRAM, 3).tolist():
            at = [j for j in np.flatnonzero(a == b[c]).tolist() if np.array_equal(a[j:j + passages.GRAM], b[c:c + passages.GRAM])]
            if len(at) != 1 or not any(p[2] <= c and c + passages.GRAM <= p[3] for p in passages.passages(a, b, np.array([c]))):
                continue
            seen += 1
            lo, first = max(c - passages.REACH, 0), max(at[0] - 2 * passages.REACH, 0)
            x = b[lo:c + passages.GRAM + passages.REACH]
            held = a[first:at[0] + passages.GRAM + 2 * passages.REACH]
            other = rng.integers(1, 1 << 31, 50).astype(np.uint32)
            got = passages.Around([other, held], [20, at[0] - first], [True, True]).hopeful(x, c - lo, (lo, len(b) - lo - len(x)))
            assert got[1] and (not got[0] or lo + len(x) < len(b))
    assert seen > 300


def test_a_passage_beside_the_anchor_does_not_hide_one_through_it():
    """The longest stretch begins after the anchor's run; a shorter one that overlaps it holds the anchor."""
    rng = np.random.default_rng(8)
    new = lambda n: rng.integers(1, 1 << 31, n).astype(np.uint32)
    runs, gaps = [new(22), new(30), new(60)], [5, 11]
    a, b = (np.concatenate([x for r, g in zip(runs, [*gaps, 0]) for x in (r, new(g))]) for _ in range(2))
    assert any(p[2] <= 3 < p[3] for p in passages.passages(a, b, np.array([3])))


def test_wholly_repeated_text_goes(spark):
    t = prose(70, 90)
    assert [r.doc_id for r in passages.cut_passages(table(spark, [t, t + "."])).collect()] == [0]


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(1)
    signs = list(" \n\t'sstremvdl.,1é中 \x1c\x85!\"<|endoftext|>") + ["👍🏽", "'re", "'ll "]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["", "a" * 3000, "ab" * 4000 + " ' 're", "'" * 50, "́e", " " * 99]


def test_bpe_equals_the_library(spark, odd, fuzz):
    ranks = bpe.load_ranks(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = fuzz + odd
    rows = bpe.encode_texts(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.ids == enc.encode_ordinary(t)
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode_texts(table(spark, texts).limit(0)).count() == 0


def test_rank_queue_orders_by_rank_then_place():
    q = bpe.RankQueue(70000)
    rng = random.Random(2)
    items = [(rng.randrange(70000), rng.randrange(100)) for _ in range(500)]
    for r, p in items:
        q.push(r, [p])
    out = []
    while q.top:
        r, ps = q.pop()
        out += [(r, p) for p in ps]
    assert out == sorted(items)


def test_rank_queue_takes_a_lower_rank_that_a_merge_opens():
    ranks = {bytes([i]): 300 + i for i in range(256)} | {b"ab": 5, b"abc": 2, b"bc": 9, b"cd": 4}
    enc = bpe.Encoder(ranks)
    def naive(data):
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    assert [np.frombuffer(p, np.uint32).tolist() for p in enc.packed(words)] == [naive(w.encode()) if w.encode() not in ranks else [ranks[w.encode()]] for w in words]


def test_packing_is_whole_exact_and_close_to_the_bound(spark, odd, fuzz):
    texts = odd + fuzz[:200] + [prose(s, 50 + 37 * (s % 30)) for s in range(150)]
    rows = packing.pack_documents(table(spark, texts)).toPandas()
    tok = Tokenizer.from_file(packing.VOCABULARY)
    tok.encode_special_tokens = True
    for i, own in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [0], np.uint32)
        assert own.length.sum() == len(ids) and list(own.piece) == list(range(len(own))) and (len(own) == 1 or (own.length[1:] <= 2048).all())
        assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(own.start, own.length)] == list(own.ids_crc32)
        assert len(ids) > 2048 or len(own) == 1
    assert rows.doc_id.nunique() == len(texts)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 1
    assert packing.pack_documents(table(spark, texts).limit(0)).count() == 0


def test_genetic_search_beats_a_bad_start_and_never_loses_pieces():
    rng = random.Random(0)
    sizes = [rng.randrange(300, 1100) for _ in range(200)]
    place = packing.evolve(sizes, 2048, [], "s", children=60)
    fill = Counter()
    for s, b in zip(sizes, place):
        fill[b] += s
    down = packing.best_fit(sizes, 2048, sorted(range(200), key=lambda i: -sizes[i]))
    assert max(fill.values()) <= 2048 and len(fill) <= len(down.bins)
    a, b = down, packing.best_fit(sizes, 2048, list(range(200)))
    child = packing.mutate(packing.crossover(a, b, rng), rng)
    assert sorted(i for x in child.bins for i in x) == list(range(200)) and max(child.fill) <= 2048


def test_shards_are_exact_gapless_and_uniform(spark, odd):
    texts = odd + [prose(s, 20) for s in range(989)]
    rows = shard.shard_documents(table(spark, texts).repartition(7), 9, seed=3).toPandas()
    assert sorted(rows.doc_id) == list(range(len(texts)))
    sizes = rows.groupby("shard").size()
    assert len(sizes) == 9 and sizes.max() - sizes.min() <= 1
    for _, s in rows.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    for r in rows.itertuples():
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t)
    assert shard.shard_documents(table(spark, texts).limit(0), 9).count() == 0


def test_communication_matrix_is_hypergeometric():
    rng = np.random.default_rng(0)
    draws = np.array([shard._draw(np.array([10, 20, 30]), np.array([15, 45]), rng) for _ in range(4000)])
    assert (draws.sum(axis=2) == [10, 20, 30]).all() and (draws.sum(axis=1) == [15, 45]).all()
    assert np.allclose(draws.mean(axis=0), np.outer([10, 20, 30], [0.25, 0.75]), atol=0.15)


def test_language_id_equals_plain_partial_matching(spark, odd):
    import math
    words = {"aa": vocabulary(1, 60), "bb": vocabulary(2, 60)}
    rows = [(i, prose(i, 40, words[k]), k) for i, k in enumerate(["aa", "bb"] * 15)]
    docs = spark.createDataFrame(rows + [(90, None, "aa"), (91, "text without language", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["aa", "bb"]
    stats = {}
    for lang in model.langs:
        for k in range(4):
            c = stats[lang, k] = {}
            for _, t, l in rows:
                b = t.encode()
                if l == lang:
                    for i in range(k, len(b)):
                        c.setdefault(b[i - k:i], Counter())[b[i]] += 1

    def bits(b, i, lang):
        total = 0.0
        for k in range(min(3, i), -1, -1):
            c = stats[lang, k].get(b[i - k:i])
            if c:
                n = sum(c.values()) + len(c)
                if b[i] in c:
                    return total - math.log2(c[b[i]] / n)
                total -= math.log2(len(c) / n)
        return total + 8

    texts = [prose(500 + i, 9, words["aa" if i % 2 else "bb"]) for i in range(20)] + ["q", "zz 中"]
    raw = [t.encode() for t in texts]
    got = langid.code_lengths(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [[sum(bits(b, i, lang) for i in range(len(b))) for lang in model.langs] for b in raw]
    assert np.allclose(got, want, rtol=1e-4)
    told = {r.doc_id: r for r in langid.predict(table(spark, texts + odd), model).collect()}
    assert all(told[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(20))
    for i, t in enumerate(odd):
        r = told[len(texts) + i]
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", t or "")) and 0 <= r.score <= 1
    assert langid.predict(docs, langid.train(docs.limit(0))).where("lang_pred = 'und'").count() == 32
    kept = langid.keep_known(table(spark, texts[:20] + [None, "", "123"]), model)
    assert kept.count() == 20


def test_language_of_few_long_texts_or_copies_is_learned(spark):
    words = {k: ["".join(random.Random(f"{k}{i}").choices(abc, k=5)) for i in range(80)] for k, abc in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}
    rows = [(prose(i, 40000, words["aa"]), "aa") for i in range(2)] + [(prose(5, 40, words["bb"]), "bb")] * 2000 + [(prose(i, 40, words["cc"]), "cc") for i in range(50)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), train_bytes=20_000)
    assert model.langs == ["aa", "bb", "cc"]
    for k in model.langs:
        assert 10_000 < model.rows[k, 0][2].sum() < 40_000
    told = langid.predict(table(spark, [prose(900 + i, 20, words[k]) for i, k in enumerate(model.langs)]), model).collect()
    assert [r.lang_pred for r in sorted(told, key=lambda r: r.doc_id)] == model.langs


def test_foreign_bound_comes_from_held_out_documents(spark):
    words = {k: ["".join(random.Random(f"{k}{i}").choices(abc, k=6)) for i in range(60)] for k, abc in (("aa", "abcdefgh"), ("bb", "abcdefgijklm"), ("xx", "dmzyxwvuhgk"))}
    rows = [(i, prose(i, 10 + i % 150, words[k]), k) for i, k in enumerate(["aa", "bb"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.held_out()
    model = langid.train(docs, where=~out)
    bounds = langid.foreign_bounds(docs, model, where=out)
    assert len(bounds) == 33 and max(bounds) < 8
    new = [prose(5000 + i, 60, words["xx"]) for i in range(20)]
    kept = langid.keep_known(docs.unionByName(spark.createDataFrame([(9000 + i, t, None) for i, t in enumerate(new)], docs.schema)), model, bounds=bounds)
    assert {r.doc_id for r in kept.collect()} == set(range(400))


def test_licence_scan(spark, odd):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
             "Licensed under the Apache License, Version 2.0.", "He renewed his driving license at the city office."]
    texts = odd + [prose(900 + i, 30) + "\n" + x + "\n" + prose(950 + i, 30) for i, x in enumerate(lines)] + [prose(s, 25) for s in range(300, 340)]
    docs = table(spark, texts)
    out = license.scan(docs, license.train(docs))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|CartesianProduct", plan)
    rows = {(r.doc_id, r.paragraph): r for r in out.collect()}
    n = len(odd)
    assert {k: r.family for k, r in rows.items() if r.family != "unknown"} == {(n, 1): "MIT", (n + 1, 1): "CC-BY-NC", (n + 2, 1): "GPL", (n + 3, 1): "Apache-2.0"}
    assert all(r.confirmed for r in rows.values() if r.family != "unknown")
    assert license.scan(docs.limit(0), license.train(docs)).count() == 0


def test_encode_buffer_of_nothing():
    ids, upto = encode_buffer("", np.zeros(3, np.int64), lambda w: [])
    assert len(ids) == 0 and upto.tolist() == [0, 0, 0]
