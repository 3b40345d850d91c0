"""Main text of pages, phrase mining and periodic runs."""

import random
import re
from collections import Counter
from html.parser import HTMLParser
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesforge.llm import pages, phrases, runs

SF = "/root/testdata/sf0.001"
PROSE = "The report that was read by the people in the city is not the same as the one which they have seen in all of this year."
AD = "This is the best of all the offers that we have for you and it is only for the people who are in the city on this day."


# main text of pages

@pytest.mark.parametrize("page, text", [
    (f"<body><nav><a href=x>Home</a></nav><h1>Title</h1><p>{PROSE}<p>Short one.<p>{PROSE}</body>", f"Title\n{PROSE}\nShort one.\n{PROSE}"),
    (f"<div class='cookie-notice'>{AD}</div><article><h1>Title</h1><p>Tiny.</p><p>{PROSE}</p></article><aside>{AD}</aside>", f"Title\nTiny.\n{PROSE}"),
    (f"<article><p>{PROSE}</p><div class=ad>{AD}</div><form><p>{AD}</form><p>End.</p></article><section id=comments><p>{AD}</section>", f"{PROSE}\nEnd."),
    (f"<header><p>{AD}</header><main><p>{PROSE}</main><footer>{AD}</footer>", PROSE),
    (f'<script>var t="</p><p>{AD}</p>"</script><style>p{{}}</style><p>{PROSE}</p><!-- <p>{AD}</p> -->', PROSE),
    (f"<p>{PROSE}</p><ul><li><a href=1>One of the links that is here</a></li><li><a href=2>And one more of the links</a></li></ul>", PROSE),
    ("<article>a &amp; b &lt;c&gt; &eacute;&#33;&nbsp; d\n\t e<br>f<br><br>g</article>", "a & b <c> é! d e f\ng"),
    ("<article><p class=ad>no<p>yes</article>", "yes"),
    ("<article><p>x &am</p><p>y &amp</p><p>1 < 2 <3</p></article>", "x &am\ny &\n1 < 2 <3"),
    ("<article><b>one<p>two<li>three<table><tr><td>four<td>five</table></article>", "one\ntwo\nthree\nfour\nfive"),
    ('<article><p title="a > b">kept</p><p>lost <a', "kept\nlost"),
    ('<body class="has-sidebar no-header"><article class="post">in</article>out</body>', "in"),
    ("", ""), (None, ""), ("plain words only", "plain words only"), ("<nav>menu</nav>", ""), ("<script>never closed <p>x</p>", ""), ("</p></div></b>", ""),
])
def test_main_text_of_small_pages(page, text):
    assert pages.main_text(page) == text


class Article(HTMLParser):
    """Texts of an article element by the standard parser: another way to the same blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_of_the_tables_equal_the_standard_parser(spark):
    found = {r.page_id: r.text for r in pages.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(found) == len(rows)
    for i, page in rows:
        parser = Article()
        parser.feed(page.replace("<br>", " <br>"))
        assert found[i] == "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x), i


def test_rules_alone_find_nearly_the_same_text():
    rows = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    whole = apart = 0
    for (page,) in rows:
        a, b = pages.main_text(page), pages.main_text(re.sub("</?article>", "", page))
        whole += len(a)
        apart += abs(len(a) - len(b))
    assert apart < 0.1 * whole


def test_pages_of_any_table(spark):
    df = spark.createDataFrame([(1, None, "t", None), (None, "<p>a</p>", None, 2), (1, "", "t", None)], "page_id long, html string, text string, n_chars long")
    got = sorted((str(r.page_id), r.text) for r in pages.extract(df).collect())
    assert got == [("1", ""), ("1", ""), ("None", "a")]
    assert pages.extract(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/abp =\"'!-&;#\n", max_size=60))
def test_any_markup_is_read(page):
    assert isinstance(pages.main_text(page), str)


def test_very_long_page():
    page = "<article>" + f"<p>{PROSE}</p>" * 3000 + "<b>" * 20_000 + "</i>" * 20_000 + "end</article>"
    assert pages.main_text(page).count("\n") == 3000 and pages.main_text('<a href="' + "<x " * 50_000).strip() == ""


# phrases

def plain(rows, least, longest, top):
    """Brute force by the definition."""
    counts: Counter = Counter()
    n: Counter = Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {g: c for g, c in counts.items() if len(g[1]) > 1 and c >= least}
    within = {(lang, part) for (lang, p), c in found.items() for part in (p[:-1], p[1:]) if found.get((lang, part)) == c}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) in within:
            continue
        score, cut = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, counts[lang, p[:cut]], counts[lang, p[cut:]], n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank: Counter = Counter()
    result = []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], *rest))
    return result


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "in", "São", "x", "new york", "new york city hall", "a-b", "q"] + [f"w{i}" for i in range(30)]
    weights = [20, 5, 15, 12, 6, 6, 8, 5, 4, 3] + [1] * 30
    rows = []
    for _ in range(n):
        text = "".join(rng.choices(words, weights)[0] + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), (None, ""), ("fr", "alone"), ("en", "odd one out " * 50), ("de", "  　.")]


@pytest.mark.parametrize("least, longest, top, rate", [(10, 5, 2000, 2), (8, 4, 5, 8), (5, 5, 2000, 50), (3, 2, 2000, 3)])
def test_phrases_equal_brute_force(spark, least, longest, top, rate):
    rows = corpus(rate)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "a long, lang string, text string").withColumns({"phrase": F.lit(1), "k": F.lit("x"), "c": F.lit(None)}).repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least=least, longest=longest, top=top, rate=rate).collect()]
    want = plain(rows, least, longest, top)
    assert sorted(got) == sorted(want) and len(want) > 5


def test_border_failures_are_closed_by_an_expansion(spark):
    df = spark.createDataFrame(corpus(1), "lang string, text string").coalesce(1)
    counts, passes = phrases.frequent_phrases(df, least=6, rate=10_000)     # an empty sample proposes nothing
    assert passes == 2
    once, one = phrases.frequent_phrases(df, least=6, rate=1)               # a whole sample proposes all
    assert one == 1
    key = ["lang", "k", "phrase", "c"]
    assert sorted(map(tuple, counts.select(key).collect())) == sorted(map(tuple, once.select(key).collect()))


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], df.schema), least=1).count() == 0


def test_scores_pass_64_bits(spark):
    from unittest.mock import patch
    rows = [("en", 0, "", 4 * 10**12), ("en", 1, "a", 3 * 10**9), ("en", 1, "b", 3 * 10**9 + 1), ("en", 2, "a b", 2 * 10**9 + 7)]
    counts = spark.createDataFrame(rows, phrases.COUNTS)
    with patch.object(phrases, "frequent_phrases", lambda *a: (counts, 1)):
        got = phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 2 * 10**9 + 7, 3 * 10**9, 3 * 10**9 + 1, 4 * 10**12, 1000 * (2 * 10**9 + 7) * 4 * 10**12 // (3 * 10**9 * (3 * 10**9 + 1)))]


# periodic runs

def runs_by_definition(s, periods, words):
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            smaller = any(size >= 2 * d and all(s[x] == s[x + d] for x in range(i, i + size - d)) for d in range(1, q))
            if size >= max(words, periods * q) and not smaller:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 6), st.integers(1, 6))
def test_runs_equal_the_definition(s, p, times):
    s = s + (s[-p:] or [0]) * times
    for periods, words in ((4, 6), (2, 2)):
        assert [tuple(x) for x in runs.find_runs(np.array(s, np.int64), periods, words).tolist()] == runs_by_definition(s, periods, words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=6), st.integers(1, 5))
def test_stretches_lose_no_run(parts, times):
    texts = [" ".join(f"w{x}" for x in p * times) for p in parts] + [None, "", " \t"]
    found, left = runs.of_texts(pa.array(texts, pa.string()), 4, 6)
    for text, own, short in zip(texts, found, left.to_pylist()):
        words = (text or "").split()
        assert own == runs_by_definition(words, 4, 6)
        dropped = {i for a, n, q in own for i in range(a + q, a + n)}
        assert short == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_suffix_tree_orders_suffixes_and_finds_extensions():
    rng = np.random.default_rng(0)
    for size in (1, 2, 30, 200):
        s = rng.integers(0, 2, size).tolist()
        tree = runs.SuffixTree(s)
        leaves, depths = tree.tour()
        suffixes = [[*s[i:], -1] for i in range(size + 1)]
        assert leaves.tolist() == sorted(range(size + 1), key=lambda i: suffixes[i])
        assert tree.falling().tolist() == sorted(range(size + 1), key=lambda i: [-x if x >= 0 else -9 for x in suffixes[i]])
        common = lambda a, b: next(k for k, (x, y) in enumerate(zip(suffixes[a], suffixes[b])) if x != y)
        assert depths[1:].tolist() == [common(a, b) for a, b in pairwise(leaves.tolist())]
        if size > 2:
            i, j = rng.integers(0, size, 50), rng.integers(0, size, 50)
            i, j = i[i != j], j[i != j]
            assert runs.Extensions(leaves, depths)(i, j).tolist() == [common(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_runs_of_any_table(spark):
    rows = [(1, "a b " * 4, 7, "x"), (2, None, None, "x"), (None, "", 1, "x"), (4, "no run here", 1, None), (1, "a b " * 4, 7, "x"), (6, " ".join(f"w{i % 5000}" for i in range(30_000)), 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long, collapsed string").withColumn("_uid", F.lit(0))
    got = {r.doc_id: r for r in runs.periodic_runs(df).withColumn("best", runs.strongest(F.col("runs"))).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 8, 2)] and got[1].collapsed == "a b" and tuple(got[1].best) == (0, 8, 2)
    assert got[2].runs == got[None].runs == got[4].runs == [] and got[2].collapsed == "" and got[4].best is None and got[4].collapsed == "no run here"
    assert [tuple(r) for r in got[6].runs] == [(0, 30_000, 5000)]
    assert runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(df, periods=2)


def test_strongest_run_and_its_ties(spark):
    df = spark.createDataFrame([([(5, 8, 2), (0, 12, 3), (20, 8, 2)],), ([(3, 12, 3), (3, 8, 2)],), ([(9, 9, 2), (0, 8, 2)],)], f"runs {runs.RUN}")
    assert [tuple(r.b) for r in df.select(runs.strongest(F.col("runs")).alias("b")).collect()] == [(0, 12, 3), (3, 8, 2), (9, 9, 2)]


def test_planted_periods_follow_their_rule(spark):
    import zlib
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 40))) for i in range(200)] + [(None, "n n"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in df.select("doc_id", "text", runs.planted_period(F.col("doc_id"), F.col("text")).alias("t")).collect():
        w = (r.text or "").split()
        if r.doc_id is not None and w and (h := zlib.crc32(str(r.doc_id).encode())) % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert (r.t or "").split() == w
