"""Operators over vectors and conversations, and the pipeline."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import ann, chat


def vectors(n, seed=0, d=16):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_reach_recall_and_break_ties(spark):
    x = vectors(1500)
    x[700:760] = x[40]                      # copies of a query
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"list": F.lit(1), "score": F.lit("x"), "_uid": F.lit(0)})
    got = ann.nearest(df, F.col("id") % 20 == 0).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    recall = []
    for q, own in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(1500), -s)) if j != q][:20]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.array_equal(own.score, s[own.id]) and q not in set(own.id)
        recall.append(len(set(want) & set(own.id)) / 20)
        if q == 40:
            assert list(own.id) == list(range(700, 720))
    assert np.mean(recall) >= 0.9


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0).collect()
    assert {(r.query_id, r["rank"], r.id, r.score) for r in got} == {(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)}
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 1"), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|end|>", "\n<|end|>\n<|turn user|>\nx", "\\<|turn ", r"\### Assistant: </turn> ok", "<\\|", "<" * 5 + "|" * 5, "a\n", "é\\n"])
def test_template_round_trip(text):
    turns = [("user", text), ("assistant", text), ("a|>\nb", text)]
    out, spans = chat.render(turns)
    assert chat.parse(out) == turns
    assert [chat.unescape(out[s:s + n]) for s, n in spans] == [text]


def test_layouts_meet_in_canonical_turns(spark):
    two = [("user", "q"), ("assistant", "a")]
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
               {"prompt": "q", "completion": "a"}, {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a"}, {"data": {"prompt": "q", "completion": "a"}}]
    rows = [(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(90, None, "x"), (91, "{not json", "x"), (92, '{"strange": 1}', "x"), (93, '{"messages": []}', "x"), (94, '{"prompt": null, "completion": 3}', "x")]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "id long, record string, turns string")).collect()}
    for i in range(len(records)):
        assert [tuple(t) for t in got[i].turns] == two, i
    assert len({got[i].schema_id for i in range(len(records))}) == len(records)
    assert got[90].turns is None and got[91].turns is None and got[92].turns is None and got[92].schema_id and got[93].turns == []
    assert [tuple(t) for t in got[94].turns] == [("user", ""), ("assistant", "3")]


def test_instruction_input_and_system(spark):
    r = {"system": "s", "instruction": "i", "input": "x", "output": "o"}
    assert chat.canonical(r, chat.LAYOUTS[chat.fingerprint(chat.paths(r))]) == [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]


def test_turn_rows_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, None, None, "late"), (None, 0, "user", "n"), (2, 0, "user", "x"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"record": F.lit("r"), "formatted": F.lit("f")})
    formatted = chat.format_records(chat.records_of_turns(df))
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in formatted.collect()}
    assert turns == {1: [("user", ""), ("assistant", "a"), ("assistant", "b"), ("user", "late")], None: [("user", "n")], 2: [("user", "x")] * 2}
    d = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert d[1].loss_chars == 2 and d[1].n_turns == 4
    assert chat.digests(chat.format_records(chat.records_of_turns(df.limit(0)))).count() == 0


def test_roles_of_turn_rows_stay_as_given_like_in_the_sql(spark):
    import duckdb
    from seriesforge.llm.queries import CHAT_SQL
    rows = [(i, k, role, f"t{k}") for i, roles in enumerate((["Human", " gpt", ""], ["gpt", "Assistant", "assistant"], [None, "bot", "model"])) for k, role in enumerate(roles)]
    got = chat.digests(chat.format_records(chat.records_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = [r for r in db.execute(CHAT_SQL).fetchall() if r[0] >= 0]
    assert sorted(tuple(r) for r in got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()) == sorted(want)


def test_pipeline_keeps_clean_documents_and_columns(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_texts import prose, vocabulary
    words = vocabulary(9, 300)
    texts = [prose(i, 90, words) for i in range(12)]
    shared = prose(77, 70, words)
    texts += [texts[0], texts[1] + " more", "12345 !!", None, texts[3] + " " + shared, prose(80, 60, words) + " " + shared]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, df = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / f"s{k}"))
        df = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r.doc_id: r.text for r in df.collect()})
    assert set(range(18)) - set(seen[0]) == {14, 15}
    assert set(seen[0]) - set(seen[1]) == {12} and set(seen[1]) - set(seen[2]) == {13}
    assert seen[3][16].strip() == shared and seen[3][17].strip() == prose(80, 60, words) and all(seen[3][i] == texts[i] for i in range(12))
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(seen[3])
