"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact, langid, license, minhash, packing, pages, passages, phrases, runs, shard
from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query("op4_exact_dedup", f"""
WITH n AS (SELECT doc_id, sha256({NORMAL}) AS text_sha256, {NORMAL} AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, text_sha256 FROM n""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf, "documents")).drop("_uid")


@query("op7_sharding")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = shard.shard_documents(table(spark, sf, "documents"), 40)
    return out.selectExpr("doc_id", "size", "text_crc32", "'rows' AS law", "cast(shard AS int) AS shard", "cast(slot AS long) AS slot",
                          "cast(NULL AS int) AS grown_shard")


MARKS = len(chat.OPEN + chat.MID + chat.CLOSE)


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(MARKS + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""".replace("MARKS", str(MARKS))


@query("op10_chat_format", CHAT_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")],
                                  "conv_id long, turn long, role string, text string")
    records = chat.records_of_turns(turns.unionByName(extra))
    return chat.digests(chat.format_records(records))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"), ids=False)


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.train(docs, where=~langid.held_out())
    told = langid.predict(docs, model, carry=["doc_id"])
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op9_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf, "documents")).drop("_uid")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf, "documents")).drop("_uid")


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = ann.nearest(table(spark, sf, "embeddings"), F.col("id") % 20 == 0, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op2_license_scan")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return license.scan(docs, license.train(docs))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = runs.periodic_runs(docs.select("doc_id", runs.planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100),
inner_ AS (SELECT DISTINCT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, a FROM c WHERE k > 2),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w FROM c ANTI JOIN inner_ USING (lang, phrase, a)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * cuts.a * n.n) // (x.a::HUGEINT * y.a) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000"""


@query("op12_phrase_mining", PHRASE_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


@query("op11_html_extraction")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = pages.extract(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
