"""Shared inputs of the registered queries and the matching SQL text.

Series come from ``events``: one series per user, ordered by (ts, event_id),
value scaled by 1/50.  Segments are blocks of 16 points labelled by the event
type of their first point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators.layout import index_series

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when given, its SQL twin."""
    def deco(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# A tiny offset keeps exact decimal ties off the rounding edge in both engines.
def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(2.71828e-8), 6) + F.lit(0.0)


def q6(x: str) -> str:
    return f"(round(({x}) + 2.71828e-8, 6) + 0.0)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


CHUNK_OF = {"click": "trend", "view": "plateau", "purchase": "event", "signup": "spike", "error": "transition"}
SHAPE_OF = {"click": "trend", "view": "plateau", "purchase": "cycle", "signup": "spike", "error": "step"}


def case_sql(col: str, mapping: dict) -> str:
    return "CASE " + col + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def case_col(col: str, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out


def points(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """series_id, t, value (+ named source columns)."""
    e = table(spark, sf, "events")
    p = index_series(e.select(F.col("user_id").alias("series_id"), "ts", "event_id", "value",
                              *[c for c in extra if c not in ("ts", "event_id")]),
                     "series_id", ["ts", "event_id"], F.date_trunc("week", "ts"))
    return p.select("series_id", "t", (F.col("value") / 50.0).alias("value"), *extra)


PTS = ("pts AS (SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 "
       "AS INT) AS t, value / 50.0 AS value, event_type, event_id, ts FROM events)")


def seg_points(spark: SparkSession, sf: str, *extra: str, block: int = 16) -> DataFrame:
    """Points with their block segment."""
    p = points(spark, sf, *extra)
    return p.withColumns({"segment_id": F.floor(F.col("t") / block).cast("int"),
                          "pos": (F.col("t") % block).cast("int")})


SP = PTS + ", sp AS (SELECT *, CAST(t // 16 AS INT) AS segment_id, CAST(t % 16 AS INT) AS pos FROM pts)"


def blocks(spark: SparkSession, sf: str, block: int = 16, labels: dict = CHUNK_OF) -> DataFrame:
    """Segment table of the blocks."""
    sp = seg_points(spark, sf, "event_type", block=block)
    g = sp.groupBy("series_id", "segment_id").agg(
        F.min("t").alias("start_index"), F.max("t").alias("end_index"), F.min_by("event_type", "t").alias("_e"))
    return g.withColumn("label", case_col("_e", labels)).drop("_e")


def segs_sql(block: int = 16, labels: dict = CHUNK_OF, name: str = "segs") -> str:
    return (f"{name} AS (SELECT series_id, CAST(t // {block} AS INT) AS segment_id, min(t) AS start_index, "
            f"max(t) AS end_index, {case_sql('arg_min(event_type, t)', labels)} AS label FROM pts GROUP BY 1, 2)")


SEGS = segs_sql()


def lengths(pts: DataFrame) -> DataFrame:
    return pts.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("series_length"))


LENS = "lens AS (SELECT series_id, CAST(count(*) AS INT) AS series_length FROM pts GROUP BY 1)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Long regular series: daily quantity per return flag from ``lineitem``."""
    li = table(spark, sf, "lineitem")
    d = li.groupBy(F.col("l_returnflag").alias("series_id"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(
        F.sum("l_quantity").alias("value"))
    p = index_series(d, "series_id", ["ts"], F.date_trunc("year", "ts"))
    return p.select("series_id", "t", "ts", (F.col("value") / 100.0).alias("value"))


DAILY = ("dd AS (SELECT l_returnflag AS series_id, date_trunc('day', l_shipdate) AS ts, sum(l_quantity) AS q "
         "FROM lineitem GROUP BY 1, 2), daily AS (SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id "
         "ORDER BY ts) - 1 AS INT) AS t, ts, q / 100.0 AS value FROM dd)")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"),
                    F.col("embedding").cast("array<double>").alias("v"))


EMB = ("emb AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, "
       "list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)")
