"""Streaming runs over the event table, compared with the batch SQL."""

from pyspark.sql import functions as F

from seriesforge.operators import sessions as X
from seriesforge.operators import validation as VA
from seriesforge.streaming import queries as Q

from .base import PTS, SHAPE_OF, case_col, q6, query, r6
from .session_logs import CF, CHIP, LOG, SH, chips, cf_results
from .validating import BAND, RESI, residuals


def stream(spark, sf):
    return Q.table_stream(spark, sf, "events")


def chip_stream(spark, sf):
    from seriesforge import config as C
    shapes = F.array(*[F.lit(s) for s in C.SHAPES])
    return stream(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id", (F.col("value") < 50).alias("is_valid"),
                                    case_col("event_type", SHAPE_OF).alias("old_shape"), F.get(shapes, (F.col("event_id") % 9 % 7).cast("int")).alias("new_shape"))


def value_stream(spark, sf):
    return stream(spark, sf).select(F.col("user_id").alias("series_id"), "ts", "event_id", (F.col("value") / 50.0).alias("value"))


COUNT = f"{CHIP}, sx AS (SELECT session_id, old_shape AS shape FROM cp UNION ALL SELECT session_id, new_shape FROM cp WHERE new_shape<>old_shape), ct AS (SELECT session_id, shape, count(*) AS count FROM sx GROUP BY 1,2)"


@query("t01_fan_out", f"WITH {COUNT}, vt AS (SELECT user_id AS session_id, count(*) AS n, count(*) FILTER (value<50) AS v FROM events GROUP BY 1) SELECT session_id, shape AS name, count AS n FROM ct UNION ALL SELECT session_id, 'n_total', n FROM vt UNION ALL SELECT session_id, 'n_valid', v FROM vt")
def _(spark, sf):
    cov, val = Q.fan_out(chip_stream(spark, sf), Q.scratch(spark))
    return cov.select("session_id", F.col("shape").alias("name"), F.col("count").alias("n")).unionByName(val.unpivot("session_id", ["n_total", "n_valid"], "name", "n"))


@query("t02_running_coverage", f"WITH {COUNT} SELECT * FROM ct")
def _(spark, sf):
    return Q.run_once(Q.coverage_counts(chip_stream(spark, sf)), "complete")


@query("t03_running_validity", f"WITH {CF} SELECT session_id, event_id, {q6('CASE WHEN count(*) OVER (PARTITION BY session_id ORDER BY ts, event_id) >= 10 THEN avg(is_valid::INT) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END')} AS recent_rate FROM cf")
def _(spark, sf):
    return Q.recent_validity(chip_stream(spark, sf))[0].withColumn("recent_rate", r6("recent_rate"))


@query("t04_online_band", f"WITH RECURSIVE {RESI}, {BAND} SELECT series_id, CAST(t AS INT) AS t, {q6('q')} AS q FROM bd WHERE t>=0")
def _(spark, sf):
    q0 = VA.calibrate_band(residuals(spark, sf))
    return Q.online_band(value_stream(spark, sf).join(q0, "series_id"))[0].withColumn("q", r6("q"))


@query("t05_online_baseflow", f"WITH RECURSIVE {PTS}, bq AS (SELECT series_id, t, value, 0.8*value AS b FROM pts WHERE t=0 UNION ALL SELECT d.series_id, d.t, d.value, least((0.2*0.98*bq.b + 0.02*0.8*d.value)/(1-0.98*0.8), d.value) FROM bq JOIN pts d ON d.series_id=bq.series_id AND d.t=bq.t+1) SELECT series_id, t, {q6('b')} AS baseflow FROM bq")
def _(spark, sf):
    return Q.online_baseflow(value_stream(spark, sf))[0].withColumn("baseflow", r6("baseflow"))


@query("t06_online_change")
def _(spark, sf):
    return Q.online_change(value_stream(spark, sf))[0]


@query("t07_online_prototypes")
def _(spark, sf):
    from seriesforge import config as C
    s = Q.table_stream(spark, sf, "embeddings")
    shapes = F.array(*[F.lit(x) for x in C.SHAPES])
    c = s.select((F.col("vec_id") % 3).alias("session_id"), F.col("vec_id").alias("seq"), F.timestamp_seconds("vec_id").alias("ts"), F.get(shapes, (F.col("label") % 7).cast("int")).alias("label"),
                 (F.col("vec_id") * 37 % 100 / 100.0).alias("confidence"), F.col("embedding").cast("array<double>").alias("v"))
    return Q.online_prototypes(c, cap=20)[0]


@query("t08_online_tips")
def _(spark, sf):
    v = F.col("value")
    m = stream(spark, sf).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.timestamp_seconds("event_id").alias("ts"), (v / 100).alias("ynn"), (v / 120).alias("cs"), (v / 200).alias("probe_ir"))
    cols = m.columns
    c = F.array_sort(F.array_compact(F.array(*[F.when(X.predicate(cond, cols), F.struct((-F.lit(sev)).alias("s"), (-F.lit(X.DEGREES[d])).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("rule_id"), F.lit(mo).alias("modality"), F.lit(sev).alias("severity")))
                                               for i, (r, cond, d, mo, sev, _m) in enumerate(X.TIP_RULES)])))
    return Q.online_tips(m.select("session_id", "ts", "seq", c.alias("c")))[0]


@query("t09_trailing_validity", f"WITH {CF} SELECT session_id, event_id, count(*) OVER w AS n_window, {q6('avg(is_valid::INT) OVER w')} AS rate FROM cf WINDOW w AS (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    return Q.trailing_validity(chip_stream(spark, sf))[0].withColumn("rate", r6("rate"))


@query("t10_sequence_numbers", f"WITH {LOG} SELECT session_id, src AS event_id, CAST(sequence AS INT) AS sequence FROM lg")
def _(spark, sf):
    return Q.sequence_numbers(chip_stream(spark, sf))[0]


@query("t11_replay_equality", f"WITH {COUNT} SELECT session_id, shape, count, true AS same FROM ct")
def _(spark, sf):
    live = Q.run_once(Q.coverage_counts(chip_stream(spark, sf)), "complete")
    again = Q.coverage_counts(chips(spark, sf)).withColumnRenamed("count", "_c")
    j = live.join(again, ["session_id", "shape"], "full_outer")
    return j.select("session_id", "shape", "count", F.col("count").eqNullSafe(F.col("_c")).alias("same"))


def arrivals(spark, sf, parts, part):
    """Stream of the events in ``parts`` batches: ``part`` says in which of them an event arrives."""
    folder = f"{Q.scratch(spark)}/events"
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(parts):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return s.select(F.col("user_id").alias("session_id"), "ts", "event_id", (F.col("value") < 50).alias("is_valid"))


@query("t03_out_of_order", f"WITH {CF} SELECT session_id, event_id, {q6('CASE WHEN count(*) OVER (PARTITION BY session_id ORDER BY ts, event_id) >= 10 THEN avg(is_valid::INT) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END')} AS recent_rate FROM cf")
def _(spark, sf):
    s = arrivals(spark, sf, 3, F.pmod(F.xxhash64("event_id"), F.lit(3)))
    return Q.recent_validity(s, delay="5000 days")[0].withColumn("recent_rate", r6("recent_rate"))


@query("t12_no_row_lost", "SELECT user_id AS session_id, count(*) AS n, true AS some_late FROM events GROUP BY 1")
def _(spark, sf):
    kept, late = Q.sequence_numbers(arrivals(spark, sf, 3, F.pmod(F.xxhash64("event_id"), F.lit(3))), delay="1 hour")
    n = kept.select("session_id", F.lit(0).alias("_l")).unionByName(late.select("session_id", F.lit(1).alias("_l")))
    some = late.groupBy().agg((F.count(F.lit(1)) > 0).alias("some_late"))
    return n.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).withColumn("some_late", some.scalar())
