"""Sessions, guardrails, study tables."""

from pyspark.sql import functions as F

from seriesforge import config as C
from seriesforge.operators import sessions as X
from seriesforge.sources import datasets as SO

from .base import DAILY, PTS, SHAPE_OF, SP, case_col, case_sql, daily, points, q6, query, r6, seg_points, table
from .windowed import MISS, gappy

ev = lambda spark, sf: table(spark, sf, "events")
SH = "['plateau','trend','step','spike','cycle','transient','noise']"


@query("p04_gap_gate", f"WITH {MISS}, g AS (SELECT series_id, CAST(t//16 AS INT) AS segment_id, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END) AS r FROM ms GROUP BY 1,2) SELECT series_id, segment_id, {q6('r')} AS missing_ratio, CAST(round(r*100) AS INT) AS missing_pct, r*100 > 20 AS blocks_dense_ops FROM g")
def _(spark, sf):
    p = gappy(spark, sf).withColumn("segment_id", F.floor(F.col("t") / 16).cast("int"))
    return X.missingness(p).withColumn("missing_ratio", r6("missing_ratio"))


@query("p05_length_filter", f"WITH {SP} SELECT series_id, segment_id, count(*) AS n FROM sp GROUP BY 1,2 HAVING count(*) >= 10")
def _(spark, sf):
    return X.long_enough(seg_points(spark, sf), 10)


@query("p14_traffic_light", "SELECT event_id, CASE WHEN value IS NULL THEN 'idle' WHEN value<15 THEN 'red' WHEN value<50 THEN 'amber' ELSE 'green' END AS validity, CASE WHEN value>100 THEN 'red' WHEN value>60 THEN 'amber' ELSE 'green' END AS forking FROM events")
def _(spark, sf):
    v = F.col("value")
    return ev(spark, sf).select("event_id", X.traffic_light(v, 50, 15).alias("validity"), X.traffic_light(v, amber_above=60, red_above=100).alias("forking"))


RES = "rr AS (SELECT event_id, value/50-1 AS before, value/100-0.6 AS after, event_type IN ('click','view') AS hard FROM events)"


@query("p15_residual_status", f"WITH {RES} SELECT event_id, CASE WHEN abs(after)<=0.25 THEN 'green' WHEN hard THEN 'red' ELSE 'amber' END AS status, CASE WHEN abs(abs(before)-abs(after))<=1e-15 THEN 'unchanged' WHEN abs(after)<abs(before) THEN 'improving' ELSE 'worsening' END AS direction FROM rr")
def _(spark, sf):
    b, a = F.col("value") / 50 - 1, F.col("value") / 100 - 0.6
    hard = F.col("event_type").isin("click", "view")
    return ev(spark, sf).select("event_id", X.residual_status(a, F.lit(0.25), hard).alias("status"), X.residual_direction(b, a).alias("direction"))


@query("p16_plausibility_badge", f"WITH {RES}, s AS (SELECT event_id, CASE WHEN event_id%5=0 THEN 'amber' WHEN before>=-1 AND before<=1 THEN 'green' ELSE 'red' END AS a, CASE WHEN abs(after)<=0.25 THEN 'green' WHEN hard THEN 'red' ELSE 'amber' END AS b, CASE WHEN event_id%2=1 THEN 'disabled' WHEN abs(before)<=2 THEN 'green' WHEN abs(before)<=3 THEN 'amber' ELSE 'red' END AS c FROM rr) "
       "SELECT event_id, CASE WHEN 'red' IN (a,b,c) THEN 'red' WHEN 'amber' IN (a,b,c) THEN 'amber' ELSE 'green' END AS badge FROM s")
def _(spark, sf):
    b, a = F.col("value") / 50 - 1, F.col("value") / 100 - 0.6
    lo = F.when(F.col("event_id") % 5 != 0, -1.0)
    r = X.range_signal(lo, F.lit(1.0), b, b)
    s = X.residual_status(a, F.lit(0.25), F.col("event_type").isin("click", "view"))
    m = X.manifold_signal(b, F.col("event_id") % 2 == 0)
    return ev(spark, sf).select("event_id", X.worst_signal(r, s, m).alias("badge"))


@query("p17_context_predicate", "SELECT event_id, value > 20 AND abs(value-50) < 30 AND event_type IN ('click','view') AS hit, true AS empty, false AS unknown_name, coalesce(greatest(value, 40) <> 40 AND NOT (round_even(value, 0) > 100), false) AS with_functions FROM events")
def _(spark, sf):
    e = ev(spark, sf)
    c = ["value", "event_type"]
    return e.select("event_id", X.predicate("value > 20 AND abs(value - 50) < 30 AND event_type IN ('click', 'view')", c).alias("hit"), X.predicate("", c).alias("empty"),
                    X.predicate("slope > 1", c).alias("unknown_name"), X.predicate("greatest(value, 40) <> 40 AND NOT (bround(value, 0) > 100)", c).alias("with_functions"))


UT = "ut AS (SELECT event_id, user_id, event_type, value, least(1.0, value/100) AS pl, (event_id%11)/10.0 AS sp, CASE WHEN value<50 THEN 1.0 ELSE 0 END AS va FROM events), uu AS (SELECT *, greatest(0.0, least(1.0, 0.4*least(1.0,pl)+0.3*least(1.0,sp)+0.3*va)) AS u FROM ut)"


def utilities(spark, sf):
    e = ev(spark, sf)
    return e.withColumn("u", X.utility(F.col("value") / 100, F.col("event_id") % 11 / 10.0, F.when(F.col("value") < 50, 1.0).otherwise(0.0)))


@query("p22_edit_utility", f"WITH {UT} SELECT event_id, {q6('u')} AS utility FROM uu")
def _(spark, sf):
    return utilities(spark, sf).select("event_id", r6("u").alias("utility"))


@query("p27_drawn_series", f"""WITH d AS (SELECT user_id AS drawing_id, (event_id*7)%200 AS x, arg_max(value, event_id) AS y FROM events GROUP BY 1,2), g AS (SELECT drawing_id, min(x) AS a, max(x) AS b FROM d GROUP BY 1), gx AS (SELECT drawing_id, i, a+(b-a)*i/15.0 AS x FROM g, range(16) r(i)),
 nb AS (SELECT gx.drawing_id, i, gx.x, greatest(1, least(count(*) FILTER (d.x < gx.x), count(*)-1)) AS k FROM gx JOIN d USING (drawing_id) GROUP BY 1,2,3), dr AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY x)-1 AS rn FROM d),
 v AS (SELECT nb.drawing_id, i, -(l.y+(r.y-l.y)*(nb.x-l.x)/(r.x-l.x)) AS v FROM nb JOIN dr l ON l.drawing_id=nb.drawing_id AND l.rn=k-1 JOIN dr r ON r.drawing_id=nb.drawing_id AND r.rn=k) SELECT drawing_id, CAST(i AS INT) AS i, {q6('-1 + (v-min(v) OVER w)/(max(v) OVER w - min(v) OVER w)*3')} AS value FROM v WINDOW w AS (PARTITION BY drawing_id)""")
def _(spark, sf):
    d = ev(spark, sf).select(F.col("user_id").alias("drawing_id"), (F.col("event_id") * 7 % 200).alias("x"), F.col("value").alias("y"), F.col("event_id").alias("seq"))
    return X.drawn_series(d, 16, -1.0, 2.0).select("drawing_id", F.posexplode("values").alias("i", "value")).withColumn("value", r6("value"))


@query("p28_scope_defaults", "WITH s AS (SELECT event_id, ['hydrology','seismo-geodesy','remote-sensing','other'][CAST(event_id%4 AS INT)+1] AS dom, CASE WHEN event_id%3=0 THEN value END AS w, CASE WHEN event_id%5=0 THEN 'fixed' END AS md, CASE WHEN event_id%7=0 THEN 1.0 END AS ref FROM events), f AS (SELECT *, coalesce(w, CASE dom WHEN 'remote-sensing' THEN 365 ELSE 30 END)::DOUBLE AS ws, coalesce(md, CASE dom WHEN 'seismo-geodesy' THEN 'fixed' ELSE 'sliding' END) AS mode FROM s) "
       f"SELECT event_id, {q6('ws')} AS window_size, mode, concat_ws(',', CASE WHEN ws<>floor(ws) THEN 'window_not_integer' WHEN ws<=0 THEN 'window_non_positive' WHEN ws>300 THEN 'window_exceeds_series' END, CASE WHEN mode='fixed' AND ref IS NULL THEN 'reference_required' END) AS scope_errors FROM f")
def _(spark, sf):
    doms = F.array(*[F.lit(x) for x in ("hydrology", "seismo-geodesy", "remote-sensing", "other")])
    k = F.col("event_id")
    s = ev(spark, sf).select("event_id", F.get(doms, (k % 4).cast("int")).alias("domain_hint"), F.when(k % 3 == 0, F.col("value")).alias("window_size"),
                             F.when(k % 5 == 0, "fixed").alias("mode"), F.when(k % 7 == 0, 1.0).alias("reference"), F.lit(300).alias("series_length"))
    return X.with_scope(s).select("event_id", r6("window_size").alias("window_size"), "mode", F.concat_ws(",", "scope_errors").alias("scope_errors"))


# --- logs: one session per user ---------------------------------------------------------

LOG = f"lg AS (SELECT user_id AS session_id, ts, event_id AS src, event_type AS op, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)"


def log(spark, sf):
    e = ev(spark, sf).select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("src"), F.col("event_type").alias("op"), "value", (F.col("value") < 60).alias("applied"))
    return X.sequence_events(e, ["ts", "src"])


@query("s11_operation_log", f"WITH {LOG} SELECT session_id, src, CAST(sequence AS INT) AS sequence, session_id || '-event-' || sequence AS event_id, CASE WHEN value<60 THEN 'operation_applied' ELSE 'operation_rejected' END AS event_type FROM lg")
def _(spark, sf):
    return log(spark, sf).select("session_id", "src", "sequence", "event_id", "event_type")


@query("s12_suggestion_log", "SELECT event_id, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'overridden' END AS decision, 'suggestion_' || CASE event_type WHEN 'click' THEN 'accepted' ELSE 'overridden' END AS event_type FROM events WHERE event_type IN ('click','view')")
def _(spark, sf):
    d = ev(spark, sf).select("event_id", case_col("event_type", {"click": "accepted", "view": "overridden", "error": "ignored"}).alias("decision"))
    return X.suggestion_events(d)[0]


@query("s10_session_export", "SELECT conv_id AS session_id, string_agg(turn || ':' || role, '|' ORDER BY turn) AS events, count(*) AS n, min(turn) AS ended_at FROM conversations GROUP BY 1")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    s = c.groupBy(F.col("conv_id").alias("session_id")).agg(F.min("turn").alias("started_at")).withColumn("ended_at", F.lit(None).cast("long"))
    e = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence"), "role")
    x = X.export_sessions(s, e)
    return x.select("session_id", F.array_join(F.transform("events", lambda r: F.concat_ws(":", r["sequence"].cast("string"), r["role"])), "|").alias("events"),
                    F.size("events").cast("long").alias("n"), "ended_at")


AUD = f"""{LOG}, ch AS (SELECT user_id AS session_id, event_id, event_id%4 AS tier, {case_sql('event_type', SHAPE_OF)} AS old_shape, {SH}[CAST(event_id%7 AS INT)+1] AS new_shape, (event_id%10)/10.0 AS confidence, CASE WHEN event_id%3=0 THEN 'PRESERVED' ELSE 'DETERMINISTIC' END AS rule_class FROM events),
 jc AS (SELECT lg.*, tier, old_shape, new_shape, rule_class, CASE WHEN confidence>=0.8 THEN 'green' WHEN confidence>=0.5 THEN 'yellow' ELSE 'red' END AS badge FROM lg LEFT JOIN ch ON ch.event_id=lg.src AND op<>'error')"""


def chips_of(spark, sf):
    """Label chips of all but error events, keyed by the event's sequence; every chip twice, the later one counts."""
    l = log(spark, sf).where("op <> 'error'")
    shapes = F.array(*[F.lit(s) for s in C.SHAPES])
    base = l.select("session_id", "sequence", (F.col("src") % 4).alias("tier"), case_col("op", SHAPE_OF).alias("old_shape"), F.get(shapes, (F.col("src") % 7).cast("int")).alias("new_shape"),
                    (F.col("src") % 10 / 10.0).alias("confidence"), F.when(F.col("src") % 3 == 0, "PRESERVED").otherwise("DETERMINISTIC").alias("rule_class"))
    return base.withColumn("chip_no", F.lit(2)).unionByName(base.withColumns({"chip_no": F.lit(1), "tier": F.lit(9).cast("long")}))


@query("j07_audit_chips", f"WITH {AUD} SELECT session_id, CAST(sequence AS INT) AS sequence, op, tier, old_shape AS pre_shape, new_shape AS post_shape, rule_class, CASE WHEN tier IS NOT NULL THEN badge END AS badge FROM jc")
def _(spark, sf):
    return X.audit_rows(log(spark, sf), chips_of(spark, sf)).select("session_id", "sequence", "op", "tier", "pre_shape", "post_shape", "rule_class", "badge")


@query("p06_audit_filter", f"WITH {AUD}, mx AS (SELECT session_id, max(sequence) AS n FROM lg GROUP BY 1) SELECT jc.session_id, CAST(sequence AS INT) AS sequence, op FROM jc JOIN mx USING (session_id) WHERE sequence <= n-3 AND tier=2 AND badge='green' AND ts >= TIMESTAMP '2024-01-05'")
def _(spark, sf):
    r = X.audit_rows(log(spark, sf), chips_of(spark, sf), undo=3)
    return X.filter_audit(r, tier=2, badge="green", date_from="2024-01-05").select("session_id", "sequence", "op")


@query("a42_session_summary", f"WITH {LOG} SELECT session_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started_at, CAST(epoch_us(max(ts)) AS BIGINT) AS ended_at, count(*) AS event_count, CAST(sum(sequence%3) AS BIGINT) AS warning_count FROM lg GROUP BY 1")
def _(spark, sf):
    s = X.session_summary(log(spark, sf).withColumn("warning_count", F.col("sequence") % 3))
    return s.select("session_id", F.unix_micros("started_at").alias("started_at"), F.unix_micros("ended_at").alias("ended_at"), "event_count", "warning_count")


@query("u02_event_type_coverage", "WITH e AS (SELECT CASE WHEN user_id%2=0 THEN 'a' ELSE 'b' END AS cond, event_type || CASE WHEN user_id%2=0 AND event_type='click' THEN '_x' ELSE '' END AS event_type FROM events) SELECT event_type, 'only_first' AS kind FROM (SELECT event_type FROM e WHERE cond='a' EXCEPT SELECT event_type FROM e WHERE cond='b') UNION ALL SELECT event_type, 'shared' FROM (SELECT event_type FROM e WHERE cond='a' INTERSECT SELECT event_type FROM e WHERE cond='b')")
def _(spark, sf):
    even = F.col("user_id") % 2 == 0
    e = ev(spark, sf).select(F.when(even, "a").otherwise("b").alias("cond"), F.concat("event_type", F.when(even & (F.col("event_type") == "click"), "_x").otherwise("")).alias("event_type"))
    return X.event_type_coverage(e, "cond", "a", "b")


@query("m10_telemetry_checks", f"WITH {LOG}, f AS (SELECT session_id, count(*) FILTER (value>490) AS dec, count(*) FILTER (value<0.1) AS tgt FROM lg GROUP BY 1) SELECT session_id, metric_id, CASE metric_id WHEN 'session_duration' THEN 'supported' WHEN 'operation_diversity' THEN 'supported' WHEN 'suggestion_uptake' THEN CASE WHEN dec>0 THEN 'supported' ELSE 'missing_fields' END WHEN 'target_segment_coverage' THEN CASE WHEN tgt>0 THEN 'supported' ELSE 'missing_fields' END ELSE 'missing_fields' END AS status "
       "FROM f, (SELECT unnest(['session_duration','operation_diversity','constraint_feedback_rate','suggestion_uptake','target_segment_coverage','condition_assignment','participant_linkage','task_completion_marker']) AS metric_id)")
def _(spark, sf):
    l = log(spark, sf)
    e = l.select("session_id", F.col("ts").alias("startedAt"), F.col("ts").alias("endedAt"), F.col("event_type").alias("eventType"), F.col("op").alias("operationType"),
                 F.when(F.col("value") > 490, "accepted").alias("suggestionDecision"), F.when(F.col("value") < 0.1, "s1").alias("operationTargets"), F.lit("").alias("conditionId"))
    return X.telemetry_checks(e).select("session_id", "metric_id", "status")


@query("m11_readiness_report")
def _(spark, sf):
    from seriesforge.plans.reports import readiness_report
    from .evaluation import session_events
    e = session_events(spark, sf).withColumnRenamed("event_type", "eventType").withColumn("condition", F.when(F.col("session_id") % 2 == 0, "semantic-interface").otherwise("rule-only-baseline"))
    return readiness_report(e)


# --- session metrics -------------------------------------------------------------------------

CF = f"cf AS (SELECT user_id AS session_id, ts, event_id, value<50 AS is_valid, event_id%4 AS tier, {case_sql('event_type', SHAPE_OF)} AS shape FROM events)"


def cf_results(spark, sf):
    return ev(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id", (F.col("value") < 50).alias("is_valid"), (F.col("event_id") % 4).cast("int").alias("tier"), case_col("event_type", SHAPE_OF).alias("shape"))


@query("v18_validity_rate", f"WITH {CF}, rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS r FROM cf) SELECT session_id, count(*) AS n_total, count(*) FILTER (is_valid) AS n_valid, {q6('avg(is_valid::INT)')} AS rate, {q6('avg(is_valid::INT) FILTER (tier=1)')} AS rate_tier_1, "
       f"{q6('avg(is_valid::INT) FILTER (shape=' + repr('cycle') + ')')} AS rate_cycle, {q6('CASE WHEN count(*)>=10 THEN avg(is_valid::INT) FILTER (r<=10) END')} AS recent_rate, {q6('avg(is_valid::INT) FILTER (ts >= TIMESTAMP ' + repr('2024-01-24') + ')')} AS rate_7_days, coalesce(count(*)>=10 AND avg(is_valid::INT) FILTER (r<=10) < 0.3, false) AS tip FROM rk GROUP BY 1")
def _(spark, sf):
    v = X.validity(cf_results(spark, sf), F.lit("2024-01-31").cast("timestamp"), ["ts", "event_id"])
    return v.select("session_id", "n_total", "n_valid", *[r6(c).alias(c) for c in ("rate", "rate_tier_1", "rate_cycle", "recent_rate", "rate_7_days")], "tip")


@query("w15_trailing_rate", f"WITH {CF} SELECT session_id, CAST(epoch_us(ts) AS BIGINT) AS ts, count(*) OVER w AS n_window, {q6('avg(is_valid::INT) OVER w')} AS rate FROM cf WINDOW w AS (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    t = X.trailing_rate(cf_results(spark, sf))
    return t.select("session_id", F.unix_micros("ts").alias("ts"), F.col("n_window").cast("long").alias("n_window"), r6("rate").alias("rate"))


CHIP = f"cp AS (SELECT user_id AS session_id, {case_sql('event_type', SHAPE_OF)} AS old_shape, {SH}[CAST((event_id%9)%7 AS INT)+1] AS new_shape FROM events)"


def chips(spark, sf):
    shapes = F.array(*[F.lit(s) for s in C.SHAPES])
    return ev(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id", case_col("event_type", SHAPE_OF).alias("old_shape"), F.get(shapes, (F.col("event_id") % 9 % 7).cast("int")).alias("new_shape"))


COV = f"""{CHIP}, sx AS (SELECT session_id, old_shape AS shape FROM cp UNION ALL SELECT session_id, new_shape FROM cp WHERE new_shape<>old_shape), sc AS (SELECT s.session_id, d.shape, o, count(x.shape) AS n FROM (SELECT DISTINCT session_id FROM cp) s CROSS JOIN (SELECT unnest({SH}) AS shape, unnest(range(7)) AS o) d LEFT JOIN sx x ON x.session_id=s.session_id AND x.shape=d.shape GROUP BY 1,2,3),
 cv AS (SELECT session_id, CAST(sum(n) AS BIGINT) AS total_edits, count(*) FILTER (n>0)/7.0 AS coverage_fraction, arg_max(shape, n*10-o) AS most_used, min(shape) FILTER (n=0 AND o=mo) AS suggested, 2*sum(i*n)/(7*sum(n))-8/7.0 AS skewness FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n) AS i, min(CASE WHEN n=0 THEN o END) OVER (PARTITION BY session_id) AS mo FROM sc) GROUP BY 1)"""


@query("v19_shape_coverage", f"WITH {COV} SELECT session_id, total_edits, {q6('coverage_fraction')} AS coverage_fraction, most_used, suggested, {q6('skewness')} AS skewness, coverage_fraction<0.4 AND skewness>0.6 AND total_edits>10 AS tip FROM cv")
def _(spark, sf):
    c = X.coverage(chips(spark, sf))
    return c.select("session_id", "total_edits", r6("coverage_fraction").alias("coverage_fraction"), "most_used", "suggested", r6("skewness").alias("skewness"), "tip")


CHP = f"""{UT}, ac AS (SELECT user_id AS session_id, event_type AS k, u FROM uu WHERE value<50), ad AS (SELECT event_type AS k, u FROM uu), qt AS (SELECT session_id, round(count(*) FILTER (ad.u<=ac.u)/count(*), 12) AS q FROM (SELECT *, row_number() OVER () AS id FROM ac) ac JOIN ad USING (k) GROUP BY session_id, id),
 qr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY q) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM qt), ks AS (SELECT session_id, n, max(greatest(i/n-q, q-(i-1)/n)) AS d, avg(q) AS mq FROM qr GROUP BY 1,2), lm AS (SELECT *, (sqrt(n)+0.12+0.11/sqrt(n))*d AS l FROM ks),
 pv AS (SELECT *, CASE WHEN n<3 THEN 1.0 WHEN l<0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT sum(CASE WHEN k%2=1 THEN 2.0 ELSE -2.0 END*exp(-2.0*k*k*l*l)) FROM range(1,21) r(k)))) END AS p FROM lm)"""


@query("v20_cherry_picking", f"WITH {CHP} SELECT session_id, n AS n_accepted, {q6('d')} AS ks, {q6('mq')} AS mean_quantile, {q6('p')} AS p_value FROM pv")
def _(spark, sf):
    u = utilities(spark, sf)
    a = u.where("value < 50").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("instance_key"), F.col("u").alias("value"))
    c = X.cherry_picking(a, u.select(F.col("event_type").alias("instance_key"), F.col("u").alias("value")))
    return c.select("session_id", "n_accepted", r6("ks").alias("ks"), r6("mean_quantile").alias("mean_quantile"), r6("p_value").alias("p_value"))


def tip_metrics(spark, sf):
    v = F.col("value")
    return ev(spark, sf).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), (v / 100).alias("ynn"), (v / 120).alias("cs"), (v / 200).alias("probe_ir"), (v / 90).alias("cherry_picking_score"),
                                F.lit("try other").alias("cherry_picking_recommendation"), F.round(v).cast("int").alias("ir_pct"), F.lit("x0").alias("coefficient_name"))


@query("v21_tip_rules", """WITH m AS (SELECT user_id AS session_id, event_id AS seq, value/100 AS ynn, value/120 AS cs, value/200 AS pir, value/90 AS cp, CAST(round(value) AS INT) AS pct FROM events), r AS (SELECT session_id, seq, 'ynn_low' AS rule_id, 1 AS severity, 'Edited series has few same-class neighbours — likely off-manifold. Consider replace_from_library with a Native-Guide donor.' AS message FROM m WHERE ynn<0.5
 UNION ALL SELECT session_id, seq, 'cs_below_threshold', 2, 'Edit is fragile: small jitter in x0 flips ~{invalidation_pct}% of nearby predictions. Try perturbing by ±10%.' FROM m WHERE cs<0.6 UNION ALL SELECT session_id, seq, 'probe_ir_high', 2, '~' || pct || '% of imperfect realisations of this edit would invalidate the CF. Consider a larger amplitude for a robustness margin.' FROM m WHERE pir>0.2 UNION ALL SELECT session_id, seq, 'cherry_picking_high', 3, 'try other' FROM m WHERE cp>0.7) SELECT * FROM r""")
def _(spark, sf):
    return X.fired_tips(tip_metrics(spark, sf), ["session_id", "seq"]).select("session_id", "seq", "rule_id", "severity", "message")


@query("k05_tip_ranking")
def _(spark, sf):
    return X.emit_tips(X.fired_tips(tip_metrics(spark, sf), ["session_id", "seq"]))


# --- study tables --------------------------------------------------------------------------

TRI = "tr AS (SELECT d.doc_id, d.source AS participant, CASE WHEN d.doc_id%2=0 THEN 'guided' ELSE 'free' END AS tool, d.lang AS shape, l.quality AS accuracy, least(100.0, d.n_chars/50.0) AS confidence FROM documents d JOIN labels l USING (doc_id))"


def trials(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("participant"), F.col("lang").alias("shape"), "n_chars")
    j = d.join(table(spark, sf, "labels"), "doc_id")
    return j.select("doc_id", "participant", F.when(F.col("doc_id") % 2 == 0, "guided").otherwise("free").alias("tool"), "shape", F.col("quality").alias("accuracy"), F.least(F.lit(100.0), F.col("n_chars") / 50.0).alias("confidence"))


@query("a37_brier", f"WITH {TRI} SELECT tool, {q6('avg(power(confidence/100-accuracy, 2))')} AS brier, count(*) AS n_trials FROM tr GROUP BY 1")
def _(spark, sf):
    return X.brier(trials(spark, sf), "tool").withColumn("brier", r6("brier"))


@query("a38_equivalence", f"WITH {TRI}, f AS (SELECT participant, tool, arg_min(confidence, doc_id) AS v FROM tr GROUP BY 1,2), s AS (SELECT avg(v) FILTER (tool='guided') AS m1, avg(v) FILTER (tool='free') AS m2, stddev_samp(v) FILTER (tool='guided') AS s1, stddev_samp(v) FILTER (tool='free') AS s2, count(*) FILTER (tool='guided') AS n1, count(*) FILTER (tool='free') AS n2 FROM f) "
       f"SELECT {q6('m1')} AS m1, {q6('m2')} AS m2, n1, n2, {q6('(m1-m2+0.3*sqrt((s1*s1+s2*s2)/2))/sqrt(s1*s1/n1+s2*s2/n2)')} AS t_lower, {q6('(m1-m2-0.3*sqrt((s1*s1+s2*s2)/2))/sqrt(s1*s1/n1+s2*s2/n2)')} AS t_upper FROM s")
def _(spark, sf):
    f = trials(spark, sf).groupBy("participant", "tool").agg(F.min_by("confidence", "doc_id").alias("v"))
    e = X.equivalence(f, "tool", "guided", "free", "v")
    return e.select("n1", "n2", *[r6(c).alias(c) for c in ("m1", "m2", "t_lower", "t_upper")])


@query("a39_accuracy_by_shape", f"WITH {TRI} SELECT tool, shape, {q6('avg(accuracy)')} AS accuracy, count(*) AS n, {q6('(SELECT corr(confidence, accuracy) FROM tr)')} AS r FROM tr GROUP BY 1,2")
def _(spark, sf):
    a = X.accuracy_by(trials(spark, sf), ["tool", "shape"])
    return a.select("tool", "shape", r6("accuracy").alias("accuracy"), "n", r6("r").alias("r"))


@query("a40_adjusted_p", f"""WITH p AS (SELECT user_id%10 AS family, event_id AS test, 1/(1+value) AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i, count(*) OVER (PARTITION BY family) AS n FROM p)
 SELECT family, test, {q6('max(least(1.0, (n-i+1)*p)) OVER (PARTITION BY family ORDER BY i)')} AS p_holm, {q6('min(least(1.0, n/i*p)) OVER (PARTITION BY family ORDER BY i DESC)')} AS p_bh FROM r""")
def _(spark, sf):
    p = ev(spark, sf).select((F.col("user_id") % 10).alias("family"), F.col("event_id").alias("test"), (1 / (1 + F.col("value"))).alias("p"))
    return X.adjust_p(p, "family").select("family", "test", r6("p_holm").alias("p_holm"), r6("p_bh").alias("p_bh"))


PAR = "pa AS (SELECT user_id AS participant, count(*)%5 AS ac, sum(value)/100 AS ct, user_id%9<>0 AS en FROM events GROUP BY 1), tt AS (SELECT user_id AS participant, count(*)-count(*)%60+60 AS n FROM events GROUP BY 1)"
FUN = f"""{PAR}, p1 AS (SELECT * FROM pa WHERE ac>=1), p2 AS (SELECT * FROM p1 WHERE participant IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 58)), q AS (SELECT median(ct) AS m, quantile_cont(ct, 0.75)-quantile_cont(ct, 0.25) AS q FROM p2), p3 AS (SELECT p2.* FROM p2, q WHERE ct<=m+1.0*q AND ct>=greatest(0, m-1.0*q)), p4 AS (SELECT * FROM p3 WHERE en)"""


def participants(spark, sf):
    e = ev(spark, sf)
    p = e.groupBy(F.col("user_id").alias("participant")).agg((F.count(F.lit(1)) % 5).alias("attention_check_pass_count"), (F.sum("value") / 100).alias("completion_time_min"))
    return p.withColumn("english_fluent_self_report", F.col("participant") % 9 != 0), e


@query("m12_exclusion_funnel", f"WITH {FUN}, s AS (SELECT 0 AS step_no, 'initial' AS step, count(*) AS remaining_n FROM pa UNION ALL SELECT 1, 'attention_check_failed', count(*) FROM p1 UNION ALL SELECT 2, 'incomplete_trials', count(*) FROM p2 UNION ALL SELECT 3, 'completion_time_outside_iqr', count(*) FROM p3 UNION ALL SELECT 4, 'english_non_fluent', count(*) FROM p4) "
       "SELECT step_no, step, remaining_n, coalesce(lag(remaining_n) OVER (ORDER BY step_no)-remaining_n, 0) AS excluded_n, 1.0-remaining_n/first_value(remaining_n) OVER (ORDER BY step_no) > 0.05 AS attrition_flag FROM s")
def _(spark, sf):
    p, e = participants(spark, sf)
    # A participant is complete when its collapsed trial count is 1, i.e. more than 58 events.
    t = e.groupBy(F.col("user_id").alias("participant")).agg(F.count(F.lit(1)).alias("n")).where("n > 58").select("participant")
    return X.exclusion_funnel(p, t, 1, 1, 1.0)[0]


@query("u03_kept_participants", f"WITH {FUN} SELECT participant FROM p4")
def _(spark, sf):
    p, e = participants(spark, sf)
    t = e.groupBy(F.col("user_id").alias("participant")).agg(F.count(F.lit(1)).alias("n")).where("n > 58").select("participant")
    return X.exclusion_funnel(p, t, 1, 1, 1.0)[1].select("participant")


@query("j21_kept_trials", f"WITH {FUN} SELECT e.event_id, e.user_id, c.c_mktsegment IS NOT NULL AS has_item FROM events e JOIN (SELECT participant FROM p4) k ON k.participant=e.user_id LEFT JOIN customer c ON c.c_custkey=e.user_id")
def _(spark, sf):
    p, e = participants(spark, sf)
    t = e.groupBy(F.col("user_id").alias("participant")).agg(F.count(F.lit(1)).alias("n")).where("n > 58").select("participant")
    keep = X.exclusion_funnel(p, t, 1, 1, 1.0)[1].select(F.col("participant").alias("user_id"))
    items = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return e.join(keep, "user_id", "left_semi").join(items, "user_id", "left").select("event_id", "user_id", F.col("c_mktsegment").isNotNull().alias("has_item"))


# --- prepared datasets: embeddings as equal-length series, id % 4 = 0 is the test split -----------

def prepared(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("emb").alias("dataset"), F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train").alias("split"), F.col("vec_id").alias("series_id"),
                                              F.col("label").cast("string").alias("label"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    return e.withColumns({"channel": (F.col("pos") % 2), "t": F.floor(F.col("pos") / 2).cast("int")}).drop("pos")


PRE = "pp AS (SELECT vec_id AS series_id, CASE WHEN vec_id%4=0 THEN 'test' ELSE 'train' END AS split, CAST(label AS VARCHAR) AS label, CAST((i-1)%2 AS INT) AS channel, CAST((i-1)//2 AS INT) AS t, x::DOUBLE AS value FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"


@query("p01_train_normalisation", f"WITH {PRE}, s AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM pp WHERE split='train' GROUP BY 1) SELECT series_id, split, pp.channel, t, {q6('(value-m)/CASE WHEN s=0 THEN 1 ELSE s END')} AS value FROM pp JOIN s ON s.channel=pp.channel")
def _(spark, sf):
    return X.normalise_with_train(prepared(spark, sf)).select("series_id", "split", "channel", "t", r6("value").alias("value"))


@query("p02_label_encoding", "WITH l AS (SELECT vec_id AS series_id, CASE WHEN vec_id%4=0 THEN 'test' ELSE 'train' END AS split, CAST(label AS VARCHAR) AS label FROM embeddings), f AS (SELECT label, min(CASE WHEN split='train' THEN 0 ELSE 1 END*1000000+series_id) AS o FROM l GROUP BY 1), k AS (SELECT label, CAST(row_number() OVER (ORDER BY o)-1 AS INT) AS label_index FROM f) SELECT series_id, split, l.label, label_index FROM l JOIN k ON k.label=l.label")
def _(spark, sf):
    l = table(spark, sf, "embeddings").select(F.lit("emb").alias("dataset"), F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train").alias("split"), F.col("vec_id").alias("series_id"), F.col("vec_id").alias("position"), F.col("label").cast("string").alias("label"))
    return X.encode_labels(l).select("series_id", "split", "label", "label_index")


@query("s03_split_sample", f"WITH {PRE} SELECT series_id, channel, t, {q6('value')} AS value, 'class_' || label AS class_name FROM pp WHERE split='test' AND series_id%8=0")
def _(spark, sf):
    return SO.split_sample(prepared(spark, sf), "test", F.col("series_id") % 8 == 0).withColumn("value", r6("value"))


@query("a41_dataset_summary", f"WITH {PRE} SELECT split, count(DISTINCT series_id) AS n_samples, count(DISTINCT channel) AS n_channels, count(DISTINCT t) AS series_length, count(DISTINCT label) AS n_classes, coalesce(bool_or(value IS NULL), false) AS has_missing FROM pp GROUP BY 1")
def _(spark, sf):
    from seriesforge.sources.datasets import dataset_summary
    return dataset_summary(prepared(spark, sf)).drop("dataset")
