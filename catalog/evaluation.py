"""Scoring of block segmentations: truth = blocks of 16, prediction = blocks of 12."""

from pyspark.sql import functions as F

from seriesforge.operators import evaluate as E
from seriesforge.operators import layout as L

from .base import PTS, blocks, q6, query, r6, points, segs_sql, table

GP = f"{PTS}, {segs_sql(16, name='g')}, {segs_sql(12, name='p')}"
OV = """ov AS (SELECT g.series_id, g.segment_id AS g_segment, p.segment_id AS p_segment, g.label AS gl, p.label AS pl, p.start_index AS ps, g.end_index-g.start_index+1 AS gn,
 least(g.end_index,p.end_index)-greatest(g.start_index,p.start_index)+1 AS i, (g.end_index-g.start_index+1)+(p.end_index-p.start_index+1) AS s
 FROM g JOIN p ON g.series_id=p.series_id AND g.start_index<=p.end_index AND p.start_index<=g.end_index)"""


def gp(spark, sf):
    return blocks(spark, sf, 16), blocks(spark, sf, 12)


@query("j01_points_in_segments", f"WITH {PTS}, {segs_sql(12, name='p')} SELECT a.series_id, a.t, p.segment_id, {q6('a.value')} AS value FROM pts a JOIN p ON a.series_id=p.series_id AND a.t BETWEEN start_index AND end_index")
def _(spark, sf):
    return L.attach_segments(points(spark, sf), blocks(spark, sf, 12)).select("series_id", "t", "segment_id", r6("value").alias("value"))


@query("p03_inclusive_slice", f"WITH {PTS}, {segs_sql(16, name='g')}, b AS (SELECT series_id, segment_id, start_index+2 AS start_index, end_index+3 AS end_index FROM g), l AS (SELECT series_id, max(t) AS mx FROM pts GROUP BY 1) "
       f"SELECT b.series_id, b.segment_id, a.t, {q6('a.value')} AS value FROM b JOIN l USING (series_id) JOIN pts a ON a.series_id=b.series_id AND a.t BETWEEN start_index AND end_index WHERE end_index <= mx AND start_index <= end_index")
def _(spark, sf):
    pts = points(spark, sf)
    want = blocks(spark, sf).withColumns({"start_index": F.col("start_index") + 2, "end_index": F.col("end_index") + 3})
    legal = want.join(pts.groupBy("series_id").agg(F.max("t").alias("_m")), "series_id").where("end_index <= _m and start_index <= end_index")
    return L.attach_segments(pts, legal).select("series_id", "segment_id", "t", r6("value").alias("value"))


@query("j03_interval_overlap", f"WITH {GP}, {OV} SELECT series_id, g_segment, {q6('max(i/(s-i))')} AS best_iou FROM ov GROUP BY 1,2")
def _(spark, sf):
    return E.overlaps(*gp(spark, sf)).groupBy("series_id", "g_segment").agg(r6(F.max("iou")).alias("best_iou"))


@query("u01_label_union", f"WITH {GP} SELECT series_id, label FROM g UNION SELECT series_id, label FROM p")
def _(spark, sf):
    return E.label_union(*gp(spark, sf))


IOU = """m AS (SELECT a.series_id, x.label AS gl, y.label AS pl FROM pts a JOIN g x ON a.series_id=x.series_id AND a.t BETWEEN x.start_index AND x.end_index JOIN p y ON a.series_id=y.series_id AND a.t BETWEEN y.start_index AND y.end_index),
 lb AS (SELECT series_id, gl AS label FROM m UNION SELECT series_id, pl FROM m),
 io AS (SELECT m.series_id, label, sum(CASE WHEN gl=label AND pl=label THEN 1 ELSE 0 END)/sum(CASE WHEN gl=label OR pl=label THEN 1 ELSE 0 END) AS v FROM m JOIN lb ON m.series_id=lb.series_id GROUP BY 1,2),
 mi AS (SELECT series_id, avg(v) AS macro_iou FROM io GROUP BY 1)"""


@query("m01_macro_iou", f"WITH {GP}, {IOU} SELECT series_id, {q6('macro_iou')} AS macro_iou FROM mi")
def _(spark, sf):
    return E.macro_iou(*gp(spark, sf)).select("series_id", r6("macro_iou").alias("macro_iou"))


BF = """gb AS (SELECT series_id, end_index+1 AS b FROM (SELECT *, max(end_index) OVER (PARTITION BY series_id) AS mx FROM g) WHERE end_index<mx), pb AS (SELECT series_id, end_index+1 AS b FROM (SELECT *, max(end_index) OVER (PARTITION BY series_id) AS mx FROM p) WHERE end_index<mx),
 ct AS (SELECT s.series_id, (SELECT count(*) FROM gb WHERE gb.series_id=s.series_id) AS ng, (SELECT count(*) FROM pb WHERE pb.series_id=s.series_id) AS np, (SELECT count(*) FROM pb JOIN gb USING (series_id, b) WHERE pb.series_id=s.series_id) AS tp FROM (SELECT DISTINCT series_id FROM g) s),
 pr AS (SELECT series_id, CASE WHEN ng=0 AND np=0 THEN 1.0 ELSE tp/greatest(np,1) END AS precision, CASE WHEN ng=0 AND np=0 THEN 1.0 ELSE tp/greatest(ng,1) END AS recall FROM ct),
 f1 AS (SELECT *, CASE WHEN precision+recall=0 THEN 0.0 ELSE 2*precision*recall/(precision+recall) END AS f1 FROM pr)"""


@query("m02_boundary_f1", f"WITH {GP}, {BF} SELECT series_id, {q6('precision')} AS precision, {q6('recall')} AS recall, {q6('f1')} AS f1 FROM f1")
def _(spark, sf):
    f = E.boundary_f1(*gp(spark, sf))
    return f.select("series_id", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


# Greedy matching within 3 steps as a recursive walk over the predictions of each series.
GM = """pn AS (SELECT series_id, b, row_number() OVER (PARTITION BY series_id ORDER BY b) AS rn FROM pb), gl AS (SELECT series_id, list(b ORDER BY b) AS gs FROM gb GROUP BY 1),
 wk AS (SELECT series_id, 0 AS i, gs, 0 AS tp FROM gl UNION ALL SELECT w.series_id, i+1, CASE WHEN len(list_filter(gs, lambda x: abs(x-b)<=3))>0 THEN list_filter(gs, lambda x: x <> list_filter(gs, lambda y: abs(y-b)<=3)[1]) ELSE gs END,
 tp + CASE WHEN len(list_filter(gs, lambda x: abs(x-b)<=3))>0 THEN 1 ELSE 0 END FROM wk w JOIN pn ON pn.series_id=w.series_id AND pn.rn=w.i+1)"""


@query("j02_boundary_band_match", f"WITH RECURSIVE {GP}, {BF}, {GM} SELECT series_id, CAST(arg_max(tp, i) AS BIGINT) AS tp FROM wk JOIN (SELECT DISTINCT series_id FROM pb) USING (series_id) GROUP BY 1")
def _(spark, sf):
    g, p = gp(spark, sf)
    return E.match_boundaries(E.inner_boundaries(g), E.inner_boundaries(p), 3)


@query("m03_covering", f"WITH {GP}, {OV}, b AS (SELECT series_id, g_segment, gn, max(i/(s-i)) AS v FROM ov GROUP BY 1,2,3) SELECT series_id, {q6('sum(gn*v)/sum(gn)')} AS covering FROM b GROUP BY 1")
def _(spark, sf):
    return E.covering(*gp(spark, sf)).select("series_id", r6("covering").alias("covering"))


@query("m04_over_segmentation", f"WITH {GP}, a AS (SELECT series_id, count(*) AS ng FROM g GROUP BY 1), b AS (SELECT series_id, count(*) AS np FROM p GROUP BY 1) SELECT series_id, {q6('greatest(0.0, (np-ng)/ng)')} AS over_segmentation_rate FROM a JOIN b USING (series_id)")
def _(spark, sf):
    return E.over_segmentation(*gp(spark, sf)).select("series_id", r6("over_segmentation_rate").alias("over_segmentation_rate"))


@query("m05_drift_summary", f"SELECT user_id % 5 AS fixture_id, count(*) AS drift_count, {q6('avg(value/50)')} AS drift_mean, {q6('max(value/50)')} AS drift_max FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("fixture_id"), (F.col("value") / 50).alias("value"))
    return E.drift_summary(e, "fixture_id").select("fixture_id", "drift_count", r6("drift_mean").alias("drift_mean"), r6("drift_max").alias("drift_max"))


EV = """se AS (SELECT user_id AS session_id, CASE event_type WHEN 'click' THEN 'operation_applied' WHEN 'error' THEN 'operation_rejected' WHEN 'purchase' THEN 'projection_applied' WHEN 'view' THEN 'suggestion_accepted' ELSE 'suggestion_overridden' END AS event_type,
 CASE event_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' WHEN 2 THEN 'FAIL' END AS evaluation_status, CASE WHEN event_id % 3 = 0 THEN 'FAIL' ELSE 'PASS' END AS result_status FROM events)"""


def session_events(spark, sf):
    from .base import case_col
    kinds = {"click": "operation_applied", "error": "operation_rejected", "purchase": "projection_applied", "view": "suggestion_accepted", "signup": "suggestion_overridden"}
    k = F.col("event_id") % 4
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), case_col("event_type", kinds).alias("event_type"),
        F.when(k == 0, "PASS").when(k == 1, "WARN").when(k == 2, "FAIL").alias("evaluation_status"),
        F.when(F.col("event_id") % 3 == 0, "FAIL").otherwise("PASS").alias("result_status"))


@query("m06_violation_rate", f"WITH {EV}, o AS (SELECT *, event_type IN ('operation_applied','operation_rejected','projection_applied') AS op FROM se) SELECT session_id, count(*) FILTER (op) AS operation_events, "
       f"count(*) FILTER (op AND (coalesce(evaluation_status,'') IN ('WARN','FAIL') OR result_status='FAIL')) AS violating_events, {q6('coalesce(count(*) FILTER (op AND (coalesce(evaluation_status,' + chr(39)*2 + ') IN (' + chr(39) + 'WARN' + chr(39) + ',' + chr(39) + 'FAIL' + chr(39) + ') OR result_status=' + chr(39) + 'FAIL' + chr(39) + '))/nullif(count(*) FILTER (op),0), 0.0)')} AS violation_rate FROM o GROUP BY 1")
def _(spark, sf):
    return E.violation_rate(session_events(spark, sf)).withColumn("violation_rate", r6("violation_rate"))


@query("m07_label_accuracy", f"WITH {GP}, {OV}, b AS (SELECT series_id, g_segment, gl, i/(s-i) AS v, pl, row_number() OVER (PARTITION BY series_id, g_segment ORDER BY i/(s-i) DESC, ps) AS rn FROM ov) SELECT series_id, {q6('coalesce(avg(CASE WHEN gl=pl THEN 1.0 ELSE 0.0 END) FILTER (v>0.5), 0.0)')} AS label_accuracy FROM b WHERE rn=1 GROUP BY 1")
def _(spark, sf):
    return E.label_accuracy(*gp(spark, sf)).withColumn("label_accuracy", r6("label_accuracy"))


@query("j04_positional_diff", f"WITH {GP}, a AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_index)-1 AS row_no FROM g), b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start_index)-1 AS row_no FROM p), "
       "j AS (SELECT coalesce(a.series_id,b.series_id) AS series_id, CAST(coalesce(a.row_no,b.row_no) AS INT) AS row_no, a.start_index AS cs, a.end_index AS ce, a.label AS cl, b.start_index AS ps, b.end_index AS pe, b.label AS pl FROM a FULL JOIN b ON a.series_id=b.series_id AND a.row_no=b.row_no) "
       "SELECT series_id, row_no, coalesce(cs<>ps OR ce<>pe, false) AS boundary_changed, coalesce(cl<>pl, false) AS label_changed, coalesce(cs<>ps OR ce<>pe OR cl<>pl, true) AS disagrees FROM j")
def _(spark, sf):
    d = E.positional_diff(*gp(spark, sf))
    return d.select("series_id", "row_no", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("boundary_changed", "label_changed")], "disagrees")


# Two classifiers on one label set: previous and next event type as predictions.
@query("m13_macro_f1", "WITH e AS (SELECT event_type AS y, lag(event_type) OVER w AS a, lead(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), q AS (SELECT 'rule' AS model, y, a AS z FROM e WHERE a IS NOT NULL UNION ALL SELECT 'prototype', y, b FROM e WHERE b IS NOT NULL), "
       "l AS (SELECT model, y AS label FROM q UNION SELECT model, z FROM q), f AS (SELECT l.model, label, 2*count(*) FILTER (y=label AND z=label)/(count(*) FILTER (y=label)+count(*) FILTER (z=label)) AS f FROM l JOIN q ON q.model=l.model GROUP BY 1,2) "
       f"SELECT model, {q6('avg(f)')} AS macro_f1 FROM f GROUP BY 1")
def _(spark, sf):
    p = points(spark, sf, "event_type")
    n = L.framed(p, 1, 1, {"a": lambda w: F.lag("event_type").over(w()), "b": lambda w: F.lead("event_type").over(w())})
    q = n.select(F.lit("rule").alias("model"), F.col("event_type").alias("y"), F.col("a").alias("z")).unionByName(
        n.select(F.lit("prototype").alias("model"), F.col("event_type").alias("y"), F.col("b").alias("z"))).where("z is not null")
    return E.macro_f1(q, "y", "z", "model").withColumn("macro_f1", r6("macro_f1"))


@query("m09_evaluation_report", f"WITH {GP}, {IOU}, {BF}, {OV}, b AS (SELECT series_id, g_segment, gn, max(i/(s-i)) AS v FROM ov GROUP BY 1,2,3), cv AS (SELECT series_id, sum(gn*v)/sum(gn) AS covering FROM b GROUP BY 1), "
       f"os AS (SELECT a.series_id, greatest(0.0, (np2-ng2)/ng2) AS o FROM (SELECT series_id, count(*) AS ng2 FROM g GROUP BY 1) a JOIN (SELECT series_id, count(*) AS np2 FROM p GROUP BY 1) b USING (series_id)) "
       f"SELECT series_id, {q6('macro_iou')} AS macro_iou, {q6('f1')} AS boundary_f1, {q6('covering')} AS covering, {q6('o')} AS over_segmentation_rate, 'wari,sms' AS unsupported_metrics FROM mi JOIN f1 USING (series_id) JOIN cv USING (series_id) JOIN os USING (series_id)")
def _(spark, sf):
    from seriesforge.plans.reports import evaluation_report
    r = evaluation_report(*gp(spark, sf))
    return r.select("series_id", *[r6(c).alias(c) for c in ("macro_iou", "boundary_f1", "covering", "over_segmentation_rate")],
                    F.concat_ws(",", "unsupported_metrics").alias("unsupported_metrics"))
