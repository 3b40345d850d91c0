"""Segment statistics, chunk scores, labels, legality, constraints."""

from pyspark.sql import functions as F

from seriesforge import config as C
from seriesforge.operators import chunks as K
from seriesforge.operators import stats as S
from seriesforge.operators.layout import cut_lineage

from .base import (LENS, PTS, SEGS, SP, blocks, case_col, case_sql, points, q6, query, r6, seg_points,  # noqa: F401
                   CHUNK_OF)

# Two channels for the multi-channel forms.
SP2 = SP + (", sp2 AS (SELECT series_id, segment_id, t, pos, 0 AS channel, value FROM sp UNION ALL "
            "SELECT series_id, segment_id, t, pos, 1, (event_id % 7) / 7.0 FROM sp)")


def sp2(spark, sf):
    p = seg_points(spark, sf, "event_id")
    pair = F.array(F.struct(F.lit(0).alias("channel"), F.col("value").alias("value")),
                   F.struct(F.lit(1).alias("channel"), (F.col("event_id") % 7 / 7.0).alias("value")))
    return p.withColumn("_p", F.explode(pair)).select("series_id", "segment_id", "t", "_p.*")


@query("a01_variance", f"WITH {SP2}, c AS (SELECT series_id, segment_id, channel, var_pop(value) v FROM sp2 GROUP BY 1,2,3) "
       f"SELECT series_id, segment_id, {q6('sum(v)')} AS variance FROM c GROUP BY 1,2")
def _(spark, sf):
    return S.variance(sp2(spark, sf)).withColumn("variance", r6("variance"))


@query("a02_slope", f"WITH {SP2}, c AS (SELECT series_id, segment_id, channel, CASE WHEN count(*) > 1 THEN regr_slope(value, t) END v "
       f"FROM sp2 GROUP BY 1,2,3) SELECT series_id, segment_id, {q6('avg(v)')} AS slope FROM c GROUP BY 1,2")
def _(spark, sf):
    return S.slope(sp2(spark, sf)).withColumn("slope", r6("slope"))


@query("a03_sign_consistency", f"WITH {SP2}, d AS (SELECT series_id, segment_id, value - lag(value) OVER "
       f"(PARTITION BY series_id, segment_id, channel ORDER BY t) AS d FROM sp2) SELECT series_id, segment_id, "
       f"{q6('greatest(avg(CASE WHEN d>0 THEN 1.0 ELSE 0 END), avg(CASE WHEN d<0 THEN 1.0 ELSE 0 END))')} AS sign_consistency "
       f"FROM d WHERE d IS NOT NULL GROUP BY 1,2")
def _(spark, sf):
    return S.sign_consistency(sp2(spark, sf)).withColumn("sign_consistency", r6("sign_consistency"))


@query("a04_residual_to_line", f"WITH {SP2}, f AS (SELECT series_id, segment_id, channel, regr_slope(value,t) b, "
       f"regr_intercept(value,t) a FROM sp2 GROUP BY 1,2,3 HAVING count(*)>1), c AS (SELECT series_id, segment_id, channel, "
       f"avg((value-a-b*t)*(value-a-b*t)) v FROM sp2 JOIN f USING (series_id, segment_id, channel) GROUP BY 1,2,3) "
       f"SELECT series_id, segment_id, {q6('avg(v)')} AS residual_to_line FROM c GROUP BY 1,2")
def _(spark, sf):
    return S.residual_to_line(sp2(spark, sf)).where("residual_to_line is not null").withColumn(
        "residual_to_line", r6("residual_to_line"))


CONTRAST = """ctx AS (SELECT s.series_id, s.segment_id,
 avg(CASE WHEN p.t < s.start_index THEN value END) l, avg(CASE WHEN p.t > s.end_index THEN value END) r,
 avg(CASE WHEN p.t BETWEEN s.start_index AND s.end_index THEN value END) m,
 max(CASE WHEN p.t = s.start_index - 1 THEN value END) pre, max(CASE WHEN p.t = s.end_index + 1 THEN value END) post,
 max(CASE WHEN p.t = s.start_index THEN value END) f, max(CASE WHEN p.t = s.end_index THEN value END) e
 FROM segs s JOIN pts p ON p.series_id = s.series_id AND p.t BETWEEN s.start_index - (s.end_index - s.start_index + 1)
 AND s.end_index + (s.end_index - s.start_index + 1) GROUP BY 1,2),
 con AS (SELECT series_id, segment_id, abs(m - CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l ELSE (l+r)/2 END) AS c0,
 coalesce((abs(f-pre)+abs(post-e))/2, abs(f-pre), abs(post-e), 0.0) AS c1 FROM ctx),
 contrast AS (SELECT series_id, segment_id, CASE WHEN c0 > 0 THEN c0 ELSE c1 END AS context_contrast FROM con)"""


@query("a05_context_contrast", f"WITH {PTS}, {SEGS}, {CONTRAST} SELECT series_id, segment_id, "
       f"{q6('context_contrast')} AS context_contrast FROM contrast")
def _(spark, sf):
    return S.context_contrast(points(spark, sf), blocks(spark, sf)).withColumn(
        "context_contrast", r6("context_contrast"))


PEAK = """nb AS (SELECT a.series_id, a.segment_id, a.t, a.value AS x, avg(b.value) AS m, stddev_pop(b.value) AS s
 FROM sp a LEFT JOIN sp b ON a.series_id=b.series_id AND a.segment_id=b.segment_id AND b.t BETWEEN a.t-3 AND a.t+3
 AND b.t<>a.t GROUP BY 1,2,3,4),
 peak AS (SELECT series_id, segment_id, max(CASE WHEN m IS NULL THEN 0 ELSE abs(x-m)/(s+1e-8) END) AS peak_score
 FROM nb GROUP BY 1,2)"""


@query("a06_peak_score", f"WITH {SP}, {PEAK} SELECT series_id, segment_id, {q6('peak_score')} AS peak_score FROM peak "
       "JOIN (SELECT series_id, segment_id FROM sp GROUP BY 1,2 HAVING count(*)>2) USING (series_id, segment_id)")
def _(spark, sf):
    sp = seg_points(spark, sf)
    big = sp.groupBy(*S.KEYS).count().where("count > 2").drop("count")
    return S.peak_score(sp).join(big, S.KEYS, "left_semi").withColumn("peak_score", r6("peak_score"))


PERIOD = """cen AS (SELECT *, value - avg(value) OVER (PARTITION BY series_id, segment_id) AS c,
 count(*) OVER (PARTITION BY series_id, segment_id) AS n FROM sp),
 lg AS (SELECT a.series_id, a.segment_id, b.pos - a.pos AS lag, sum(a.c*b.c) xy, sum(a.c*a.c) xx, sum(b.c*b.c) yy
 FROM cen a JOIN cen b ON a.series_id=b.series_id AND a.segment_id=b.segment_id AND b.pos > a.pos
 AND b.pos - a.pos <= a.n // 2 WHERE a.n > 2 GROUP BY 1,2,3),
 per AS (SELECT series_id, segment_id, max(CASE WHEN xx*yy=0 THEN 0 ELSE abs(xy/sqrt(xx*yy)) END) AS periodicity_score
 FROM lg GROUP BY 1,2)"""


@query("a07_periodicity_score", f"WITH {SP}, {PERIOD} SELECT series_id, segment_id, "
       f"{q6('periodicity_score')} AS periodicity_score FROM per")
def _(spark, sf):
    return S.periodicity_score(seg_points(spark, sf)).where("periodicity_score is not null").withColumn(
        "periodicity_score", r6("periodicity_score"))


STATS = f"""{SP}, {SEGS}, {CONTRAST}, {PEAK}, {PERIOD},
 ln AS (SELECT series_id, segment_id, regr_slope(value,t) b, regr_intercept(value,t) a, avg(value) AS mean, var_pop(value) AS variance
 FROM sp GROUP BY 1,2 HAVING count(*)>1),
 rs AS (SELECT sp.series_id, sp.segment_id, avg((value-a-b*t)*(value-a-b*t)) AS residual_to_line FROM sp
 JOIN ln USING (series_id, segment_id) GROUP BY 1,2),
 df AS (SELECT series_id, segment_id, value - lag(value) OVER (PARTITION BY series_id, segment_id ORDER BY t) AS d FROM sp),
 sg AS (SELECT series_id, segment_id, greatest(avg(CASE WHEN d>0 THEN 1.0 ELSE 0 END), avg(CASE WHEN d<0 THEN 1.0 ELSE 0 END))
 AS sign_consistency FROM df WHERE d IS NOT NULL GROUP BY 1,2),
 stat AS (SELECT s.series_id, s.segment_id, s.start_index, s.end_index, s.label, s.end_index-s.start_index+1 AS segment_length,
 ln.mean, ln.variance, ln.b AS slope, sign_consistency, residual_to_line, context_contrast, peak_score,
 coalesce(periodicity_score, 0.0) AS periodicity_score
 FROM segs s JOIN ln USING (series_id, segment_id) JOIN rs USING (series_id, segment_id) JOIN sg USING (series_id, segment_id)
 JOIN contrast USING (series_id, segment_id) JOIN peak USING (series_id, segment_id)
 LEFT JOIN per USING (series_id, segment_id))"""
NUM = ["mean", "variance", "slope", "sign_consistency", "residual_to_line", "context_contrast", "peak_score",
       "periodicity_score"]


def stats(spark, sf):
    return S.segment_statistics(points(spark, sf), blocks(spark, sf))


# Two-point neighbour windows have zero spread, where the score is noise over epsilon; both sides keep length > 3.
@query("a08_segment_statistics", f"WITH {STATS} SELECT series_id, segment_id, start_index, end_index, segment_length, "
       + ", ".join(f"{q6(c)} AS {c}" for c in NUM) + " FROM stat WHERE segment_length > 3")
def _(spark, sf):
    return stats(spark, sf).where("segment_length > 3").select(
        "series_id", "segment_id", "start_index", "end_index", "segment_length", *[r6(c).alias(c) for c in NUM])


T, L = C.THRESHOLDS, C.LIMITS


def cl(x):
    return f"greatest(0.0, least(1.0, {x}))"


SCORE = f"""sc0 AS (SELECT *,
 ({cl('segment_length/6.0')} + {cl('periodicity_score/0.7')} + {cl('1-peak_score/5.0')})/3 AS s_periodic,
 (CASE WHEN segment_length<=8 THEN 1.0 ELSE {cl('1-(segment_length-8)/8.0')} END + {cl('peak_score/2.5')} + {cl('context_contrast/0.4')})/3 AS s_spike,
 ({cl('abs(slope)/0.1')} + {cl('sign_consistency/0.8')} + {cl('1-residual_to_line/0.05')})/3 AS s_trend,
 ({cl('1-abs(slope)/0.2')} + {cl('1-variance/0.02')} + {cl('1-periodicity_score/0.7')})/3 AS s_plateau,
 (CASE WHEN segment_length BETWEEN 3 AND 40 THEN 1.0 WHEN segment_length<3 THEN segment_length/3.0
  ELSE {cl('1-(segment_length-40)/38.0')} END + {cl('context_contrast/0.4')})/2 AS ev0,
 ({cl('segment_length/2.0')} + {cl('context_contrast/0.4')})/2 * {cl('abs(slope)/0.1')} AS s_transition FROM stat),
 sc AS (SELECT *, {cl('ev0*(1-0.35*greatest(s_spike, s_periodic))')} AS s_event FROM sc0)"""


@query("p20_chunk_scores", f"WITH {STATS}, {SCORE} SELECT series_id, segment_id, "
       + ", ".join(f"{q6('s_' + c)} AS score_{c}" for c in C.CHUNK_TYPES) + " FROM sc")
def _(spark, sf):
    return K.with_scores(stats(spark, sf)).select(
        "series_id", "segment_id", *[r6(f"score_{c}").alias(f"score_{c}") for c in C.CHUNK_TYPES])


ASSIGN = f"""{SCORE}, lg2 AS (SELECT series_id, segment_id, unnest(['{"','".join(C.CHUNK_TYPES)}']) AS nm, unnest([0,1,2,3,4,5]) AS o,
 unnest([{','.join('s_' + c for c in C.CHUNK_TYPES)}]) AS s FROM sc),
 rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, segment_id ORDER BY round(s, 9) DESC, o) AS rn FROM lg2),
 asg AS (SELECT series_id, segment_id, max(CASE WHEN rn=1 THEN nm END) AS assigned_label, max(CASE WHEN rn=1 THEN s END) AS confidence,
 max(CASE WHEN rn=2 THEN nm END) AS runner_up, max(CASE WHEN rn=1 THEN s END) - max(CASE WHEN rn=2 THEN s END) AS margin FROM rk GROUP BY 1,2)"""


@query("p19_label_assignment", f"WITH {STATS}, {ASSIGN} SELECT series_id, segment_id, assigned_label, {q6('confidence')} AS confidence, "
       f"runner_up, {q6('margin')} AS margin, margin < 0.1 AS is_ambiguous FROM asg")
def _(spark, sf):
    return K.assign(stats(spark, sf)).select("series_id", "segment_id", "assigned_label", r6("confidence").alias("confidence"),
                                             "runner_up", r6("ambiguity_margin").alias("margin"), "is_ambiguous")


@query("p10_ratio_scores", f"WITH {PTS} SELECT series_id, t, {q6(cl('value/0.7'))} AS ratio, {q6(cl('1-value/2.0'))} AS inverse, "
       f"{q6(cl('t/40.0'))} AS min_duration, {q6('CASE WHEN t<=8 THEN 1.0 ELSE ' + cl('1-(t-8)/8.0') + ' END')} AS max_duration, "
       f"{q6('CASE WHEN t BETWEEN 3 AND 40 THEN 1.0 WHEN t<3 THEN ' + cl('t/3.0') + ' ELSE ' + cl('1-(t-40)/38.0') + ' END')} AS bounded "
       "FROM pts")
def _(spark, sf):
    from seriesforge.functions import scores as X
    p, t = points(spark, sf), F.col("t")
    return p.select("series_id", "t", r6(X.ratio(F.col("value"), 0.7)).alias("ratio"),
                    r6(X.inverse_ratio(F.col("value"), 2.0)).alias("inverse"), r6(X.min_duration(t, 40)).alias("min_duration"),
                    r6(X.max_duration(t, 8)).alias("max_duration"), r6(X.bounded_duration(t, 3, 40)).alias("bounded"))


# --- legality ----------------------------------------------------------------

OPS = ["split", "merge", "shift_level", "scale", "remove", "change_slope", "no_such_op"]
LEGAL_VALUES = ", ".join(f"('{c}','{o}')" for c, ops in C.LEGAL_OPERATIONS.items() for o in ops)
EDITS = ("ed AS (SELECT series_id, segment_id, CASE WHEN segment_id % 5 = 4 THEN 'unknown' ELSE label END AS label, "
         f"['{chr(39).join([]) + (chr(39) + ',' + chr(39)).join(OPS)}'][CAST((series_id + segment_id) % 7 + 1 AS INT)] AS op_name FROM segs), "
         f"legal(chunk_type, op) AS (VALUES {LEGAL_VALUES})")


def edits(spark, sf):
    ops = F.array(*[F.lit(o) for o in OPS])
    return blocks(spark, sf).select(
        "series_id", "segment_id",
        F.when(F.col("segment_id") % 5 == 4, "unknown").otherwise(F.col("label")).alias("label"),
        F.get(ops, ((F.col("series_id") + F.col("segment_id")) % 7).cast("int")).alias("op_name"))


@query("p08_operation_legality", f"WITH {PTS}, {SEGS}, {EDITS} SELECT series_id, segment_id, label, op_name, "
       "CASE WHEN label NOT IN (SELECT chunk_type FROM legal) THEN 'UNKNOWN_CHUNK_TYPE' WHEN legal.op IS NULL THEN 'OPERATION_NOT_ALLOWED' "
       "ELSE 'LEGAL' END AS reason_code, CASE WHEN legal.op IS NULL THEN 'DENY' ELSE 'ALLOW' END AS legality "
       "FROM ed LEFT JOIN legal ON chunk_type = label AND op = op_name")
def _(spark, sf):
    return K.legality(edits(spark, sf))


@query("p09_boundary_legality", f"WITH {PTS}, {SEGS}, {EDITS}, d AS (SELECT *, CAST(series_id % 3 - 1 AS INT) AS delta FROM ed), "
       "o AS (SELECT *, CASE WHEN label IN ('trend','plateau') THEN CASE WHEN delta>0 THEN 'extend' ELSE 'shorten' END "
       "WHEN label='event' THEN 'change_duration' WHEN label='spike' THEN CASE WHEN delta>0 THEN 'widen' ELSE 'narrow' END "
       "WHEN label='transition' THEN 'shift_onset' WHEN label='periodic' THEN 'split' ELSE 'edit_boundary' END AS bop FROM d) "
       "SELECT series_id, segment_id, delta, CASE WHEN delta=0 THEN 'LEGAL' WHEN label NOT IN (SELECT chunk_type FROM legal) "
       "THEN 'UNKNOWN_CHUNK_TYPE' WHEN EXISTS (SELECT 1 FROM legal WHERE chunk_type=label AND op=bop) THEN 'LEGAL' "
       "ELSE 'OPERATION_NOT_ALLOWED' END AS reason_code FROM o")
def _(spark, sf):
    d = (F.col("series_id") % 3 - 1).cast("int")
    return edits(spark, sf).select("series_id", "segment_id", d.alias("delta"),
                                   K.boundary_legality(F.col("label"), d).alias("reason_code"))


# --- constraints -------------------------------------------------------------

VIOL = f"""v1 AS (SELECT series_id, 'minimum_segment_duration' AS constraint_id, 'hard' AS severity,
 CAST(segment_id AS VARCHAR) AS affected FROM segs WHERE end_index-start_index+1 < 2),
 v2 AS (SELECT series_id, 'monotonic_trend_consistency', 'soft', CAST(segment_id AS VARCHAR) FROM stat WHERE label='trend'
 AND NOT (abs(slope)>=0.1 AND sign_consistency>=0.8 AND residual_to_line<=0.05)),
 v3 AS (SELECT series_id, 'plateau_stability', 'soft', CAST(segment_id AS VARCHAR) FROM stat WHERE label='plateau' AND segment_length>2
 AND NOT (abs(slope)<0.1 AND variance<=0.02 AND (segment_length<6 OR periodicity_score<0.7))),
 nx AS (SELECT *, lead(label) OVER w AS nl, lead(segment_id) OVER w AS ns FROM segs WINDOW w AS (PARTITION BY series_id ORDER BY start_index)),
 v4 AS (SELECT series_id, 'label_compatibility', 'soft', segment_id || ',' || ns FROM nx WHERE label='event' AND nl='event'),
 viol AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4)"""


def flat(v):
    return v.select("series_id", "constraint_id", "severity", F.concat_ws(",", "affected").alias("affected"))


def _constraint(name, cte, needs_stats, fn):
    base = STATS if needs_stats else f"{PTS}, {SEGS}, stat AS (SELECT NULL AS series_id, NULL AS segment_id, '' AS label, 0 AS slope, " \
        "0 AS sign_consistency, 0 AS residual_to_line, 0 AS variance, 0 AS segment_length, 0 AS periodicity_score)"
    query(name, f"WITH {base}, {VIOL} SELECT series_id, constraint_id, severity, affected FROM viol "
          f"WHERE constraint_id = '{cte}'")(fn)


_constraint("c01_minimum_duration", "minimum_segment_duration", False,
            lambda spark, sf: flat(K.min_duration_violations(blocks(spark, sf))))
_constraint("c02_trend_consistency", "monotonic_trend_consistency", True,
            lambda spark, sf: flat(K.trend_violations(stats(spark, sf))))
_constraint("c03_plateau_stability", "plateau_stability", True,
            lambda spark, sf: flat(K.plateau_violations(stats(spark, sf))))
_constraint("c04_label_compatibility", "label_compatibility", False,
            lambda spark, sf: flat(K.adjacency_violations(blocks(spark, sf))))

STATUS = """st AS (SELECT l.series_id, count(v.series_id) AS n_violations, CASE WHEN coalesce(bool_or(severity='hard'), false)
 THEN 'hard' ELSE 'soft' END AS constraint_mode FROM (SELECT DISTINCT series_id FROM segs) l LEFT JOIN viol v USING (series_id) GROUP BY 1)"""


@query("c05_constraint_status", f"WITH {STATS}, {VIOL}, {STATUS} SELECT *, CASE WHEN n_violations=0 THEN 'PASS' WHEN constraint_mode='hard' "
       "THEN 'FAIL' ELSE 'WARN' END AS status FROM st")
def _(spark, sf):
    b = blocks(spark, sf)
    return K.status(b, K.evaluate(b, S.segment_statistics(points(spark, sf), b)))


@query("j22_adjacent_context", f"WITH {PTS}, {SEGS} SELECT series_id, segment_id, label, lag(label) OVER w AS prev_label, "
       "lead(label) OVER w AS next_label, coalesce(label = lead(label) OVER w, false) AS same_as_next FROM segs "
       "WINDOW w AS (PARTITION BY series_id ORDER BY start_index)")
def _(spark, sf):
    from seriesforge.operators.layout import neighbours
    n = neighbours(neighbours(blocks(spark, sf), "start_index", ["label"]), "start_index", ["label"], back=False)
    return n.select("series_id", "segment_id", "label", "prev_label", "next_label",
                    F.coalesce(F.col("label") == F.col("next_label"), F.lit(False)).alias("same_as_next"))


@query("slice_segment_labels_and_status", f"WITH {STATS}, {ASSIGN}, {VIOL}, {STATUS} SELECT a.series_id, a.segment_id, assigned_label, "
       f"{q6('a.confidence')} AS confidence, {q6('stat.variance')} AS variance, CASE WHEN n_violations=0 THEN 'PASS' WHEN constraint_mode='hard' "
       "THEN 'FAIL' ELSE 'WARN' END AS status FROM asg a JOIN st USING (series_id) JOIN stat USING (series_id, segment_id)")
def _(spark, sf):
    # One row per segment feeds labels and constraints, so it is written once instead of computed three times.
    b = blocks(spark, sf)
    s = cut_lineage(S.segment_statistics(points(spark, sf), b))
    a = K.assign(s).select("series_id", "segment_id", "assigned_label", r6("confidence").alias("confidence"),
                           r6("variance").alias("variance"))
    return a.join(K.status(b, K.evaluate(b, s)).select("series_id", "status"), "series_id")
