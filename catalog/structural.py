"""Structural edits, component edits, fits."""

from pyspark.sql import functions as F

from seriesforge import config as C
from seriesforge.operators import component_edits as CE
from seriesforge.operators import edits as E
from seriesforge.operators import fits as T
from seriesforge.operators import stats as ST
from seriesforge.operators import structure as U

from .base import CHUNK_OF, DAILY, PTS, SEGS, SP, blocks, case_sql, daily, points, q6, query, r6, seg_points, segs_sql
from .editing import BW, seg
from .statistics import STATS, STATUS, VIOL

ML = "CASE {l} WHEN 'event' THEN 3 WHEN 'transition' THEN 2 WHEN 'periodic' THEN 6 ELSE 2 END"

# One boundary edit per series: segment series_id % 3 with small shifts.
E01 = f"""WITH {PTS}, {SEGS}, nb AS (SELECT *, lag(start_index) OVER w AS ps, lag(label) OVER w AS pl, lead(end_index) OVER w AS ne, lead(label) OVER w AS nl, lag(segment_id) OVER w AS pi, lead(segment_id) OVER w AS ni FROM segs WINDOW w AS (PARTITION BY series_id ORDER BY start_index)),
 ed AS (SELECT *, CAST(start_index + series_id%5-2 AS INT) AS b, CAST(end_index + series_id%7*3-9 AS INT) AS e FROM nb WHERE segment_id = series_id % 3),
 rj AS (SELECT *, CASE WHEN b<0 THEN 'negative_start' WHEN b>e THEN 'inverted' WHEN e-b+1 < {ML.format(l='label')} THEN 'too_short' WHEN pi IS NOT NULL AND b-1-ps+1 < {ML.format(l='pl')} THEN 'left_too_short' WHEN ni IS NOT NULL AND ne-e < {ML.format(l='nl')} THEN 'right_too_short' END AS reject FROM ed)
 SELECT s.series_id, s.segment_id, CASE WHEN r.reject IS NULL AND r.series_id IS NOT NULL AND s.segment_id=r.segment_id THEN b WHEN r.reject IS NULL AND s.segment_id=r.ni THEN e+1 ELSE s.start_index END AS start_index,
 CASE WHEN r.reject IS NULL AND r.series_id IS NOT NULL AND s.segment_id=r.segment_id THEN e WHEN r.reject IS NULL AND s.segment_id=r.pi THEN b-1 ELSE s.end_index END AS end_index,
 coalesce(r.reject IS NULL AND s.segment_id IN (r.segment_id, r.pi, r.ni), false) AS decomposition_dirty, CASE WHEN s.segment_id IN (r.segment_id, r.pi, r.ni) THEN r.reject END AS reject FROM segs s LEFT JOIN rj r ON r.series_id=s.series_id"""


@query("e01_move_boundaries", E01)
def _(spark, sf):
    b = blocks(spark, sf)
    ed = b.where("segment_id = series_id % 3").select("series_id", "segment_id", (F.col("series_id") % 5 - 2).cast("int").alias("delta_b"),
                                                      (F.col("series_id") % 7 * 3 - 9).cast("int").alias("delta_e"))
    return U.move_ends(b, ed).drop("label")


@query("e02_split", f"""WITH {PTS}, {SEGS}, e AS (SELECT *, CASE WHEN segment_id%2=0 THEN CAST(start_index + series_id%18 AS INT) END AS t FROM segs), r AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN NOT (start_index<t AND t<end_index) THEN 'not_inside'
 WHEN t-start_index+1 < {ML.format(l='label')} THEN 'left_too_short' WHEN end_index-t < {ML.format(l='label')} THEN 'right_too_short' END AS reject FROM e)
 SELECT series_id, CAST(segment_id AS VARCHAR) AS segment_id, start_index, end_index, false AS decomposition_dirty, reject FROM r WHERE t IS NULL OR reject IS NOT NULL UNION ALL SELECT series_id, segment_id || '-a', start_index, t, true, NULL FROM r WHERE t IS NOT NULL AND reject IS NULL
 UNION ALL SELECT series_id, segment_id || '-b', t+1, end_index, true, NULL FROM r WHERE t IS NOT NULL AND reject IS NULL""")
def _(spark, sf):
    b = blocks(spark, sf)
    ed = b.where("segment_id % 2 = 0").select("series_id", "segment_id", (F.col("start_index") + F.col("series_id") % 18).cast("int").alias("t_star"))
    return U.split_segments(b, ed).drop("label")


@query("e03_merge")
def _(spark, sf):
    from seriesforge.operators.shapes import classify
    b = blocks(spark, sf)
    m = U.merge_segments(b, b.where("segment_id % 3 = 0").select("series_id", "segment_id"))
    ok = m.where("reject is null").select("series_id", F.col("merged_id").alias("segment_id"), "start_index", "end_index", F.col("old_label").alias("label"))
    return classify(E.frames(points(spark, sf), ok, 0)).select("series_id", "segment_id", F.col("shape").alias("new_label"), "confidence")


LEGALV = ", ".join(f"('{c}','{o}')" for c, ops in C.LEGAL_OPERATIONS.items() for o in ops)
BOP = "CASE WHEN {l} IN ('trend','plateau') THEN CASE WHEN {d}>0 THEN 'extend' ELSE 'shorten' END WHEN {l}='event' THEN 'change_duration' WHEN {l}='spike' THEN CASE WHEN {d}>0 THEN 'widen' ELSE 'narrow' END WHEN {l}='transition' THEN 'shift_onset' ELSE 'split' END"
LG = "EXISTS (SELECT 1 FROM legal WHERE chunk_type={l} AND op={o})"
REQ = f"""legal(chunk_type, op) AS (VALUES {LEGALV}), nb AS (SELECT *, lead(segment_id) OVER w AS ni, lead(end_index) OVER w AS ne, lead(label) OVER w AS nl FROM segs WINDOW w AS (PARTITION BY series_id ORDER BY start_index)),
 rq AS (SELECT *, ['edit_boundary','split','merge','reclassify'][CAST(series_id%4 AS INT)+1] AS op_name, CAST(CASE WHEN series_id%4=0 THEN end_index + series_id%5 - 2 ELSE start_index + series_id%17 END AS INT) AS p, CAST(segment_id+1+(series_id%11=0)::INT AS INT) AS other, ['trend','plateau','spike','event','bogus'][CAST(series_id%5 AS INT)+1] AS new_label FROM nb WHERE segment_id = 1),
 dz AS (SELECT *, CASE op_name WHEN 'edit_boundary' THEN CASE WHEN ni IS NULL OR other<>ni THEN 'NON_ADJACENT_SEGMENTS' WHEN p=end_index THEN 'NO_OP' WHEN NOT {LG.format(l='label', o=BOP.format(l='label', d='(p-end_index)'))} THEN 'OPERATION_NOT_ALLOWED' WHEN NOT {LG.format(l='nl', o=BOP.format(l='nl', d='(end_index-p)'))} THEN 'OPERATION_NOT_ALLOWED' WHEN p-start_index+1<2 OR ne-p<2 THEN 'CONSTRAINT_FAIL' ELSE 'LEGAL' END
  WHEN 'split' THEN CASE WHEN NOT {LG.format(l='label', o="'split'")} THEN 'OPERATION_NOT_ALLOWED' WHEN NOT (start_index<=p AND p<end_index) THEN 'INVALID_SPLIT_POINT' WHEN p-start_index+1<2 OR end_index-p<2 THEN 'CONSTRAINT_FAIL' ELSE 'LEGAL' END
  WHEN 'merge' THEN CASE WHEN ni IS NULL OR other<>ni THEN 'NON_ADJACENT_SEGMENTS' WHEN label<>nl THEN 'INCOMPATIBLE_SEGMENTS' WHEN NOT {LG.format(l='label', o="'merge'")} THEN 'OPERATION_NOT_ALLOWED' ELSE 'LEGAL' END
  ELSE CASE WHEN new_label='bogus' THEN 'UNKNOWN_TARGET_LABEL' WHEN new_label=label THEN 'NO_OP' ELSE 'LEGAL' END END AS reason_code FROM rq)"""


def requests(spark, sf):
    b = blocks(spark, sf)
    k = F.col("series_id")
    ops = F.array(*[F.lit(x) for x in ("edit_boundary", "split", "merge", "reclassify")])
    labs = F.array(*[F.lit(x) for x in ("trend", "plateau", "spike", "event", "bogus")])
    return b, b.where("segment_id = 1").select(
        "series_id", "segment_id", F.get(ops, (k % 4).cast("int")).alias("op_name"),
        F.when(k % 4 == 0, F.col("end_index") + k % 5 - 2).otherwise(F.col("start_index") + k % 17).cast("int").alias("position"),
        (F.col("segment_id") + 1 + (k % 11 == 0).cast("int")).cast("int").alias("other_id"), F.get(labs, (k % 5).cast("int")).alias("new_label"))


@query("e04_governed_structure", f"WITH {PTS}, {SEGS}, {REQ} SELECT series_id, segment_id, op_name, reason_code, reason_code='LEGAL' AS applied, CASE WHEN op_name='reclassify' THEN new_label ELSE label END AS result_label FROM dz")
def _(spark, sf):
    b, r = requests(spark, sf)
    return U.governed(b, r).select("series_id", "segment_id", "op_name", "reason_code", "applied", "result_label")


@query("e05_segmentation_versions", f"""WITH {PTS}, {SEGS}, {REQ}, ap AS (SELECT * FROM dz WHERE reason_code='LEGAL'), nx AS (
 SELECT s.series_id, CAST(s.segment_id AS VARCHAR) || CASE WHEN a.op_name='split' AND s.segment_id=a.segment_id THEN '-a' ELSE '' END AS segment_id, CASE WHEN a.op_name='edit_boundary' AND s.segment_id=a.other THEN p+1 ELSE s.start_index END AS start_index,
 CASE WHEN a.op_name IN ('edit_boundary','split') AND s.segment_id=a.segment_id THEN p WHEN a.op_name='merge' AND s.segment_id=a.segment_id THEN a.ne ELSE s.end_index END AS end_index, CASE WHEN a.op_name='reclassify' AND s.segment_id=a.segment_id THEN a.new_label ELSE s.label END AS label
 FROM segs s LEFT JOIN ap a ON a.series_id=s.series_id WHERE NOT coalesce(a.op_name='merge' AND s.segment_id=a.other, false) UNION ALL SELECT s.series_id, s.segment_id || '-b', p+1, s.end_index, s.label FROM segs s JOIN ap a ON a.series_id=s.series_id AND a.op_name='split' AND s.segment_id=a.segment_id)
 SELECT nx.*, 2 AS version, true AS valid FROM nx""")
def _(spark, sf):
    b, r = requests(spark, sf)
    nxt = U.apply_governed(b, U.governed(b, r), r)
    hist = U.append_version(b.withColumn("version", F.lit(1)), nxt, "governed")
    return nxt.join(hist.select("series_id", F.col("after_version").alias("version"), "valid"), "series_id")


# The first segment of every series is edited, by the operation of its label.
FIRST = ("p0 AS " + PTS.removeprefix("pts AS ") + """, f0 AS (SELECT series_id, count(*) AS n, avg(value) AS m, list(value ORDER BY t) AS v, """ + case_sql("arg_min(event_type, t)", CHUNK_OF) + """ AS label FROM p0 WHERE t < 16 GROUP BY 1),
 pts AS (SELECT p0.series_id, t, CASE WHEN t >= 16 THEN value WHEN label='plateau' THEN value + 2 WHEN label='trend' THEN value + (t-(n-1)/2.0)*2 WHEN label='spike' THEN m + 2*(value-m) WHEN label='event' THEN v[CAST(greatest(0, t-2) AS INT)+1] ELSE value END AS value, event_type, event_id, ts FROM p0 JOIN f0 USING (series_id))""")


@query("e11_constraint_status", f"WITH {STATS.replace(PTS, FIRST)}, {VIOL}, {STATUS} SELECT f0.series_id, CASE WHEN label='transition' THEN 'OPERATION_NOT_ALLOWED' WHEN n_violations=0 THEN 'PASS' WHEN constraint_mode='hard' THEN 'CONSTRAINT_FAIL' ELSE 'WARN' END AS reason_code, CASE WHEN label<>'transition' THEN n_violations END AS n_violations, label<>'transition' AND NOT (n_violations>0 AND constraint_mode='hard') AS applied FROM f0 JOIN st USING (series_id)")
def _(spark, sf):
    b = blocks(spark, sf)
    op = (F.when(F.col("label") == "trend", "change_slope").when(F.col("label") == "spike", "scale_spike").when(F.col("label") == "event", "shift_event").otherwise("shift_level"))
    names = ("delta", "slope_delta", "scale_factor", "offset")
    ed = b.where("segment_id = 0").select("series_id", "segment_id", op.alias("op_name"), F.create_map(*[x for n in names for x in (F.lit(n), F.lit(2.0))]).alias("params"))
    return U.govern_value_edits(points(spark, sf), b, ed).select("series_id", "reason_code", "n_violations", "applied")


VOP = ["shift_level", "change_slope", "scale_spike", "suppress_spike", "shift_event", "remove_event"]


@query("e11_governed_value_edits", f"""WITH {BW}, {SEGS}, st AS (SELECT series_id, segment_id, start_index AS st, end_index AS en, label FROM segs), nb AS (SELECT s.*, a.value AS l, b.value AS r FROM st s LEFT JOIN pts a ON a.series_id=s.series_id AND a.t=st-1 LEFT JOIN pts b ON b.series_id=s.series_id AND b.t=en+1),
 ed AS (SELECT bw.*, label, l, r, CASE label WHEN 'plateau' THEN 'shift_level' WHEN 'trend' THEN 'change_slope' WHEN 'spike' THEN CASE WHEN segment_id%2=0 THEN 'scale_spike' ELSE 'suppress_spike' END WHEN 'event' THEN CASE WHEN segment_id%2=0 THEN 'shift_event' ELSE 'remove_event' END ELSE 'shift_level' END AS op, CAST(series_id%3 AS DOUBLE) AS k FROM bw JOIN nb USING (series_id, segment_id)),
 rs AS (SELECT *, CASE WHEN label='transition' THEN 'OPERATION_NOT_ALLOWED' WHEN op IN ('shift_level','change_slope','shift_event') AND k=0 THEN 'INVALID_PARAMETERS' WHEN op='scale_spike' AND k=1 THEN 'INVALID_PARAMETERS' ELSE 'LEGAL' END AS reason_code FROM ed)
 SELECT series_id, segment_id, CAST(i AS INT) AS pos, reason_code, {q6("CASE WHEN reason_code<>'LEGAL' THEN x WHEN op='shift_level' THEN x+k WHEN op='change_slope' THEN x+(i-(n-1)/2.0)*k WHEN op='scale_spike' THEN m+k*(x-m) WHEN op='suppress_spike' THEN m WHEN op='shift_event' THEN v[CAST(greatest(0, i-k) AS INT)+1] ELSE CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN l+(r-l)*(i+1)/(n+1) ELSE coalesce(l, r) END END")} AS value FROM rs""")
def _(spark, sf):
    f = E.frames(points(spark, sf), blocks(spark, sf))
    k = (F.col("series_id") % 3).cast("double")
    even = F.col("segment_id") % 2 == 0
    op = (F.when(F.col("label") == "plateau", "shift_level").when(F.col("label") == "trend", "change_slope")
          .when(F.col("label") == "spike", F.when(even, "scale_spike").otherwise("suppress_spike"))
          .when(F.col("label") == "event", F.when(even, "shift_event").otherwise("remove_event")).otherwise("shift_level"))
    names = ("delta", "slope_delta", "scale_factor", "offset")
    ed = f.select("series_id", "segment_id", op.alias("op_name"), F.create_map(*[x for n in names for x in (F.lit(n), k)]).alias("params"))
    out = U.apply_value_edits(f, ed)
    return out.select("series_id", "segment_id", "reason_code", F.posexplode("edited").alias("pos", "value")).withColumn("value", r6("value"))


# --- fits ------------------------------------------------------------------------------

def long(f):
    return T.components_long(f).withColumn("value", r6("value"))


@query("f01_constant_fit", f"WITH {BW} SELECT series_id, segment_id, 'trend' AS component, CAST(i AS INT) AS pos, {q6('m')} AS value FROM bw UNION ALL SELECT series_id, segment_id, 'residual', CAST(i AS INT), {q6('x-m')} FROM bw")
def _(spark, sf):
    return long(T.constant(seg(spark, sf)))


DELTA = "dk AS (SELECT *, first_value(i) OVER (PARTITION BY series_id, segment_id ORDER BY round(abs(x-m), 9) DESC, i) AS k FROM bw WHERE n>1), db AS (SELECT *, avg(CASE WHEN i<>k THEN x END) OVER (PARTITION BY series_id, segment_id) AS b FROM dk)"


@query("f02_delta_fit", f"WITH {BW}, {DELTA} SELECT DISTINCT series_id, segment_id, CAST(k AS INT) AS peak_index, {q6('b')} AS baseline, {q6('v[CAST(k AS INT)+1]-b')} AS peak_amplitude FROM db WHERE n > 2")
def _(spark, sf):
    d = T.delta(seg(spark, sf)).where(F.size("v") > 2)
    c = lambda n: F.element_at("coefficients", F.lit(n))
    return d.select("series_id", "segment_id", c("peak_index").cast("int").alias("peak_index"), r6(c("baseline")).alias("baseline"), r6(c("peak_amplitude")).alias("peak_amplitude"))


@query("f03_noise_fit", f"WITH {SP} SELECT series_id, segment_id, {q6('avg(value)')} AS level, {q6('stddev_pop(value)')} AS std FROM sp GROUP BY 1,2")
def _(spark, sf):
    c = lambda n: F.element_at("coefficients", F.lit(n))
    return T.noise_model(seg(spark, sf)).select("series_id", "segment_id", r6(c("level")).alias("level"), r6(c("std")).alias("std"))


def line(spark, sf):
    return T.etm(seg_points(spark, sf).withColumn("t", F.col("pos")))


LINE = "lf AS (SELECT series_id, segment_id, CASE WHEN count(*)<2 THEN avg(value) ELSE regr_intercept(value, pos) END AS a, CASE WHEN count(*)<2 THEN 0 ELSE regr_slope(value, pos) END AS b FROM sp GROUP BY 1,2)"


@query("f04_trajectory_fit", f"WITH {SP}, {LINE} SELECT series_id, segment_id, {q6('a')} AS x0, {q6('b')} AS linear_rate, {q6('sqrt(avg((value-a-b*pos)*(value-a-b*pos)))')} AS rmse FROM sp JOIN lf USING (series_id, segment_id) GROUP BY 1,2,a,b")
def _(spark, sf):
    return line(spark, sf).select("series_id", "segment_id", r6(CE.coef("x0")).alias("x0"), r6(CE.coef("linear_rate")).alias("linear_rate"), r6("rmse").alias("rmse"))


@query("f04_trajectory_fit_full")
def _(spark, sf):
    d = daily(spark, sf).withColumn("segment_id", F.lit(0))
    f = T.etm(d, steps=[1200], transients=[(400, 50, "log")], periods=[365.25])
    return T.coefficients_long(f)


SEAS = f"""ma AS (SELECT series_id, t, value, avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM daily), ph AS (SELECT series_id, t%7 AS p, avg(value-trend) AS s FROM ma GROUP BY 1,2),
 sc AS (SELECT series_id, p, s - avg(s) OVER (PARTITION BY series_id) AS s FROM ph), sd AS (SELECT ma.*, s AS seasonal, value-trend-s AS residual FROM ma JOIN sc ON sc.series_id=ma.series_id AND sc.p=ma.t%7)"""


@query("f05_seasonal_split", f"WITH {DAILY}, {SEAS} SELECT series_id, t, {q6('trend')} AS trend, {q6('seasonal')} AS seasonal, {q6('residual')} AS residual FROM sd")
def _(spark, sf):
    s = T.seasonal_split(daily(spark, sf), 7)
    return s.select("series_id", "t", *[r6(c).alias(c) for c in ("trend", "seasonal", "residual")])


@query("f06_multi_seasonal", f"""WITH {DAILY}, {SEAS}, m2 AS (SELECT series_id, t, value, seasonal AS s7, value-seasonal AS y FROM sd), ma2 AS (SELECT *, (avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) + avg(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 14 PRECEDING AND 15 FOLLOWING))/2 AS tr FROM m2),
 p2 AS (SELECT series_id, t%30 AS p, avg(y-tr) AS s FROM ma2 GROUP BY 1,2), s2 AS (SELECT series_id, p, s-avg(s) OVER (PARTITION BY series_id) AS s FROM p2) SELECT ma2.series_id, t, {q6('tr')} AS trend, {q6('s7')} AS seasonal_7, {q6('s')} AS seasonal_30, {q6('value-tr-s7-s')} AS residual FROM ma2 JOIN s2 ON s2.series_id=ma2.series_id AND s2.p=t%30""")
def _(spark, sf):
    d = daily(spark, sf)
    m = T.multi_seasonal(d, T.valid_periods(d, [30, 7, 100000]))
    return m.select("series_id", "t", *[r6(c).alias(c) for c in ("trend", "seasonal_7", "seasonal_30", "residual")])


BF = "bq AS (SELECT series_id, t, value, 0.8*value AS b FROM {src} WHERE t=0 UNION ALL SELECT d.series_id, d.t, d.value, least((0.2*0.98*bq.b + 0.02*0.8*d.value)/(1-0.98*0.8), d.value) FROM bq JOIN {src} d ON d.series_id=bq.series_id AND d.t=bq.t+1)"


@query("f08_baseflow", f"WITH RECURSIVE {DAILY}, {BF.format(src='daily')} SELECT series_id, t, {q6('b')} AS baseflow, {q6('value-b')} AS quickflow FROM bq")
def _(spark, sf):
    return T.baseflow(daily(spark, sf)).select("series_id", "t", r6("baseflow").alias("baseflow"), r6("quickflow").alias("quickflow"))


@query("f09_baseflow_calibration", f"""WITH RECURSIVE {DAILY}, r AS (SELECT series_id, t, value, lead(value) OVER (PARTITION BY series_id ORDER BY t) AS nx FROM daily), a0 AS (SELECT series_id, greatest(0.5, least(0.999, exp(avg(ln(nx/value)) FILTER (value>0 AND nx>0)))) AS a FROM r WHERE t%100 BETWEEN 10 AND 38 GROUP BY 1),
 q AS (SELECT d.series_id, d.t, d.value, 0.0::DOUBLE AS q, a FROM daily d JOIN a0 USING (series_id) WHERE d.t=0 UNION ALL SELECT d.series_id, d.t, d.value, greatest(0, least(q.a*q.q + 0.5*(1+q.a)*(d.value-q.value), d.value)), q.a FROM q JOIN daily d ON d.series_id=q.series_id AND d.t=q.t+1)
 SELECT series_id, {q6('a')} AS a, {q6('greatest(0.05, least(0.95, sum(value-q)/sum(value)))')} AS bfi_max FROM q GROUP BY series_id, a""")
def _(spark, sf):
    d = daily(spark, sf)
    last = d.groupBy("series_id").agg(F.max("t").alias("m"))
    spans = last.select("series_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 100))).alias("k")).select(
        "series_id", (F.col("k") * 100 + 10).cast("int").alias("start_index"), (F.col("k") * 100 + 40).cast("int").alias("end_index"))
    c = T.calibrate_baseflow(d, spans)
    return c.select("series_id", r6("a").alias("a"), r6("bfi_max").alias("bfi_max"))


@query("f12_fit_dispatch", "WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'trend' WHEN 'view' THEN 'plateau' WHEN 'purchase' THEN 'cycle' WHEN 'signup' THEN 'transient' ELSE 'noise' END AS shape, ['remote-sensing','multi-period','seismo-geodesy','hydrology'][CAST(event_id%4 AS INT)+1] AS domain FROM events) SELECT event_id, shape, domain, "
       "CASE WHEN shape='trend' AND domain='remote-sensing' THEN 'LandTrendr' WHEN shape='cycle' AND domain='multi-period' THEN 'MSTL' WHEN shape='transient' AND domain='seismo-geodesy' THEN 'GrAtSiD' WHEN shape='plateau' THEN 'Constant' WHEN shape='cycle' THEN 'STL' WHEN shape='noise' THEN 'NoiseModel' ELSE 'ETM' END AS method FROM e")
def _(spark, sf):
    from .base import case_col, table
    shapes = {"click": "trend", "view": "plateau", "purchase": "cycle", "signup": "transient", "error": "noise"}
    doms = F.array(*[F.lit(x) for x in ("remote-sensing", "multi-period", "seismo-geodesy", "hydrology")])
    e = table(spark, sf, "events").select("event_id", case_col("event_type", shapes).alias("shape"), F.get(doms, (F.col("event_id") % 4).cast("int")).alias("domain"))
    return e.withColumn("method", T.method_for(F.col("shape"), F.col("domain")))


@query("f14_reassemble", f"WITH {SP} SELECT series_id, segment_id, pos, {q6('value')} AS signal FROM sp")
def _(spark, sf):
    f = T.reassemble(line(spark, sf))
    return E.explode_values(f, "signal", "signal").withColumn("signal", r6("signal"))


@query("p23_coefficient_vector", f"WITH {SP}, {LINE} SELECT series_id, segment_id, {q6('a')} AS v0, {q6('b')} AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3 FROM lf")
def _(spark, sf):
    f = T.coefficient_vector(line(spark, sf))
    return f.select("series_id", "segment_id", *[r6(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(4)])


@query("a23_period_and_tau", f"WITH {SP}, {LINE} SELECT series_id, segment_id, 7.0::DOUBLE AS period, 4.0::DOUBLE AS tau FROM sp GROUP BY 1,2 HAVING count(*)>8")
def _(spark, sf):
    from seriesforge.operators.metrics import fit_metric
    f = feats(spark, sf).withColumn("coefficients", F.create_map(F.lit("period"), F.lit(7.0)))
    return f.select("series_id", "segment_id", fit_metric("period").alias("period"), fit_metric("tau").alias("tau"))


# --- edits in coefficient space --------------------------------------------------------------

def comp(name, sql, fn):
    """Signal after a component edit."""
    def run(spark, sf):
        return E.explode_values(T.reassemble(fn(spark, sf), "edited")).withColumn("value", r6("value"))
    query(name, sql)(run)


def pos_sql(expr, cte="", where="true", src="bw"):
    return f"WITH {BW}{cte} SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6(expr)} AS value FROM {src} WHERE {where}"


LCTE = f", {LINE}, bl AS (SELECT * FROM bw JOIN lf USING (series_id, segment_id))"
K3 = lambda: F.col("segment_id") % 3
comp("e12_scale_with_fit", pos_sql("x + m*(s%3) - m"), lambda sp, sf: CE.scale_amplitude(T.constant(seg(sp, sf)), K3()))
comp("e13_offset_with_fit", pos_sql("x + 1.25", LCTE, src="bl"), lambda sp, sf: CE.offset_level(line(sp, sf), 1.25))
comp("e23_raise_by_delta", pos_sql("x + 0.5*(s%3)"), lambda sp, sf: CE.raise_lower(T.constant(seg(sp, sf)), delta=K3() * 0.5))
comp("e23_raise_about_pivot", pos_sql("x - m + (1 + 1.4*(m-1))"), lambda sp, sf: CE.raise_lower(T.constant(seg(sp, sf)), alpha=0.4, pivot=1.0))
comp("e24_plateau_to_trend", pos_sql("m + 0.3*i"), lambda sp, sf: CE.to_trend(T.constant(seg(sp, sf)), 0.3))
comp("e24_plateau_to_cycle", pos_sql("m + 2*sin(2*pi()*i/6 + 0.4)"), lambda sp, sf: CE.to_cycle(T.constant(seg(sp, sf)), 2.0, 6.0, 0.4))
comp("e25_trend_slope", pos_sql("x - b*i + (s%3-1)*b*i", LCTE, src="bl"), lambda sp, sf: CE.change_slope(line(sp, sf), K3() - 1))
comp("e26_add_acceleration", pos_sql("x + 0.05*i*i", LCTE, src="bl"), lambda sp, sf: CE.accelerate(line(sp, sf), 0.05))


@query("e23_invert", f"WITH {BW}, g AS (SELECT series_id, avg(value) AS gm FROM pts GROUP BY 1) SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6('2*gm - x')} AS value FROM bw JOIN g USING (series_id)")
def _(spark, sf):
    g = points(spark, sf).groupBy("series_id").agg(F.avg("value").alias("gm"))
    f = T.reassemble(T.constant(seg(spark, sf))).join(g, "series_id")
    return E.explode_values(f.withColumn("edited", CE.invert_about(F.col("signal"), F.col("gm")))).withColumn("value", r6("value"))


@query("e24_local_detrend", pos_sql("x - 0.2*i"))
def _(spark, sf):
    f = T.reassemble(T.constant(seg(spark, sf)))
    return E.explode_values(f.withColumn("edited", CE.detrend_locally(F.col("signal"), 0.2))).withColumn("value", r6("value"))


@query("e26_extrapolate", f"WITH {SP}, {LINE}, x AS (SELECT series_id, segment_id, unnest([16,17,18,19]) AS t, a, b FROM lf) SELECT series_id, segment_id, CAST(t AS INT) AS t, {q6('a+b*t')} AS value FROM x")
def _(spark, sf):
    return CE.extrapolate(line(spark, sf), F.lit(16), 4).select("series_id", "segment_id", "t", r6("value").alias("value"))


@query("e26_robust_line", f"WITH {BW}, pr AS (SELECT a.series_id, a.segment_id, median((b.x-a.x)/(b.i-a.i)) AS sl FROM bw a JOIN bw b ON a.series_id=b.series_id AND a.segment_id=b.segment_id AND a.i<b.i GROUP BY 1,2), ic AS (SELECT bw.series_id, bw.segment_id, sl, median(x) - sl*median(i) AS c FROM bw JOIN pr USING (series_id, segment_id) GROUP BY 1,2,3) "
       f"SELECT series_id, segment_id, {q6('sl')} AS slope, {q6('c')} AS intercept FROM ic")
def _(spark, sf):
    from seriesforge.operators.shapes import robust_line
    r = robust_line(seg(spark, sf).where(F.size("v") > 1))
    return r.select("series_id", "segment_id", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


# Step model: level of the first 8 points, step at 8 to the mean of the rest, residual.
STEP = ", h AS (SELECT series_id, segment_id, avg(x) FILTER (i<8) AS l, avg(x) FILTER (i>=8) - avg(x) FILTER (i<8) AS d FROM bw GROUP BY 1,2), bs AS (SELECT * FROM bw JOIN h USING (series_id, segment_id) WHERE n>8)"


def step_fit(spark, sf):
    d = seg(spark, sf).where(F.size("v") > 8)
    from seriesforge.functions import vectors as V
    d = d.withColumn("l", V.vmean(F.slice("v", 1, 8))).withColumn("d", V.vmean(F.slice("v", 9, 100)) - F.col("l"))
    lev = F.transform("v", lambda x: F.col("l"))
    st = F.transform("v", lambda x, i: F.when(i >= 8, F.col("d")).otherwise(0.0))
    res = F.transform("v", lambda x, i: x - F.col("l") - F.when(i >= 8, F.col("d")).otherwise(0.0))
    return d.select("series_id", "segment_id", F.lit("ETM").alias("method"), F.create_map(F.lit("x0"), lev, F.lit("step_at_8"), st, F.lit("residual"), res).alias("components"),
                    F.create_map(F.lit("x0"), F.col("l"), F.lit("step_at_8"), F.col("d")).alias("coefficients"))


def step_sql(expr):
    return pos_sql(expr, STEP, src="bs")


H8 = "CASE WHEN i>=8 THEN d ELSE 0 END"
comp("e27_remove_step", step_sql(f"x - {H8}"), lambda sp, sf: CE.scale_step(step_fit(sp, sf), 8, 0.0))
comp("e27_invert_step", step_sql(f"x - 2*{H8}"), lambda sp, sf: CE.scale_step(step_fit(sp, sf), 8, -1.0))
comp("e27_scale_step", step_sql(f"x + 0.5*{H8}"), lambda sp, sf: CE.scale_step(step_fit(sp, sf), 8, 1.5))
comp("e27_move_step", step_sql(f"x - {H8} + CASE WHEN i>=5 THEN d ELSE 0 END"), lambda sp, sf: CE.move_step(step_fit(sp, sf), 8, 5))
comp("e28_step_to_ramp", step_sql(f"x - {H8} + d*ln(1+greatest(0.0, (i-8)/3.0))"), lambda sp, sf: CE.step_to_ramp(step_fit(sp, sf), 8, 3.0))
comp("e28_duplicate_step", step_sql("x + CASE WHEN i>=11 THEN 0.75 ELSE 0 END"), lambda sp, sf: CE.duplicate_step(step_fit(sp, sf), 8, 3, 0.75))

# Cycle model: mean trend, phase means of period 4, residual.
CYC = ", pm AS (SELECT series_id, segment_id, i%4 AS ph, avg(x-m) AS sv FROM bw GROUP BY 1,2,3), bc AS (SELECT bw.*, sv, list(sv) OVER (PARTITION BY bw.series_id, bw.segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sl FROM bw JOIN pm ON pm.series_id=bw.series_id AND pm.segment_id=bw.segment_id AND pm.ph=bw.i%4)"


def cycle_fit(spark, sf):
    from seriesforge.functions import vectors as V

    def phases(s):
        each = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: V.vmean(F.transform(F.filter(s["v"], lambda x, i: i % 4 == k), lambda x: x - s["m"])))
        return F.struct(s["v"].alias("v"), s["m"].alias("m"), each.alias("ph"))

    def parts(s):
        tr = F.transform(s["v"], lambda x: s["m"])
        se = F.transform(s["v"], lambda x, i: F.get(s["ph"], i % 4))
        re = F.transform(s["v"], lambda x, i: x - s["m"] - F.get(s["ph"], i % 4))
        return F.create_map(F.lit("trend"), tr, F.lit("seasonal"), se, F.lit("residual"), re)
    # bound, not columns of their own: a column named in a lambda is worked out again for each element once projections merge
    v = F.col("v")
    comps = V.let(V.let(F.struct(v.alias("v"), V.vmean(v).alias("m")), phases), parts)
    return seg(spark, sf).select("series_id", "segment_id", F.lit("STL").alias("method"), comps.alias("components"), F.create_map(F.lit("period"), F.lit(4.0)).alias("coefficients"))


def cyc_sql(expr, cte="", src="bc"):
    return pos_sql(expr, CYC + cte, src=src)


comp("e33_scale_season", cyc_sql("x + (s%3-1)*sv"), lambda sp, sf: CE.scale_matching(cycle_fit(sp, sf), CE.is_seasonal, K3()))
comp("e33_replace_with_flat", cyc_sql("m"), lambda sp, sf: CE.flatten_cycle(cycle_fit(sp, sf)))
comp("e34_change_period", cyc_sql("x - sv + sl[CAST(floor(i/1.5) AS INT)%n+1]*(1-(i/1.5-floor(i/1.5))) + sl[CAST((floor(i/1.5)+1)%n AS INT)+1]*(i/1.5-floor(i/1.5))"), lambda sp, sf: CE.change_period(cycle_fit(sp, sf), 1.5))
HAR = ", hs AS (SELECT series_id, segment_id, sum(cos(pi()*i/2)*cos(pi()*i/2)) AS cc, sum(sin(pi()*i/2)*sin(pi()*i/2)) AS ss, sum(cos(pi()*i/2)*sin(pi()*i/2)) AS cs, sum(cos(pi()*i/2)*sv) AS cv, sum(sin(pi()*i/2)*sv) AS svv FROM bc GROUP BY 1,2), bh AS (SELECT * FROM bc JOIN hs USING (series_id, segment_id) WHERE n>3)"
comp("e35_set_harmonic", cyc_sql("x + (0.5-(cv*ss-svv*cs)/(cc*ss-cs*cs))*cos(pi()*i/2) + (0.25-(svv*cc-cv*cs)/(cc*ss-cs*cs))*sin(pi()*i/2)", HAR, "bh"),
     lambda sp, sf: CE.set_harmonic(cycle_fit(sp, sf).where("size(components['trend']) > 3"), 1, 0.5, 0.25))


# Transient model: two features of fixed form scaled by the block mean, residual.
def feats(spark, sf):
    from seriesforge.functions import vectors as V
    d = seg(spark, sf).where(F.size("v") > 8).withColumn("m", V.vmean(F.col("v")))
    fs = F.array(CE.feature("exp", 3, 4.0, F.col("m")).cast(CE.FEATURE), CE.feature("log", 6, 2.0, F.lit(0.5)).cast(CE.FEATURE))
    d = d.withColumn("features", fs)
    tr = CE.transient_of(F.col("features"), F.size("v"))
    d = d.withColumn("tr", tr)
    return d.select("series_id", "segment_id", F.lit("GrAtSiD").alias("method"), "features", "v",
                    F.create_map(F.lit("transient"), F.col("tr"), F.lit("residual"), F.zip_with("v", "tr", lambda a, b: a - b)).alias("components"),
                    F.create_map(F.lit("n_features"), F.lit(2.0)).alias("coefficients"))


FE = "(m*exp(-greatest(0.0, (i-3)/4.0)))"
FL = "(0.5*ln(1+greatest(0.0, (i-6)/2.0)))"
tra = lambda e: pos_sql(e, where="n>8")
comp("e37_remove_feature", tra(f"x - {FE}"), lambda sp, sf: CE.remove_feature(feats(sp, sf), 0))
comp("e37_scale_feature", tra(f"x + 0.5*{FE}"), lambda sp, sf: CE.scale_feature(feats(sp, sf), 0, 1.5))
comp("e38_shift_feature", tra(f"x - {FE} + m*exp(-greatest(0.0, (i-5)/4.0))"), lambda sp, sf: CE.shift_feature(feats(sp, sf), 0, 2))
comp("e38_stretch_feature", tra(f"x - {FE} + m*exp(-greatest(0.0, (i-3)/8.0))"), lambda sp, sf: CE.stretch_feature(feats(sp, sf), 0, 2.0))
comp("e38_duplicate_feature", tra(f"x + m*exp(-greatest(0.0, (i-6)/4.0))"), lambda sp, sf: CE.duplicate_feature(feats(sp, sf), 0, 3))
comp("e39_feature_to_step", tra(f"x - {FE} + CASE WHEN i>=3 THEN m ELSE 0 END"), lambda sp, sf: CE.feature_to_step(feats(sp, sf), 0))
comp("e39_change_basis", f"WITH {BW}, tf AS (SELECT *, {FE} AS fe, {FL} AS fl, ln(1+greatest(0.0, (i-3)/4.0)) AS nb FROM bw WHERE n>8), am AS (SELECT series_id, segment_id, sum((fe+fl)*nb)/(sum(nb*nb)+1e-12) AS a FROM tf GROUP BY 1,2) SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6('x - fe + a*nb')} AS value FROM tf JOIN am USING (series_id, segment_id)",
     lambda sp, sf: CE.change_basis(feats(sp, sf), 0, "log"))
