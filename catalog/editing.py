"""Value edits of blocks, relabelling, conservation."""

from pyspark.sql import functions as F

from seriesforge.functions import vectors as V
from seriesforge.operators import conservation as K
from seriesforge.operators import edits as E
from seriesforge.operators import relabel as R
from seriesforge.operators import stats as ST
from seriesforge.operators import windows as X

from .base import (CHUNK_OF, DAILY, PTS, SEGS, SHAPE_OF, SP, blocks, case_col, case_sql, daily, points, q6, query, r6,
                   seg_points, segs_sql, table)

# Window columns of each block: i position, x value, n length, m mean, s segment number.
BW = (SP + ", bw AS (SELECT series_id, segment_id, segment_id AS s, pos AS i, value AS x, count(*) OVER k AS n, avg(value) OVER k AS m, min(value) OVER k AS mn, "
      "list(value) OVER (k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM sp WINDOW k AS (PARTITION BY series_id, segment_id))")
def S():
    return F.col("segment_id")


def seg(spark, sf):
    return ST.values(seg_points(spark, sf))


def edit(name, expr, fn, where="true", sfilter=None):
    """Register an array edit with its per-point SQL."""
    def run(spark, sf):
        d = seg(spark, sf)
        if sfilter is not None:
            d = d.where(sfilter)
        out = E.explode_values(d.withColumn("edited", fn(F.col("v"))))
        return out.withColumn("value", r6("value"))
    query(name, f"WITH {BW} SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6(expr)} AS value FROM bw WHERE {where}")(run)


edit("e06_shift_level", "x + (s%3)*0.5", lambda v: E.shift_level(v, (S() % 3) * 0.5))
edit("e07_add_ramp", "x + (i-(n-1)/2.0)*0.1*(s%3)", lambda v: E.add_ramp(v, (S() % 3) * 0.1))
edit("e08_scale_about_mean", "m + 0.5*(s%3)*(x-m)", lambda v: E.scale_about_mean(v, (S() % 3) * 0.5))
edit("e09_shift_with_hold", "v[CAST(greatest(0, least(i-(s%5-2), n-1)) AS INT)+1]", lambda v: E.shift_hold(v, S() % 5 - 2))
edit("e12_scale_pivots", "mn + 1.5*(x-mn)", lambda v: E.scale(v, 1.5, "min"))
edit("e13_offset", "x + 2.5", lambda v: E.shift_level(v, 2.5))
edit("e15_circular_shift", "CASE WHEN s%2=0 THEN CASE WHEN i<5 THEN i/4.0*v[CAST((i+n-2)%n AS INT)+1]+(1-i/4.0)*v[CAST((5+n-2)%n AS INT)+1] ELSE v[CAST((i+n-2)%n AS INT)+1] END "
     "ELSE CASE WHEN i>=n-5 THEN (1-(i-(n-5))/4.0)*v[CAST((i+3)%n AS INT)+1]+(i-(n-5))/4.0*v[CAST((n-6+3)%n AS INT)+1] ELSE v[CAST((i+3)%n AS INT)+1] END END",
     lambda v: E.circular_shift(v, F.when(S() % 2 == 0, 2).otherwise(-3)), "n > 5", "size(v) > 5")
edit("e16_reverse_time", "v[CAST(n-1-i AS INT)+1]", E.reverse)
edit("e30_cap_at_quantile", "least(x, list_aggregate(v, 'quantile_cont', 0.9))", lambda v: E.cap_at_quantile(v, 0.9))
edit("e31_gaussian_gain", "x + exp(-0.5*((i-3)/2.0)*((i-3)/2.0))*(2.5-1)*x", lambda v: E.gaussian_gain(v, 3, 2.5))
edit("e31_duplicate_peak", "x + CASE WHEN i=1 THEN 0.7*list_max(v) ELSE 0 END", lambda v: E.duplicate_peak(v, 1, 0.7))
HAT = E.mexican_hat(1.0)
edit("e32_smear_to_transient", " + ".join(f"coalesce(CASE WHEN i-({j}-3) BETWEEN 0 AND n-1 THEN v[CAST(i-({j}-3) AS INT)+1] END, 0)*({w!r})" for j, w in enumerate(HAT)),
     lambda v: E.smear(v, 1.0), "n >= 7", "size(v) >= 7")
edit("e42_polynomial_smooth", "CASE WHEN i BETWEEN 5 AND n-6 THEN (" + " + ".join(f"v[CAST(i AS INT)+1+({j - 5})]*({w})" for j, w in enumerate(E.CUBIC_11)) + ")/429 ELSE x END",
     E.smooth_cubic, "n >= 11", "size(v) >= 11")
edit("w17_crossfade_weights", "CASE WHEN i>=n-4 THEN (1-(n-1-i)/3.0)*x + (n-1-i)/3.0*v[CAST(n-1-i AS INT)+1] WHEN i<4 THEN (1-i/3.0)*x + i/3.0*v[CAST(n-1-i AS INT)+1] ELSE v[CAST(n-1-i AS INT)+1] END",
     lambda v: E.crossfade(v, F.reverse(v), 4), "n > 8", "size(v) > 8")


@query("e14_mute", f"WITH {BW}, g AS (SELECT series_id, avg(value) AS gm FROM pts GROUP BY 1) SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6('CASE WHEN s%2=0 THEN 0 ELSE gm END')} AS value FROM bw JOIN g USING (series_id)")
def _(spark, sf):
    g = points(spark, sf).groupBy("series_id").agg(F.avg("value").alias("gm"))
    d = seg(spark, sf).join(g, "series_id")
    return E.explode_values(d.withColumn("edited", E.fill_with(F.col("v"), F.when(S() % 2 == 0, 0.0).otherwise(F.col("gm"))))).withColumn("value", r6("value"))


@query("e17_resample_step", f"WITH {BW}, g AS (SELECT DISTINCT series_id, segment_id, n, v, unnest(range(0, CAST(ceil(n*0.4) AS BIGINT))) AS k FROM bw), p AS (SELECT *, least(k/0.4, n-1) AS pos0 FROM g) "
       f"SELECT series_id, segment_id, CAST(k AS INT) AS pos, {q6('v[CAST(floor(pos0) AS INT)+1] + (v[CAST(least(floor(pos0)+1, n-1) AS INT)+1]-v[CAST(floor(pos0) AS INT)+1])*(pos0-floor(pos0))')} AS value FROM p")
def _(spark, sf):
    d = seg(spark, sf)
    return E.explode_values(d.withColumn("edited", E.resample_step(F.col("v"), 0.4))).withColumn("value", r6("value"))


@query("e17_block_means", f"WITH {BW} SELECT series_id, segment_id, CAST(i//3 AS INT) AS pos, {q6('avg(x)')} AS value FROM bw GROUP BY 1,2,3")
def _(spark, sf):
    d = seg(spark, sf)
    return E.explode_values(d.withColumn("edited", E.resample_step(F.col("v"), 1 / 3, "block"))).withColumn("value", r6("value"))


def fr(spark, sf):
    return E.frames(points(spark, sf), blocks(spark, sf))


@query("e10_remove_bridge", f"WITH {BW}, nb AS (SELECT s.series_id, s.segment_id, a.value AS l, b.value AS r FROM (SELECT series_id, segment_id, min(t) AS st, max(t) AS en FROM sp GROUP BY 1,2) s LEFT JOIN pts a ON a.series_id=s.series_id AND a.t=st-1 LEFT JOIN pts b ON b.series_id=s.series_id AND b.t=en+1) "
       f"SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6('CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN l+(r-l)*(i+1)/(n+1) ELSE coalesce(l, r) END')} AS value FROM bw JOIN nb USING (series_id, segment_id)")
def _(spark, sf):
    d = fr(spark, sf)
    left = F.when(F.size("pre") > 0, F.element_at("pre", -1))
    return E.explode_values(d.withColumn("edited", E.bridge(F.col("v"), left, F.get("post", F.lit(0))))).withColumn("value", r6("value"))


@query("e18_linear_gap_fill", f"WITH {BW}, st AS (SELECT series_id, segment_id, min(t) AS st, max(t) AS en FROM sp GROUP BY 1,2), nb AS (SELECT s.series_id, s.segment_id, avg(CASE WHEN p.t<st THEN p.value END) AS l, avg(CASE WHEN p.t>en THEN p.value END) AS r FROM st s JOIN pts p ON p.series_id=s.series_id AND p.t BETWEEN st-3 AND en+3 GROUP BY 1,2) "
       f"SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6('coalesce(l, v[1]) + (coalesce(r, v[len(v)])-coalesce(l, v[1]))*CASE WHEN n>1 THEN i/(n-1) ELSE 0 END')} AS value FROM bw JOIN nb USING (series_id, segment_id)")
def _(spark, sf):
    d = fr(spark, sf)
    return E.explode_values(d.withColumn("edited", E.fill_linear(F.col("v"), F.col("pre"), F.col("post")))).withColumn("value", r6("value"))


@query("e19_cubic_gap_fill")
def _(spark, sf):
    d = fr(spark, sf)
    return E.explode_values(d.withColumn("edited", E.fill_cubic(F.col("v"), F.col("pre"), F.col("post"))))


CLIM = "cl AS (SELECT dayofyear(ts) AS doy, avg(value) AS c FROM daily WHERE year(ts) < 2000 GROUP BY 1)"


@query("j16_climatology_lookup", f"WITH {DAILY}, {CLIM} SELECT series_id, t, dayofyear(ts) AS doy, {q6('c')} AS climatology, c IS NULL AS missing FROM daily LEFT JOIN cl ON doy=dayofyear(ts)")
def _(spark, sf):
    d = daily(spark, sf)
    cl = d.where(F.year("ts") < 2000).groupBy(F.dayofyear("ts").alias("doy")).agg(F.avg("value").alias("c"))
    j = E.fill_climatology(d, cl)
    return j.select("series_id", "t", "doy", r6("c").alias("climatology"), F.col("c").isNull().alias("missing"))


@query("e20_climatology_gap_fill", f"WITH {DAILY}, {CLIM} SELECT series_id, t, {q6('CASE WHEN t%50 BETWEEN 10 AND 19 THEN coalesce(c, value) ELSE value END')} AS value FROM daily LEFT JOIN cl ON doy=dayofyear(ts)")
def _(spark, sf):
    d = daily(spark, sf)
    cl = d.where(F.year("ts") < 2000).groupBy(F.dayofyear("ts").alias("doy")).agg(F.avg("value").alias("c"))
    gap = (F.col("t") % 50).between(10, 19)
    return E.fill_climatology(d, cl).select("series_id", "t", r6(F.when(gap, F.coalesce("c", "value")).otherwise(F.col("value"))).alias("value"))


@query("e20_trend_gap_fill")
def _(spark, sf):
    from seriesforge.operators.fits import seasonal_split
    gap = (F.col("t") % 50).between(10, 19)
    return seasonal_split(daily(spark, sf), 7).select("series_id", "t", F.when(gap, F.col("trend")).otherwise(F.col("value")).alias("value"))


@query("e20_baseflow_gap_fill")
def _(spark, sf):
    from seriesforge.operators.fits import baseflow
    gap = (F.col("t") % 50).between(10, 19)
    b = baseflow(daily(spark, sf), 0.8, 0.925)
    return b.select("series_id", "t", F.when(gap, F.col("baseflow")).otherwise(F.col("value")).alias("value"))


def _noise(kind):
    def run(spark, sf):
        d = seg(spark, sf)
        return E.explode_values(d.withColumn("edited", E.add_noise(F.col("v"), F.xxhash64("series_id", "segment_id", F.lit(7)), kind, 0.2)))
    return run


for _k in ("white", "pink", "red"):
    query(f"e21_noise_{_k}")(_noise(_k))
for _k in ("ar1", "gamma"):
    query(f"e43_inject_{_k}")(_noise(_k))


@query("e22_replace_from_library")
def _(spark, sf):
    from seriesforge.operators.distance import class_shapelets
    d = E.frames(points(spark, sf), blocks(spark, sf, labels=SHAPE_OF)).where(F.size("v") > 10)
    lib = d.select(F.concat_ws("-", "series_id", "segment_id").alias("id"), "label", "v").where(F.size("v") == 16)
    donors = d.join(class_shapelets(lib, 8), "label").select("series_id", "segment_id", F.col("shapelet").alias("donor"))
    return E.explode_values(E.replace_from_library(d, donors, 5))


HAMP = """hm AS (SELECT a.series_id, a.segment_id, a.pos, a.value, median(b.value) AS med FROM sp a JOIN sp b ON a.series_id=b.series_id AND a.segment_id=b.segment_id AND b.t BETWEEN a.t-3 AND a.t+3 GROUP BY 1,2,3,4),
 ha AS (SELECT a.series_id, a.segment_id, a.pos, a.value, a.med, median(abs(b.value-a.med)) AS mad FROM hm a JOIN sp b ON a.series_id=b.series_id AND a.segment_id=b.segment_id AND b.pos BETWEEN a.pos-3 AND a.pos+3 GROUP BY 1,2,3,4,5)"""


@query("e29_spike_removal", f"WITH {SP}, {HAMP} SELECT series_id, segment_id, pos, {q6('CASE WHEN abs(value-med) > 3*1.4826*mad THEN med ELSE value END')} AS value FROM ha")
def _(spark, sf):
    h = X.hampel(seg_points(spark, sf), keys=("series_id", "segment_id"), t="pos")
    return h.select("series_id", "segment_id", "pos", r6("filtered").alias("value"))


@query("e29_despike_rounds")
def _(spark, sf):
    d = seg(spark, sf).where(F.size("v") >= 11)
    return E.explode_values(d.withColumn("edited", E.despike_rounds(F.col("v"))))


@query("e42_subtract_correction", f"WITH {DAILY}, cor AS (SELECT t, avg(value) AS c FROM daily GROUP BY 1) SELECT series_id, d.t, {q6('value - c')} AS value FROM daily d JOIN cor USING (t)")
def _(spark, sf):
    d = daily(spark, sf)
    c = d.groupBy("t").agg(F.avg("value").alias("c"))
    return d.join(c, "t").select("series_id", "t", r6(F.col("value") - F.col("c")).alias("value"))


@query("e41_state_space_smooth")
def _(spark, sf):
    return E.kalman_smooth(daily(spark, sf), 0.01, 1.0)


def _spec(mode):
    def run(spark, sf):
        d = seg(spark, sf).where(F.size("v") >= 4)
        return E.explode_values(d.withColumn("edited", E.spectral(F.col("v"), mode, 0.7)))
    return run


query("e36_phase_rotation")(_spec("rotate"))
query("e36_analytic_phase_shift")(_spec("analytic"))
query("e40_whiten")(_spec("whiten"))


@query("e40_recolour")
def _(spark, sf):
    d = seg(spark, sf)
    n = E.noise(F.col("v"), F.xxhash64("series_id", "segment_id"), "pink", float("nan"))
    return E.explode_values(d.withColumn("edited", F.zip_with("v", n, lambda a, b: b)))


@query("e40_noise_gain", f"WITH {BW} SELECT series_id, segment_id, CAST(i AS INT) AS pos, {q6('m + 1.8*(x-m)')} AS value FROM bw")
def _(spark, sf):
    from seriesforge.operators import component_edits as C
    from seriesforge.operators import fits as T
    f = C.scale_matching(T.noise_model(seg(spark, sf)), lambda k: k == "residual", 1.8)
    return E.explode_values(T.reassemble(f, "edited")).withColumn("value", r6("value"))


@query("e44_align_warp")
def _(spark, sf):
    d = E.frames(points(spark, sf), blocks(spark, sf, labels=SHAPE_OF)).withColumn("ref_id", F.col("label"))
    ref = d.where(F.size("v") == 16).groupBy("ref_id").agg(F.min_by("v", F.struct("series_id", "segment_id")).alias("v"))
    return E.explode_values(E.align_warp(d, ref))


# --- relabelling ------------------------------------------------------------------------

OPS = ["scale", "split", "raise_lower", "change_slope", "amplify_amplitude", "remove", "convert_to_ramp", "edit_boundary", "mute_zero"]
RULE_VALUES = ", ".join(f"('{s}','{o}','{p}','{v if isinstance(v, str) else v[0]}',{'NULL' if isinstance(v, str) else chr(39) + v[1] + chr(39)})" for (s, o, p), v in R.RULES.items())
RE = (f"{PTS}, {segs_sql(16, SHAPE_OF, 'g')}, ed AS (SELECT series_id || '-' || segment_id AS edit_id, series_id AS session_id, segment_id, CAST(segment_id % 3 AS INT) AS tier, label AS old_shape, "
      f"[{', '.join(repr(o) for o in OPS)}][CAST((series_id + segment_id) % {len(OPS)} + 1 AS INT)] AS op_name, CAST(series_id % 2 AS DOUBLE) AS alpha FROM g), rules(shape, op, pred, cls, tgt) AS (VALUES {RULE_VALUES}), "
      "mt AS (SELECT ed.*, r.cls, r.tgt, row_number() OVER (PARTITION BY edit_id ORDER BY CASE WHEN r.shape=old_shape AND pred<>'' THEN 1 WHEN r.shape='*' AND pred<>'' THEN 2 WHEN r.shape=old_shape THEN 3 ELSE 4 END) AS rn FROM ed LEFT JOIN rules r ON r.op=op_name AND r.shape IN (old_shape,'*') AND (pred='' OR (pred='alpha=0' AND alpha=0))), "
      "rl AS (SELECT *, CASE WHEN cls='DETERMINISTIC' THEN tgt WHEN cls IS NOT NULL THEN old_shape END AS new_shape, CASE WHEN cls='RECLASSIFY_VIA_SEGMENTER' THEN 0.0 WHEN cls IS NOT NULL THEN 1.0 END::DOUBLE AS confidence FROM mt WHERE rn=1)")


def edit_rows(spark, sf):
    b = blocks(spark, sf, labels=SHAPE_OF)
    ops = F.array(*[F.lit(o) for o in OPS])
    return b.select(F.concat_ws("-", "series_id", "segment_id").alias("edit_id"), F.col("series_id").alias("session_id"), "segment_id",
                    (F.col("segment_id") % 3).cast("int").alias("tier"), F.col("label").alias("old_shape"),
                    F.get(ops, ((F.col("series_id") + F.col("segment_id")) % len(OPS)).cast("int")).alias("op_name"),
                    (F.col("series_id") % 2).cast("double").alias("alpha"), "series_id")


@query("j06_relabel_rule_lookup", f"WITH {RE} SELECT edit_id, op_name, old_shape, cls AS rule_class, new_shape, confidence FROM rl")
def _(spark, sf):
    return R.relabel(edit_rows(spark, sf)).select("edit_id", "op_name", "old_shape", "rule_class", "new_shape", "confidence")


@query("l02_label_chips", f"WITH {RE} SELECT sha256(session_id || '|' || edit_id) AS chip_id, session_id, segment_id, op_name, tier, old_shape, new_shape, confidence, cls AS rule_class FROM rl WHERE NOT (tier=0 AND op_name='edit_boundary')")
def _(spark, sf):
    r = R.relabel(edit_rows(spark, sf)).withColumn("ts", F.lit(None).cast("timestamp"))
    return R.label_chips(r).select("chip_id", "session_id", "segment_id", "op_name", "tier", "old_shape", "new_shape", "confidence", "rule_class")


OPV = ", ".join(f"('{s}','{o}')" for s, ops in R.SHAPE_OPERATIONS.items() for o in ops)


@query("u05_shared_operations", f"WITH {PTS}, {segs_sql(16, SHAPE_OF, 'g')}, so(shape, op) AS (VALUES {OPV}), sel AS (SELECT DISTINCT series_id*100 + segment_id//2 AS selection_id, label AS shape FROM g), n AS (SELECT selection_id, count(*) AS n FROM sel GROUP BY 1) "
       "SELECT selection_id, op AS op_name FROM sel JOIN so USING (shape) JOIN n USING (selection_id) GROUP BY selection_id, op, n HAVING count(*) = n")
def _(spark, sf):
    b = blocks(spark, sf, labels=SHAPE_OF)
    return R.shared_operations(b.select((F.col("series_id") * 100 + F.floor(F.col("segment_id") / 2)).alias("selection_id"), F.col("label").alias("shape")))


# --- conservation ----------------------------------------------------------------------------

WB = "wb AS (SELECT l_orderkey, l_linenumber, l_quantity AS p, l_extendedprice/10000 AS et, l_discount*100 AS q, l_tax*100 AS ds FROM lineitem)"


def water(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("P"), (F.col("l_extendedprice") / 10000).alias("ET"),
                                               (F.col("l_discount") * 100).alias("Q"), (F.col("l_tax") * 100).alias("dS"))


@query("e45_water_balance", f"WITH {WB}, r AS (SELECT *, p-et-q-ds AS r0 FROM wb) SELECT l_orderkey, l_linenumber, {q6('p-r0/4')} AS p_new, {q6('et+r0/4')} AS et_new, {q6('q+r0/4')} AS q_new, {q6('ds+r0/4')} AS ds_new, {q6('r0')} AS initial_residual FROM r")
def _(spark, sf):
    w = K.water_balance(water(spark, sf), "coupled")
    return w.select("l_orderkey", "l_linenumber", r6("P").alias("p_new"), r6("ET").alias("et_new"), r6("Q").alias("q_new"), r6("dS").alias("ds_new"), r6("initial_residual").alias("initial_residual"))


@query("e46_moment_tensor", f"WITH {WB}, t AS (SELECT l_orderkey, l_linenumber, p AS m11, et AS m22, q AS m33, p+et+q AS tr FROM wb) SELECT l_orderkey, l_linenumber, {q6('m11-tr/3')} AS m11, {q6('m22-tr/3')} AS m22, {q6('m33-tr/3')} AS m33, {q6('tr')} AS initial_residual FROM t")
def _(spark, sf):
    w = water(spark, sf).select("l_orderkey", "l_linenumber", F.col("P").alias("m11"), F.col("ET").alias("m22"), F.col("Q").alias("m33"))
    m = K.moment_balance(w, "coupled")
    return m.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in ("m11", "m22", "m33", "initial_residual")])


@query("e47_phase_closure", f"WITH {WB}, t AS (SELECT l_orderkey, l_linenumber, p/3 AS a, et AS b, q AS c FROM wb), k AS (SELECT *, (a+b-c) - 2*pi()*floor((a+b-c+pi())/(2*pi())) AS z FROM t) SELECT l_orderkey, l_linenumber, {q6('a')} AS phi_12, {q6('b')} AS phi_23, {q6('c+z')} AS phi_13, {q6('z')} AS initial_residual FROM k")
def _(spark, sf):
    w = water(spark, sf).select("l_orderkey", "l_linenumber", (F.col("P") / 3).alias("phi_12"), F.col("ET").alias("phi_23"), F.col("Q").alias("phi_13"))
    m = K.phase_closure(w, "local")
    return m.select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in ("phi_12", "phi_23", "phi_13", "initial_residual")])


def stations(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_suppkey") % 20).alias("network"), "l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 20000).alias("y"),
                     (F.col("l_discount") * 30).alias("z"), (F.col("l_tax") * 20).alias("vx"), (F.col("l_partkey") % 11 / 5.0).alias("vy"), (F.col("l_orderkey") % 7 / 3.0).alias("vz"))


# Cramer's rule on the same 3 x 3 system.
NNR = """st AS (SELECT l_suppkey % 20 AS network, l_orderkey, l_linenumber, l_quantity/10 AS x, l_extendedprice/20000 AS y, l_discount*30 AS z, l_tax*20 AS vx, (l_partkey%11)/5.0 AS vy, (l_orderkey%7)/3.0 AS vz FROM lineitem),
 sy AS (SELECT network, sum(y*vz-z*vy) AS b0, sum(z*vx-x*vz) AS b1, sum(x*vy-y*vx) AS b2, sum(y*y+z*z) AS a, sum(-x*y) AS b, sum(-x*z) AS c, sum(x*x+z*z) AS d, sum(-y*z) AS e, sum(x*x+y*y) AS f FROM st GROUP BY 1),
 dt AS (SELECT *, a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c) AS det FROM sy),
 om AS (SELECT network, (b0*(d*f-e*e)-b*(b1*f-e*b2)+c*(b1*e-d*b2))/det AS w0, (a*(b1*f-e*b2)-b0*(b*f-e*c)+c*(b*b2-b1*c))/det AS w1, (a*(d*b2-b1*e)-b*(b*b2-b1*c)+b0*(b*e-d*c))/det AS w2 FROM dt)"""


@query("e48_no_net_rotation", f"WITH {NNR} SELECT network, l_orderkey, l_linenumber, {q6('vx-(w1*z-w2*y)')} AS vx, {q6('vy-(w2*x-w0*z)')} AS vy, {q6('vz-(w0*y-w1*x)')} AS vz FROM st JOIN om USING (network)")
def _(spark, sf):
    s = K.nnr_frame(stations(spark, sf))
    return s.select("network", "l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in ("vx", "vy", "vz")])


@query("e49_conservation_audit", f"WITH {WB} SELECT 'water_balance' AS law, 'local' AS mode, {q6('max(abs(p-et-q-ds))')} AS initial, 0.0::DOUBLE AS final, true AS converged FROM wb")
def _(spark, sf):
    _, audit = K.enforce(water(spark, sf), "water_balance", "local")
    return audit.select("law", "mode", r6("initial").alias("initial"), F.abs(r6("final")).alias("final"), "converged")


@query("e50_linear_projection", f"WITH {PTS}, w AS (SELECT series_id, t, value, CASE WHEN t%16<8 THEN 1 ELSE 0 END AS mk, 1.0/(1+t%3) AS w FROM pts), r AS (SELECT series_id, sum(w*value) - 30.0 AS r, sum(CASE WHEN mk=1 THEN w*w END) AS g FROM w GROUP BY 1) "
       f"SELECT series_id, t, {q6('value - CASE WHEN mk=1 THEN w*r/g ELSE 0 END')} AS projected FROM w JOIN r USING (series_id)")
def _(spark, sf):
    p = points(spark, sf).withColumn("in_mask", F.col("t") % 16 < 8)
    w = p.select(F.lit("c1").alias("constraint_id"), "series_id", "t", (1.0 / (1 + F.col("t") % 3)).alias("weight"))
    t = p.select("series_id").distinct().select("series_id", F.lit("c1").alias("constraint_id"), F.lit(30.0).alias("target"))
    return K.project_linear(p, w, t).select("series_id", "t", r6("projected").alias("projected"))
