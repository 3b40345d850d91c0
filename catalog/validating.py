"""Validation of edits, bootstrap family, round-based fits."""

from pyspark.sql import functions as F

from seriesforge.functions import vectors as V
from seriesforge.operators import distance as D
from seriesforge.operators import edits as E
from seriesforge.operators import fits as T
from seriesforge.operators import prototypes as P
from seriesforge.operators import validation as X

from .base import DAILY, EMB, PTS, SP, daily, embeddings, points, q6, query, r6, seg_points
from .editing import BW, seg
from .vectorspace import NUNQ, PAIR, vecs

# Edit: every block loses its mean distance by half when the block number is even.
EDS = f"{BW}, ed AS (SELECT series_id, segment_id, i, x AS value, CASE WHEN i%3=0 THEN x ELSE m + 0.5*(x-m) END AS edited FROM bw)"


def edited_pairs(spark, sf):
    d = seg(spark, sf)
    e = V.let(F.struct(F.col("v").alias("v"), V.vmean(F.col("v")).alias("m")), lambda s: F.transform(s["v"], lambda x, i: F.when(i % 3 == 0, x).otherwise(s["m"] + 0.5 * (x - s["m"]))))
    return d.select("series_id", "segment_id", F.posexplode(F.zip_with("v", e, lambda a, b: F.struct(a.alias("value"), b.alias("edited")))).alias("pos", "_z")).select("series_id", "segment_id", "pos", "_z.*")


@query("v01_edit_proximity", f"WITH {EDS}, {EMB}, {PAIR}, {NUNQ}, g AS (SELECT series_id, segment_id, sqrt(sum(power(value-edited,2))) AS p, avg((abs(value-edited)<1e-6)::INT) AS s FROM ed GROUP BY 1,2) SELECT series_id, segment_id, {q6('p')} AS proximity, {q6('s')} AS sparsity, {q6('(SELECT count(*) FROM nun WHERE distance<=p)/(SELECT count(*) FROM nun)')} AS proximity_pct, s<0.7 AND p>(SELECT quantile_cont(distance, 0.9) FROM nun) AS too_dense FROM g")
def _(spark, sf):
    nun = D.unlike_neighbour(vecs(spark, sf)).select(F.col("distance").alias("value"))
    e = X.edit_distance(edited_pairs(spark, sf), nun)
    return e.select("series_id", "segment_id", r6("proximity").alias("proximity"), r6("sparsity").alias("sparsity"), r6("proximity_pct").alias("proximity_pct"), "too_dense")


RESI = f"{PTS}, re AS (SELECT series_id, t, value - coalesce(lag(value) OVER (PARTITION BY series_id ORDER BY t), 0) AS residual FROM pts), q0 AS (SELECT series_id, quantile_cont(abs(residual), 0.9) AS q0 FROM re GROUP BY 1)"


def residuals(spark, sf):
    from seriesforge.operators.layout import framed
    p = framed(points(spark, sf), 1, 0, {"_p": lambda w: F.lag("value").over(w())})
    return p.select("series_id", "t", (F.col("value") - F.coalesce("_p", F.lit(0.0))).alias("residual"))


@query("v02_band_calibration", f"WITH {RESI} SELECT series_id, {q6('q0')} AS q0 FROM q0")
def _(spark, sf):
    return X.calibrate_band(residuals(spark, sf)).withColumn("q0", r6("q0"))


BAND = """bd AS (SELECT series_id, -1 AS t, q0 AS q, []::DOUBLE[] AS e FROM q0 UNION ALL SELECT bd.series_id, bd.t+1, greatest(bd.q + 0.5*((abs(residual)>bd.q)::INT-0.1) + 0.1*list_sum(list_append(bd.e[greatest(len(bd.e)-8,1):], (abs(residual)>bd.q)::INT-0.1)), 0), list_append(bd.e[greatest(len(bd.e)-8,1):], (abs(residual)>bd.q)::INT-0.1) FROM bd JOIN re ON re.series_id=bd.series_id AND re.t=bd.t+1)"""


@query("v03_adaptive_band", f"WITH RECURSIVE {RESI}, {BAND} SELECT series_id, CAST(t AS INT) AS t, {q6('q')} AS q FROM bd WHERE t>=0")
def _(spark, sf):
    r = residuals(spark, sf)
    return X.adaptive_band(r, X.calibrate_band(r)).withColumn("q", r6("q"))


TWO = RESI.replace("user_id AS series_id", "user_id % 2 AS series_id").replace("PARTITION BY user_id", "PARTITION BY user_id % 2")


@query("v03_adaptive_band_long_series", f"WITH RECURSIVE {TWO}, {BAND} SELECT series_id, CAST(t AS INT) AS t, {q6('q')} AS q FROM bd WHERE t>=0")
def _(spark, sf):
    from seriesforge.operators.layout import framed, index_series
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 2).alias("series_id"), "ts", "event_id", (F.col("value") / 50.0).alias("value"))
    p = index_series(e, "series_id", ["ts", "event_id"], F.to_date("ts"))
    p = framed(p, 1, 0, {"_p": lambda w: F.lag("value").over(w())})
    r = p.select("series_id", "t", (F.col("value") - F.coalesce("_p", F.lit(0.0))).alias("residual"))
    return X.adaptive_band(r, X.calibrate_band(r), chunk=512).withColumn("q", r6("q"))


@query("v04_band_check", f"WITH RECURSIVE {RESI}, {BAND}, e AS (SELECT series_id, t, value AS y_pre, value*1.2+0.2 AS y_post, (t//5)*5 AS tb FROM pts) SELECT e.series_id, e.t, {q6('abs(y_post-y_pre)')} AS delta, CASE WHEN abs(y_post-y_pre)<q THEN 'within' WHEN abs(y_post-y_pre)<2*q THEN 'exceeds_alpha=0.1' ELSE 'exceeds_alpha=0.05' END AS verdict FROM e JOIN bd ON bd.series_id=e.series_id AND bd.t=e.tb")
def _(spark, sf):
    r = residuals(spark, sf)
    bands = X.adaptive_band(r, X.calibrate_band(r)).where("t % 5 = 0")
    e = points(spark, sf).select("series_id", "t", F.col("value").alias("y_pre"), (F.col("value") * 1.2 + 0.2).alias("y_post"))
    return X.band_check(e, bands).select("series_id", "t", r6("delta").alias("delta"), "verdict")


@query("v05_invalidation_rate", f"""WITH {BW}, s AS (SELECT series_id, segment_id, sum(x*(i+1))/10 AS f, sqrt(sum((i+1)*(i+1)))/10 AS g, CASE WHEN segment_id%2=0 THEN 0.5 ELSE 0.1 END AS sg FROM bw GROUP BY 1,2), z AS (SELECT *, abs(f-8)/(sg*g) AS z FROM s), t AS (SELECT *, 1/(1+0.3275911*z/sqrt(2)) AS t FROM z)
 SELECT series_id, segment_id, {q6('0.5*((((1.061405429*t-1.453152027)*t+1.421413741)*t-0.284496736)*t+0.254829592)*t*exp(-z*z/2)')} AS invalidation_rate FROM t""")
def _(spark, sf):
    d = seg(spark, sf)
    score = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x) / 10
    g = F.sqrt(F.aggregate(F.transform("v", lambda x, i: (i + 1) * (i + 1)), F.lit(0.0), lambda a, x: a + x)) / 10
    op = F.when(F.col("segment_id") % 2 == 0, "shift_phase").otherwise("unknown")
    return X.invalidation_rate(d, score, g, op, 8.0).select("series_id", "segment_id", r6("invalidation_rate").alias("invalidation_rate"))


@query("v05_invalidation_monte_carlo")
def _(spark, sf):
    v = vecs(spark, sf)
    return X.invalidation_monte_carlo(v, P.means(v), 0.05, 10)


def mixed_sql(x: str) -> str:
    for _ in range(2):
        x = f"(xor({x}, ({x}) >> 16) * 73244475) % 4294967296"
    return f"xor({x}, ({x}) >> 16)"


def draw_sql(rep: str, t: str, seed: int) -> str:
    inner = mixed_sql("x")
    return f"list_transform([(list_transform([CAST({rep} AS BIGINT) + {seed * 7919}], lambda x: {inner})[1] + CAST({t} AS BIGINT) * 2654435761) % 4294967296], lambda x: {inner})[1]"


BOOT = f"""bg AS (SELECT p.series_id, t, n, r AS rep, {draw_sql("r", "t", 7)} < 4294967296/5.0 OR t=0 AS rs, {draw_sql("r", "t", 108)} % n AS st FROM pts p JOIN (SELECT series_id, count(*) AS n FROM pts GROUP BY 1) USING (series_id), range(20) g(r)),
 bc AS (SELECT *, last_value(CASE WHEN rs THEN st END IGNORE NULLS) OVER w AS s0, last_value(CASE WHEN rs THEN t END IGNORE NULLS) OVER w AS t0 FROM bg WINDOW w AS (PARTITION BY series_id, rep ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 bb AS (SELECT bc.series_id, rep, bc.t, p.value FROM bc JOIN pts p ON p.series_id=bc.series_id AND p.t=(s0+bc.t-t0)%n)"""


@query("v06_stationary_bootstrap", f"WITH {PTS}, {BOOT} SELECT series_id, CAST(rep AS INT) AS rep, t, {q6('value')} AS value FROM bb")
def _(spark, sf):
    return X.stationary_bootstrap(points(spark, sf), 5.0, 20).select("series_id", "rep", "t", r6("value").alias("value"))


@query("v07_bootstrap_interval", f"WITH {PTS}, {BOOT}, s AS (SELECT series_id, rep, avg(value-1) AS s FROM bb GROUP BY 1,2) SELECT series_id, {q6('quantile_cont(s, 0.025)')} AS ci_lower, {q6('quantile_cont(s, 0.975)')} AS ci_upper, {q6('least(1.0, 2*least(avg((s>=0)::INT), avg((s<=0)::INT)))')} AS p_value FROM s GROUP BY 1")
def _(spark, sf):
    c = X.bootstrap_mean_ci(points(spark, sf), 5.0, 20, less=1.0)
    return c.select("series_id", *[r6(k).alias(k) for k in ("ci_lower", "ci_upper", "p_value")])


FIT = f"""{PTS}, ln AS (SELECT series_id, regr_intercept(value, t) AS a, regr_slope(value, t) AS b FROM pts GROUP BY 1), {BOOT}, rl AS (SELECT bc.series_id, bc.rep, bc.t, a + b*bc.t + (p.value - a - b*p.t) AS y FROM bc JOIN ln USING (series_id) JOIN pts p ON p.series_id=bc.series_id AND p.t=(s0+bc.t-t0)%n),
 co AS (SELECT series_id, rep, regr_intercept(y, t) AS x0, regr_slope(y, t) AS linear_rate FROM rl GROUP BY 1,2), cu AS (SELECT series_id, 'x0' AS name, x0 AS v FROM co UNION ALL SELECT series_id, 'linear_rate', linear_rate FROM co),
 ed AS (SELECT series_id, 'x0' AS name, a + 0.5 AS edited FROM ln UNION ALL SELECT series_id, 'linear_rate', b * 3 FROM ln)"""


@query("v08_coefficient_interval", f"WITH {FIT} SELECT series_id, name, {q6('quantile_cont(v, 0.025)')} AS ci_lower, {q6('quantile_cont(v, 0.975)')} AS ci_upper, {q6('max(edited)')} AS edited, abs((max(edited)-avg(v))/greatest(stddev_pop(v), 1e-12)) > 3 AS is_extreme FROM cu JOIN ed USING (series_id, name) GROUP BY 1,2")
def _(spark, sf):
    p = points(spark, sf)
    e = p.groupBy("series_id").agg((F.regr_intercept("value", "t") + 0.5).alias("x0"), (F.regr_slope("value", "t") * 3).alias("linear_rate"))
    return X.coefficient_ci(p, e, 20).select("series_id", "name", *[r6(c).alias(c) for c in ("ci_lower", "ci_upper", "edited")], "is_extreme")


@query("v09_surrogate_test")
def _(spark, sf):
    d = seg(spark, sf).withColumn("edited", F.array_sort("v"))
    return X.surrogate_test(d, 19)


@query("v10_stationarity_check")
def _(spark, sf):
    p = points(spark, sf)
    post = p.withColumn("value", F.col("value") + F.when(F.col("t") >= 30, 3.0).otherwise(0.0))
    w = p.select("series_id").distinct().withColumns({"start": F.lit(28), "end": F.lit(36)})
    return X.stationarity_verdict(p, post, w)


DT = f"dl AS (SELECT series_id, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM pts GROUP BY 1), dt AS (SELECT series_id, t, value-a-b*t AS value FROM pts JOIN dl USING (series_id))"


@query("v11_detrend_whiten", f"WITH {PTS}, {DT}, l AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS p FROM dt), c AS (SELECT series_id, regr_slope(value, p) AS b, regr_intercept(value, p) AS a FROM l WHERE p IS NOT NULL GROUP BY 1) SELECT series_id, t, {q6('value-a-b*p')} AS value FROM l JOIN c USING (series_id) WHERE p IS NOT NULL")
def _(spark, sf):
    return X.whiten(X.detrend(points(spark, sf))).withColumn("value", r6("value"))


@query("v12_conservation_significance")
def _(spark, sf):
    p = X.detrend(points(spark, sf))
    post = p.withColumn("value", F.col("value") * 0.5 + 0.1)
    return X.conservation_significance(p, post, 20, 19)


@query("v13_donor_shift")
def _(spark, sf):
    p = points(spark, sf).select(F.col("series_id").alias("edit_id"), "t", "value")
    w = p.where("t < 20").select("edit_id", F.col("t").alias("i"), (F.col("value") + 0.3).alias("value"))
    c = p.where("t >= 20").select("edit_id", (F.col("t") - 20).alias("i"), "value")
    return X.donor_shift(w, c, 19)


@query("v14_coefficient_stability")
def _(spark, sf):
    v = vecs(spark, sf)
    proto = P.build(v)
    f = v.select("id", "label", F.get("v", F.lit(0)).alias("x0"), F.lit(0.0).alias("rate"), F.lit(0.05).alias("sigma_x0"), F.lit(0.002).alias("sigma_rate"),
                 F.transform("v", lambda x: x - F.get("v", F.lit(0))).alias("residual"))
    return X.coefficient_stability(f, proto, F.col("label"), 10)


@query("v15_stability_bound", f"""WITH {EMB}, s AS (SELECT vec_id AS id, 0.05*abs(v[1]) AS s1, v[2] AS d1, 0.1*abs(v[3]) AS s2, v[4] AS d2, v[5] AS m FROM emb), w AS (SELECT id, m, s1*s1*d1*d1 + s2*s2*d2*d2 AS var FROM s), z AS (SELECT *, m/greatest(sqrt(var), 1e-6) AS z FROM w), t AS (SELECT *, 1/(1+0.3275911*abs(z)/sqrt(2)) AS t FROM z),
 e AS (SELECT *, 0.5*((((1.061405429*t-1.453152027)*t+1.421413741)*t-0.284496736)*t+0.254829592)*t*exp(-z*z/2) AS h FROM t) SELECT id, {q6('CASE WHEN var<=0 THEN 1.0 WHEN z>=0 THEN 1-h ELSE h END')} AS bound FROM e""")
def _(spark, sf):
    v = vecs(spark, sf)
    g = lambda i: F.get("v", F.lit(i))
    t = v.select("id", F.explode(F.array(F.struct(F.lit("a").alias("name"), (0.05 * F.abs(g(0))).alias("sigma"), g(1).alias("dp")),
                                         F.struct(F.lit("b").alias("name"), (0.1 * F.abs(g(2))).alias("sigma"), g(3).alias("dp")))).alias("_x")).select("id", "_x.*")
    return X.stability_bound(t, v.select("id", g(4).alias("margin"))).withColumn("bound", r6("bound"))


def accepted(spark, sf):
    return seg(spark, sf).where(F.size("v") == 16).select(F.col("series_id").alias("session_id"), F.col("segment_id").alias("seq"), "v")


for _k in ("latent_euclidean", "shapelet_edit", "dtw_rbf"):
    query(f"v16_diversity_{_k}")((lambda k: lambda spark, sf: X.diversity(accepted(spark, sf), k))(_k))


@query("v17_incremental_diversity")
def _(spark, sf):
    return X.incremental_diversity(accepted(spark, sf))


# --- round-based fits ----------------------------------------------------------------------

@query("f07_season_and_breaks")
def _(spark, sf):
    c, _b = T.season_and_breaks(daily(spark, sf), 7, rounds=2, max_depth=2)
    return c


@query("f07_trend_breaks")
def _(spark, sf):
    return T.trend_breaks(points(spark, sf), max_depth=2)


@query("f10_trajectory")
def _(spark, sf):
    return T.trajectory(points(spark, sf), 3)


@query("f11_transient_pursuit")
def _(spark, sf):
    return T.pursuit(points(spark, sf), 2, [1.0, 5.0, 25.0], 6)
