"""Vector helpers, neighbours, prototypes."""

from pyspark.sql import functions as F

from seriesforge import config as C
from seriesforge.functions import scores as S
from seriesforge.functions import vectors as V
from seriesforge.operators import distance as D
from seriesforge.operators import prototypes as P
from seriesforge.operators import stats as ST

from .base import EMB, PTS, SEGS, SHAPE_OF, SP, case_col, case_sql, embeddings, points, q6, query, r6, seg_points, table

LV = "sv AS (SELECT series_id, segment_id, list(value ORDER BY t) AS v FROM sp GROUP BY 1,2)"
SOFT = "list_transform(v, lambda x: exp(x - list_max(v)))"


def arrays(spark, sf, least=1):
    return ST.values(seg_points(spark, sf)).where(F.size("v") >= least)


# Probabilities of the five event types in each block.
PROB = ("kn AS (SELECT series_id, segment_id, event_type, count(*) AS n FROM sp GROUP BY 1,2,3), pr AS (SELECT series_id, segment_id, event_type, "
        "n / sum(n) OVER (PARTITION BY series_id, segment_id) AS p FROM kn)")


def probs(spark, sf):
    k = seg_points(spark, sf, "event_type").groupBy("series_id", "segment_id", "event_type").count()
    g = k.groupBy("series_id", "segment_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"), F.sum("count").alias("n"))
    return g.select("series_id", "segment_id", F.transform_values("m", lambda k, v: v / F.col("n")).alias("p"))


@query("p11_sigmoid_softmax", f"WITH {SP}, {LV}, e AS (SELECT series_id, segment_id, v, {SOFT} AS e FROM sv) SELECT series_id, segment_id, {q6('list_max(e)/list_sum(e)')} AS top, {q6('1/(1+exp(-10*(v[1]-0.55)))')} AS above, "
       f"{q6('1/(1+exp(-20*(0.5-v[1])))')} AS below FROM e")
def _(spark, sf):
    a = arrays(spark, sf)
    x = F.get("v", F.lit(0))
    return a.select("series_id", "segment_id", r6(F.array_max(V.softmax(F.col("v")))).alias("top"),
                    r6(S.sigmoid_above(x, 0.55)).alias("above"), r6(S.sigmoid_below(x, 0.5, 20.0)).alias("below"))


@query("p12_normalised_entropy", f"WITH {SP}, {PROB} SELECT series_id, segment_id, {q6('CASE WHEN count(*)<=1 THEN 0 ELSE least(1.0, -sum(p*ln(p))/ln(count(*))) END')} AS entropy FROM pr GROUP BY 1,2")
def _(spark, sf):
    return probs(spark, sf).select("series_id", "segment_id", r6(V.entropy(F.map_values("p"))).alias("entropy"))


@query("p13_top2_margin", f"WITH {SP}, {PROB}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, segment_id ORDER BY p DESC) AS rn FROM pr), g AS (SELECT series_id, segment_id, max(CASE WHEN rn=1 THEN p END)-max(CASE WHEN rn=2 THEN p END) AS m FROM r GROUP BY 1,2) "
       f"SELECT series_id, segment_id, {q6('m')} AS margin, coalesce(m < 0.15, false) AS uncertain FROM g")
def _(spark, sf):
    m = S.top2_margin(F.map_values("p"))
    return probs(spark, sf).select("series_id", "segment_id", r6(m).alias("margin"), F.coalesce(m < 0.15, F.lit(False)).alias("uncertain"))


@query("p07_shape_to_chunk", f"SELECT event_id, {case_sql('event_type', SHAPE_OF)} AS shape, {case_sql(case_sql('event_type', SHAPE_OF), C.SHAPE_TO_CHUNK)} AS chunk FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", case_col("event_type", SHAPE_OF).alias("shape"))
    return e.withColumn("chunk", F.coalesce(C.lookup(C.SHAPE_TO_CHUNK, F.col("shape")), F.lit(C.CHUNK_TYPES[0])))


@query("p18_phase_wrap", f"WITH {PTS} SELECT series_id, t, {q6('x - 2*pi()*floor((x+pi())/(2*pi()))')} AS wrapped, {q6('2*pi()*round_even(x/(2*pi()), 0)')} AS snapped, "
       "abs(x - 2*pi()*round_even(x/(2*pi()),0)) <= 0.1*pi() AND round_even(x/(2*pi()),0) <> 0 AS is_multiple FROM (SELECT series_id, t, value*5-7 AS x FROM pts)")
def _(spark, sf):
    x = F.col("value") * 5 - 7
    near, hit = S.snap_two_pi(x, 0.1 * 3.141592653589793)
    return points(spark, sf).select("series_id", "t", r6(S.wrap_phase(x)).alias("wrapped"), r6(near).alias("snapped"), hit.alias("is_multiple"))


@query("p21_rounded_probabilities", f"""WITH {SP}, {PROB}, r AS (SELECT series_id, segment_id, event_type, round_even(p, 6) AS p FROM pr), t AS (SELECT *, round(sum(p) OVER w, 6) AS tot, max(p) OVER w AS mx FROM r WINDOW w AS (PARTITION BY series_id, segment_id)),
 d AS (SELECT *, CASE WHEN p = mx AND row_number() OVER (PARTITION BY series_id, segment_id, p = mx ORDER BY event_type) = 1 THEN 1 ELSE 0 END AS dom FROM t)
 SELECT series_id, segment_id, event_type, CASE WHEN tot<>1.0 AND dom=1 THEN greatest(0.0, round(p+(1.0-tot), 6)) ELSE p END AS p FROM d""")
def _(spark, sf):
    q = probs(spark, sf).select("series_id", "segment_id", F.explode(P.rounded_probabilities(F.col("p"))).alias("event_type", "p"))
    return q


RES = "rs AS (SELECT vec_id, i, 1 + i*63/15.0 AS pos, v FROM emb, range(16) r(i)), rv AS (SELECT vec_id, i, v[CAST(floor(pos) AS INT)] + (coalesce(v[CAST(floor(pos) AS INT)+1], v[64]) - v[CAST(floor(pos) AS INT)])*(pos-floor(pos)) AS x FROM rs)"


@query("p25_linear_resample", f"WITH {EMB}, {RES} SELECT vec_id, CAST(i AS INT) AS i, {q6('x')} AS x FROM rv")
def _(spark, sf):
    e = embeddings(spark, sf).select("vec_id", F.posexplode(V.resample(F.col("v"), 16)).alias("i", "x"))
    return e.withColumn("x", r6("x"))


@query("p26_znorm", f"WITH {EMB}, x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1)-1 AS i FROM emb) SELECT vec_id, CAST(i AS INT) AS i, {q6('(x-avg(x) OVER w)/stddev_pop(x) OVER w')} AS z FROM x WINDOW w AS (PARTITION BY vec_id)")
def _(spark, sf):
    return embeddings(spark, sf).select("vec_id", F.posexplode(V.znorm(F.col("v"))).alias("i", "z")).withColumn("z", r6("z"))


ENC = f"""{RES}, st AS (SELECT vec_id, i, (x-avg(x) OVER w)/CASE WHEN stddev_pop(x) OVER w>1e-8 THEN stddev_pop(x) OVER w ELSE 1.0 END AS z FROM rv WINDOW w AS (PARTITION BY vec_id)),
 en AS (SELECT vec_id, i, z AS e FROM st UNION ALL SELECT vec_id, 16+i, coalesce(z - lag(z) OVER (PARTITION BY vec_id ORDER BY i), 0.0) FROM st
 UNION ALL SELECT vec_id, 32, ln(65.0) FROM st GROUP BY 1 UNION ALL SELECT vec_id, 33, avg(abs(z)) FROM st GROUP BY 1 UNION ALL SELECT vec_id, 34, stddev_pop(z) FROM st GROUP BY 1 UNION ALL SELECT vec_id, 35, max(abs(z)) FROM st GROUP BY 1),
 ev AS (SELECT vec_id, i, e/sqrt(sum(e*e) OVER (PARTITION BY vec_id)) AS e FROM en)"""


@query("p24_segment_embedding", f"WITH {EMB}, {ENC} SELECT vec_id, CAST(i AS INT) AS i, {q6('e')} AS e FROM ev")
def _(spark, sf):
    return embeddings(spark, sf).select("vec_id", F.posexplode(V.encode(F.col("v"))).alias("i", "e")).withColumn("e", r6("e"))


# --- neighbours ---------------------------------------------------------------

def vecs(spark, sf):
    return embeddings(spark, sf).withColumnRenamed("vec_id", "id")


PAIR = "d AS (SELECT a.vec_id AS id, b.vec_id AS nn_id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS d FROM emb a JOIN emb b ON a.vec_id <> b.vec_id)"


@query("j08_unlike_neighbour_l2", f"WITH {EMB}, {PAIR} SELECT id, {q6('min(d)')} AS distance FROM d WHERE la<>lb GROUP BY 1")
def _(spark, sf):
    return D.unlike_neighbour(vecs(spark, sf)).select("id", r6("distance").alias("distance"))


@query("j08_unlike_neighbour_l1", f"WITH {EMB}, d AS (SELECT a.vec_id AS id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1]-z[2]))) AS d FROM emb a JOIN emb b ON a.label<>b.label) SELECT id, {q6('min(d)')} AS distance FROM d GROUP BY 1")
def _(spark, sf):
    return D.unlike_neighbour(vecs(spark, sf), "l1").select("id", r6("distance").alias("distance"))


@query("j08_unlike_neighbour_dtw")
def _(spark, sf):
    return D.unlike_neighbour(vecs(spark, sf), "dtw", 6)


NUNQ = f"nun AS (SELECT id, min(d) AS distance FROM d WHERE la<>lb GROUP BY 1)"


@query("a33_neighbour_distance_quantile", f"WITH {EMB}, {PAIR}, {NUNQ} SELECT 'embeddings' AS dataset, {q6('quantile_cont(distance, 0.9)')} AS q90, count(*) AS n FROM nun")
def _(spark, sf):
    from seriesforge.operators.validation import neighbour_thresholds
    t = neighbour_thresholds(D.unlike_neighbour(vecs(spark, sf)).withColumn("dataset", F.lit("embeddings")))
    return t.select("dataset", r6("q90").alias("q90"), "n")


@query("w13_percentile_rank", f"WITH {EMB}, {PAIR}, {NUNQ} SELECT vec_id AS id, {q6('(SELECT count(*) FROM nun WHERE distance <= list_sum(list_transform(v, lambda x: abs(x)))/6)/(SELECT count(*) FROM nun)')} AS pct FROM emb")
def _(spark, sf):
    from seriesforge.operators.validation import percentile_rank
    nun = D.unlike_neighbour(vecs(spark, sf)).select(F.col("distance").alias("value"))
    x = vecs(spark, sf).select("id", (V.vsum(F.transform("v", lambda x: F.abs(x))) / 6).alias("value"))
    return percentile_rank(x, nun, []).select("id", r6("pct").alias("pct"))


KNN = "kn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nn_id) AS rn FROM d)"


@query("j09_knn_class_share", f"WITH {EMB}, {PAIR}, {KNN} SELECT id, {q6('avg(CASE WHEN la=lb THEN 1.0 ELSE 0.0 END)')} AS ynn, count(*) AS n_neighbours FROM kn WHERE rn<=5 GROUP BY 1")
def _(spark, sf):
    v = vecs(spark, sf)
    return D.ynn(v.withColumn("target", F.col("label")), v).withColumn("ynn", r6("ynn"))


@query("j09_knn_dtw_shortlist")
def _(spark, sf):
    v = vecs(spark, sf)
    return D.ynn_dtw(v.withColumn("target", F.col("label")), v)


PROTO = """un AS (SELECT vec_id, label, list_transform(v, lambda x: x/sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS u FROM emb), ux AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM un),
 um AS (SELECT label, i, avg(x) AS x FROM ux GROUP BY 1,2), pv AS (SELECT label, list(x ORDER BY i) AS p0 FROM um GROUP BY 1), proto AS (SELECT label, list_transform(p0, lambda x: x/sqrt(list_sum(list_transform(p0, lambda y: y*y)))) AS p FROM pv)"""


@query("a31_class_prototypes", f"WITH {EMB}, {PROTO} SELECT label, CAST(generate_subscripts(p, 1)-1 AS INT) AS i, {q6('unnest(p)')} AS x FROM proto")
def _(spark, sf):
    return P.build(vecs(spark, sf)).select("label", F.posexplode("prototype").alias("i", "x")).withColumn("x", r6("x"))


@query("j10_dtw_to_prototype")
def _(spark, sf):
    v = vecs(spark, sf).join(P.means(vecs(spark, sf)), "label")
    return v.select("id", "label", D.dtw_distance("v", "prototype", 6).alias("distance"))


@query("j11_keogh_bound", f"""WITH {EMB}, ep AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY 1,2) GROUP BY 1),
 en AS (SELECT label, i, list_max(m[greatest(i-6,1):i+6]) AS u, list_min(m[greatest(i-6,1):i+6]) AS l FROM ep, range(1, 65) r(i)), x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb)
 SELECT vec_id AS id, {q6('sqrt(sum(greatest(x-u,0)*greatest(x-u,0)+greatest(l-x,0)*greatest(l-x,0)))')} AS bound FROM x JOIN en USING (label, i) GROUP BY 1""")
def _(spark, sf):
    m = P.means(vecs(spark, sf)).withColumn("e", V.envelope(F.col("prototype"), 6))
    j = vecs(spark, sf).join(m, "label")
    return j.select("id", r6(V.lb_keogh(F.col("v"), F.col("e.upper"), F.col("e.lower"))).alias("bound"))


@query("j12_donor_by_dtw")
def _(spark, sf):
    v = vecs(spark, sf)
    t = v.withColumn("target", F.pmod(F.col("label").cast("int") + 1, F.lit(10)).cast("string"))
    return D.donors(t, v).drop("donor")


@query("j13_class_shapelets")
def _(spark, sf):
    return D.class_shapelets(vecs(spark, sf), 16)


@query("j14_discords", f"""WITH {PTS}, w AS (SELECT series_id, t, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM pts), z AS (SELECT series_id, t, list_transform(v, lambda x: (x-list_avg(v))/list_stddev_pop(v)) AS z FROM w WHERE len(v)=8),
 p AS (SELECT a.series_id, a.t, min(list_distance(a.z, b.z)) AS d FROM z a JOIN z b ON a.series_id=b.series_id AND abs(a.t-b.t)>2 GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(d, 9) DESC, t) AS rn FROM p) SELECT series_id, CAST(t AS INT) AS t, {q6('round(d, 9)')} AS distance FROM k WHERE rn=1""")
def _(spark, sf):
    return D.discords(points(spark, sf), 8).withColumn("distance", r6("distance"))


@query("j18_nearest_prototype", f"""WITH {EMB}, pm AS (SELECT label, list(x ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY 1,2) GROUP BY 1),
 s AS (SELECT e.vec_id AS id, pm.label, -power(list_distance(v, p), 2) AS s FROM emb e JOIN pm ON true), m AS (SELECT *, exp(s-max(s) OVER (PARTITION BY id)) AS e, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS rn FROM s)
 SELECT id, max(CASE WHEN rn=1 THEN label END) AS label, {q6('max(s)')} AS score, {q6('1/sum(e)')} AS confidence FROM m GROUP BY 1""")
def _(spark, sf):
    v = vecs(spark, sf)
    return P.classify(v.drop("label"), P.means(v), "neg_sq_l2").select("id", "label", r6("score").alias("score"), r6("confidence").alias("confidence"))


@query("j19_cosine_prototype", f"""WITH {EMB}, {PROTO}, lb AS (SELECT unnest(['0','1','2','3','4','none']) AS label), s AS (SELECT un.vec_id AS id, lb.label, coalesce(list_dot_product(u, p), -1.0)/0.2 AS s FROM un JOIN lb ON true LEFT JOIN proto ON proto.label=lb.label),
 m AS (SELECT *, exp(s-max(s) OVER (PARTITION BY id)) AS e, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS rn FROM s) SELECT id, max(CASE WHEN rn=1 THEN label END) AS label, {q6('1/sum(e)')} AS confidence, {q6('max(CASE WHEN label=' + chr(39) + 'none' + chr(39) + ' THEN e END)/sum(e)')} AS p_missing FROM m GROUP BY 1""")
def _(spark, sf):
    v = vecs(spark, sf)
    u = v.select("id", V.unit(F.col("v")).alias("v"))
    c = P.chunk_probabilities(u, P.build(v), ("0", "1", "2", "3", "4", "none"))
    return c.select("id", "label", r6("confidence").alias("confidence"), r6(F.element_at("probabilities", F.lit("none"))).alias("p_missing"))


@query("j20_local_outlier_factor", f"""WITH {EMB}, {PAIR}, {KNN}, nb AS (SELECT * FROM kn WHERE rn<=10), kd AS (SELECT id, max(d) AS kd FROM nb GROUP BY 1), lt AS (SELECT nb.id, 1/(avg(greatest(nb.d, kd.kd))+1e-10) AS lrd FROM nb JOIN kd ON kd.id=nb.nn_id GROUP BY 1),
 qd AS (SELECT a.vec_id AS id, b.vec_id AS nn_id, list_distance(list_transform(a.v, lambda x: x*1.1), b.v) AS d FROM emb a JOIN emb b ON true), qk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nn_id) AS rn FROM qd), qn AS (SELECT * FROM qk WHERE rn<=10),
 lq AS (SELECT qn.id, 1/(avg(greatest(qn.d, kd.kd))+1e-10) AS lrd FROM qn JOIN kd ON kd.id=qn.nn_id GROUP BY 1) SELECT qn.id, {q6('avg(lt.lrd)/max(lq.lrd)')} AS lof FROM qn JOIN lt ON lt.id=qn.nn_id JOIN lq ON lq.id=qn.id GROUP BY 1""")
def _(spark, sf):
    v = vecs(spark, sf)
    e = v.withColumn("v", F.transform("v", lambda x: x * 1.1))
    return D.local_outlier_factor(e, v, 10).withColumn("lof", r6("lof"))


@query("g12_prototype_drift", f"""WITH {EMB}, {PROTO}, um2 AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM un WHERE vec_id % 2 = 0) GROUP BY 1,2), p2 AS (SELECT label, list(x ORDER BY i) AS p0 FROM um2 GROUP BY 1), pr2 AS (SELECT label, list_transform(p0, lambda x: x/sqrt(list_sum(list_transform(p0, lambda y: y*y)))) AS q FROM p2)
 SELECT label, {q6('coalesce(list_distance(p, q), 0.0)')} AS drift FROM proto LEFT JOIN pr2 USING (label)""")
def _(spark, sf):
    v = vecs(spark, sf)
    return P.drift(P.build(v), P.build(v.where("id % 2 = 0"))).withColumn("drift", r6("drift"))


# Corrections: vectors in id order, one session per id modulo 3, label mapped to a shape, confidence from the id.
def corrections(spark, sf):
    shapes = F.array(*[F.lit(s) for s in C.SHAPES])
    return vecs(spark, sf).select(
        (F.col("id") % 3).alias("session_id"), F.col("id").alias("seq"), F.get(shapes, F.col("label").cast("int") % 7).alias("label"),
        ((F.col("id") * 37 % 100) / 100.0).alias("confidence"), "v")


@query("g10_prototype_memory")
def _(spark, sf):
    return P.update_memory(corrections(spark, sf), max_drift=1.2)


@query("g11_support_snapshots")
def _(spark, sf):
    return P.support_snapshots(corrections(spark, sf), cap=20)


@query("g13_default_support", "WITH i AS (SELECT i FROM range(24) r(i)), t AS (SELECT 'trend' AS label, i, i/23.0 AS x FROM i UNION ALL SELECT 'plateau', i, 0.25 FROM i UNION ALL SELECT 'spike', i, CASE WHEN i=11 THEN 3.0 ELSE 0.0 END FROM i UNION ALL SELECT 'event', i, CASE WHEN i BETWEEN 6 AND 17 THEN 1.0 ELSE 0.0 END FROM i "
       f"UNION ALL SELECT 'transition', i, CASE WHEN i<6 THEN 0.0 WHEN i<18 THEN (i-6)/11.0 ELSE 1.0 END FROM i UNION ALL SELECT 'periodic', i, sin(i*2*pi()/6) FROM i), s AS (SELECT label, CAST(i AS INT) AS i, x FROM t) SELECT s.label, s.i, {q6('x')} AS x, k.n FROM s LEFT JOIN (SELECT {case_sql('event_type', {'click': 'trend', 'view': 'plateau', 'purchase': 'event', 'signup': 'spike', 'error': 'transition'})} AS label, count(*) AS n FROM events GROUP BY 1) k ON k.label=s.label")
def _(spark, sf):
    from .base import CHUNK_OF
    n = table(spark, sf, "events").groupBy(case_col("event_type", CHUNK_OF).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    d = P.default_support(spark).select("label", F.posexplode("v").alias("i", "x")).withColumn("x", r6("x"))
    return d.join(n, "label", "left")
