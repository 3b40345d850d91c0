"""Framed operators, boundary proposal, interval operators."""

from pyspark.sql import functions as F

from seriesforge.operators import boundaries as B
from seriesforge.operators import layout as L
from seriesforge.operators import windows as X
from seriesforge.operators.stats import smooth_same

from .base import DAILY, LENS, PTS, SEGS, SP, blocks, daily, lengths, points, q6, query, r6, seg_points, segs_sql

WS = "PARTITION BY series_id ORDER BY t"


@query("w01_rolling_mean", f"WITH {DAILY} SELECT series_id, t, {q6(f'avg(value) OVER ({WS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} AS smooth FROM daily")
def _(spark, sf):
    return X.rolling_mean(daily(spark, sf), 5).select("series_id", "t", r6("smooth").alias("smooth"))


ZS = (f"zz AS (SELECT series_id, t, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM daily WINDOW w AS ({WS} "
      "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))")


@query("w02_local_zscore", f"WITH {DAILY}, {ZS} SELECT series_id, t, {q6('(value-m)/CASE WHEN s>1e-8 THEN s ELSE 1.0 END')} AS zscore FROM zz WHERE t > 0")
def _(spark, sf):
    return X.local_zscore(daily(spark, sf), 10).where("t > 0").select("series_id", "t", r6("zscore").alias("zscore"))


# Every seventh value counts as missing.
MISS = PTS + ", ms AS (SELECT series_id, t, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM pts)"


def gappy(spark, sf):
    return points(spark, sf, "event_id").select("series_id", "t", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


FEAT = f"""{MISS}, r AS (SELECT series_id, t, coalesce(value, 0.0) AS raw, CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END AS missing FROM ms),
 ft AS (SELECT *, avg(raw) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smooth, coalesce(raw - lag(raw) OVER w, 0.0) AS delta,
 avg(raw) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, stddev_pop(raw) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s
 FROM r WINDOW w AS ({WS})), fx AS (SELECT *, (raw-m)/CASE WHEN s>1e-8 THEN s ELSE 1.0 END AS zscore FROM ft)"""


@query("w03_feature_matrix", f"WITH {FEAT} SELECT series_id, t, {q6('raw')} AS raw, {q6('smooth')} AS smooth, {q6('delta')} AS delta, "
       f"CASE WHEN t = 0 THEN 0.0 ELSE {q6('zscore')} END AS zscore, missing::DOUBLE AS missing FROM fx")
def _(spark, sf):
    return X.feature_columns(gappy(spark, sf)).select(
        "series_id", "t", r6("raw").alias("raw"), r6("smooth").alias("smooth"), r6("delta").alias("delta"),
        F.when(F.col("t") == 0, 0.0).otherwise(r6("zscore")).alias("zscore"), "missing")


@query("u04_feature_union", f"WITH {FEAT}, un AS (SELECT series_id, t, 'raw' AS feature, raw AS value FROM fx UNION ALL SELECT series_id, t, 'smooth', smooth FROM fx "
       "UNION ALL SELECT series_id, t, 'delta', delta FROM fx UNION ALL SELECT series_id, t, 'zscore', CASE WHEN t=0 THEN 0.0 ELSE zscore END FROM fx UNION ALL "
       f"SELECT series_id, t, 'missing', missing FROM fx) SELECT series_id, t, feature, {q6('value')} AS value FROM un")
def _(spark, sf):
    f = X.feature_long(gappy(spark, sf))
    v = F.when((F.col("feature") == "zscore") & (F.col("t") == 0), 0.0).otherwise(F.col("value"))
    return f.select("series_id", "t", "feature", r6(v).alias("value"))


RATIO = (f"en AS (SELECT series_id, t, avg(value*value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / greatest(avg(value*value) OVER "
         f"(w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 1e-12) AS ratio FROM daily WINDOW w AS ({WS}))")


@query("w04_sta_lta", f"WITH {DAILY}, {RATIO} SELECT series_id, coalesce(min(CASE WHEN ratio >= 1.6 THEN t END), -1) AS trigger_index, "
       f"{q6('max(ratio)')} AS ratio_max FROM en GROUP BY 1")
def _(spark, sf):
    return X.sta_lta_triggers(daily(spark, sf), 3, 30, 1.6).withColumn("ratio_max", r6("ratio_max"))


@query("w05_keogh_envelope", f"WITH {DAILY} SELECT series_id, t, {q6(f'max(value) OVER ({WS} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)')} AS upper, "
       f"{q6(f'min(value) OVER ({WS} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)')} AS lower FROM daily")
def _(spark, sf):
    return X.keogh_envelope(daily(spark, sf), 12).select("series_id", "t", r6("upper").alias("upper"), r6("lower").alias("lower"))


HAMPEL = """hm AS (SELECT a.series_id, a.t, a.value, median(b.value) AS med FROM {src} a JOIN {src} b ON a.series_id=b.series_id AND b.t BETWEEN a.t-3 AND a.t+3 GROUP BY 1,2,3),
 ha AS (SELECT a.series_id, a.t, a.value, a.med, median(abs(b.value-a.med)) AS mad FROM hm a JOIN {src} b ON a.series_id=b.series_id AND b.t BETWEEN a.t-3 AND a.t+3 GROUP BY 1,2,3,4),
 hf AS (SELECT series_id, t, CASE WHEN abs(value-med) > 3*1.4826*mad THEN med ELSE value END AS filtered FROM ha)"""


@query("w06_hampel_filter", f"WITH {PTS}, {HAMPEL.format(src='pts')} SELECT series_id, t, {q6('filtered')} AS filtered FROM hf")
def _(spark, sf):
    return X.hampel(points(spark, sf)).select("series_id", "t", r6("filtered").alias("filtered"))


SC = f"""bs AS (SELECT series_id, stddev_pop(value) AS sd, count(*) AS n FROM pts GROUP BY 1),
 fr AS (SELECT p.series_id, p.t AS b, n, sd, {{win}}
 FROM pts p JOIN bs USING (series_id) WINDOW w AS (PARTITION BY p.series_id ORDER BY t)),
 rw AS (SELECT series_id, b - 1 AS t, n, CASE WHEN n >= 10 AND b BETWEEN 5 AND n-5 THEN (abs(mr-ml) + 0.5*abs(coalesce(sr,0)-coalesce(sl,0)))/CASE WHEN sd>1e-6 THEN sd ELSE 1 END ELSE 0.0 END AS raw FROM fr),
 tp AS (SELECT series_id, max(raw) AS top FROM rw GROUP BY 1),
 bsc AS (SELECT series_id, t, n, CASE WHEN top>0 THEN raw/top ELSE raw END AS score FROM rw JOIN tp USING (series_id) WHERE t>=0 UNION ALL
 SELECT series_id, n-1, n, 0.0 FROM bs)""".format(win="""avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS mr, avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS ml,
 regr_slope(value, t) OVER (w ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS sr, regr_slope(value, t) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sl""")


@query("w07_boundary_scores", f"WITH {PTS}, {SC} SELECT series_id, CAST(t AS INT) AS t, {q6('score')} AS score FROM bsc")
def _(spark, sf):
    return X.boundary_scores(points(spark, sf)).select("series_id", "t", r6("score").alias("score"))


@query("w08_local_maxima", f"WITH {PTS}, {SC}, lm AS (SELECT *, max(score) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS mx FROM bsc) "
       f"SELECT series_id, CAST(t AS INT) AS t, {q6('score')} AS score FROM lm WHERE score>=0.4 AND score>=mx AND t>=10 AND t<n-10")
def _(spark, sf):
    s = X.boundary_scores(points(spark, sf)).select("series_id", "t", "score")
    return X.local_maxima(s, "score", 0.4, 10).select("series_id", "t", r6("score").alias("score"))


@query("w09_smoothed_scores", f"WITH {PTS}, {SC}, k AS (SELECT o, exp(-0.5*(o/2.0)*(o/2.0)) AS w0 FROM range(-8, 9) r(o)), kn AS (SELECT o, w0/(SELECT sum(w0) FROM k) AS w FROM k), "
       f"cv AS (SELECT a.series_id, a.t, sum(b.score*w) AS u FROM bsc a JOIN kn ON true JOIN bsc b ON a.series_id=b.series_id AND b.t=a.t-o GROUP BY 1,2) "
       f"SELECT series_id, CAST(t AS INT) AS t, {q6('greatest(0.0, least(1.0, u))')} AS uncertainty FROM cv")
def _(spark, sf):
    s = X.boundary_scores(points(spark, sf)).select("series_id", "t", "score")
    return X.smooth_boundary_scores(s).select("series_id", "t", r6("uncertainty").alias("uncertainty"))


@query("w10_moving_average_same", f"WITH {SP} SELECT series_id, segment_id, t, {q6('sum(value) OVER (PARTITION BY series_id, segment_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5')} AS smoothed FROM sp")
def _(spark, sf):
    return smooth_same(seg_points(spark, sf), 5).select("series_id", "segment_id", "t", r6("smoothed").alias("smoothed"))


RUNS = """rn AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY series_id ORDER BY t) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS c FROM pts),
 rs AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY t) AS run FROM rn),
 runs AS (SELECT series_id, CAST(run AS INT) AS run, min(t) AS start_index, max(t) AS end_index, min(event_type) AS label FROM rs GROUP BY 1,2)"""


def runs(spark, sf):
    return L.tile_runs(points(spark, sf, "event_type").withColumnRenamed("event_type", "label"))


@query("w11_label_runs", f"WITH {PTS}, {RUNS} SELECT series_id, start_index, end_index, label FROM runs")
def _(spark, sf):
    return runs(spark, sf)


@query("w12_segments_from_boundaries", f"WITH {PTS}, {LENS}, {RUNS}, b AS (SELECT series_id, start_index FROM runs) SELECT series_id, 'segment-' || lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') AS segment_id, "
       "start_index, CAST(coalesce(lead(start_index) OVER w - 1, series_length - 1) AS INT) AS end_index FROM b JOIN lens USING (series_id) WINDOW w AS (PARTITION BY b.series_id ORDER BY start_index)")
def _(spark, sf):
    b = runs(spark, sf).where("start_index > 0").select("series_id", F.col("start_index").alias("boundary"))
    return L.boundaries_to_segments(b, lengths(points(spark, sf)))


@query("w14_contiguity", f"WITH {PTS}, {LENS}, {SEGS}, bad AS (SELECT * FROM segs WHERE NOT (series_id % 3 = 0 AND segment_id = 1)), k AS (SELECT *, coalesce(lag(end_index) OVER (PARTITION BY series_id ORDER BY start_index), -1) AS pe FROM bad) "
       "SELECT series_id, CAST(sum(CASE WHEN pe+1<>start_index OR end_index<start_index THEN 1 ELSE 0 END) AS BIGINT) AS violations, max(end_index) AS last_index, count(*) AS n_segments, min(series_length) AS series_length, "
       "sum(CASE WHEN pe+1<>start_index THEN 1 ELSE 0 END)=0 AND max(end_index)=min(series_length)-1 AS covers FROM k JOIN lens USING (series_id) GROUP BY 1")
def _(spark, sf):
    b = blocks(spark, sf).where("not (series_id % 3 = 0 and segment_id = 1)")
    return L.contiguity(b, lengths(points(spark, sf)))


@query("w16_label_expansion", f"WITH {PTS}, {SEGS} SELECT p.series_id, p.t, s.label FROM pts p JOIN segs s ON p.series_id=s.series_id AND p.t BETWEEN start_index AND end_index")
def _(spark, sf):
    return L.expand_labels(blocks(spark, sf)).select("series_id", "t", "label")


@query("w19_boundary_shift", f"WITH {PTS}, {RUNS}, sd AS (SELECT series_id, stddev_pop(value) AS s FROM pts GROUP BY 1), m AS (SELECT series_id, t, abs(avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) - "
       f"avg(value) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS d FROM pts WINDOW w AS ({WS})) SELECT m.series_id, m.t AS boundary, {q6('least(1.0, d/(s+1e-8))')} AS score FROM m JOIN runs r ON m.series_id=r.series_id AND m.t=r.start_index JOIN sd ON sd.series_id=m.series_id WHERE m.t>0")
def _(spark, sf):
    b = runs(spark, sf).where("start_index > 0").select("series_id", F.col("start_index").alias("boundary"))
    return X.shift_scores(points(spark, sf), b, 10).select("series_id", "boundary", r6("score").alias("score"))


GREEDY = """cand0 AS (SELECT series_id, t+1 AS b, score, lag(score) OVER w AS p, lead(score) OVER w AS q FROM bsc WINDOW w AS (PARTITION BY series_id ORDER BY t)),
 cand AS (SELECT series_id, b, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, b) AS rn FROM cand0 WHERE score>=0.35 AND score>=p AND score>=q),
 gr AS (SELECT DISTINCT series_id, 0 AS i, []::BIGINT[] AS sel FROM cand UNION ALL SELECT g.series_id, g.i+1, CASE WHEN len(sel)<8 AND len(list_filter(sel, lambda x: abs(x-b)<5))=0 THEN list_append(sel, b) ELSE sel END
 FROM gr g JOIN cand c ON c.series_id=g.series_id AND c.rn=g.i+1),
 fin AS (SELECT series_id, unnest(arg_max(sel, i)) AS b FROM gr GROUP BY 1)"""


@query("k01_candidate_boundaries", f"WITH RECURSIVE {PTS}, {SC}, {GREEDY} SELECT f.series_id, CAST(f.b AS INT) AS boundary, {q6('score')} AS score FROM fin f JOIN cand USING (series_id, b)")
def _(spark, sf):
    s = X.boundary_scores(points(spark, sf)).select("series_id", "t", "score")
    return B.candidate_boundaries(s).select("series_id", "boundary", r6("score").alias("score"))


@query("g02_window_proposer", f"WITH RECURSIVE {PTS}, {LENS}, {SC}, {GREEDY}, bb AS (SELECT series_id, CAST(b AS INT) AS s FROM fin UNION ALL SELECT series_id, 0 FROM lens) SELECT series_id, 'segment-' || lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') AS segment_id, "
       "s AS start_index, CAST(coalesce(lead(s) OVER w - 1, series_length-1) AS INT) AS end_index FROM bb JOIN lens USING (series_id) WINDOW w AS (PARTITION BY bb.series_id ORDER BY s)")
def _(spark, sf):
    return B.propose(points(spark, sf))[2]


@query("k03_strongest_points", f"WITH {PTS}, {SC}, r AS (SELECT series_id, t, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, t) AS rn FROM bsc) SELECT series_id, CAST(t AS INT) AS boundary, {q6('score')} AS score FROM r WHERE rn<=4")
def _(spark, sf):
    s = X.boundary_scores(points(spark, sf)).select("series_id", F.col("t").alias("boundary"), "score")
    return B.strongest(s, 4).select("series_id", "boundary", r6("score").alias("score"))


@query("k06_onset_candidates", f"""WITH RECURSIVE {PTS}, cand AS (SELECT series_id, t AS b, row_number() OVER (PARTITION BY series_id ORDER BY d DESC, t) AS rn FROM
 (SELECT series_id, t, coalesce(abs(lead(value) OVER ({WS}) - value), abs(value - lag(value) OVER ({WS}))) AS d FROM pts)),
 gr AS (SELECT DISTINCT series_id, 0 AS i, []::BIGINT[] AS sel FROM cand UNION ALL SELECT g.series_id, g.i+1, CASE WHEN len(sel)<6 AND len(list_filter(sel, lambda x: abs(x-b)<4))=0 THEN list_append(sel, b) ELSE sel END
 FROM gr g JOIN cand c ON c.series_id=g.series_id AND c.rn=g.i+1),
 fin AS (SELECT series_id, unnest(arg_max(sel, i)) AS b FROM gr GROUP BY 1) SELECT series_id, CAST(b AS INT) AS t_ref FROM fin UNION SELECT series_id, min(t) FROM pts GROUP BY 1 UNION SELECT series_id, max(t) FROM pts GROUP BY 1""")
def _(spark, sf):
    return B.onset_candidates(points(spark, sf), 6, 4)


@query("w18_cross_match_profile")
def _(spark, sf):
    return B.cross_match_profile(points(spark, sf), 5)


@query("k02_binary_segmentation")
def _(spark, sf):
    s = X.boundary_scores(points(spark, sf)).select("series_id", "t", F.col("score").alias("profile"))
    return B.binary_segmentation(s, 4, 8)


@query("g03_cross_match_proposer")
def _(spark, sf):
    return B.binary_segmentation(B.cross_match_profile(points(spark, sf), 5), 4, 10)


@query("g04_penalised_change_points")
def _(spark, sf):
    return B.penalised_splits(daily(spark, sf), 4, 10, 0.5)


@query("g05_online_change_probability")
def _(spark, sf):
    return B.change_probabilities(points(spark, sf))
