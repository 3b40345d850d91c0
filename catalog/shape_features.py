"""Shape features, classifier, metrics, two-sample statistics."""

from pyspark.sql import functions as F

from seriesforge import config as C
from seriesforge.functions import vectors as V
from seriesforge.operators import edits as E
from seriesforge.operators import metrics as M
from seriesforge.operators import shapes as H
from seriesforge.operators import stats as ST

from .base import DAILY, PTS, SEGS, SHAPE_OF, SP, blocks, daily, points, q6, query, r6, seg_points, segs_sql, table
from .editing import BW, fr, seg

FB = f"""{SP}, {SEGS}, fb AS (SELECT s.series_id, s.segment_id, list(p.value ORDER BY t) FILTER (t BETWEEN start_index AND end_index) AS v, coalesce(list(p.value ORDER BY t) FILTER (t<start_index), []) AS pre, coalesce(list(p.value ORDER BY t) FILTER (t>end_index), []) AS post
 FROM segs s JOIN pts p ON p.series_id=s.series_id AND p.t BETWEEN start_index-10 AND end_index+10 GROUP BY 1,2), f0 AS (SELECT *, len(v) AS n, list_concat(pre, post) AS ctx, list_avg(v) AS m, coalesce(list_stddev_pop(v), 0) AS sd FROM fb)"""
UX = "ux AS (SELECT series_id, segment_id, n, m, unnest(v) AS x, generate_subscripts(v, 1)-1 AS i FROM f0)"
TS = "ts AS (SELECT a.series_id, a.segment_id, median((b.x-a.x)/(b.i-a.i)) AS slope FROM ux a JOIN ux b ON a.series_id=b.series_id AND a.segment_id=b.segment_id AND a.i<b.i GROUP BY 1,2)"
DF = "dfs AS (SELECT series_id, segment_id, x - lag(x) OVER (PARTITION BY series_id, segment_id ORDER BY i) AS d FROM ux), sg AS (SELECT series_id, segment_id, greatest(avg((d>0)::INT), avg((d<0)::INT)) AS sign FROM dfs WHERE d IS NOT NULL GROUP BY 1,2)"
LIN = "lf AS (SELECT series_id, segment_id, regr_slope(x,i) AS b, regr_intercept(x,i) AS a FROM ux WHERE n>1 GROUP BY 1,2), ln AS (SELECT ux.series_id, ux.segment_id, CASE WHEN max(sd)<1e-8 THEN 0 ELSE avg(abs(x-a-b*i))/max(sd) END AS lin FROM ux JOIN lf USING (series_id, segment_id) JOIN f0 USING (series_id, segment_id) GROUP BY 1,2)"
PW = "pw AS (SELECT series_id, segment_id, n, k, power(sum((x-m)*cos(2*pi()*k*i/n)),2)+power(sum((x-m)*sin(2*pi()*k*i/n)),2) AS p FROM ux, range(1, 9) r(k) WHERE n>=4 AND k<=n//2 GROUP BY 1,2,3,4), sp1 AS (SELECT series_id, segment_id, n, least(1.0, max(p)/(sum(p)+1e-10)) AS fft_peak, n/arg_max(k, p) AS period, sum(p) AS tp FROM pw GROUP BY 1,2,3)"
AC = "ac AS (SELECT a.series_id, a.segment_id, a.n, b.i-a.i AS lag, sum((a.x-a.m)*(b.x-b.m)) AS c FROM ux a JOIN ux b ON a.series_id=b.series_id AND a.segment_id=b.segment_id AND b.i>=a.i GROUP BY 1,2,3,4), an AS (SELECT ac.*, c/max(CASE WHEN lag=0 THEN c END) OVER (PARTITION BY series_id, segment_id) AS r FROM ac), ap AS (SELECT series_id, segment_id, greatest(0.0, least(1.0, max(r) FILTER (lag BETWEEN 1 AND n//2))) AS acf_peak, coalesce(min(lag) FILTER (lag>0 AND r<exp(-1)), max(n)) AS f1e FROM an WHERE n>=4 GROUP BY 1,2)"
KEY = "series_id, segment_id"


@query("a09_theil_sen", f"WITH {FB}, {UX}, {TS}, {DF} SELECT {KEY}, {q6('slope')} AS slope, {q6('sign')} AS sign FROM ts JOIN sg USING (series_id, segment_id)")
def _(spark, sf):
    s = seg(spark, sf).where(F.size("v") > 1)
    return s.select("series_id", "segment_id", r6(H.theil_sen(F.col("v"))).alias("slope"), r6(H.sign_share(F.col("v"))).alias("sign"))


SAMP = "hk AS (SELECT k, ((k*1103515245+12345)%2147483648)//7 AS h1, ((k*22695477+1)%2147483648)//11 AS h2 FROM range(200) r(k))"


@query("a09_theil_sen_sampled", f"WITH {DAILY}, bl AS (SELECT series_id, t//100 AS segment_id, list(value ORDER BY t) AS v FROM daily GROUP BY 1,2), {SAMP}, sl AS (SELECT series_id, segment_id, v[CAST(h2%len(v) AS INT)+1]-v[CAST(h1%len(v) AS INT)+1] AS dy, h2%len(v)-h1%len(v) AS dx FROM bl, hk) "
       f"SELECT series_id, CAST(segment_id AS INT) AS segment_id, {q6('median(dy/dx)')} AS slope FROM sl WHERE dx<>0 GROUP BY 1,2")
def _(spark, sf):
    d = daily(spark, sf).withColumn("segment_id", F.floor(F.col("t") / 100).cast("int"))
    return ST.values(d).select("series_id", "segment_id", r6(H.theil_sen(F.col("v"))).alias("slope"))


@query("a10_line_ratio", f"WITH {FB}, {UX}, {LIN} SELECT {KEY}, {q6('lin')} AS lin FROM ln")
def _(spark, sf):
    return seg(spark, sf).where(F.size("v") > 1).select("series_id", "segment_id", r6(H.line_ratio(F.col("v"))).alias("lin"))


@query("a11_spectral_peaks", f"WITH {FB}, {UX}, {PW}, {AC} SELECT {KEY}, {q6('fft_peak')} AS fft_peak, {q6('acf_peak')} AS acf_peak FROM sp1 JOIN ap USING (series_id, segment_id)")
def _(spark, sf):
    s = seg(spark, sf).where(F.size("v") >= 4).withColumn("p", H.power(F.col("v")))
    return s.select("series_id", "segment_id", r6(H.power_share(F.col("p"))).alias("fft_peak"), r6(H.acf_peak(F.col("v"))).alias("acf_peak"))


@query("a12_dominant_period", f"WITH {FB}, {UX}, {PW} SELECT {KEY}, {q6('period')} AS period FROM sp1")
def _(spark, sf):
    s = seg(spark, sf).where(F.size("v") >= 4)
    return s.select("series_id", "segment_id", r6(H.dominant_period(F.col("v"))).alias("period"))


@query("a13_dominant_period_list", f"""WITH {DAILY}, c AS (SELECT series_id, t, value-avg(value) OVER (PARTITION BY series_id) AS x, CAST(count(*) OVER (PARTITION BY series_id) AS INT) AS n FROM daily),
 p AS (SELECT series_id, n, k, power(sum(x*cos(2*pi()*k*t/n)),2)+power(sum(x*sin(2*pi()*k*t/n)),2) AS p FROM c, range(1, 2000) r(k) WHERE n/k>=2 AND n/k<=n//2 GROUP BY 1,2,3), tp AS (SELECT *, max(p) OVER (PARTITION BY series_id) AS mx FROM p), cd AS (SELECT series_id, n, CAST(round_even(n/k, 0) AS INT) AS t, max(p) AS p FROM tp WHERE p>=0.1*mx GROUP BY 1,2,3),
 rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p DESC) AS rn FROM cd), tc AS (SELECT * FROM rk WHERE rn<=5), lg AS (SELECT series_id, least(max(n)//2, max(t)+10) AS ml FROM tc GROUP BY 1),
 ac AS (SELECT a.series_id, b.t-a.t AS lag, sum(a.x*b.x) AS c FROM c a JOIN c b ON a.series_id=b.series_id AND b.t>=a.t AND b.t-a.t<=a.n//2 GROUP BY 1,2), an AS (SELECT series_id, lag, c/max(CASE WHEN lag=0 THEN c END) OVER (PARTITION BY series_id) AS r FROM ac),
 bs AS (SELECT tc.series_id, tc.t, arg_max(lag, r) AS b, max(r) AS r FROM tc JOIN lg USING (series_id) JOIN an ON an.series_id=tc.series_id AND lag BETWEEN greatest(2, tc.t-5) AND least(ml, tc.t+5) GROUP BY 1,2),
 ok AS (SELECT DISTINCT series_id, CAST(b AS INT) AS period FROM bs WHERE r>0.1) SELECT * FROM ok UNION SELECT series_id, t FROM tc WHERE rn=1 AND series_id NOT IN (SELECT series_id FROM ok)""")
def _(spark, sf):
    # The list is a segment feature; here each daily series is one segment.
    d = daily(spark, sf).withColumn("segment_id", F.lit(0))
    return ST.values(d).select("series_id", F.explode(H.dominant_periods(F.col("v"))).alias("period"))


PK = "pk AS (SELECT *, CASE WHEN len(ctx)>0 THEN list_avg(ctx) ELSE list_median(v) END AS ref FROM f0), pz AS (SELECT series_id, segment_id, CASE WHEN sd<1e-8 THEN 0 ELSE list_max(list_transform(v, lambda x: abs(x-ref)))/sd END AS z_max, CASE WHEN sd<1e-8 THEN 0 ELSE len(list_filter(v, lambda x: x>ref+sd))/n END AS peak_width FROM pk)"


@query("a14_peak_z", f"WITH {FB}, {PK} SELECT {KEY}, {q6('z_max')} AS z_max, {q6('peak_width')} AS peak_width FROM pz")
def _(spark, sf):
    f = fr(spark, sf).withColumn("p", H.peak_z(F.col("v"), F.concat("pre", "post")))
    return f.select("series_id", "segment_id", r6("p.z").alias("z_max"), r6("p.width").alias("peak_width"))


STP = "st AS (SELECT series_id, segment_id, CASE WHEN len(pre)>0 AND len(post)>0 THEN list_avg(post)-list_avg(pre) WHEN n//2<1 OR n//2>=n-1 THEN 0 ELSE list_avg(v[n//2+1:n])-list_avg(v[1:n//2]) END AS step, CASE WHEN n<4 THEN 1.0 WHEN sd*sd<1e-8 THEN 0 ELSE least(1.0, (list_var_pop(v[1:n//2])+list_var_pop(v[n//2+1:n]))/2/(sd*sd)) END AS trans, CASE WHEN len(ctx)=0 THEN 0 ELSE list_max(list_transform(v, lambda x: abs(x-list_avg(ctx))))/CASE WHEN len(ctx)<2 OR list_stddev_pop(ctx)<1e-8 THEN 1.0 ELSE list_stddev_pop(ctx) END END AS ctx_peak FROM f0)"


@query("a15_step_magnitude", f"WITH {FB}, {STP} SELECT {KEY}, {q6('step')} AS step FROM st")
def _(spark, sf):
    f = fr(spark, sf)
    return f.select("series_id", "segment_id", r6(H.step_magnitude(F.col("v"), F.col("pre"), F.col("post"))).alias("step"))


@query("a16_transition_share", f"WITH {FB}, {STP} SELECT {KEY}, {q6('trans')} AS trans FROM st")
def _(spark, sf):
    return seg(spark, sf).select("series_id", "segment_id", r6(H.transition_share(F.col("v"))).alias("trans"))


@query("a17_context_peak", f"WITH {FB}, {STP} SELECT {KEY}, {q6('ctx_peak')} AS ctx_peak FROM st")
def _(spark, sf):
    return fr(spark, sf).select("series_id", "segment_id", r6(H.context_peak(F.col("v"), F.concat("pre", "post"))).alias("ctx_peak"))


BMP = """b0 AS (SELECT series_id, segment_id, n, list_transform(v, lambda x: x-(v[1]+v[n])/2) AS c FROM f0 WHERE n>=4), b1 AS (SELECT series_id, segment_id, n, list_transform(c, lambda x: x/greatest(abs(list_max(c)), abs(list_min(c)))) AS z FROM b0), b2 AS (SELECT *, list_position(list_transform(z, lambda x: round(abs(x),12)), list_max(list_transform(z, lambda x: round(abs(x),12))))-1 AS k FROM b1),
 b3 AS (SELECT series_id, segment_id, n, k, z[n] AS ev, unnest(z) AS z, generate_subscripts(z, 1)-1 AS i FROM b2), b4 AS (SELECT *, z-lag(z) OVER w AS d, abs(z)-abs(lag(z) OVER w) AS da FROM b3 WINDOW w AS (PARTITION BY series_id, segment_id ORDER BY i)),
 bp AS (SELECT series_id, segment_id, CASE WHEN k<n//4 OR k>3*n//4 OR abs(ev)>0.5 THEN 0 ELSE coalesce(avg((d>=-0.1)::INT) FILTER (i>=1 AND i<=k), 1)*coalesce(avg((da<=0.1)::INT) FILTER (i>k), 1) END AS bump FROM b4 GROUP BY series_id, segment_id, k, n, ev)"""


@query("a18_bump", f"WITH {FB}, {BMP} SELECT {KEY}, {q6('bump')} AS bump FROM bp")
def _(spark, sf):
    return seg(spark, sf).where(F.size("v") >= 4).select("series_id", "segment_id", r6(H.bump(F.col("v"))).alias("bump"))


SYM = """hm0 AS (SELECT series_id, segment_id, least(floor((x-mn)/((mx-mn)/5)), 4) AS b, mn, (mx-mn)/5 AS w, count(*) AS c FROM (SELECT *, min(x) OVER q AS mn, max(x) OVER q AS mx FROM ux WINDOW q AS (PARTITION BY series_id, segment_id)) WHERE mx>mn GROUP BY 1,2,3,4,5),
 hm1 AS (SELECT *, max(c) OVER (PARTITION BY series_id, segment_id) AS mc FROM hm0), hm AS (SELECT series_id, segment_id, avg(mn+w*(b+0.5)) AS hist_mode FROM hm1 WHERE c=mc GROUP BY 1,2),
 qs AS (SELECT *, list_sort(v) AS s FROM f0), qt AS (SELECT series_id, segment_id, s[CAST(floor(n/3.0-0.5) AS INT)+1] + (s[CAST(least(floor(n/3.0-0.5)+1, n-1) AS INT)+1]-s[CAST(floor(n/3.0-0.5) AS INT)+1])*(n/3.0-0.5-floor(n/3.0-0.5)) AS a, s[CAST(floor(2*n/3.0-0.5) AS INT)+1] + (s[CAST(least(floor(2*n/3.0-0.5)+1, n-1) AS INT)+1]-s[CAST(floor(2*n/3.0-0.5) AS INT)+1])*(2*n/3.0-0.5-floor(2*n/3.0-0.5)) AS b FROM qs WHERE n>3),
 sy AS (SELECT ux.series_id, ux.segment_id, i, CASE WHEN x<=a THEN 0 WHEN x<=b THEN 1 ELSE 2 END AS y FROM ux JOIN qt USING (series_id, segment_id)), wd AS (SELECT series_id, segment_id, y*3 + lead(y) OVER (PARTITION BY series_id, segment_id ORDER BY i) AS w FROM sy), wc AS (SELECT series_id, segment_id, w, count(*) AS c FROM wd WHERE w IS NOT NULL GROUP BY 1,2,3), mo AS (SELECT series_id, segment_id, -sum(c/t*ln(c/t)) AS motif FROM (SELECT *, sum(c) OVER (PARTITION BY series_id, segment_id) AS t FROM wc) GROUP BY 1,2)"""


@query("a19_symbol_features", f"WITH {FB}, {UX}, {AC}, {SYM} SELECT {KEY}, f1e::DOUBLE AS f1e, {q6('hist_mode')} AS hist_mode, {q6('motif')} AS motif FROM ap JOIN hm USING (series_id, segment_id) JOIN mo USING (series_id, segment_id)")
def _(spark, sf):
    s = seg(spark, sf).where(F.size("v") > 3)
    return s.select("series_id", "segment_id", H.first_decay_lag(F.col("v")).alias("f1e"), r6(H.histogram_mode(F.col("v"))).alias("hist_mode"), r6(H.pair_entropy(F.col("v"))).alias("motif"))


def sa(x, th, k):
    return f"(1/(1+exp(-{k}*(({x})-{th}))))"


def sb(x, th, k):
    return f"(1/(1+exp(-{k}*({th}-({x})))))"


GATE = f"""ft AS (SELECT f0.series_id, f0.segment_id, n, slope*(n-1)/(list_max(v)-list_min(v)+1e-8) AS sr, sd*sd AS var, sign, lin, acf_peak, period, z_max, step, trans, ctx_peak, bump, motif, f1e, hist_mode FROM f0 JOIN ts USING ({KEY}) JOIN sg USING ({KEY}) JOIN ln USING ({KEY}) JOIN ap USING ({KEY}) JOIN (SELECT {KEY}, period FROM sp1) USING ({KEY}) JOIN pz USING ({KEY}) JOIN st USING ({KEY}) JOIN bp USING ({KEY}) JOIN hm USING ({KEY}) JOIN mo USING ({KEY}) WHERE n>3),
 gt AS (SELECT *, [{sb('abs(sr)', 0.5, 20)}*{sb('var', 0.02, 30)}*(1-{sa('acf_peak', 0.55, 10)}), {sa('abs(sr)', 0.5, 20)}*{sa('sign', 0.65, 15)}*{sb('lin', 0.12, 20)}, {sa('abs(step)', 0.4, 10)}*{sb('trans', 0.3, 15)}, {sb('n', 20, 0.5)}*{sa('z_max', 2.5, 2)}*{sa('ctx_peak', 0.35, 10)},
 {sa('acf_peak', 0.55, 10)}*CASE WHEN period>0 THEN CASE WHEN n>=2*period THEN 1.0 ELSE greatest(0.0, least(1.0, n/(2*period))) END ELSE 0 END, bump*(0.5+0.5*least(1.0, abs(motif)/5)), (1-greatest(0.0, least(1.0, f1e)))*(1-least(1.0, abs(hist_mode)/3))] AS q FROM ft),
 gl AS (SELECT *, ['{"','".join(C.SHAPES)}'][list_position(q, list_max(q))] AS shape, 1/list_sum(list_transform(q, lambda x: exp(x-list_max(q)))) AS confidence, list_reverse_sort(q) AS rq FROM gt)"""
ALLF = f"{FB}, {UX}, {TS}, {DF}, {LIN}, {PW}, {AC}, {PK}, {STP}, {BMP}, {SYM}, {GATE}"


@query("g01_shape_classifier", f"WITH {ALLF} SELECT {KEY}, shape, {q6('confidence')} AS confidence, rq[1]-rq[2] < 0.15 AS uncertain FROM gl")
def _(spark, sf):
    c = H.classify(fr(spark, sf).where(F.size("v") > 3))
    return c.select("series_id", "segment_id", "shape", r6("confidence").alias("confidence"), "uncertain")


@query("l01_relabel_with_classifier", f"""WITH {ALLF}, rc AS (SELECT gl.series_id || '-' || gl.segment_id AS edit_id, ['split','scale','mute_zero'][CAST(gl.segment_id%3 AS INT)+1] AS op_name, CASE WHEN s.event_type='click' THEN 'trend' WHEN s.event_type='view' THEN 'plateau' WHEN s.event_type='purchase' THEN 'cycle' WHEN s.event_type='signup' THEN 'spike' ELSE 'step' END AS old_shape, shape, confidence FROM gl JOIN sp s ON s.series_id=gl.series_id AND s.segment_id=gl.segment_id AND s.pos=0)
 SELECT edit_id, op_name, CASE op_name WHEN 'split' THEN shape WHEN 'scale' THEN old_shape ELSE 'plateau' END AS new_shape, {q6("CASE op_name WHEN 'split' THEN confidence ELSE 1.0 END")} AS confidence, CASE op_name WHEN 'split' THEN 'RECLASSIFY_VIA_SEGMENTER' WHEN 'scale' THEN 'PRESERVED' ELSE 'DETERMINISTIC' END AS rule_class FROM rc""")
def _(spark, sf):
    from seriesforge.operators import relabel as R
    f = E.frames(points(spark, sf), blocks(spark, sf, labels=SHAPE_OF)).where(F.size("v") > 3)
    ops = F.array(*[F.lit(x) for x in ("split", "scale", "mute_zero")])
    f = f.withColumns({"edit_id": F.concat_ws("-", "series_id", "segment_id"), "op_name": F.get(ops, (F.col("segment_id") % 3).cast("int")), "old_shape": F.col("label")})
    # Only edits of the re-classify class reach the classifier.
    again = H.classify(f.where("op_name = 'split'")).select("edit_id", F.col("shape").alias("label"), "confidence")
    ed = f.select("edit_id", "op_name", "old_shape", F.lit(1.0).alias("alpha"))
    return R.relabel(ed, again).select("edit_id", "op_name", "new_shape", r6("confidence").alias("confidence"), "rule_class")


@query("a32_threshold_calibration", f"WITH {FB}, lb AS (SELECT f0.*, label FROM f0 JOIN segs USING ({KEY})), u AS (SELECT label, 'sd' AS feature, sd AS value FROM lb UNION ALL SELECT label, 'range', list_max(v)-list_min(v) FROM lb) SELECT label, feature, {q6('quantile_cont(value, 0.1)')} AS q10, {q6('quantile_cont(value, 0.9)')} AS q90, count(*) AS n FROM u GROUP BY 1,2")
def _(spark, sf):
    f = fr(spark, sf).select("label", V.vstd(F.col("v")).alias("sd"), (F.array_max("v") - F.array_min("v")).alias("range")).unpivot("label", ["sd", "range"], "feature", "value")
    return H.calibrate(f).select("label", "feature", r6("q10").alias("q10"), r6("q90").alias("q90"), "n")


# --- metrics -----------------------------------------------------------------------------

def metric(name, expr, key, where="true", **aux):
    def run(spark, sf):
        s = seg(spark, sf)
        return M.metric_table(s, [key], aux).withColumn(key, r6(key))
    query(name, f"WITH {BW}, a AS (SELECT series_id, segment_id, n, v, m FROM bw GROUP BY ALL) SELECT series_id, segment_id, {q6(expr)} AS {key} FROM a")(run)


metric("a20_peak", "list_max(v)", "peak")
metric("a20_trough", "list_min(v)", "trough")
metric("a20_amplitude", "list_max(v)-list_min(v)", "amplitude")
metric("a21_duration", "n*0.5", "duration", dt=0.5)
metric("a22_area", "CASE WHEN n>1 THEN (list_sum(v)-(v[1]+v[CAST(n AS INT)])/2)*0.5 END", "area", dt=0.5)
metric("a26_seismic_moment", "30.0*2.5*4.0", "m0", shear_modulus=30.0, fault_area=2.5, slip_from_segment=4.0)


@query("a25_season_ends", f"WITH {BW}, a AS (SELECT series_id, segment_id, i, x, min(x) OVER k + 0.2*(max(x) OVER k - min(x) OVER k) AS thr FROM bw WHERE n>1 WINDOW k AS (PARTITION BY series_id, segment_id)) SELECT series_id, segment_id, min(i) FILTER (x>=thr)::DOUBLE AS sos, max(i) FILTER (x>=thr)::DOUBLE AS eos FROM a GROUP BY 1,2")
def _(spark, sf):
    return M.metric_table(seg(spark, sf).where(F.size("v") > 1), ["sos", "eos"])


BFQ = "WITH RECURSIVE {sp}, q AS (SELECT series_id, segment_id, pos, value, 0.8*value AS b FROM sp WHERE pos=0 UNION ALL SELECT d.series_id, d.segment_id, d.pos, d.value, least((0.2*0.98*q.b+0.02*0.8*d.value)/(1-0.98*0.8), d.value) FROM q JOIN sp d ON d.series_id=q.series_id AND d.segment_id=q.segment_id AND d.pos=q.pos+1)"


@query("a24_baseflow_index", BFQ.format(sp=SP) + f" SELECT series_id, segment_id, {q6('sum(b)/sum(value)')} AS bfi FROM q GROUP BY 1,2")
def _(spark, sf):
    from seriesforge.operators.fits import baseflow_array, cmap
    s = seg(spark, sf).withColumn("components", cmap(baseflow=baseflow_array(F.col("v"))))
    return M.metric_table(s, ["bfi"]).withColumn("bfi", r6("bfi"))


@query("a27_metric_table", f"WITH {BW}, a AS (SELECT series_id, segment_id, n, v FROM bw GROUP BY ALL) SELECT series_id, segment_id, {q6('list_max(v)')} AS peak, {q6('list_min(v)')} AS trough, n::DOUBLE AS duration, {q6('CASE WHEN n>1 THEN list_sum(v)-(v[1]+v[CAST(n AS INT)])/2 END')} AS area, CAST(NULL AS DOUBLE) AS tau FROM a")
def _(spark, sf):
    t = M.metric_table(seg(spark, sf), ["peak", "trough", "duration", "area", "tau"])
    return t.withColumns({c: r6(c) for c in ("peak", "trough", "area")})


PE = "w AS (SELECT series_id, list(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS v FROM {src}), pt AS (SELECT series_id, list_grade_up(v) AS p FROM w WHERE len(v)=4), pc AS (SELECT series_id, p, count(*) AS c FROM pt GROUP BY 1,2), pp AS (SELECT series_id, c/sum(c) OVER (PARTITION BY series_id) AS q FROM pc)"


@query("a28_permutation_entropy", f"WITH {PTS}, {PE.format(src='pts')} SELECT series_id, {q6('-sum(q*ln(q))')} AS permutation_entropy FROM pp GROUP BY 1")
def _(spark, sf):
    return M.permutation_entropy(points(spark, sf)).withColumn("permutation_entropy", r6("permutation_entropy"))


BLK = """c AS (SELECT series_id, t, value-avg(value) OVER q AS x, var_pop(value) OVER q AS s, count(*) OVER q AS n FROM pts WINDOW q AS (PARTITION BY series_id)), rl AS (SELECT a.series_id, a.n, b.t-a.t AS k, sum(a.x*b.x)/(a.n*a.s) AS r FROM c a JOIN c b ON a.series_id=b.series_id AND b.t-a.t BETWEEN 1 AND 10 GROUP BY a.series_id, a.n, a.s, 3),
 m0 AS (SELECT a.series_id, min(a.k) AS mh FROM rl a JOIN rl b ON a.series_id=b.series_id AND b.k=a.k+1 WHERE abs(a.r)<2*sqrt(log10(a.n)/a.n) AND abs(b.r)<2*sqrt(log10(a.n)/a.n) GROUP BY 1), m1 AS (SELECT DISTINCT rl.series_id, n, greatest(2*coalesce(mh, 5), 2) AS mm FROM rl LEFT JOIN m0 USING (series_id)),
 gs AS (SELECT m1.series_id, m1.n, 1+sum(2*CASE WHEN k/mm<=0.5 THEN 1.0 WHEN k/mm<=1 THEN 2*(1-k/mm) ELSE 0 END*r) AS g0, sum(2*k*CASE WHEN k/mm<=0.5 THEN 1.0 WHEN k/mm<=1 THEN 2*(1-k/mm) ELSE 0 END*r) AS g1 FROM m1 JOIN rl USING (series_id) WHERE k<=mm GROUP BY 1,2),
 bl AS (SELECT series_id, CAST(CASE WHEN g0<=0 OR g1<=0 THEN greatest(1, ceil(power(n, 1/3.0))) ELSE greatest(1, ceil(power(2*g0*g0/g1, 1/3.0)*power(n, 1/3.0))) END AS INT) AS block_length FROM gs)"""


@query("a29_block_length", f"WITH {PTS}, {BLK} SELECT * FROM bl")
def _(spark, sf):
    return M.block_length(points(spark, sf))


@query("a30_gini", f"WITH k AS (SELECT user_id AS series_id, event_type, count(*) AS n FROM events GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n, event_type) AS i FROM k) SELECT series_id, {q6('2*sum(i*n)/(count(*)*sum(n)) - (count(*)+1)/count(*)')} AS gini FROM r GROUP BY 1")
def _(spark, sf):
    k = table(spark, sf, "events").groupBy(F.col("user_id").alias("series_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return M.gini(k, ["series_id"]).withColumn("gini", r6("gini"))


# Two samples per group of users: 'x' click and view events, 'y' the others, in event order.
MM = """mm AS (SELECT user_id%5 AS grp, CASE WHEN event_type IN ('click','view') THEN 'x' ELSE 'y' END AS side, event_id, value/50 AS value FROM events), mi AS (SELECT *, row_number() OVER (PARTITION BY grp, side ORDER BY event_id)-1 AS i FROM mm),
 np AS (SELECT grp, least(count(*) FILTER (side='x'), count(*) FILTER (side='y'))//2 AS k FROM mi GROUP BY 1), ms AS (SELECT mi.*, k, i + CASE WHEN side='y' THEN 2*k ELSE 0 END AS pos FROM mi JOIN np USING (grp) WHERE i<2*k), kp AS (SELECT grp, pos, value FROM ms WHERE 4*k<=500 OR floor(ceil(pos*499/(4*k-1))*(4*k-1)/499)=pos),
 bw AS (SELECT a.grp, median(abs(a.value-b.value)) AS s FROM kp a JOIN kp b ON a.grp=b.grp AND a.pos<b.pos GROUP BY 1), pr AS (SELECT grp, k, i//2 AS j, max(value) FILTER (side='x' AND i%2=0) AS xa, max(value) FILTER (side='x' AND i%2=1) AS xb, max(value) FILTER (side='y' AND i%2=0) AS ya, max(value) FILTER (side='y' AND i%2=1) AS yb FROM ms GROUP BY 1,2,3),
 hh AS (SELECT pr.grp, k, s, exp(-power(xa-xb,2)/(2*s*s))+exp(-power(ya-yb,2)/(2*s*s))-exp(-power(xa-yb,2)/(2*s*s))-exp(-power(xb-ya,2)/(2*s*s)) AS h FROM pr JOIN bw ON bw.grp=pr.grp)"""


def two_samples(spark, sf):
    from seriesforge.operators.layout import index_series
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("grp"), F.when(F.col("event_type").isin("click", "view"), "x").otherwise("y").alias("side"), "event_id", (F.col("value") / 50).alias("value"))
    return index_series(e, ["grp", "side"], ["event_id"], F.floor(F.col("event_id") / 1000), "i")


@query("a34_mmd_linear", f"WITH {MM} SELECT grp, {q6('s')} AS bandwidth, {q6('avg(h)')} AS mmd2, {q6('sqrt(var_pop(h)/k)')} AS std_err, {q6('avg(h)/greatest(sqrt(var_pop(h)/k), 1e-6)')} AS z_score, k AS n_pairs FROM hh GROUP BY grp, s, k")
def _(spark, sf):
    m = M.mmd_linear(two_samples(spark, sf), ["grp"])
    return m.select("grp", "n_pairs", *[r6(c).alias(c) for c in ("bandwidth", "mmd2", "std_err", "z_score")])


@query("a35_mmd_quadratic", f"""WITH s0 AS (SELECT user_id%5 AS grp, CASE WHEN event_type IN ('click','view') THEN 'x' ELSE 'y' END AS side, value/50 AS value, row_number() OVER (PARTITION BY user_id%5, CASE WHEN event_type IN ('click','view') THEN 'x' ELSE 'y' END ORDER BY (event_id*1103515245+12345)%2147483648) AS rn FROM events), s AS (SELECT * , row_number() OVER (ORDER BY grp, side, rn) AS id FROM s0 WHERE rn<=500),
 bw AS (SELECT a.grp, median(abs(a.value-b.value)) AS s FROM s a JOIN s b ON a.grp=b.grp AND a.id<b.id GROUP BY 1), k AS (SELECT a.grp, s, avg(exp(-power(a.value-b.value,2)/(2*s*s))) FILTER (a.side='x' AND b.side='x') + avg(exp(-power(a.value-b.value,2)/(2*s*s))) FILTER (a.side='y' AND b.side='y') - 2*avg(exp(-power(a.value-b.value,2)/(2*s*s))) FILTER (a.side='x' AND b.side='y') AS m FROM s a JOIN s b ON a.grp=b.grp JOIN bw ON bw.grp=a.grp GROUP BY 1,2)
 SELECT grp, {q6('s')} AS bandwidth, {q6('m')} AS mmd2 FROM k""")
def _(spark, sf):
    h = (F.col("event_id") * 1103515245 + 12345) % 2147483648
    m = M.mmd_quadratic(two_samples(spark, sf), ["grp"], h)
    return m.select("grp", r6("bandwidth").alias("bandwidth"), r6("mmd2").alias("mmd2"))


@query("a36_variance_ratio", f"WITH {PTS}, r AS (SELECT series_id, CASE WHEN t%2=0 THEN 'pre' ELSE 'post' END AS side, value - avg(value) OVER (PARTITION BY series_id) AS value FROM pts), g AS (SELECT series_id, sum(value*value) FILTER (side='pre') AS a, sum(value*value) FILTER (side='post') AS b, count(*) FILTER (side='pre')-1 AS df_pre, count(*) FILTER (side='post')-1 AS df_post FROM r GROUP BY 1) SELECT series_id, {q6('b/a')} AS ratio, {q6('b/a*df_pre/df_post')} AS f_statistic, df_pre, df_post FROM g")
def _(spark, sf):
    p = points(spark, sf)
    m = p.groupBy("series_id").agg(F.avg("value").alias("m"))
    r = p.join(m, "series_id").select("series_id", F.when(F.col("t") % 2 == 0, "pre").otherwise("post").alias("side"), (F.col("value") - F.col("m")).alias("value"))
    v = M.variance_ratio(r, ["series_id"])
    return v.select("series_id", r6("ratio").alias("ratio"), r6("f_statistic").alias("f_statistic"), "df_pre", "df_post")
