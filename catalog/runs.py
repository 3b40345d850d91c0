"""Composed runs, sources and sinks round trips, extension points."""

from pyspark.sql import functions as F

from seriesforge import config as C
from seriesforge import registry as G
from seriesforge.functions import vectors as V
from seriesforge.operators import edits as E
from seriesforge.operators import prototypes as P
from seriesforge.operators import windows as W
from seriesforge.plans import pipelines as L
from seriesforge.sources import datasets as S
from seriesforge.streaming.queries import scratch

from .base import CHUNK_OF, DAILY, PTS, SEGS, SHAPE_OF, SP, blocks, case_col, case_sql, points, q6, query, r6, seg_points, segs_sql, table
from .editing import BW, fr, seg
from .session_logs import AUD, chips_of, log, prepared
from .shape_features import ALLF, KEY
from .windowed import SC


@query("g06_segment_labels", f"WITH {ALLF} SELECT {KEY}, {case_sql('shape', C.SHAPE_TO_CHUNK)} AS label, {q6('round_even(confidence, 6)')} AS confidence FROM gl")
def _(spark, sf):
    d = L.label_segments(fr(spark, sf).where(F.size("v") > 3))
    return d.select("series_id", "segment_id", "label", r6("confidence").alias("confidence"))


@query("g06_segment_labels_with_support")
def _(spark, sf):
    f = fr(spark, sf)
    return L.label_segments(f, P.default_support(spark)).select("series_id", "segment_id", "label", "confidence")


@query("g07_duration_smoothing")
def _(spark, sf):
    from .windowed import runs
    r = runs(spark, sf).withColumns({"label": case_col("label", CHUNK_OF), "confidence": F.lit(0.5), "label_scores": F.lit(None).cast("map<string,double>")})
    return L.smooth_durations(r).drop("label_scores")


@query("g08_suggestion_run")
def _(spark, sf):
    s, _b, u = L.suggest(points(spark, sf), P.default_support(spark))
    return s.join(u, ["series_id", "segment_id"]).drop("label_scores")


ENT = "kn AS (SELECT series_id, segment_id, event_type, count(*) AS n FROM sp GROUP BY 1,2,3), pe AS (SELECT series_id, segment_id, n/sum(n) OVER (PARTITION BY series_id, segment_id) AS p FROM kn)"


@query("g09_uncertainty", f"WITH {SP}, {ENT} SELECT series_id, segment_id, {q6('CASE WHEN count(*)<=1 THEN 0 ELSE least(1.0, -sum(p*ln(p))/ln(count(*))) END')} AS segment_uncertainty FROM pe GROUP BY 1,2")
def _(spark, sf):
    from .vectorspace import probs
    s = W.boundary_scores(points(spark, sf)).select("series_id", "t", "score")
    _, u = L.uncertainty(s, probs(spark, sf).withColumnRenamed("p", "label_scores"))
    return u.withColumn("segment_uncertainty", r6("segment_uncertainty"))


OPS = ["scale", "offset", "mute_zero", "reverse_time", "suppress", "raise_lower", "change_slope", "clip_cap", "nonsense"]


def edit_table(spark, sf):
    b = blocks(spark, sf, labels=SHAPE_OF)
    ops = F.array(*[F.lit(o) for o in OPS])
    op = F.get(ops, ((F.col("series_id") + F.col("segment_id")) % len(OPS)).cast("int"))
    e = b.select(F.concat_ws("-", "series_id", "segment_id").alias("edit_id"), F.col("series_id").alias("session_id"), "series_id",
                 F.when(F.col("series_id") % 13 == 0, 999).otherwise(F.col("segment_id")).alias("segment_id"), op.alias("op_name"),
                 F.create_map(F.lit("alpha"), F.lit(0.5), F.lit("delta"), F.lit(1.0)).alias("params"), F.lit(None).cast("timestamp").alias("ts"))
    return e.withColumn("tier", F.when(F.col("op_name").isin("raise_lower", "change_slope", "clip_cap"), 2).otherwise(1))


def shape_frames(spark, sf):
    return E.frames(points(spark, sf), blocks(spark, sf, labels=SHAPE_OF))


@query("l03_batch_edits", f"""WITH {PTS}, {segs_sql(16, SHAPE_OF, 'g')}, e AS (SELECT series_id || '-' || segment_id AS edit_id, label, [{', '.join(repr(o) for o in OPS)}][CAST((series_id+segment_id)%9+1 AS INT)] AS op, series_id%13=0 AS lost FROM g)
 SELECT edit_id, op AS op_name, CASE WHEN op='nonsense' THEN 'unknown_operation' WHEN lost THEN 'segment_not_found' WHEN op='raise_lower' AND label<>'plateau' THEN 'incompatible_operation' WHEN op='change_slope' AND label<>'trend' THEN 'incompatible_operation' WHEN op='clip_cap' AND label<>'spike' THEN 'incompatible_operation' END AS error_class FROM e""")
def _(spark, sf):
    rows, _c = L.invoke(shape_frames(spark, sf), edit_table(spark, sf))
    return rows.select("edit_id", "op_name", "error_class")


@query("l04_counterfactual_run")
def _(spark, sf):
    c = L.counterfactual(shape_frames(spark, sf), edit_table(spark, sf))
    return c.select("edit_id", "op_name", "error_class", "chip.new_shape", "chip.rule_class", "native_guide.proximity", "native_guide.sparsity")


@query("f13_decompose", f"WITH {PTS}, {segs_sql(16, SHAPE_OF, 'g')} SELECT series_id, segment_id, CASE label WHEN 'plateau' THEN 'Constant' WHEN 'spike' THEN 'Delta' ELSE 'ETM' END AS method, 'user_tier3_decompose' AS refit_reason FROM g WHERE NOT (label='spike' AND end_index=start_index)")
def _(spark, sf):
    d = L.decompose(seg_points(spark, sf), blocks(spark, sf, labels=SHAPE_OF))
    return d.select("series_id", "segment_id", "method", "refit_reason")


@query("m08_dataset_evaluation")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("embeddings").alias("dataset"), F.col("vec_id").alias("sample"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return L.evaluate_dataset(e)


# --- sources and sinks: tables of the given data written and read back ----------------------

@query("s01_ts_text_scan", "SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(64 AS BIGINT) AS n_points, count(*) FILTER (abs(x) < 0.01) AS n_missing, " + q6("sum(CASE WHEN abs(x) >= 0.01 THEN x END)") + " AS total FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1,2")
def _(spark, sf):
    path = scratch(spark)
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    # Channel 0 holds the id, channel 1 the values; small values stand for missing ones.
    val = F.array_join(F.transform("v", lambda x: F.when(F.abs(x) < 0.01, "?").otherwise(x.cast("string"))), ",")
    ids = F.array_join(F.transform("v", lambda x: F.col("vec_id").cast("string")), ",")
    e.select(F.concat_ws(":", ids, val, F.col("label").cast("string")).alias("value")).write.mode("overwrite").text(path)
    pts, labels, _h = S.read_ts(spark, path)
    vid = pts.where("channel = 0").groupBy("file", "case_id").agg(F.max("value").cast("long").alias("vec_id"))
    agg = pts.where("channel = 1").groupBy("file", "case_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("value").isNull()).alias("n_missing"), r6(F.sum("value")).alias("total"))
    return agg.join(vid, ["file", "case_id"]).join(labels, ["file", "case_id"]).select("vec_id", "label", "n_points", "n_missing", "total")


def _manifest(spark, sf):
    """Catalog JSON derived from the part table: one dataset per manufacturer, one artifact per brand."""
    path = scratch(spark)
    p = table(spark, sf, "part")
    name = [c for c in p.columns if c in ("p_mfgr", "p_brand", "p_type")][0]
    g = p.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("k"))
    ds = F.struct("name", (F.col("n") % 2 + 1).cast("int").alias("n_channels"), (F.col("n") % 7 + 60).cast("int").alias("series_length"), F.array(F.lit("0"), F.lit("1")).alias("classes"))
    ar = F.struct(F.concat(F.lit("model-"), "name").alias("artifact_id"), F.lit("proto").alias("family"), F.col("name").alias("dataset"),
                  F.array((F.col("k") % 2 + 1).cast("int"), (F.col("n") % 7 + 60).cast("int")).alias("input_shape"), F.array(F.lit("0")).alias("label_space"))
    m = g.agg(F.collect_list(ds).alias("datasets"), F.collect_list(ar).alias("artifacts"))
    fam = F.array(F.struct(F.lit("proto").alias("family"), F.transform("datasets", lambda d: d["name"]).alias("supported_datasets")))
    m.withColumn("families", fam).coalesce(1).write.mode("overwrite").json(path)
    return path


@query("s02_catalog_scan")
def _(spark, sf):
    return S.read_catalog(spark, _manifest(spark, sf), register=False)["datasets"].withColumn("classes", F.concat_ws(",", "classes"))


@query("j05_compatibility")
def _(spark, sf):
    c = S.read_catalog(spark, _manifest(spark, sf), register=False)
    req = c["artifacts"].select("artifact_id", F.col("dataset").alias("dataset_name"))
    bad = c["artifacts"].select("artifact_id", F.lit("absent").alias("dataset_name"))
    r = S.compatibility(c["datasets"], c["artifacts"], c["families"], req.unionByName(bad))
    return r.withColumn("messages", F.concat_ws(",", "messages"))


@query("s04_labelled_csv", f"WITH {BW} SELECT series_id, segment_id, count(*) AS n, {q6('sum(x)')} AS total FROM bw GROUP BY 1,2")
def _(spark, sf):
    path = scratch(spark)
    s = seg(spark, sf)
    s.select(F.concat_ws("-", "series_id", "segment_id").alias("label"), F.to_json("v").alias("values"), F.lit("[]").alias("ctx_pre"), F.lit("[]").alias("ctx_post")).write.mode(
        "overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    d = S.read_labelled_csv(spark, path)
    k = F.split("label", "-")
    return d.select(k[0].cast("long").alias("series_id"), k[1].cast("int").alias("segment_id"), F.size("v").cast("long").alias("n"), r6(V.vsum(F.col("v"))).alias("total"))


@query("s05_session_json", "SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS sequence, role AS event_type FROM conversations")
def _(spark, sf):
    path = scratch(spark)
    c = table(spark, sf, "conversations")
    ev = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("eventType"))))
    c.groupBy(F.col("conv_id").cast("string").alias("sessionId")).agg(ev.alias("events")).write.mode("overwrite").json(path)
    return S.read_session_logs(spark, path, multiline=False).select("session_id", "sequence", "event_type")


@query("s06_case_json", f"WITH {PTS}, {segs_sql(16, name='g')}, {segs_sql(12, name='p')} SELECT CAST(series_id AS VARCHAR) AS series_id, 'gt' AS side, start_index, end_index, label FROM g UNION ALL SELECT CAST(series_id AS VARCHAR), 'pred', start_index, end_index, label FROM p")
def _(spark, sf):
    path = scratch(spark)

    def side(n, name):
        st = F.struct(F.col("segment_id").cast("string").alias("segmentId"), F.col("start_index").alias("startIndex"), F.col("end_index").alias("endIndex"), "label")
        return blocks(spark, sf, n).groupBy("series_id").agg(F.struct(F.collect_list(st).alias("segments")).alias(name))
    c = side(16, "groundTruth").join(side(12, "prediction"), "series_id").select(F.col("series_id").cast("string").alias("fixtureId"), "groundTruth", "prediction",
                                                                                 F.array(F.lit(0.1)).alias("prototypeDriftValues"))
    c.write.mode("overwrite").json(path)
    seg_rows, _d = S.read_cases(spark, path, multiline=False)
    return seg_rows.select("series_id", "side", "start_index", "end_index", "label")


@query("s07_prepared_sink", "SELECT CASE WHEN vec_id%4=0 THEN 'test' ELSE 'train' END AS split, count(*)*64 AS n_points, false AS wrote_again FROM embeddings GROUP BY 1")
def _(spark, sf):
    path = scratch(spark) + "/prepared"
    p = prepared(spark, sf)
    S.write_prepared(p, path)
    again = S.write_prepared(p, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n_points")).withColumn("wrote_again", F.lit(again))


@query("s08_report_sink", "SELECT user_id % 5 AS fixture_id, count(*) AS drift_count FROM events GROUP BY 1")
def _(spark, sf):
    from seriesforge.operators.evaluate import drift_summary
    path = scratch(spark)
    e = table(spark, sf, "events").select((F.col("user_id") % 5).alias("fixture_id"), (F.col("value") / 50).alias("value"))
    S.write_report(drift_summary(e, "fixture_id"), path)
    return spark.read.schema("fixture_id long, drift_count long").json(path)


@query("s09_audit_export", f"WITH {AUD} SELECT op, count(*) AS n, count(tier) AS with_chip FROM jc GROUP BY 1")
def _(spark, sf):
    from seriesforge.operators.sessions import audit_rows
    path = scratch(spark)
    r = audit_rows(log(spark, sf), chips_of(spark, sf))
    r = r.select(F.col("ts").alias("timestamp"), "tier", "op", F.lit("s1").alias("segment_id"), "pre_shape", "post_shape", "rule_class", F.lit(None).cast("string").alias("compensation_mode"),
                 F.col("badge").alias("plausibility_badge"), F.array(F.struct(F.lit("a,\"b\"").alias("message"))).alias("constraint_residual"))
    S.write_audit_csv(r, path + "/csv")
    S.write_audit_json(r, path + "/json")
    return spark.read.option("header", True).option("escape", '"').csv(path + "/csv").groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.count("tier").alias("with_chip"))


# --- extension points ------------------------------------------------------------------------

@query("x01_register_metric", f"WITH {BW} SELECT series_id, segment_id, {q6('max(x)-avg(x)')} AS crest FROM bw GROUP BY 1,2")
def _(spark, sf):
    from seriesforge.operators.metrics import metric_table
    G.register_metric("crest")(lambda aux: F.array_max("v") - V.vmean(F.col("v")))
    return metric_table(seg(spark, sf), ["crest"]).withColumn("crest", r6("crest"))


@query("x02_register_detector", f"WITH {BW} SELECT series_id, segment_id, max(x) > 3 AS matched, CASE WHEN max(x) > 3 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM bw GROUP BY 1,2")
def _(spark, sf):
    from seriesforge.operators.packs import match_label
    G.register_detector("over_three")(lambda r: (F.array_max("v") > r.num("limit", 3.0), F.lit(0.9), {"top": F.array_max("v")}, 1))
    return match_label(seg(spark, sf).withColumn("shape", F.lit("spike")), ("tall", "spike", "over_three", {"limit": 3.0}, "top > 3")).drop("semantic_label")


@query("x03_register_law", f"SELECT 'charge' AS law, {q6('max(abs(l_quantity-l_tax))')} AS initial FROM lineitem")
def _(spark, sf):
    from seriesforge.operators.conservation import enforce
    def law(d, mode):
        d = d.withColumn("initial_residual", F.col("l_quantity") - F.col("l_tax"))
        return d.withColumn("final_residual", F.lit(0.0) if mode != "naive" else F.col("initial_residual"))
    G.register_law("charge", law)
    return enforce(table(spark, sf, "lineitem"), "charge", "local", 1e-9)[1].select("law", r6("initial").alias("initial"))


@query("x04_register_fitter", f"WITH {BW} SELECT series_id, segment_id, {q6('(max(x)+min(x))/2')} AS mid FROM bw GROUP BY 1,2")
def _(spark, sf):
    from seriesforge.operators.fits import cmap
    G.register_fitter("MidRange", lambda s: s.withColumns({"method": F.lit("MidRange"), "coefficients": cmap(mid=(F.array_max("v") + F.array_min("v")) / 2), "components": cmap(all=F.col("v"))}))
    return G.fit(seg(spark, sf), "MidRange").select("series_id", "segment_id", r6(F.element_at("coefficients", F.lit("mid"))).alias("mid"))


@query("x05_register_encoder", f"WITH {BW} SELECT series_id, segment_id, {q6('avg(x)')} AS a, {q6('2*avg(x)')} AS b FROM bw GROUP BY 1,2")
def _(spark, sf):
    from seriesforge.operators.fits import constant
    G.register_coefficient_encoder("Constant2", lambda: F.array(F.element_at("coefficients", F.lit("level")), 2 * F.element_at("coefficients", F.lit("level"))))
    f = G.encode(constant(seg(spark, sf)).withColumn("method", F.lit("Constant2")))
    return f.select("series_id", "segment_id", r6(F.get("vector", F.lit(0))).alias("a"), r6(F.get("vector", F.lit(1))).alias("b"))


@query("x06_donor_engines")
def _(spark, sf):
    from .vectorspace import vecs
    v = vecs(spark, sf)
    t = v.withColumn("target", F.pmod(F.col("label").cast("int") + 1, F.lit(10)).cast("string"))
    return G.propose_donors(t, v, "class_shapelet").select("id", F.size("donor").alias("n"))


@query("x07_constraint_contract", f"WITH {PTS} SELECT series_id, {q6('10.0')} AS total FROM pts GROUP BY 1")
def _(spark, sf):
    from seriesforge.operators.conservation import project_linear
    p = points(spark, sf).withColumn("in_mask", F.lit(True))
    w, t = G.linear_constraint(p, "sum", F.lit(1.0), F.lit(10.0))
    return project_linear(p, w, t, "coupled").groupBy("series_id").agg(r6(F.sum("projected")).alias("total"))


@query("x08_user_statistic")
def _(spark, sf):
    import numpy as np
    import pandas as pd
    from seriesforge.operators.validation import stationary_bootstrap
    G.register_functions(spark)

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        x = v.to_numpy()
        low, high = np.quantile(x[~np.isnan(x)], [0.25, 0.75])
        return float(high - low)
    return G.user_statistic(stationary_bootstrap(points(spark, sf), 5.0, 10), spread)


@query("x09_validate_pack")
def _(spark, sf):
    from .packs_catalog import frames
    f = frames(spark, sf)
    bad = [("a", "spike", "hampel_peak", {}, "peak_Q > 2"), ("b", "blob", "hampel_peak", {}, ""), ("c", "spike", "absent", {}, ""), ("d", "spike", "hampel_peak", {}, "peak_Q ** 2 > 1"), ("e", "spike", "hampel_peak", {}, "no_such > 1")]
    msgs = G.validate_pack(f, bad)
    return f.groupBy("shape").count().withColumn("problems", F.lit(len(msgs)))
