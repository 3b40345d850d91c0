"""Runs composed of operators: suggestion, batch edits, counterfactual edits, dataset evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import vectors as V
from ..operators import boundaries as B
from ..operators import edits as E
from ..operators import evaluate as EV
from ..operators import fits as T
from ..operators import prototypes as P
from ..operators import relabel as R
from ..operators import shapes as H
from ..operators import windows as X

# Chunk type -> shape, for corrections given as chunk labels; and the least support of the shape branch.
CHUNK_TO_SHAPE = {"plateau": "plateau", "trend": "trend", "spike": "spike", "event": "transient", "transition": "step", "periodic": "cycle"}
MIN_CORRECTIONS, MIN_CLASSES = 5, 4


def label_segments(frames: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Labels of segments: rules without support, shape prototypes with enough corrections, else chunk prototypes.

    ``support``: label (chunk type), v.  Gives label, confidence and label_scores (chunk branch only).
    """
    if support is None:
        c = H.label_segments(frames)
        return c.select("series_id", "segment_id", "start_index", "end_index", "label", F.bround("confidence", 6).alias("confidence"),
                        F.lit(None).cast("map<string,double>").alias("label_scores"))
    shaped = support.withColumn("label", F.coalesce(C.lookup(CHUNK_TO_SHAPE, F.col("label")), F.col("label")))
    rich = shaped.groupBy("label").count().where(F.col("count") >= MIN_CORRECTIONS).count() >= MIN_CLASSES
    rows = frames.where(F.size("v") >= 2).withColumn("id", F.struct("series_id", "segment_id"))
    # an outer explode keeps the filter above the encoding, which it would otherwise repeat
    enc = lambda d, key: d.select(key, F.explode_outer(F.array(V.encode(F.col("v")))).alias("v")).where("v is not null")
    emb = enc(rows, "id")
    if rich:
        c = P.classify(emb, P.build(enc(shaped, "label")), "cosine", 0.1)
        out = c.select("id", F.coalesce(C.lookup(C.SHAPE_TO_CHUNK, F.col("label")), F.lit(C.CHUNK_TYPES[0])).alias("label"),
                       F.bround("confidence", 6).alias("confidence"), F.lit(None).cast("map<string,double>").alias("label_scores"))
    else:
        c = P.chunk_probabilities(emb, P.build(enc(support, "label")))
        out = c.select("id", "label", F.bround("confidence", 6).alias("confidence"), P.rounded_probabilities(F.col("probabilities")).alias("label_scores"))
    keep = rows.select("id", "start_index", "end_index")
    return keep.join(out, "id").select("id.*", "start_index", "end_index", "label", "confidence", "label_scores")


def smooth_durations(segments: DataFrame, limits: dict | None = None, default: int = 2, tie: str = "left") -> DataFrame:
    """Merge under-length segments into the better neighbour, left to right, and renumber.

    Everything left of the scan is already long enough, so rows stream in order
    through a kernel that holds two segments.
    """
    limits = limits if limits is not None else {"event": C.LIMITS["event_min"], "transition": C.LIMITS["transition_min"], "periodic": C.LIMITS["periodic_min"]}
    rows = segments.select("series_id", "start_index", "end_index", "label", "confidence", F.to_json("label_scores").alias("scores")).repartition(
        "series_id").sortWithinPartitions("series_id", "start_index")

    def run(batches):
        import json
        import pandas as pd
        size = lambda s: s["e"] - s["b"] + 1
        short = lambda s: size(s) < limits.get(s["l"], default)

        def fit(a, nb):
            x = (a["p"] or {}).get(nb["l"], 0.0) if a["p"] and nb["l"] else 0.0
            x += 0.5 if a["l"] and nb["l"] == a["l"] else 0.0
            x += nb["c"] * 0.05 if nb["c"] is not None else 0.0
            return x + min(size(nb), 10) * 0.001

        def merge(keep, gone):
            n, m = size(keep), size(gone)
            c = keep["c"] if gone["c"] is None else gone["c"] if keep["c"] is None else round((keep["c"] * n + gone["c"] * m) / (n + m), 6)
            p = keep["p"] or gone["p"]
            if keep["p"] and gone["p"]:
                p = {k: round((keep["p"].get(k, 0.0) * n + gone["p"].get(k, 0.0) * m) / (n + m), 6) for k in sorted(set(keep["p"]) | set(gone["p"]))}
                t = round(sum(p.values()), 6)
                if t != 1.0:
                    d = max(p, key=p.get)
                    p[d] = round(max(0.0, p[d] + 1.0 - t), 6)
            return {"b": min(keep["b"], gone["b"]), "e": max(keep["e"], gone["e"]), "l": keep["l"], "c": c, "p": p}

        out, left, cur, sid, num = [], None, None, None, 0

        def emit(s):
            nonlocal num
            num += 1
            out.append((sid, f"segment-{num:03d}", s["b"], s["e"], s["l"], s["c"], json.dumps(s["p"]) if s["p"] else None))

        def close():
            nonlocal left, cur
            if cur is not None:
                if short(cur) and left is not None:
                    left, cur = merge(left, cur), None
                if left is not None:
                    emit(left)
                if cur is not None:
                    emit(cur)
            left = cur = None
        for pdf in batches:
            for s, b, e, l, c, p in pdf.itertuples(index=False):
                nxt = {"b": int(b), "e": int(e), "l": l, "c": None if c is None or c != c else float(c), "p": json.loads(p) if p else None}
                if s != sid:
                    close()
                    sid, num, cur = s, 0, nxt
                    continue
                if not short(cur):
                    if left is not None:
                        emit(left)
                    left, cur = cur, nxt
                    continue
                if left is None:
                    cur = merge(nxt, cur)
                    continue
                a, z = fit(cur, left), fit(cur, nxt)
                go_left = a > z or (a == z and (tie == "left" or size(left) >= size(nxt)))
                if go_left:
                    left, cur = merge(left, cur), nxt
                else:
                    cur = merge(nxt, cur)
            yield pd.DataFrame(out, columns=["series_id", "segment_id", "start_index", "end_index", "label", "confidence", "scores"])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=["series_id", "segment_id", "start_index", "end_index", "label", "confidence", "scores"])

    t = dict(segments.dtypes)["series_id"]
    r = rows.mapInPandas(run, f"series_id {t}, segment_id string, start_index int, end_index int, label string, confidence double, scores string")
    return r.withColumn("label_scores", F.from_json("scores", "map<string,double>")).drop("scores")


def uncertainty(scores: DataFrame, segments: DataFrame, sigma: float = 2.0):
    """(boundary uncertainty per index, label entropy per segment)."""
    seg = segments.select("series_id", "segment_id", F.coalesce(V.entropy(F.map_values("label_scores")), F.lit(0.0)).alias("segment_uncertainty"))
    return X.smooth_boundary_scores(scores, sigma).select("series_id", "t", "uncertainty"), seg


def suggest(points: DataFrame, support: DataFrame | None = None, method: str = "window", **config):
    """Full suggestion: boundaries, labels, smoothing, uncertainty; (segments, boundary uncertainty, segment uncertainty)."""
    from ..operators.layout import boundaries_to_segments, cut_lineage
    scores, bounds, segs = B.propose(points, **config)
    if method == "splits":
        bounds = B.penalised_splits(points, config.get("max_boundaries", 8), config.get("min_length", 5))
        lens = points.groupBy("series_id").agg((F.max("t") + 1).cast("int").alias("series_length"))
        segs = boundaries_to_segments(bounds, lens)
    frames = E.frames(points, segs.withColumn("label", F.lit(None).cast("string")))
    smooth = cut_lineage(smooth_durations(label_segments(frames, support)))
    b, s = uncertainty(scores.select("series_id", "t", "score"), smooth)
    return smooth, b, s


# --- batch edits -------------------------------------------------------------------------

TIER1 = ("scale", "offset", "mute_zero", "time_shift", "reverse_time", "resample", "suppress", "add_uncertainty")
SPIKE = ("remove", "clip_cap", "amplify", "smear_to_transient", "duplicate", "shift_time")
FIT = {"plateau": ("raise_lower", "replace_with_trend", "replace_with_cycle", "tilt_detrend"),
       "trend": ("flatten", "change_slope", "reverse_direction", "add_acceleration")}


def _p(name: str, default: float):
    return F.coalesce(F.try_element_at("params", F.lit(name)), F.lit(float(default)))


def invoke(frames: DataFrame, edits: DataFrame, reclassify: bool = False):
    """(edited segment rows, label chips) of a batch of edits with an error class per row.

    ``frames``: series_id, segment_id, label (shape), v, pre, post; ``edits``: edit_id, session_id, series_id,
    segment_id, tier, op_name, params map, ts.  Each family is one projection; families are united.
    """
    from ..operators.validation import normal
    j = edits.join(frames, ["series_id", "segment_id"], "left")
    op, v, lab, tier = F.col("op_name"), F.col("v"), F.col("label"), F.col("tier")
    known = ((tier == 1) & op.isin(*TIER1)) | ((tier == 2) & op.isin(*SPIKE, *[o for ops in FIT.values() for o in ops]))
    fits_shape = (tier == 1) | ((lab == "spike") & op.isin(*SPIKE)) | F.coalesce(sum(((lab == s) & op.isin(*o)).cast("int") for s, o in FIT.items()) > 0, F.lit(False))
    bad = ((op == "resample") & (_p("ratio", 1) <= 0)) | ((op == "add_uncertainty") & (_p("sigma", 0.1) < 0)) | (
        (op == "time_shift") & (F.size("v") <= 5) & (_p("delta_t", 1) != 0)) | ((op == "clip_cap") & ~_p("quantile", 0.99).between(1e-9, 1.0))
    error = (F.when(~known, "unknown_operation").when(v.isNull(), "segment_not_found").when(~fits_shape, "incompatible_operation")
             .when(bad, "invalid_parameters"))
    j = j.withColumn("error_class", error)
    ok = F.col("error_class").isNull()
    white = F.transform(v, lambda x, i: x + _p("sigma", 0.1) * normal(F.col("edit_id"), i))
    raw = (F.when(op == "scale", E.scale(v, _p("alpha", 1))).when(op == "offset", E.shift_level(v, _p("delta", 0)))
           .when(op == "mute_zero", E.fill_with(v, _p("fill", 0))).when(op == "time_shift", E.circular_shift(v, _p("delta_t", 1).cast("int")))
           .when(op == "shift_time", E.circular_shift(v, _p("delta_t", 1).cast("int"))).when(op == "reverse_time", F.reverse(v))
           .when(op == "resample", V.resample(v, F.greatest(F.lit(1), F.ceil(F.size("v") * _p("ratio", 1)).cast("int"))))
           .when(op == "suppress", E.fill_linear(v, F.col("pre"), F.col("post"))).when(op == "add_uncertainty", white)
           .when(op == "clip_cap", E.cap_at_quantile(v, 0.99)).when(op == "amplify", E.gaussian_gain(v, E.peak_position(v), _p("alpha", 2)))
           .when((op == "smear_to_transient") & (F.size("v") >= 7), E.smear(v, 1.0)).when(op == "duplicate", E.duplicate_peak(v, _p("t_new", 0).cast("int"), _p("alpha", 1)))
           .when(op == "remove", E.despike_rounds(v)))
    is_raw = op.isin(*TIER1, *SPIKE)
    cols = ["edit_id", "session_id", "series_id", "segment_id", "tier", "op_name", "params", "ts", "label", "v", "error_class"]
    a = j.where(~ok | is_raw).select(*cols, F.when(ok, raw).otherwise(v).alias("edited"))
    # Coefficient-space families: plateau on a level fit, trend on a line fit.
    pl = j.where(ok & ~is_raw & (lab == "plateau"))
    lev = V.vmean(v)
    grid = lambda f: F.transform(v, lambda x, i: f(x, i))
    a2 = pl.select(*cols, F.when(op == "raise_lower", E.shift_level(v, _p("delta", 0))).when(op == "tilt_detrend", grid(lambda x, i: x - _p("beta", 0) * i))
                   .when(op == "replace_with_trend", V.let(F.struct(v.alias("v"), lev.alias("l")), lambda s: F.transform(
                       s["v"], lambda x, i: s["l"] + _p("beta", 0) * i)))
                   .otherwise(V.let(F.struct(v.alias("v"), lev.alias("l")), lambda s: F.transform(s["v"], lambda x, i: s["l"] + _p("amplitude", 1) * F.sin(
                       6.283185307179586 * i / _p("period", 4) + _p("phase", 0))))).alias("edited"))
    tr = j.where(ok & ~is_raw & (lab == "trend"))
    alpha = F.when(op == "flatten", 0.0).when(op == "reverse_direction", -1.0).otherwise(_p("alpha", 1))
    a3 = tr.select(*cols, F.when(op == "add_acceleration", F.transform(v, lambda x, i: x + _p("c", 0) * i * i)).otherwise(
        V.let(H.line_of(v), lambda q: F.transform(q["v"], lambda x, i: x + (alpha - 1.0) * q["b"] * i))).alias("edited"))
    rows = a.unionByName(a2).unionByName(a3)
    rel = rows.where("error_class is null").withColumns({"old_shape": F.col("label"), "alpha": F.coalesce(F.try_element_at("params", F.lit("alpha")), F.lit(1.0))})
    again = None
    if reclassify:
        need = rel.where(F.startswith(R.rule(F.col("old_shape"), F.col("op_name"), F.col("alpha")), F.lit(R.R)))
        empty = F.array().cast("array<double>")
        again = H.classify(need.select("edit_id", F.col("edited").alias("v"), empty.alias("pre"), empty.alias("post"))).select(
            "edit_id", F.col("shape").alias("label"), "confidence")
    chips = R.label_chips(R.relabel(rel.drop("label"), again))
    return rows, chips


def counterfactual(frames: DataFrame, edits: DataFrame, nun: DataFrame | None = None, reclassify: bool = True) -> DataFrame:
    """Edit, relabel, chip and distance check per edit id in one struct row."""
    from ..operators.validation import edit_distance
    rows, chips = invoke(frames, edits, reclassify)
    ok = rows.where((F.col("error_class").isNull()) & (F.size("v") == F.size("edited")))
    pairs = ok.select("edit_id", F.explode(F.arrays_zip(F.col("v").alias("value"), F.col("edited"))).alias("_z")).select("edit_id", "_z.*")
    d = edit_distance(pairs, nun, keys=("edit_id",)).select("edit_id", F.struct("proximity", "sparsity", "proximity_pct", "too_dense").alias("native_guide"))
    c = chips.select(F.col("op_id").alias("edit_id"), F.struct("chip_id", "old_shape", "new_shape", "confidence", "rule_class").alias("chip"))
    return rows.select("edit_id", "op_name", "error_class", "edited").join(c, "edit_id", "left").join(d, "edit_id", "left")


def decompose(seg_points: DataFrame, segments: DataFrame, domain: str | None = None) -> DataFrame:
    """Refit of chosen segments by (label, domain); rows of coefficients with the method used and the refit reason.

    Constant, Delta, NoiseModel and the trajectory model run per segment row; methods for long series (seasonal
    split, trajectory, pursuit) are called on series tables directly.
    """
    from ..operators.stats import values
    m = segments.withColumn("method", T.method_for(F.col("label"), F.lit(domain)))
    v = values(seg_points).join(m.select("series_id", "segment_id", "label", F.col("method").alias("_want")), ["series_id", "segment_id"])
    pick = lambda name: v.where(F.col("_want") == name)
    base = ["series_id", "segment_id", "method", "coefficients"]
    line = T.etm(seg_points.join(m.where(F.col("method").isin("ETM", "LandTrendr", "GrAtSiD", "STL", "MSTL")).select("series_id", "segment_id"),
                                 ["series_id", "segment_id"], "left_semi").withColumn("t", F.col("pos")))
    out = (T.constant(pick("Constant")).select(*base).unionByName(T.delta(pick("Delta")).select(*base))
           .unionByName(T.noise_model(pick("NoiseModel")).select(*base)).unionByName(line.select(*base)))
    return out.withColumns({"refit_reason": F.lit("user_tier3_decompose"), "domain_hint": F.lit(domain)})


def evaluate_dataset(samples: DataFrame, tolerance: int = 3) -> DataFrame:
    """Concatenate samples, take class changes as true boundaries, propose, label, score per dataset.

    ``samples``: dataset, sample (0-based), label, v of equal length.
    """
    length = samples.select(F.size("v")).first()[0]
    count = samples.groupBy("dataset").count().agg(F.max("count")).first()[0]
    pts = samples.select(F.col("dataset").alias("series_id"), "sample", "label", F.posexplode("v").alias("_i", "value")).withColumn(
        "t", (F.col("sample") * length + F.col("_i")).cast("int"))
    from ..operators.layout import cut_lineage, tile_runs
    pts = cut_lineage(pts.select("series_id", "t", "value", "label"))
    true = tile_runs(pts).withColumn("segment_id", F.col("start_index").cast("string"))
    pts = pts.drop("label")
    _, bounds, segs = B.propose(pts, max(length // 4, 10), max(length // 2, 5), 0.3, int(count))
    frames = E.frames(pts, segs.withColumn("label", F.lit(None).cast("string")), 0)
    labelled = label_segments(frames, P.default_support(samples.sparkSession))
    f1 = EV.boundary_f1(true, segs.withColumn("label", F.lit("")), tolerance)
    acc = EV.label_accuracy(true, labelled)
    n = segs.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_proposed_segments"))
    return f1.join(acc, "series_id").join(n, "series_id").withColumnRenamed("series_id", "dataset")
