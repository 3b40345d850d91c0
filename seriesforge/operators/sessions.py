"""Session logs, session metrics, guardrail lights, tips and study tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores as S
from ..streaming.stateful import TipState
from .layout import CHUNK, index_series, running_sums
from .scan import Recursion, run_ordered
from .validation import percentile_rank

DAY = 86_400_000_000


# --- predicates ---------------------------------------------------------------------

def missingness(points: DataFrame, keys=("series_id", "segment_id"), threshold_pct: float = 20.0) -> DataFrame:
    """Missing share per segment and whether it bars dense operations (raw ratio, strict)."""
    miss = F.avg(F.when(F.col("value").isNull() | F.isnan("value"), 1.0).otherwise(0.0))
    g = points.groupBy(*keys).agg(miss.alias("missing_ratio"))
    return g.withColumns({"missing_pct": F.round(F.col("missing_ratio") * 100).cast("int"),
                          "blocks_dense_ops": F.col("missing_ratio") * 100 > threshold_pct})


def long_enough(points: DataFrame, least: int, keys=("series_id", "segment_id"), channel: str | None = None) -> DataFrame:
    """(keys, n) of the segments with ``least`` points or more; with ``channel``, of univariate ones only."""
    g = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *([F.min(channel).alias("_a"), F.max(channel).alias("_b")] if channel else []))
    g = g.where(F.col("n") >= least)
    return g.where("_a = _b").drop("_a", "_b") if channel else g


def traffic_light(value: Column, amber_below=None, red_below=None, amber_above=None, red_above=None) -> Column:
    out = F.when(value.isNull() | F.isnan(value), "idle")
    if red_below is not None:
        out = out.when(value < red_below, "red")
    if amber_below is not None:
        out = out.when(value < amber_below, "amber")
    if red_above is not None:
        out = out.when(value > red_above, "red")
    if amber_above is not None:
        out = out.when(value > amber_above, "amber")
    return out.otherwise("green")


# Default thresholds of the session lights.
LIGHTS = {
    "coverage": {"amber_below": 0.6, "red_below": 0.4}, "diversity": {"amber_below": 0.0, "red_below": -10.0},
    "validity": {"amber_below": 0.5, "red_below": 0.3}, "cherry_picking": {"amber_above": 0.5, "red_above": 0.7},
    "forking_paths": {"amber_above": 5.0, "red_above": 10.0},
}


def residual_status(residual: Column, tolerance: Column, hard: Column) -> Column:
    ok = F.abs(residual) <= tolerance
    return (F.when(residual.isNull() | tolerance.isNull() | F.isnan(residual), "amber").when(ok, "green")
            .when(hard, "red").otherwise("amber"))


def residual_direction(before: Column, after: Column) -> Column:
    i, f = F.abs(before), F.abs(after)
    return (F.when(before.isNull() | after.isNull() | (F.abs(i - f) <= 1e-15), "unchanged").when(f < i, "improving")
            .otherwise("worsening"))


def range_signal(lo: Column, hi: Column, seen_lo: Column, seen_hi: Column) -> Column:
    unknown = lo.isNull() | hi.isNull() | seen_lo.isNull() | seen_hi.isNull()
    return F.when(unknown, "amber").when((seen_lo >= lo) & (seen_hi <= hi), "green").otherwise("red")


def manifold_signal(sigma: Column, enabled: Column, amber: float = 2.0, red: float = 3.0) -> Column:
    return (F.when(~enabled, "disabled").when(sigma.isNull() | F.isnan(sigma), "amber").when(F.abs(sigma) <= amber, "green")
            .when(F.abs(sigma) <= red, "amber").otherwise("red"))


def worst_signal(*signals: Column) -> Column:
    """Worst of green, amber, red; disabled signals are left out."""
    rank = F.greatest(*[F.when(s == "red", 2).when(s == "amber", 1).otherwise(0) for s in signals])
    return F.when(rank == 2, "red").when(rank == 1, "amber").otherwise("green")


def utility(plausibility: Column, sparsity: Column, valid: Column, weights=(0.4, 0.3, 0.3)) -> Column:
    parts = [S.clamp01(F.coalesce(c, F.lit(0.0))) * w for c, w in zip((plausibility, sparsity, valid), weights)]
    return S.clamp01(parts[0] + parts[1] + parts[2])


def with_scope(segments: DataFrame) -> DataFrame:
    """Effective scope: explicit values, else the defaults of the domain; problems listed in ``scope_errors``."""
    # Window and mode by domain.
    window = C.lookup({"hydrology": 30, "seismo-geodesy": 30, "remote-sensing": 365}, F.col("domain_hint"))
    mode = C.lookup({"hydrology": "sliding", "seismo-geodesy": "fixed", "remote-sensing": "sliding"}, F.col("domain_hint"))
    s = segments.withColumns({"window_size": F.coalesce("window_size", window.cast("double"), F.lit(30.0)),
                              "mode": F.coalesce("mode", mode, F.lit("sliding"))})
    w = F.col("window_size")
    err = F.array_compact(F.array(
        F.when(w != F.floor(w), "window_not_integer").when(w <= 0, "window_non_positive").when(w > F.col("series_length"), "window_exceeds_series"),
        F.when(~F.col("mode").isin("fixed", "sliding"), "mode_unknown"),
        F.when((F.col("mode") == "fixed") & F.col("reference").isNull(), "reference_required")))
    return s.withColumn("scope_errors", err)


def drawn_series(points: DataFrame, length: int, lo: float, hi: float, key: str = "drawing_id") -> DataFrame:
    """Drawn (x, y, seq) points on an even grid: last y per x wins, linear between neighbours, flipped, min-max scaled.

    A drawing is a short list of strokes, handled as one array.
    """
    from ..functions import vectors as V
    d = points.groupBy(key, "x").agg(F.max_by("y", "seq").alias("y"))
    g = d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_p")).where(F.size("_p") >= 2)

    def grid(s):
        def at(i):
            x = s["p"][0]["x"] + (F.element_at(s["p"], -1)["x"] - s["p"][0]["x"]) * i / (length - 1)
            def near(q):
                k = F.greatest(F.lit(1), F.least(F.size(F.filter(q["p"], lambda e: e["x"] < q["x"])), F.size(q["p"]) - 1))
                return V.let(F.struct(F.get(q["p"], k - 1).alias("l"), F.get(q["p"], k).alias("r"), q["x"].alias("x")), lambda z: -(
                    z["l"]["y"] + (z["r"]["y"] - z["l"]["y"]) * (z["x"] - z["l"]["x"]) / (z["r"]["x"] - z["l"]["x"])))
            return V.let(F.struct(s["p"].alias("p"), x.alias("x")), near)
        return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)
    raw = V.let(F.struct(F.col("_p").alias("p")), grid)
    scaled = V.let(F.struct(raw.alias("v"), F.array_min(raw).alias("a"), F.array_max(raw).alias("b")), lambda s: F.transform(
        s["v"], lambda x: F.when(s["b"] == s["a"], (lo + hi) / 2).otherwise(lo + (x - s["a"]) / (s["b"] - s["a"]) * (hi - lo))))
    return g.select(key, scaled.alias("values"))


# --- logs -------------------------------------------------------------------------------

def sequence_events(events: DataFrame, order: list[str], key: str = "session_id") -> DataFrame:
    """Append form of operation events: per-session sequence, event id, type, outcome metadata."""
    e = index_series(events, key, order, F.date_trunc("day", order[0]), "sequence").withColumn("sequence", F.col("sequence") + 1)
    return e.withColumns({
        "event_id": F.concat_ws("-", F.col(key).cast("string"), F.lit("event"), F.col("sequence").cast("string")),
        "event_type": F.when(F.col("applied"), "operation_applied").otherwise("operation_rejected")})


def suggestion_events(decisions: DataFrame):
    """(accepted rows with their event type, rejected rows) of suggestion decisions."""
    ok = F.col("decision").isin("accepted", "overridden")
    return (decisions.where(ok).withColumn("event_type", F.concat(F.lit("suggestion_"), F.col("decision"))),
            decisions.where(~ok | F.col("decision").isNull()))


def export_sessions(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row per session with its ordered events; a missing end falls back to the start."""
    cols = [c for c in events.columns if c != "session_id"]
    e = events.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("sequence", *[c for c in cols if c != "sequence"]))).alias("events"))
    return sessions.join(e, "session_id", "left").withColumn("ended_at", F.coalesce("ended_at", "started_at"))


def audit_rows(events: DataFrame, chips: DataFrame, undo: int = 0) -> DataFrame:
    """Events with their label chip (the last chip of a sequence wins); the newest ``undo`` events are hidden."""
    c = chips.groupBy("session_id", "sequence").agg(F.max_by(F.struct("tier", "old_shape", "new_shape", "rule_class", "confidence"), "chip_no").alias("_c"))
    n = events.groupBy("session_id").agg(F.max("sequence").alias("_n"))
    j = events.join(n, "session_id").where(F.col("sequence") <= F.col("_n") - undo).join(c, ["session_id", "sequence"], "left")
    conf = F.col("_c.confidence")
    badge = F.when(conf >= 0.8, "green").when(conf >= 0.5, "yellow").when(conf.isNotNull(), "red")
    return j.select(*[x for x in events.columns], F.col("_c.tier").alias("tier"), F.col("_c.old_shape").alias("pre_shape"),
                    F.col("_c.new_shape").alias("post_shape"), F.col("_c.rule_class").alias("rule_class"), badge.alias("badge"))


def filter_audit(rows: DataFrame, tier=None, rule_class=None, badge=None, op=None, date_from=None, date_to=None) -> DataFrame:
    for col, v in (("tier", tier), ("rule_class", rule_class), ("badge", badge), ("op", op)):
        if v is not None:
            rows = rows.where(F.col(col) == v)
    if date_from is not None:
        rows = rows.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(date_from).cast("timestamp")))
    if date_to is not None:
        rows = rows.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(date_to).cast("timestamp")))
    return rows


def session_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.min_by("ts", "sequence").alias("started_at"), F.max_by("ts", "sequence").alias("ended_at"),
                                            F.count(F.lit(1)).alias("event_count"), F.sum("warning_count").alias("warning_count"))


def event_type_coverage(events: DataFrame, condition: str, a: str, b: str) -> DataFrame:
    """Event types only in condition a, and shared by a and b."""
    ta = events.where(F.col(condition) == a).select("event_type").distinct()
    tb = events.where(F.col(condition) == b).select("event_type").distinct()
    return (ta.subtract(tb).withColumn("kind", F.lit("only_first"))
            .unionByName(ta.intersect(tb).withColumn("kind", F.lit("shared"))))


# Telemetry checks: id -> (fields looked for, fields required).
TELEMETRY = {
    "session_duration": (("startedAt", "endedAt"), ("startedAt", "endedAt")),
    "operation_diversity": (("eventType", "operationType"), ("eventType", "operationType")),
    "constraint_feedback_rate": (("evaluationStatus", "resultStatus"), ("evaluationStatus",)),
    "suggestion_uptake": (("suggestionDecision", "suggestionId"), ("suggestionDecision",)),
    "target_segment_coverage": (("metadataTargets", "operationTargets"), ("operationTargets",)),
    "condition_assignment": (("conditionId",), ("conditionId",)),
    "participant_linkage": (("participantId",), ("participantId",)),
    "task_completion_marker": (("taskId", "taskCompletedAt", "taskOutcome"), ("taskId", "taskOutcome")),
}


def telemetry_checks(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Supported or missing fields of each metric per session; a field counts when any event has it non-empty.

    Columns are named after the fields; absent columns count as missing.
    """
    fields = sorted({f for looked, _ in TELEMETRY.values() for f in looked})
    have = [F.max((F.col(f).isNotNull() & (F.col(f).cast("string") != "")).cast("int")).alias(f) if f in events.columns
            else F.max(F.lit(0)).alias(f) for f in fields]
    g = events.groupBy(key).agg(*have)
    names = lambda fs: F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in fs]))
    rows = F.array(*[F.struct(F.lit(m).alias("metric_id"), names(l).alias("available"),
                              F.array_except(F.array(*[F.lit(x) for x in r]), names(l)).alias("missing")) for m, (l, r) in TELEMETRY.items()])
    return g.select(key, F.explode(rows).alias("_r")).select(key, "_r.*").withColumn(
        "status", F.when(F.size("missing") == 0, "supported").otherwise("missing_fields"))


# --- session metrics -------------------------------------------------------------------------

def validity(results: DataFrame, clock: Column, order: list[str], window: int = 10, threshold: float = 0.3,
             key: str = "session_id") -> DataFrame:
    """Validity rate overall, by tier and shape, over the last ``window`` events and the trailing 7 days."""
    i = index_series(results, key, order, F.date_trunc("day", order[0]), "_i")
    n = results.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    v = F.col("is_valid").cast("double")
    r = i.join(n, key)
    rate = lambda cond: F.avg(F.when(cond, v))
    recent = rate(F.col("_i") >= F.col("_n") - window)
    week = rate(F.unix_micros("ts") >= F.unix_micros(clock) - 7 * DAY)
    g = r.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("is_valid").alias("n_valid"), F.avg(v).alias("rate"),
        *[rate(F.col("tier") == t).alias(f"rate_tier_{t}") for t in range(4)],
        *[rate(F.col("shape") == s).alias(f"rate_{s}") for s in C.SHAPES], recent.alias("_r"), week.alias("rate_7_days"))
    g = g.withColumn("recent_rate", F.when(F.col("n_total") >= window, F.col("_r"))).drop("_r")
    return g.withColumn("tip", F.coalesce(F.col("recent_rate") < threshold, F.lit(False)))


def trailing_rate(results: DataFrame, key: str = "session_id", days: int = 7) -> DataFrame:
    """Validity over the trailing span at each event.

    The events of one time enter together and leave just after the span; a chunked
    running sum over entries and exits gives the trailing counts without a
    whole-session window.  Events of equal time count each other.
    """
    at = results.groupBy(key, "ts").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("is_valid").cast("int")).alias("_v"))
    t = F.unix_micros("ts") * 2
    enter = at.select(key, "ts", t.alias("t"), F.lit(1).alias("_e"), "_n", "_v")
    leave = at.select(key, F.lit(None).cast("timestamp").alias("ts"), (t + 2 * days * DAY + 1).alias("t"), F.lit(0).alias("_e"),
                      (-F.col("_n")).alias("_n"), (-F.col("_v")).alias("_v"))
    s = running_sums(enter.unionByName(leave), {"n": F.col("_n"), "k": F.col("_v")}, (key,), size=2 * DAY)
    told = s.where("_e = 1").select(key, "ts", F.col("n").alias("n_window"), (F.col("k") / F.col("n")).alias("rate"))
    return results.select(key, "ts").join(told, [key, "ts"], "left")


def coverage(chips: DataFrame, key: str = "session_id", fraction: float = 0.4, skew: float = 0.6, min_edits: int = 10) -> DataFrame:
    """Shape coverage per session: counts of the seven shapes, share touched, most and least used, Gini, tip, suggestion."""
    touched = F.array_distinct(F.array_compact(F.array("old_shape", "new_shape")))
    s = chips.select(key, F.explode(touched).alias("shape"))
    counts = {k: F.count_if(F.col("shape") == k) for k in C.SHAPES}
    g = s.groupBy(key).agg(*[c.alias(f"n_{k}") for k, c in counts.items()])
    arr = F.array(*[F.col(f"n_{k}") for k in C.SHAPES])
    item = F.array(*[F.struct((-F.col(f"n_{k}")).alias("neg"), F.lit(i).alias("i"), F.lit(k).alias("s")) for i, k in enumerate(C.SHAPES)])
    g = g.withColumns({"total_edits": sum(F.col(f"n_{k}") for k in C.SHAPES), "_a": F.array_sort(arr), "_o": F.array_sort(item)})
    nz = F.filter("_o", lambda e: e["neg"] < 0)
    low = F.array_max(F.transform(nz, lambda e: e["neg"]))
    at_low = F.filter(nz, lambda e: e["neg"] == low)
    weighted = F.aggregate(F.transform("_a", lambda x, i: (i + 1) * x), F.lit(0).cast("long"), lambda a, x: a + x)
    gini = F.when(F.col("total_edits") > 0, 2.0 * weighted / (7 * F.col("total_edits")) - 8.0 / 7.0).otherwise(0.0)
    unused = F.filter(F.array(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("s")) for k in C.SHAPES]), lambda e: e["n"] == 0)
    g = g.withColumns({"coverage_fraction": F.size(nz) / 7.0, "most_used": F.get("_o.s", F.lit(0)),
                       "least_used": F.when((F.size(nz) >= 2) & (F.size(at_low) == 1), F.get(at_low, F.lit(0))["s"]),
                       "skewness": gini, "suggested": F.get(unused, F.lit(0))["s"]})
    return g.withColumn("tip", (F.col("coverage_fraction") < fraction) & (F.col("skewness") > skew) & (F.col("total_edits") > min_edits)).drop("_a", "_o")


def cherry_picking(accepted: DataFrame, admissible: DataFrame, min_accepted: int = 3, threshold: float = 0.7,
                   key: str = "session_id") -> DataFrame:
    """Quantile of accepted utilities among admissible ones, distance to uniform, score 1 - p.

    ``accepted``: session, instance_key, value; ``admissible``: instance_key, value.
    """
    q = percentile_rank(accepted, admissible, ["instance_key"]).withColumn("pct", F.round("pct", 12))
    # Rank inside a session through value bins first, so a long session is not one sort.
    r = index_series(q, key, ["pct"], F.floor(F.col("pct") * 64), "_i")
    n = q.groupBy(key).agg(F.count(F.lit(1)).alias("n_accepted"))
    r = r.join(n, key)
    d = F.greatest((F.col("_i") + 1) / F.col("n_accepted") - F.col("pct"), F.col("pct") - F.col("_i") / F.col("n_accepted"))
    g = r.groupBy(key, "n_accepted").agg(F.max(d).alias("ks"), F.avg("pct").alias("mean_quantile"))
    enough = F.col("n_accepted") >= min_accepted
    p = F.when(enough, S.ks_pvalue(F.col("ks"), F.col("n_accepted"))).otherwise(1.0)
    g = g.withColumn("p_value", p).withColumn("score", F.when(enough, 1.0 - F.col("p_value")).otherwise(0.0))
    rec = (F.when(F.col("score") < threshold, None).when(F.col("mean_quantile") > 0.8, "top_quantile").when(F.col("mean_quantile") < 0.2, "bottom_quantile")
           .otherwise("non_uniform"))
    return g.withColumns({"recommendation": rec, "tip": F.col("score") > threshold})


# --- tips ----------------------------------------------------------------------------------

# Tip rules (id, condition over metric columns, degree, modality, severity, message).
TIP_RULES = [
    ("high_autocorrelation_propagation", "autocorr_at_lag_k > 0.5 AND k_steps_after_edit_in_horizon", "directing", "contingency", 2,
     "Edit at t={t_edit} likely propagates to t={t_edit_plus_k}; verify CF validity downstream."),
    ("cherry_picking_high", "cherry_picking_score > 0.7", "prescribing", "contrastive", 3, "{cherry_picking_recommendation}"),
    ("shape_coverage_low", "shape_coverage < 0.4 AND edit_count >= 5", "orienting", "contrastive", 1,
     "You have only explored {shapes_used}/7 shape primitives. Try {underexplored_shape} for contrast."),
    ("ynn_low", "ynn < 0.5", "directing", "contrastive", 1,
     "Edited series has few same-class neighbours — likely off-manifold. Consider replace_from_library with a Native-Guide donor."),
    ("kpss_post_only", "kpss_pre_p > 0.05 AND kpss_post_p < 0.05", "orienting", "cf", 1,
     "Edit appears to have introduced non-stationary drift (KPSS rejected post-edit only)."),
    ("cs_below_threshold", "cs < 0.6", "directing", "cf", 2,
     "Edit is fragile: small jitter in {coefficient_name} flips ~{invalidation_pct}% of nearby predictions. Try perturbing by ±10%."),
    ("probe_ir_high", "probe_ir > 0.2", "directing", "cf", 2,
     "~{ir_pct}% of imperfect realisations of this edit would invalidate the CF. Consider a larger amplitude for a robustness margin."),
]
DEGREES = {"prescribing": 3, "directing": 2, "orienting": 1}


def predicate(text: str, columns: list[str]) -> Column:
    """Condition text as Spark SQL; empty is true, missing names or nulls are false."""
    if not text or not text.strip():
        return F.lit(True)
    import re
    names = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", text)))
    # Words and functions a condition may use.
    allowed = {"and", "or", "not", "in", "is", "null", "true", "false", "between", "abs", "greatest", "least", "bround", "size", "array"}
    if any(n not in columns and n.lower() not in allowed for n in names):
        return F.lit(False)
    return F.coalesce(F.expr(text), F.lit(False))


def render(message: str, columns: list[str]) -> Column:
    """Message with {name} placeholders filled from columns."""
    out = F.lit(message)
    for c in columns:
        if "{" + c + "}" in message:
            out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    return out


def fired_tips(metrics: DataFrame, keys: list[str], rules=TIP_RULES) -> DataFrame:
    """Rows of the rules that hold for each metric row, with rendered message and rank."""
    cols = metrics.columns
    items = [F.when(predicate(cond, cols), F.struct((-F.lit(sev)).alias("_s"), (-F.lit(DEGREES[deg])).alias("_d"), F.lit(i).alias("_i"),
                                                    F.lit(rid).alias("rule_id"), F.lit(deg).alias("degree"), F.lit(mod).alias("modality"),
                                                    F.lit(sev).alias("severity"), render(msg, cols).alias("message")))
             for i, (rid, cond, deg, mod, sev, msg) in enumerate(rules)]
    t = metrics.withColumn("_t", F.array_sort(F.array_compact(F.array(*items))))
    return t.select(*keys, F.posexplode("_t").alias("rank", "_e")).select(*keys, "rank", "_e.rule_id", "_e.degree", "_e.modality", "_e.severity", "_e.message")


def emit_tips(fired: DataFrame, session: str = "session_id", order: str = "seq", max_tips: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Tips actually shown: at most ``max_tips`` per edit, repeats suppressed, modality switched.

    Emission depends on the last few emissions; a long session runs by chunks (see ``scan``).
    """
    g = fired.groupBy(session, order).agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "modality", "severity"))).alias("c"))
    g = index_series(g, session, [order], F.floor(F.col(order) / CHUNK), "_n")
    state = Recursion("rule_id string, modality string, severity int", lambda row: TipState(max_tips), lambda row: [TipState(max_tips)],
                      lambda s, row: s.emit([(x["rule_id"], x["modality"], int(x["severity"])) for x in row.c]), lambda s: json.dumps([s.recent, s.modalities]),
                      lambda text: TipState(max_tips, recent=json.loads(text)[0], modalities=json.loads(text)[1]))
    return run_ordered(g, [session], state, order, "_n", chunk=chunk)


# --- study tables --------------------------------------------------------------------------

def accuracy_by(trials: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy and count per group, with the correlation of confidence and accuracy over all trials."""
    r = trials.agg(F.corr("confidence", "accuracy").alias("r")).scalar()
    return trials.groupBy(*by).agg(F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n")).withColumn("r", r)


def brier(trials: DataFrame, by: str) -> DataFrame:
    e = F.col("confidence") / 100.0 - F.col("accuracy")
    return trials.groupBy(by).agg(F.avg(e * e).alias("brier"), F.count(F.lit(1)).alias("n_trials"))


def equivalence(values: DataFrame, group: str, a: str, b: str, value: str, bound_d: float = 0.3) -> DataFrame:
    """Means, deviations, sizes of two groups and the two one-sided t statistics for bounds of ± d pooled deviations."""
    c = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    r = values.agg(c(a, F.avg).alias("m1"), c(b, F.avg).alias("m2"), c(a, F.stddev_samp).alias("s1"), c(b, F.stddev_samp).alias("s2"),
                   c(a, F.count).alias("n1"), c(b, F.count).alias("n2"))
    pooled = F.sqrt((F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2")) / 2)
    se = F.sqrt(F.col("s1") * F.col("s1") / F.col("n1") + F.col("s2") * F.col("s2") / F.col("n2"))
    d = F.col("m1") - F.col("m2")
    return r.withColumns({"t_lower": (d + bound_d * pooled) / se, "t_upper": (d - bound_d * pooled) / se})


def adjust_p(pvalues: DataFrame, family: str, p: str = "p") -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p within a family of tests."""
    up, tie = W.partitionBy(family).orderBy(p, "test"), W.partitionBy(family)
    r = pvalues.withColumns({"_i": F.row_number().over(up), "_n": F.count(F.lit(1)).over(tie)})
    holm = F.least(F.lit(1.0), (F.col("_n") - F.col("_i") + 1) * F.col(p))
    bh = F.least(F.lit(1.0), F.col("_n") / F.col("_i") * F.col(p))
    down = W.partitionBy(family).orderBy(F.col("_i").desc())
    return (r.withColumns({"_h": holm, "_b": bh}).withColumns({
        "p_holm": F.max("_h").over(W.partitionBy(family).orderBy("_i")), "p_bh": F.min("_b").over(down)}).drop("_i", "_n", "_h", "_b"))


def exclusion_funnel(participants: DataFrame, trials: DataFrame, per_participant: int, attention: int, iqr_k: float = 3.0):
    """(audit rows, kept participants): attention check, complete trials, completion time within k IQR of the median, fluency."""
    from .layout import cut_lineage
    p0 = participants
    p1 = p0.where(F.col("attention_check_pass_count") >= attention)
    done = trials.groupBy("participant").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == per_participant).select("participant")
    p2 = p1.join(done, "participant", "left_semi")
    q = p2.agg(F.percentile("completion_time_min", F.lit(0.5)).alias("_m"), (F.percentile("completion_time_min", F.lit(0.75))
                                                                       - F.percentile("completion_time_min", F.lit(0.25))).alias("_q"))
    p2q = p2.withColumns({"_m": q.select("_m").scalar(), "_q": q.select("_q").scalar()})
    t = F.col("completion_time_min")
    p3 = p2q.where((t <= F.col("_m") + iqr_k * F.col("_q")) & (t >= F.greatest(F.lit(0.0), F.col("_m") - iqr_k * F.col("_q")))).drop("_m", "_q")
    p4 = p3.where("english_fluent_self_report")
    steps = [("initial", p0), ("attention_check_failed", p1), ("incomplete_trials", p2), ("completion_time_outside_iqr", p3), ("english_non_fluent", p4)]
    rows = None
    for i, (name, d) in enumerate(steps):
        r = d.agg(F.count(F.lit(1)).alias("remaining_n")).select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "remaining_n")
        rows = r if rows is None else rows.unionByName(r)
    w = W.partitionBy(F.lit(0)).orderBy("step_no")  # five constant rows
    first = F.first("remaining_n").over(w)
    audit = rows.withColumns({"excluded_n": F.coalesce(F.lag("remaining_n").over(w) - F.col("remaining_n"), F.lit(0)),
                              "attrition_flag": 1.0 - F.col("remaining_n") / first > 0.05})
    return audit, p4


# --- prepared datasets -----------------------------------------------------------------------

def normalise_with_train(points: DataFrame) -> DataFrame:
    """Per (dataset, channel) z-normalisation of both splits with training statistics; zero deviation becomes 1."""
    s = points.where("split = 'train'").groupBy("dataset", "channel").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return points.join(s, ["dataset", "channel"]).withColumn(
        "value", (F.col("value") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def encode_labels(labels: DataFrame) -> DataFrame:
    """Index of each label by first appearance, training rows first; (dataset, split, position, label)."""
    o = F.struct((F.col("split") != "train").cast("int").alias("s"), F.col("position").alias("p"))
    first = labels.groupBy("dataset", "label").agg(F.min(o).alias("_o"))
    idx = first.withColumn("label_index", F.row_number().over(W.partitionBy("dataset").orderBy("_o")) - 1)
    return labels.join(idx.select("dataset", "label", "label_index"), ["dataset", "label"])
