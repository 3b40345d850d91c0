"""Chunk scores, label assignment, legality and constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores as S
from .layout import neighbours

T, L = C.THRESHOLDS, C.LIMITS


def chunk_scores() -> dict[str, Column]:
    """Score columns of the six chunk types over a statistics table."""
    n, slope = F.col("segment_length"), F.abs(F.col("slope"))
    peak, per, con = F.col("peak_score"), F.col("periodicity_score"), F.col("context_contrast")
    periodic = S.average(S.min_duration(n, L["periodic_min"]), S.ratio(per, T["periodicity_score_min"]),
                         S.inverse_ratio(peak, T["peak_score_min"] * 2.0))
    spike = S.average(S.max_duration(n, L["spike_max"]), S.ratio(peak, T["peak_score_min"]),
                      S.ratio(con, T["context_contrast_min"]))
    trend = S.average(S.ratio(slope, T["slope_abs_min"]),
                      S.ratio(F.col("sign_consistency"), T["sign_consistency_min"]),
                      S.inverse_ratio(F.col("residual_to_line"), T["residual_to_line_max"]))
    plateau = S.average(S.inverse_ratio(slope, T["slope_abs_min"] * 2.0),
                        S.inverse_ratio(F.col("variance"), T["variance_max"]),
                        S.inverse_ratio(per, T["periodicity_score_min"]))
    event = S.clamp01(S.average(S.bounded_duration(n, L["event_min"], L["event_max"]),
                                S.ratio(con, T["context_contrast_min"]))
                      * (1.0 - 0.35 * F.greatest(spike, periodic)))
    transition = S.average(S.min_duration(n, L["transition_min"]),
                           S.ratio(con, T["context_contrast_min"])) * S.ratio(slope, T["slope_abs_min"])
    return {"trend": trend, "plateau": plateau, "spike": spike, "event": event, "transition": transition,
            "periodic": periodic}


def with_scores(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"score_{k}": c for k, c in chunk_scores().items()})


def assign(stats: DataFrame, margin: float | None = None) -> DataFrame:
    """Winner, runner-up, margin and ambiguity flag; ties go to ontology order."""
    scored = with_scores(stats)
    items = F.array(*[F.struct((-F.col(f"score_{c}")).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("name"))
                      for i, c in enumerate(C.CHUNK_TYPES)])
    ranked = scored.withColumn("_r", F.array_sort(items))
    top, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    gap = second["neg"] - top["neg"]
    return ranked.withColumns({
        "assigned_label": top["name"], "confidence": -top["neg"], "runner_up": second["name"],
        "ambiguity_margin": gap,
        "is_ambiguous": gap < F.lit(margin if margin is not None else T["ambiguity_margin_min"])}).drop("_r")


def legality(edits: DataFrame, label: str = "label", op: str = "op_name") -> DataFrame:
    """ALLOW / DENY with reason for each requested operation."""
    reason = C.legality_reason(F.col(label), F.col(op))
    return edits.withColumns({"reason_code": reason,
                              "legality": F.when(reason == "LEGAL", "ALLOW").otherwise("DENY")})


def boundary_operation(label: Column, delta: Column) -> Column:
    """Name of the operation a boundary shift stands for."""
    grow = delta > 0
    return (F.when(label.isin("trend", "plateau"), F.when(grow, "extend").otherwise("shorten"))
            .when(label == "event", "change_duration")
            .when(label == "spike", F.when(grow, "widen").otherwise("narrow"))
            .when(label == "transition", "shift_onset").when(label == "periodic", "split")
            .otherwise("edit_boundary"))


def boundary_legality(label: Column, delta: Column) -> Column:
    """Reason code of a boundary shift for one segment; no shift is always legal."""
    return F.when(delta == 0, "LEGAL").otherwise(C.legality_reason(label, boundary_operation(label, delta)))


# --- constraints -----------------------------------------------------------

def _severity(name: str, mode: str | None) -> Column:
    return F.lit(mode or C.CONSTRAINT_MODES[name])


def _row(df: DataFrame, name: str, mode: str | None, ids: Column, hint: str) -> DataFrame:
    return df.select("series_id", F.lit(name).alias("constraint_id"), _severity(name, mode).alias("severity"),
                     ids.alias("affected"), F.lit(hint).alias("repair_hint"))


def min_duration_violations(segments: DataFrame, mode: str | None = None) -> DataFrame:
    short = segments.where(F.col("end_index") - F.col("start_index") + 1 < L["minimum"])
    return _row(short, "minimum_segment_duration", mode, F.array(F.col("segment_id").cast("string")),
                "extend_or_merge")


def trend_violations(stats: DataFrame, mode: str | None = None) -> DataFrame:
    ok = ((F.abs(F.col("slope")) >= T["slope_abs_min"]) & (F.col("sign_consistency") >= T["sign_consistency_min"])
          & (F.col("residual_to_line") <= T["residual_to_line_max"]))
    bad = stats.where((F.col("label") == "trend") & (F.col("segment_length") >= 2) & ~ok)
    return _row(bad, "monotonic_trend_consistency", mode, F.array(F.col("segment_id").cast("string")),
                "adjust_boundary_or_reclassify")


def plateau_violations(stats: DataFrame, mode: str | None = None) -> DataFrame:
    # A segment under 3 points has no periodicity score in the reference and is skipped there.
    per_ok = ((F.col("segment_length") < L["periodic_min"])
              | (F.col("periodicity_score") < T["periodicity_score_min"]))
    ok = (F.abs(F.col("slope")) < T["slope_abs_min"]) & (F.col("variance") <= T["variance_max"]) & per_ok
    bad = stats.where((F.col("label") == "plateau") & (F.col("segment_length") >= 3) & ~ok)
    return _row(bad, "plateau_stability", mode, F.array(F.col("segment_id").cast("string")), "reclassify_or_smooth")


def adjacency_violations(segments: DataFrame, mode: str | None = None, same_label: bool = False) -> DataFrame:
    """Neighbouring event segments; with ``same_label`` any neighbours of one label."""
    n = neighbours(segments, "start_index", ["segment_id", "label"], back=False)
    hit = (F.col("label") == F.col("next_label"))
    if not same_label:
        hit = hit & (F.col("label") == "event")
    return _row(n.where(hit), "label_compatibility", mode,
                F.array(F.col("segment_id").cast("string"), F.col("next_segment_id").cast("string")),
                "merge_or_insert_transition")


def evaluate(segments: DataFrame, stats: DataFrame, mode: str | None = None) -> DataFrame:
    """All violations of every series."""
    return (min_duration_violations(segments, mode).unionByName(trend_violations(stats, mode))
            .unionByName(plateau_violations(stats, mode)).unionByName(adjacency_violations(segments, mode)))


def status(segments: DataFrame, violations: DataFrame, mode: str | None = None) -> DataFrame:
    """PASS / WARN / FAIL per series."""
    every = segments.select("series_id").distinct()
    v = violations.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_violations"),
                                            F.bool_or(F.col("severity") == "hard").alias("_hard"))
    j = every.join(v, "series_id", "left")
    m = F.lit(mode) if mode else F.when(F.coalesce("_hard", F.lit(False)), "hard").otherwise("soft")
    n = F.coalesce("n_violations", F.lit(0))
    return j.select("series_id", n.alias("n_violations"), m.alias("constraint_mode"),
                    F.when(n == 0, "PASS").when(m == "hard", "FAIL").otherwise("WARN").alias("status"))
