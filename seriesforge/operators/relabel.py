"""Relabelling after an edit and label chips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import lookup

P, D, R = "PRESERVED", "DETERMINISTIC", "RECLASSIFY_VIA_SEGMENTER"

# Fixed values: (shape, operation, parameter predicate) -> rule class or (rule class, target); "*" is any shape.
RULES = {
    ("*", "edit_boundary", ""): P, ("*", "split", ""): R, ("*", "merge", ""): R,
    ("*", "scale", "alpha=0"): (D, "plateau"), ("*", "scale", ""): P, ("*", "offset", ""): P,
    ("*", "mute_zero", ""): (D, "plateau"), ("*", "time_shift", ""): P, ("*", "reverse_time", ""): P,
    ("*", "resample", ""): P, ("*", "suppress", ""): R, ("*", "add_uncertainty", ""): P,
    ("*", "replace_from_library", ""): R,
    ("plateau", "raise_lower", ""): P, ("plateau", "invert", ""): P, ("plateau", "replace_with_trend", ""): (D, "trend"),
    ("plateau", "replace_with_cycle", ""): (D, "cycle"), ("plateau", "tilt_detrend", ""): P,
    ("trend", "flatten", ""): (D, "plateau"), ("trend", "reverse_direction", ""): P,
    ("trend", "change_slope", "alpha=0"): (D, "plateau"), ("trend", "change_slope", ""): P,
    ("trend", "linearise", ""): P, ("trend", "extrapolate", ""): P, ("trend", "add_acceleration", ""): P,
    ("step", "de_jump", ""): R, ("step", "invert_sign", ""): P, ("step", "scale_magnitude", "alpha=0"): (D, "plateau"),
    ("step", "scale_magnitude", ""): P, ("step", "shift_in_time", ""): P, ("step", "convert_to_ramp", ""): (D, "transient"),
    ("step", "duplicate", ""): R,
    ("spike", "remove", ""): R, ("spike", "clip_cap", ""): P, ("spike", "amplify", ""): P,
    ("spike", "smear_to_transient", ""): (D, "transient"), ("spike", "duplicate", ""): R, ("spike", "shift_time", ""): P,
    ("cycle", "deseasonalise_remove", ""): R, ("cycle", "amplify_amplitude", "alpha=0"): (D, "plateau"),
    ("cycle", "amplify_amplitude", ""): P, ("cycle", "dampen_amplitude", ""): P, ("cycle", "phase_shift", ""): P,
    ("cycle", "change_period", ""): P, ("cycle", "change_harmonic_content", ""): P, ("cycle", "replace_with_flat", ""): (D, "plateau"),
    ("transient", "remove", ""): R, ("transient", "amplify", ""): P, ("transient", "dampen", "alpha=0"): (D, "plateau"),
    ("transient", "dampen", ""): P, ("transient", "shift_time", ""): P, ("transient", "change_duration", ""): P,
    ("transient", "change_decay_constant", ""): P, ("transient", "replace_shape", ""): P, ("transient", "duplicate", ""): P,
    ("transient", "convert_to_step", ""): (D, "step"),
    ("noise", "suppress_denoise", ""): R, ("noise", "amplify", ""): P, ("noise", "change_color", ""): P,
    ("noise", "inject_synthetic", ""): P, ("noise", "whiten", ""): P,
}

# Shape-gated operations offered for a selection.
SHAPE_OPERATIONS = {
    "plateau": ["plateau_flatten", "plateau_add_noise", "plateau_scale", "plateau_remove_drift", "plateau_add_seasonal"],
    "trend": ["trend_change_slope", "trend_reverse", "trend_scale", "trend_add_noise", "trend_detrend", "trend_fit_piecewise"],
    "step": ["step_adjust_height", "step_smooth", "step_scale", "step_add_noise", "step_remove"],
    "spike": ["spike_scale", "spike_widen", "spike_narrow", "spike_remove", "spike_add"],
    "cycle": ["cycle_scale_amplitude", "cycle_shift_phase", "cycle_change_frequency", "cycle_add_harmonics",
              "cycle_remove_harmonics", "cycle_damp", "cycle_amplify"],
    "transient": ["transient_scale", "transient_shift_onset", "transient_change_duration", "transient_smooth_onset",
                  "transient_sharpen_onset"],
    "noise": ["noise_rescale", "noise_filter", "noise_change_distribution", "noise_add_periodic", "noise_denoise"],
}


def rule(shape: Column, op: Column, alpha: Column) -> Column:
    """'class|target' of the first matching rule: shape and predicate, any shape and predicate, shape, any shape."""
    table = {"|".join(k): (v if isinstance(v, str) else "|".join(v)) for k, v in RULES.items()}
    pred = F.when(alpha == 0, "alpha=0").otherwise("")
    key = lambda s, p: lookup(table, F.concat_ws("|", s, op, p))
    return F.coalesce(key(shape, pred), key(F.lit("*"), pred), key(shape, F.lit("")), key(F.lit("*"), F.lit("")))


def relabel(edits: DataFrame, classified: DataFrame | None = None, shape: str = "old_shape", op: str = "op_name",
            alpha: str = "alpha") -> DataFrame:
    """new_shape, confidence, needs_resegment, rule_class per edit.

    Edits of the re-classify class take label and confidence from ``classified``
    (edit_id, label, confidence), or keep the old shape with confidence 0; an
    edit without a rule gets null.
    """
    e = edits.withColumn("_r", rule(F.col(shape), F.col(op), F.col(alpha)))
    cls = F.get(F.split("_r", "\\|"), F.lit(0))
    tgt = F.get(F.split("_r", "\\|"), F.lit(1))
    if classified is None:
        e = e.withColumns({"_l": F.lit(None).cast("string"), "_c": F.lit(None).cast("double")})
    else:
        e = e.join(classified.select("edit_id", F.col("label").alias("_l"), F.col("confidence").alias("_c")), "edit_id", "left")
    again = cls == R
    return e.withColumns({
        "rule_class": cls, "new_shape": F.when(cls == P, F.col(shape)).when(cls == D, tgt).when(again, F.coalesce("_l", F.col(shape))),
        "confidence": F.when(again, F.coalesce("_c", F.lit(0.0))).when(cls.isNotNull(), 1.0), "needs_resegment": again}).drop("_r", "_l", "_c")


def label_chips(relabelled: DataFrame, session: str = "session_id") -> DataFrame:
    """One chip per edit, none for boundary moves; the id is a hash of the keys."""
    keep = relabelled.where(~((F.col("tier") == 0) & (F.col("op_name") == "edit_boundary")))
    return keep.select(F.sha2(F.concat_ws("|", session, "edit_id"), 256).alias("chip_id"), session, "segment_id",
                       F.col("edit_id").alias("op_id"), "op_name", "tier", "old_shape", "new_shape", "confidence", "rule_class", "ts")


def shared_operations(selection: DataFrame) -> DataFrame:
    """Operations legal for every shape of a selection: (selection_id, shape) -> (selection_id, op_name)."""
    ops = F.split(lookup({s: ",".join(o) for s, o in SHAPE_OPERATIONS.items()}, F.col("shape")), ",")
    s = selection.select("selection_id", "shape").distinct()
    n = s.groupBy("selection_id").agg(F.count(F.lit(1)).alias("_n"))
    h = s.withColumn("op_name", F.explode(ops)).groupBy("selection_id", "op_name").agg(F.count(F.lit(1)).alias("_k"))
    return h.join(n, "selection_id").where("_k = _n").select("selection_id", "op_name")
