"""Fixed values of the domain: thresholds, limits, legal operations, label maps.

They are small constant tables, so joins on them are written as map lookups or
as broadcasts of a literal DataFrame whose size never depends on the data.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label vocabularies.
CHUNK_TYPES = ("trend", "plateau", "spike", "event", "transition", "periodic")
SHAPES = ("plateau", "trend", "step", "spike", "cycle", "transient", "noise")

# Shape primitive -> chunk type.
SHAPE_TO_CHUNK = {
    "plateau": "plateau", "trend": "trend", "step": "transition", "spike": "spike",
    "cycle": "periodic", "transient": "event", "noise": "plateau",
}

# Scoring thresholds and duration limits.
THRESHOLDS = {
    "slope_abs_min": 0.1, "sign_consistency_min": 0.8, "residual_to_line_max": 0.05, "variance_max": 0.02,
    "peak_score_min": 2.5, "context_contrast_min": 0.4, "periodicity_score_min": 0.7, "ambiguity_margin_min": 0.1,
}
LIMITS = {
    "minimum": 2, "spike_max": 8, "event_min": 3, "event_max": 40, "transition_min": 2, "periodic_min": 6,
}

# Operations legal for each chunk type.
LEGAL_OPERATIONS = {
    "trend": ("change_slope", "reverse_trend", "shift_in_time", "extend", "shorten", "split", "merge"),
    "plateau": ("shift_level", "add_noise", "extend", "shorten", "merge", "split"),
    "spike": ("scale", "dampen", "suppress", "move", "widen", "narrow"),
    "event": ("shift_in_time", "change_duration", "change_intensity", "remove", "duplicate", "split", "merge"),
    "transition": ("change_slope", "accelerate", "decelerate", "shift_onset", "reverse"),
    "periodic": ("change_amplitude", "change_frequency", "phase_shift", "duplicate_cycle", "remove_cycle", "split"),
}

# Default severity of each constraint.
CONSTRAINT_MODES = {
    "minimum_segment_duration": "hard", "monotonic_trend_consistency": "soft", "plateau_stability": "soft",
    "label_compatibility": "soft",
}

# Value operation -> (label it needs, legality name).
VALUE_OPERATIONS = {
    "shift_level": ("plateau", "shift_level"), "change_slope": ("trend", "change_slope"),
    "scale_spike": ("spike", "scale"), "suppress_spike": ("spike", "suppress"),
    "shift_event": ("event", "shift_in_time"), "remove_event": ("event", "remove"),
}

# Gates of the shape classifier.
SHAPE_GATES = {
    "slope": 0.5, "var": 0.02, "per": 0.55, "peak": 2.5, "step": 0.4, "ctx": 0.35, "sign": 0.65, "lin": 0.12,
    "trans": 0.3, "spike_max_len": 20.0, "uncertainty_delta": 0.15,
}


def lookup(mapping: dict, key: Column) -> Column:
    """Value of a small constant map for ``key``; null when absent."""
    lits = [F.lit(x) for x in chain.from_iterable(mapping.items())]
    return F.try_element_at(F.create_map(*lits), key)


def min_length(label: Column) -> Column:
    """Shortest length a segment of this label may have."""
    return (F.when(label == "event", LIMITS["event_min"]).when(label == "transition", LIMITS["transition_min"])
            .when(label == "periodic", LIMITS["periodic_min"]).otherwise(LIMITS["minimum"]))


def legal_operations(spark: SparkSession) -> DataFrame:
    """(chunk_type, op_name) pairs: 37 constant rows."""
    rows = [(c, o) for c, ops in LEGAL_OPERATIONS.items() for o in ops]
    return spark.createDataFrame(rows, "chunk_type string, op_name string")


def is_legal(label: Column, op: Column) -> Column:
    """ALLOW test as one constant-map lookup, no join."""
    legal = {c: "|" + "|".join(ops) + "|" for c, ops in LEGAL_OPERATIONS.items()}
    return F.coalesce(F.contains(lookup(legal, label), F.concat(F.lit("|"), op, F.lit("|"))), F.lit(False))


def legality_reason(label: Column, op: Column) -> Column:
    return (F.when(~label.isin(*CHUNK_TYPES) | label.isNull(), "UNKNOWN_CHUNK_TYPE")
            .when(is_legal(label, op), "LEGAL").otherwise("OPERATION_NOT_ALLOWED"))
