"""Reports composed from the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E


def evaluation_report(gt: DataFrame, pred: DataFrame, tolerance: int = 0) -> DataFrame:
    """One row of segmentation-quality metrics per series, unsupported metrics named."""
    f1 = E.boundary_f1(gt, pred, tolerance).select("series_id", "precision", "recall", F.col("f1").alias("boundary_f1"))
    return (E.macro_iou(gt, pred).join(f1, "series_id").join(E.covering(gt, pred), "series_id")
            .join(E.over_segmentation(gt, pred), "series_id")
            .withColumn("unsupported_metrics", F.array(F.lit("wari"), F.lit("sms"))))


# Study conditions and the event types each may produce.
CONDITIONS = {
    "semantic-interface": ("operation_applied", "operation_rejected", "projection_applied", "suggestion_accepted", "suggestion_overridden"),
    "rule-only-baseline": ("operation_applied", "operation_rejected", "projection_applied"),
}


def readiness_report(events: DataFrame) -> DataFrame:
    """Per condition: telemetry checks met, event types seen, and unexpected event types (protocol drift).

    ``events``: session_id, condition, eventType and telemetry fields.
    """
    from ..config import lookup
    from ..operators.sessions import telemetry_checks
    checks = telemetry_checks(events).join(events.select("session_id", "condition").distinct(), "session_id")
    ok = checks.groupBy("condition").agg(F.count_if(F.col("status") == "supported").alias("checks_supported"), F.count(F.lit(1)).alias("checks_total"))
    expected = F.split(lookup({k: ",".join(v) for k, v in CONDITIONS.items()}, F.col("condition")), ",")
    drift = F.array_sort(F.array_except(F.collect_set("eventType"), F.first(expected)))
    seen = events.groupBy("condition").agg(F.array_sort(F.collect_set("eventType")).alias("event_types"), drift.alias("protocol_drift"))
    return ok.join(seen, "condition")
