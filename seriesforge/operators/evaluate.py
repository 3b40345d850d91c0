"""Scoring of segmentations: overlap joins, boundary matching, label agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import BUCKET, neighbours, running_sums


def overlaps(gt: DataFrame, pred: DataFrame, width: int = BUCKET) -> DataFrame:
    """Pairs of overlapping segments of one series with intersection and IoU.

    Both sides meet on (series, position bucket); a pair is kept in the bucket
    where its intersection starts, so it appears once.
    """
    def side(df, tag):
        s = df.select("series_id", F.col("segment_id").alias(f"{tag}_segment"), F.col("start_index").alias(f"{tag}_start"),
                      F.col("end_index").alias(f"{tag}_end"), F.col("label").alias(f"{tag}_label"))
        return s.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{tag}_start") / width),
                                                       F.floor(F.col(f"{tag}_end") / width))))
    j = side(gt, "g").join(side(pred, "p"), ["series_id", "_b"])
    lo, hi = F.greatest("g_start", "p_start"), F.least("g_end", "p_end")
    j = j.where((lo <= hi) & (F.floor(lo / width) == F.col("_b"))).drop("_b")
    inter = hi - lo + 1
    union = (F.col("g_end") - F.col("g_start") + 1) + (F.col("p_end") - F.col("p_start") + 1) - inter
    return j.withColumns({"intersection": inter, "iou": inter / F.greatest(union, F.lit(1))})


def _label_lengths(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("series_id", "label").agg(F.sum(F.col("end_index") - F.col("start_index") + 1).alias(name))


def label_union(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Labels present on either side, per series."""
    return gt.select("series_id", "label").unionByName(pred.select("series_id", "label")).distinct()


def macro_iou(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean IoU over labels; works on interval lengths, never on expanded points."""
    inter = (overlaps(gt, pred).where(F.col("g_label") == F.col("p_label"))
             .groupBy("series_id", F.col("g_label").alias("label")).agg(F.sum("intersection").alias("i")))
    j = (_label_lengths(gt, "g").join(_label_lengths(pred, "p"), ["series_id", "label"], "full_outer")
         .join(inter, ["series_id", "label"], "left").na.fill(0, ["g", "p", "i"]))
    return j.groupBy("series_id").agg(F.avg(F.col("i") / (F.col("g") + F.col("p") - F.col("i"))).alias("macro_iou"))


def inner_boundaries(segments: DataFrame) -> DataFrame:
    """Boundary positions: end + 1 of every segment but the last."""
    last = segments.groupBy("series_id").agg(F.max("end_index").alias("_m"))
    return (segments.join(last, "series_id").where(F.col("end_index") < F.col("_m"))
            .select("series_id", (F.col("end_index") + 1).alias("boundary")))


def match_boundaries(gt: DataFrame, pred: DataFrame, tolerance: int = 0) -> DataFrame:
    """True positives per series: each prediction in order takes the first free true boundary within tolerance.

    Tolerance 0 is an equi-join.  Otherwise the merged boundary line is cut
    wherever a gap exceeds the tolerance; matches cannot cross a cut, so only
    short clusters are folded.
    """
    if tolerance == 0:
        hit = pred.join(gt, ["series_id", "boundary"], "left_semi")
        return hit.groupBy("series_id").agg(F.count(F.lit(1)).alias("tp"))
    both = (pred.select("series_id", "boundary", F.lit(1).alias("p"), F.lit(0).alias("g"))
            .unionByName(gt.select("series_id", "boundary", F.lit(0).alias("p"), F.lit(1).alias("g")))
            .groupBy("series_id", "boundary").agg(F.max("p").alias("p"), F.max("g").alias("g")))
    gap = neighbours(both, "boundary", ["boundary"])
    far = F.when(F.col("prev_boundary").isNull() | (F.col("boundary") - F.col("prev_boundary") > tolerance), 1).otherwise(0)
    runs = running_sums(gap, {"_run": far}, t="boundary")
    g = runs.groupBy("series_id", "_run").agg(
        F.array_sort(F.collect_list(F.when(F.col("p") == 1, F.col("boundary")))).alias("ps"),
        F.array_sort(F.collect_list(F.when(F.col("g") == 1, F.col("boundary")))).alias("gs"))

    def take(acc, p):
        free = F.get(F.filter(acc["gs"], lambda x: F.abs(x - p) <= tolerance), F.lit(0))
        return F.struct(F.when(free.isNull(), acc["gs"]).otherwise(F.array_remove(acc["gs"], free)).alias("gs"),
                        (acc["tp"] + F.when(free.isNull(), 0).otherwise(1)).alias("tp"))
    tp = F.aggregate("ps", F.struct(F.col("gs"), F.lit(0).alias("tp")), take, lambda a: a["tp"])
    return g.select("series_id", tp.alias("tp")).groupBy("series_id").agg(F.sum("tp").alias("tp"))


def boundary_f1(gt_segments: DataFrame, pred_segments: DataFrame, tolerance: int = 0) -> DataFrame:
    """Precision, recall, F1 per series; both sides empty counts as 1."""
    g, p = inner_boundaries(gt_segments), inner_boundaries(pred_segments)
    return boundary_scores_of(g, p, gt_segments.select("series_id").distinct(), tolerance)


def boundary_scores_of(g: DataFrame, p: DataFrame, every: DataFrame, tolerance: int) -> DataFrame:
    n = lambda df, name: df.groupBy("series_id").agg(F.count(F.lit(1)).alias(name))
    j = (every.join(n(g, "ng"), "series_id", "left").join(n(p, "np"), "series_id", "left")
         .join(match_boundaries(g, p, tolerance), "series_id", "left").na.fill(0, ["ng", "np", "tp"]))
    empty = (F.col("ng") == 0) & (F.col("np") == 0)
    pr = F.when(empty, 1.0).otherwise(F.col("tp") / F.greatest(F.col("np"), F.lit(1)))
    rc = F.when(empty, 1.0).otherwise(F.col("tp") / F.greatest(F.col("ng"), F.lit(1)))
    return j.withColumns({"precision": pr, "recall": rc}).select(
        "series_id", "precision", "recall",
        F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("f1"))


def covering(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Length-weighted best IoU of the true segments."""
    best = overlaps(gt, pred).groupBy("series_id", "g_segment").agg(F.max("iou").alias("best"))
    j = gt.select("series_id", F.col("segment_id").alias("g_segment"),
                  (F.col("end_index") - F.col("start_index") + 1).alias("n")).join(best, ["series_id", "g_segment"], "left")
    return j.groupBy("series_id").agg(
        (F.sum(F.col("n") * F.coalesce("best", F.lit(0.0))) / F.greatest(F.sum("n"), F.lit(1))).alias("covering"))


def over_segmentation(gt: DataFrame, pred: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("series_id").agg(F.count(F.lit(1)).alias(name))
    j = n(gt, "ng").join(n(pred, "np"), "series_id", "left").na.fill(0, ["np"])
    return j.select("series_id", F.greatest(F.lit(0.0), (F.col("np") - F.col("ng")) / F.greatest(F.col("ng"), F.lit(1)))
                    .alias("over_segmentation_rate"))


def label_accuracy(true: DataFrame, proposed: DataFrame, min_iou: float = 0.5) -> DataFrame:
    """Share of matched true segments whose best proposal carries the same label."""
    best = overlaps(true, proposed).groupBy("series_id", "g_segment", "g_label").agg(
        F.max(F.struct("iou", (-F.col("p_start")).alias("_o"), "p_label")).alias("b"))
    m = best.where(F.col("b.iou") > min_iou).groupBy("series_id").agg(
        F.avg((F.col("b.p_label") == F.col("g_label")).cast("double")).alias("a"))
    return true.select("series_id").distinct().join(m, "series_id", "left").select(
        "series_id", F.coalesce("a", F.lit(0.0)).alias("label_accuracy"))


def drift_summary(drift: DataFrame, key: str, value: str = "value") -> DataFrame:
    return drift.groupBy(key).agg(F.count(value).alias("drift_count"), F.avg(value).alias("drift_mean"),
                                  F.max(value).alias("drift_max"))


# Event types that count as operations, and statuses that count as violations.
OPERATION_EVENTS = ("operation_applied", "operation_rejected", "projection_applied")
VIOLATING = ("WARN", "FAIL")


def violation_rate(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Share of operation events with WARN or FAIL, read from the evaluation or else from the result."""
    op = F.col("event_type").isin(*OPERATION_EVENTS)
    bad = F.coalesce(F.col("evaluation_status").isin(*VIOLATING), F.lit(False)) | F.coalesce(
        F.col("result_status").isin(*VIOLATING), F.lit(False))
    return events.groupBy(key).agg(
        F.count_if(op).alias("operation_events"), F.count_if(op & bad).alias("violating_events")).withColumn(
        "violation_rate", F.coalesce(F.try_divide("violating_events", "operation_events"), F.lit(0.0)))


def positional_diff(current: DataFrame, proposal: DataFrame) -> DataFrame:
    """Full outer join of two segmentations by position, with change flags.

    The position of a segment in its series comes from the two-level index, not
    from a whole-series window.
    """
    from .layout import index_series

    def ranked(df, tag):
        d = index_series(df, "series_id", ["start_index"], F.floor(F.col("start_index") / BUCKET), "row_no")
        return d.select("series_id", "row_no", F.col("start_index").alias(f"{tag}_start"),
                        F.col("end_index").alias(f"{tag}_end"), F.col("label").alias(f"{tag}_label"))
    j = ranked(current, "c").join(ranked(proposal, "p"), ["series_id", "row_no"], "full_outer")
    both = F.col("c_start").isNotNull() & F.col("p_start").isNotNull()
    moved = both & ((F.col("c_start") != F.col("p_start")) | (F.col("c_end") != F.col("p_end")))
    renamed = both & (F.col("c_label") != F.col("p_label"))
    return j.withColumns({"boundary_changed": moved, "label_changed": renamed,
                          "disagrees": moved | renamed | ~both})


def macro_f1(pairs: DataFrame, truth: str, predicted: str, key: str | None = None) -> DataFrame:
    """Macro F1 over the labels that occur on either side."""
    ks = [key] if key else []
    t = pairs.groupBy(*ks, F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("nt"), F.count_if(F.col(truth) == F.col(predicted)).alias("tp"))
    p = pairs.groupBy(*ks, F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("np"))
    j = t.join(p, ks + ["label"], "full_outer").na.fill(0, ["nt", "tp", "np"])
    return j.groupBy(*ks).agg(F.avg(2 * F.col("tp") / (F.col("nt") + F.col("np"))).alias("macro_f1"))
