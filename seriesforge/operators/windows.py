"""Framed operators on long series.  All frames run per chunk with a halo."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .layout import framed


def rolling_mean(points: DataFrame, window: int, value: str = "value", out: str = "smooth") -> DataFrame:
    """Causal mean with a short left edge."""
    return framed(points, window - 1, 0, {out: lambda w: F.avg(value).over(w(-(window - 1), 0))})


def feature_columns(points: DataFrame, smooth: int = 5, zwin: int = 10) -> DataFrame:
    """raw (missing -> 0), smooth, delta, zscore and missing mask, in one pass over the widest frame."""
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    p = points.withColumns({"raw": F.when(ok, F.col("value")).otherwise(0.0),
                            "missing": F.when(ok, 0.0).otherwise(1.0)})
    z = zwin - 1
    p = framed(p, max(smooth, zwin, 2) - 1, 0, {
        "smooth": lambda w: F.avg("raw").over(w(-(smooth - 1), 0)),
        "delta": lambda w: F.coalesce(F.col("raw") - F.lag("raw").over(w()), F.lit(0.0)),
        "_m": lambda w: F.avg("raw").over(w(-z, 0)),
        "_q": lambda w: F.avg(F.col("raw") * F.col("raw")).over(w(-z, 0))})
    sd = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    return (p.withColumn("zscore", (F.col("raw") - F.col("_m")) / F.when(sd > 1e-8, sd).otherwise(1.0))
            .drop("_m", "_q"))


def feature_long(points: DataFrame, mask: bool = True) -> DataFrame:
    """Feature matrix as rows (feature, t, value)."""
    names = ["raw", "smooth", "delta", "zscore"] + (["missing"] if mask else [])
    wide = feature_columns(points).select("series_id", "t", *names)
    return wide.unpivot(["series_id", "t"], names, "feature", "value")


def local_zscore(points: DataFrame, window: int) -> DataFrame:
    return feature_columns(points, 1, window).select("series_id", "t", "zscore")


def sta_lta(points: DataFrame, sta: int, lta: int, keys=("series_id",), t: str = "t") -> DataFrame:
    """Short-term over long-term mean energy."""
    e = F.col("value") * F.col("value")
    return framed(points, lta - 1, 0, {"ratio": lambda w: F.avg(e).over(w(-(sta - 1), 0)) / F.greatest(
        F.avg(e).over(w(-(lta - 1), 0)), F.lit(1e-12))}, keys, t)


def sta_lta_triggers(points: DataFrame, sta: int, lta: int, threshold: float = 4.0, keys=("series_id",),
                     t: str = "t") -> DataFrame:
    """First trigger (-1 when none) and maximal ratio."""
    r = sta_lta(points, sta, lta, keys, t)
    return r.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("ratio") >= threshold, F.col(t))), F.lit(-1)).alias("trigger_index"),
        F.max("ratio").alias("ratio_max"))


def keogh_envelope(points: DataFrame, radius: int) -> DataFrame:
    return framed(points, radius, radius, {"upper": lambda w: F.max("value").over(w(-radius, radius)),
                                           "lower": lambda w: F.min("value").over(w(-radius, radius))})


def hampel(points: DataFrame, window: int = 7, n_sigma: float = 3.0, keys=("series_id",), t: str = "t") -> DataFrame:
    """Replace a point by its window median when it lies beyond n_sigma scaled deviations.

    Reads original values only, so all points are filtered at once.
    """
    k = window // 2
    p = framed(points, k, k, {"_w": lambda w: F.array_sort(F.collect_list("value").over(w(-k, k)))}, keys, t)
    med = lambda a: V.let(a, lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
                                        + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)
    p = p.withColumn("_med", med(F.col("_w")))
    # The deviation lambda needs one scalar only; _med is a bound window result, not a nested fold.
    mad = V.let(F.struct(F.col("_w").alias("w"), F.col("_med").alias("m")),
                lambda s: med(F.array_sort(F.transform(s["w"], lambda x: F.abs(x - s["m"])))))
    hit = F.abs(F.col("value") - F.col("_med")) > n_sigma * 1.4826 * mad
    return p.withColumn("filtered", F.when(hit, F.col("_med")).otherwise(F.col("value"))).drop("_w", "_med")


def boundary_scores(points: DataFrame, window: int = 6, min_length: int = 5, n_col: str = "series_length",
                    scale: bool = True) -> DataFrame:
    """Mean shift plus half slope shift between adjacent windows over the series deviation, scaled to max 1.

    ``score`` at t belongs to the boundary between t and t + 1.  The window
    shrinks for series shorter than three windows.
    """
    ck = ["channel"] if "channel" in points.columns else []
    base = points.groupBy("series_id").agg(
        (F.max("t") + 1).cast("int").alias(n_col), F.stddev_pop("value").alias("_sd"))
    sizes = range(min(min_length, window), window + 1)
    cols = {}
    for k in sizes:
        cols[f"_m{k}"] = lambda w, k=k: F.avg("value").over(w(0, k - 1)) - F.avg("value").over(w(-k, -1))
        cols[f"_s{k}"] = lambda w, k=k: (
            F.coalesce(F.regr_slope("value", "t").over(w(0, k - 1)), F.lit(0.0))
            - F.coalesce(F.regr_slope("value", "t").over(w(-k, -1)), F.lit(0.0)))
        cols[f"_n{k}"] = lambda w, k=k: F.least(F.count("value").over(w(0, k - 1)), F.count("value").over(w(-k, -1)))
    p = framed(points, window, window - 1, cols, tuple(["series_id"] + ck)).join(base, "series_id")
    n = F.col(n_col)
    eff = F.least(F.lit(window), F.greatest(F.lit(min_length), F.floor(n / 3)))
    pick = lambda tag: F.coalesce(*[F.when(eff == k, F.col(f"_{tag}{k}")) for k in sizes])
    inside = (n >= 2 * min_length) & F.col("t").between(min_length, n - min_length) & (pick("n") >= 2)
    m, s = F.when(inside, pick("m")), F.when(inside, pick("s"))
    norm = F.when(F.col("_sd") > 1e-6, F.col("_sd")).otherwise(1.0)
    if ck:
        g = p.withColumns({"_m": m, "_s": s}).groupBy("series_id", "t", n_col, "_sd").agg(
            F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_m"), F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_s"))
        raw = g.withColumn("_raw", F.coalesce((F.col("_m") + 0.5 * F.col("_s")) / norm, F.lit(0.0)))
    else:
        raw = p.withColumn("_raw", F.coalesce((F.abs(m) + 0.5 * F.abs(s)) / norm, F.lit(0.0)))
    # Score of boundary b sits at index b - 1; index n - 1 has none.
    shifted = raw.where("t > 0").select("series_id", (F.col("t") - 1).cast("int").alias("t"), n_col, "_raw")
    tail = base.select("series_id", (F.col(n_col) - 1).cast("int").alias("t"), n_col, F.lit(0.0).alias("_raw"))
    every = shifted.unionByName(tail)
    if not scale:
        return every.withColumnRenamed("_raw", "score")
    top = raw.groupBy("series_id").agg(F.max("_raw").alias("_top"))
    return every.join(top, "series_id").select("series_id", "t", n_col, F.when(
        F.col("_top") > 0, F.col("_raw") / F.col("_top")).otherwise(F.col("_raw")).alias("score"))


def local_maxima(points: DataFrame, value: str, threshold: float, min_length: int) -> DataFrame:
    """Rows whose value reaches the threshold and the maximum of ± min_length // 2; ties kept."""
    h = max(1, min_length // 2)
    n = points.groupBy("series_id").agg((F.max("t") + 1).alias("_n"))
    p = framed(points, h, h, {"_mx": lambda w: F.max(value).over(w(-h, h))})
    return (p.join(n, "series_id").where((F.col(value) >= threshold) & (F.col(value) >= F.col("_mx"))
            & (F.col("t") >= min_length) & (F.col("t") < F.col("_n") - min_length)).drop("_mx", "_n"))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = max(1, int(truncate * sigma + 0.5))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [x / total for x in raw]


def convolve_same(points: DataFrame, kernel: list[float], value: str, out: str, keys=("series_id",),
                  t: str = "t") -> DataFrame:
    """Zero-padded centred convolution with a fixed odd kernel."""
    r = len(kernel) // 2

    def expr(w):
        total = F.lit(0.0)
        for j, weight in enumerate(kernel):
            shift = j - r
            x = F.lag(value, shift, 0.0) if shift >= 0 else F.lead(value, -shift, 0.0)
            total = total + x.over(w()) * weight
        return total
    return framed(points, r, r, {out: expr}, keys, t)


def smooth_boundary_scores(scores: DataFrame, sigma: float = 2.0) -> DataFrame:
    p = convolve_same(scores, gaussian_kernel(sigma), "score", "_u")
    return p.withColumn("uncertainty", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_u")))).drop("_u")


def shift_scores(points: DataFrame, boundaries: DataFrame, window: int) -> DataFrame:
    """Absolute mean shift at each boundary over the series deviation, at most 1."""
    sd = points.groupBy("series_id").agg(F.stddev_pop("value").alias("_sd"))
    p = framed(points, window, window - 1, {
        "_d": lambda w: F.abs(F.avg("value").over(w(0, window - 1)) - F.avg("value").over(w(-window, -1)))})
    j = p.join(boundaries.select("series_id", F.col("boundary").alias("t")), ["series_id", "t"]).join(sd, "series_id")
    s = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return j.select("series_id", F.col("t").alias("boundary"), F.least(
        F.lit(1.0), F.coalesce(F.col("_d"), F.lit(0.0)) / (s + 1e-8)).alias("score"))
