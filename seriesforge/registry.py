"""Extension points.

Metrics, detectors, laws, fit methods, coefficient encoders, donor engines,
constraints, noise and statistics are plain functions over columns or
DataFrames, kept by name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as N
from .operators import distance as D
from .operators import fits as T
from .operators.conservation import register_law  # noqa: F401
from .operators.metrics import register_metric  # noqa: F401
from .operators.packs import register_detector, validate_pack  # noqa: F401

FITTERS = {"Constant": T.constant, "Delta": T.delta, "NoiseModel": T.noise_model}
ENCODERS: dict = {}
DONORS: dict = {}


def register_fitter(method: str, fn) -> None:
    """fn(segment rows) -> fit rows (method, components, coefficients)."""
    FITTERS[method] = fn


def fit(segments: DataFrame, method: str) -> DataFrame:
    if method not in FITTERS:
        raise ValueError(f"unknown fit method {method!r}; registered: {sorted(FITTERS)}")
    return FITTERS[method](segments)


def register_coefficient_encoder(method: str, fn) -> None:
    """fn() -> Column giving the coefficient vector of a fit row."""
    ENCODERS[method] = fn


def encode(fits: DataFrame) -> DataFrame:
    """Coefficient vectors; registered encoders go before the built-in ones."""
    base = T.coefficient_vector(fits)
    vec = F.col("vector")
    for m, fn in ENCODERS.items():
        vec = F.when(F.col("method") == m, fn()).otherwise(vec)
    return base.withColumn("vector", vec)


def register_donor_engine(name: str, fn) -> None:
    """fn(targets, library) -> (id, donor)."""
    DONORS[name] = fn


register_donor_engine("nearest_dtw", lambda t, l: D.donors(t, l).select("id", "donor"))
register_donor_engine("class_shapelet", lambda t, l: t.join(D.class_shapelets(l).withColumnRenamed("label", "target"), "target").select("id", F.col("shapelet").alias("donor")))


def propose_donors(targets: DataFrame, library: DataFrame, engine: str) -> DataFrame:
    if engine not in DONORS:
        raise ValueError(f"unknown donor engine {engine!r}; registered: {sorted(DONORS)}")
    return DONORS[engine](targets, library)


def linear_constraint(points: DataFrame, constraint_id: str, weight: Column, target: Column):
    """(weights, targets) rows of one linear constraint on every series, for ``conservation.project_linear``."""
    w = points.select("series_id", F.lit(constraint_id).alias("constraint_id"), "t", weight.cast("double").alias("weight"))
    t = points.groupBy("series_id").agg(F.first(target.cast("double")).alias("target")).withColumn("constraint_id", F.lit(constraint_id))
    return w, t


def user_statistic(boot: DataFrame, statistic, key: str = "series_id") -> DataFrame:
    """Bootstrap interval of a user statistic: an aggregate Column, or a grouped-aggregate pandas UDF on ``value``."""
    from .operators.validation import bootstrap_ci, interval
    if isinstance(statistic, Column):
        return bootstrap_ci(boot, statistic, key)
    return interval(_by_replicate(boot, statistic.func, key), key)


def _by_replicate(boot: DataFrame, statistic: Callable, key: str) -> DataFrame:
    """(key, rep, _s): the function of each replicate's values; many small replicates share an Arrow batch, where a
    grouped aggregate would send each in one of its own."""
    rows = boot.select(key, "rep", "value").repartition(key, "rep").sortWithinPartitions(key, "rep")
    kinds = dict(rows.dtypes)

    def run(batches):
        at, parts = None, []                    # the replicate that the next batch may go on with

        def close():
            return (*at, statistic(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]))
        for pdf in batches:
            if not len(pdf):
                continue
            k, r = pdf[key].to_numpy(), pdf["rep"].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (r[1:] != r[:-1])) + 1).tolist(), len(pdf)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                head = (k[a], r[a])
                if at is not None and head != at:
                    out.append(close())
                    parts = []
                at = head
                parts.append(pdf["value"].iloc[a:b].reset_index(drop=True))
            yield pd.DataFrame(out, columns=[key, "rep", "_s"])
        if at is not None:
            yield pd.DataFrame([close()], columns=[key, "rep", "_s"])

    return rows.mapInPandas(run, f"{key} {kinds[key]}, rep {kinds['rep']}, _s double")


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions dtw_distance(a, b), keogh_envelope(v, r) and resample_series(v, n)."""
    @F.pandas_udf("double")
    def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(N.dtw(np.asarray([x], float), np.asarray([y], float))[0]) for x, y in zip(a, b)])

    @F.pandas_udf("upper array<double>, lower array<double>")
    def keogh_envelope(v: pd.Series, r: pd.Series) -> pd.DataFrame:
        out = [N.envelopes(np.asarray([x], float), int(k)) for x, k in zip(v, r)]
        return pd.DataFrame({"upper": [u[0].tolist() for u, _ in out], "lower": [l[0].tolist() for _, l in out]})

    @F.pandas_udf("array<double>")
    def resample_series(v: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([np.interp(np.linspace(0, len(x) - 1, int(k)), np.arange(len(x)), x).tolist() for x, k in zip(v, m)])
    fns = {"dtw_distance": dtw_distance, "keogh_envelope": keogh_envelope, "resample_series": resample_series}
    for name, fn in fns.items():
        spark.udf.register(name, fn)
    return sorted(fns)
