"""Segment metrics: a registry of column builders evaluated in one pass."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .layout import framed

METRICS: dict = {}


def register_metric(name: str):
    """Add a metric: f(aux) -> Column over a segment row (v, segment columns)."""
    def deco(fn):
        METRICS[name] = fn
        return fn
    return deco


def _v() -> Column:
    return F.col("v")


@register_metric("peak")
def _peak(aux):
    return F.array_max(_v())


@register_metric("trough")
def _trough(aux):
    return F.array_min(_v())


@register_metric("amplitude")
def _amplitude(aux):
    return F.array_max(_v()) - F.array_min(_v())


@register_metric("duration")
def _duration(aux):
    return F.size(_v()) * F.lit(float(aux.get("dt", 1.0)))


@register_metric("area")
def _area(aux):
    """Trapezoid integral; null under 2 points."""
    inner = (V.vsum(_v()) - (F.get(_v(), F.lit(0)) + F.element_at(_v(), -1)) / 2)
    return F.when(F.size(_v()) >= 2, inner * float(aux.get("dt", 1.0)))


@register_metric("bfi")
def _bfi(aux):
    """Baseflow over flow from the fit's component; null without one."""
    b = F.try_element_at("components", F.lit("baseflow"))
    return F.when(V.vsum(_v()) > 0, V.vsum(b) / V.vsum(_v()))


@register_metric("m0")
def _m0(aux):
    ks = ("shear_modulus", "fault_area", "slip_from_segment")
    if not all(k in aux for k in ks):
        return F.lit(None).cast("double")
    a = [aux[k] if isinstance(aux[k], Column) else F.lit(float(aux[k])) for k in ks]
    return a[0] * a[1] * a[2]


@register_metric("period")
def _period(aux):
    return fit_metric("period")


@register_metric("tau")
def _tau(aux):
    return fit_metric("tau")


def season(aux=None) -> Column:
    """Struct (sos, eos, threshold): first and last position at or above min + p % of the amplitude."""
    p = float((aux or {}).get("threshold_percent", 20.0)) / 100.0
    thr = V.let(F.struct(F.array_min(_v()).alias("a"), F.array_max(_v()).alias("b")), lambda s: s["a"] + p * (s["b"] - s["a"]))

    def ends(s):
        hit = F.filter(F.transform(s["v"], lambda x, i: F.when(x >= s["t"], i)), lambda i: i.isNotNull())
        return F.struct(F.get(hit, F.lit(0)).alias("sos"), F.element_at(hit, -1).alias("eos"), s["t"].alias("threshold"))
    ok = (F.size(_v()) >= 2) & (F.array_max(_v()) > F.array_min(_v()))
    return F.when(ok, V.let(F.struct(_v().alias("v"), thr.alias("t")), ends))


METRICS["sos"] = lambda aux: season(aux)["sos"].cast("double")
METRICS["eos"] = lambda aux: season(aux)["eos"].cast("double")


def fit_metric(name: str) -> Column:
    """Period from the coefficients; tau of the first feature of a transient pursuit."""
    if name == "period":
        return F.try_element_at("coefficients", F.lit("period"))
    return F.when(F.col("method") == "GrAtSiD", F.get("features.tau", F.lit(0)))


def metric_table(seg: DataFrame, names: list[str], aux: dict | None = None) -> DataFrame:
    """Chosen metrics per segment; a metric whose inputs are missing gives null."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; registered: {sorted(METRICS)}")
    have = set(seg.columns)
    need = {"bfi": {"components"}, "period": {"coefficients"}, "tau": {"method", "features"}}
    cols = [METRICS[n](aux or {}).cast("double").alias(n) if need.get(n, set()) <= have else F.lit(None).cast("double").alias(n) for n in names]
    return seg.select("series_id", "segment_id", *cols)


def permutation_entropy(points: DataFrame, m: int = 4, tau: int = 1, keys=("series_id",), t: str = "t") -> DataFrame:
    """Entropy of ordinal patterns: chunked windows, then pre-aggregated pattern counts."""
    span = (m - 1) * tau
    w = framed(points, 0, span, {"_w": lambda w: F.array(*[F.lead("value", k * tau).over(w()) for k in range(m)])}, keys, t)
    item = F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    pat = F.concat_ws(",", F.transform(F.array_sort(item), lambda e: e["i"].cast("string")))
    full = w.where(F.get("_w", F.lit(m - 1)).isNotNull())
    c = full.groupBy(*keys, pat.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(*keys).agg(F.sum("n").alias("_t"), F.sum(F.col("n") * F.ln("n")).alias("_nl"))
    return tot.select(*keys, (F.ln("_t") - F.col("_nl") / F.col("_t")).alias("permutation_entropy"))


def lag_correlations(points: DataFrame, max_lag: int, key: str = "series_id") -> DataFrame:
    """Autocorrelations at lags 1..max_lag, normalised by n * variance; lagged products are chunk-local."""
    mv = points.groupBy(key).agg(F.avg("value").alias("_m"), F.var_pop("value").alias("_s"), F.count(F.lit(1)).alias("n"))
    p = framed(points.join(mv, key).withColumn("_x", F.col("value") - F.col("_m")), 0, max_lag,
               {f"_l{k}": lambda w, k=k: F.lead("_x", k).over(w()) for k in range(1, max_lag + 1)}, (key,))
    s = p.groupBy(key, "_s", "n").agg(*[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"c{k}") for k in range(1, max_lag + 1)])
    rho = F.array(*[F.coalesce(F.col(f"c{k}"), F.lit(0.0)) / (F.col("n") * F.col("_s")) for k in range(1, max_lag + 1)])
    return s.select(key, "n", F.when(F.col("_s") > 0, rho).otherwise(F.array_repeat(F.lit(0.0), max_lag)).alias("rho"))


def block_length(points: DataFrame, k_n: int = 5, key: str = "series_id") -> DataFrame:
    """Automatic block length: flat-top kernel on the autocorrelations, cube root as fallback."""
    r = lag_correlations(points, 2 * k_n, key)
    n = F.col("n").cast("double")
    kn = F.least(F.lit(k_n), (F.col("n") - 2).cast("int"))
    cube = F.greatest(F.lit(1), F.ceil(F.pow(n, F.lit(1 / 3))))
    cut = 2.0 * F.sqrt(F.log10(n) / n)
    r = r.withColumns({"_rho": F.slice("rho", 1, F.greatest(2 * kn, F.lit(0))), "_cut": cut, "_kn": kn})
    hit = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_rho") - 1, F.lit(1))), lambda k: F.when(
        (F.abs(F.get("_rho", k - 1)) < F.col("_cut")) & (F.abs(F.get("_rho", k)) < F.col("_cut")), k)), lambda k: k.isNotNull())
    r = r.withColumn("_mh", F.coalesce(F.get(hit, F.lit(0)), F.greatest(F.lit(1), F.col("_kn")))).withColumn("_M", F.greatest(2 * F.col("_mh"), F.lit(2)))

    def sums(s):
        w = lambda k: F.when(k / s["M"] <= 0.5, 1.0).when(k / s["M"] <= 1.0, 2.0 * (1.0 - k / s["M"])).otherwise(0.0)
        ks = F.sequence(F.lit(1), s["M"])
        rho = lambda k: F.coalesce(F.get(s["r"], k - 1), F.lit(0.0))
        g0 = F.aggregate(ks, F.lit(1.0), lambda a, k: a + 2.0 * w(k) * rho(k))
        g1 = F.aggregate(ks, F.lit(0.0), lambda a, k: a + 2.0 * w(k) * k * rho(k))
        return F.struct(g0.alias("g0"), g1.alias("g1"))
    r = r.withColumn("_g", V.let(F.struct(F.col("_rho").alias("r"), F.col("_M").alias("M")), sums))
    b = F.ceil(F.pow(2.0 * F.col("_g.g0") * F.col("_g.g0") / F.col("_g.g1"), F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3)))
    flat = F.forall("_rho", lambda x: F.abs(x) <= 1e-8)
    length = (F.when((F.col("n") < 4) | flat, cube).when((F.col("_g.g0") <= 0) | (F.col("_g.g1") <= 0), cube)
              .otherwise(F.greatest(F.lit(1), b)))
    return r.select(key, length.cast("int").alias("block_length"))


def gini(counts: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Gini coefficient of counts per key, from a rank over each key's (few) categories."""
    w = W.partitionBy(*keys).orderBy(value, *[c for c in counts.columns if c not in keys and c != value])
    r = counts.withColumn("_i", F.row_number().over(w))
    g = r.groupBy(*keys).agg(F.sum(F.col("_i") * F.col(value)).alias("_w"), F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    v = F.col("_w") * 2 / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n")
    return g.select(*keys, F.when(F.col("_s") > 0, v).otherwise(0.0).alias("gini"))


# --- two-sample discrepancy -------------------------------------------------------------------

def bandwidth(sample: Column) -> Column:
    """Median of pairwise distances of a bounded sample; 1 when it vanishes (numpy, Arrow batches)."""
    def run(v: pd.Series) -> pd.Series:
        import numpy as np
        out = []
        for row in v:
            x = np.asarray(row, float)
            d = np.abs(x[:, None] - x[None])[np.triu_indices(len(x), 1)]
            m = float(np.median(d)) if len(d) else 1.0
            out.append(m if m > 0 else 1.0)
        return pd.Series(out, dtype="float64")
    return F.pandas_udf(run, "double")(sample)


def mmd_linear(samples: DataFrame, keys: list[str], cap: int = 500) -> DataFrame:
    """Linear-time discrepancy of two samples per key.

    ``samples``: keys, side ('x' or 'y'), i (0-based position), value.  Pairs are
    formed by index parity in one grouped pass; the bandwidth reads at most
    ``cap`` evenly spaced positions.
    """
    n = samples.groupBy(*keys).agg(F.count_if(F.col("side") == "x").alias("_nx"), F.count_if(F.col("side") == "y").alias("_ny"))
    n = n.withColumn("n_pairs", F.floor(F.least("_nx", "_ny") / 2)).where("n_pairs >= 1")
    s = samples.join(n, keys).where(F.col("i") < 2 * F.col("n_pairs"))
    pos = F.col("i") + F.when(F.col("side") == "y", 2 * F.col("n_pairs")).otherwise(0)
    tot = 4 * F.col("n_pairs")
    j = F.ceil(pos * (cap - 1) / (tot - 1))
    keep = (tot <= cap) | (F.floor(j * (tot - 1) / (cap - 1)) == pos)
    bw = s.where(keep).groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("_v")).select(*keys, bandwidth(F.col("_v")).alias("bandwidth"))
    at = lambda side, par: F.max(F.when((F.col("side") == side) & (F.col("i") % 2 == par), F.col("value")))
    pr = s.groupBy(*keys, "n_pairs", F.floor(F.col("i") / 2).alias("_k")).agg(at("x", 0).alias("xa"), at("x", 1).alias("xb"), at("y", 0).alias("ya"), at("y", 1).alias("yb"))
    pr = pr.join(bw, keys)
    k = lambda a, b: F.exp(-(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) / (2 * F.col("bandwidth") * F.col("bandwidth")))
    h = k("xa", "xb") + k("ya", "yb") - k("xa", "yb") - k("xb", "ya")
    g = pr.groupBy(*keys, "n_pairs", "bandwidth").agg(F.avg(h).alias("mmd2"), F.sqrt(F.var_pop(h) / F.max("n_pairs")).alias("std_err"))
    return g.withColumn("z_score", F.col("mmd2") / F.greatest("std_err", F.lit(1e-6)))


def capped_sample(df: DataFrame, keys: list[str], order: Column, cap: int = 500) -> DataFrame:
    """``cap`` rows per key by hash order, pre-cut in salted parts (the sampling step of the quadratic test)."""
    p = df.withColumn("_h", order).withColumn("_p", F.pmod(F.xxhash64("_h"), F.lit(64)))
    p = p.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_p").orderBy("_h"))).where(F.col("_r") <= cap)
    return p.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= cap).drop("_h", "_p", "_r")


def mmd_quadratic(samples: DataFrame, keys: list[str], order: Column, cap: int = 500) -> DataFrame:
    """Biased quadratic discrepancy over at most ``cap`` rows per side."""
    s = capped_sample(samples, [*keys, "side"], order, cap)
    side = lambda x: F.sort_array(F.collect_list(F.when(F.col("side") == x, F.col("value"))))
    g = s.groupBy(*keys).agg(side("x").alias("_x"), side("y").alias("_y"))
    g = g.withColumn("bandwidth", bandwidth(F.concat("_x", "_y")))
    return g.select(*keys, "bandwidth", kernel_mmd(F.col("_x"), F.col("_y"), F.col("bandwidth")).alias("mmd2"))


def kernel_mmd(x: Column, y: Column, bw: Column) -> Column:
    """Biased squared discrepancy of two bounded samples under a Gaussian kernel (numpy, Arrow batches)."""
    def run(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.Series:
        import numpy as np
        k = lambda u, w, h: np.exp(-(u[:, None] - w[None]) ** 2 / (2 * h * h)).mean()
        out = []
        for p, q, h in zip(a, b, s):
            u, w = np.asarray(p, float), np.asarray(q, float)
            out.append(k(u, u, h) + k(w, w, h) - 2 * k(u, w, h) if len(u) and len(w) else float("nan"))
        return pd.Series(out, dtype="float64")
    return F.pandas_udf(run, "double")(x, y, bw)


def beta_tail(x: Column, a: Column, b: Column) -> Column:
    """1 - I_x(a, b), the regularised incomplete beta complement, continued fraction in Arrow batches."""
    def run(xs: "pd.Series", aa: "pd.Series", bb: "pd.Series") -> "pd.Series":
        out = []
        for x0, p, q in zip(xs, aa, bb):
            out.append(None if x0 is None or x0 != x0 else 1.0 - _betainc(x0, p, q))
        return pd.Series(out, dtype="float64")
    run.__annotations__ = {"xs": pd.Series, "aa": pd.Series, "bb": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(x, a, b)


def _betainc(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _betainc(1 - x, b, a)
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / max(1e-300, 1.0 + num * d) if abs(1.0 + num * d) > 1e-300 else 1e300
        c = 1.0 + num / c
        f *= c * d
        if abs(1.0 - c * d) < 1e-13:
            break
    return front * (f - 1.0) / a


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Upper tail of the F distribution."""
    x = d1 * f / (d1 * f + d2)
    return beta_tail(x.cast("double"), (d1 / 2.0).cast("double"), (d2 / 2.0).cast("double"))


def variance_ratio(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Energy of the residuals after over before, scaled to an F statistic; columns side ('pre'/'post'), value."""
    e = lambda s: F.sum(F.when(F.col("side") == s, F.col("value") * F.col("value")))
    g = residuals.groupBy(*keys).agg(e("pre").alias("_a"), e("post").alias("_b"), F.count_if(F.col("side") == "pre").alias("_na"),
                                     F.count_if(F.col("side") == "post").alias("_nb")).where("_na >= 2 and _nb >= 2")
    g = g.withColumns({"ratio": F.try_divide("_b", "_a"), "df_pre": F.col("_na") - 1, "df_post": F.col("_nb") - 1})
    g = g.withColumn("f_statistic", F.col("ratio") * F.col("df_pre") / F.greatest(F.col("df_post"), F.lit(1)))
    return g.withColumn("p_value", f_tail(F.col("f_statistic"), F.col("df_post"), F.col("df_pre"))).drop("_a", "_b", "_na", "_nb")
