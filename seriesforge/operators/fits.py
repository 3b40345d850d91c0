"""Decomposition fits.

A fit is one row per segment: method, ``components`` map<string, array<double>>
(their sum is the signal) and ``coefficients`` map<string, double>.  Linear
models gather X'X and X'y as partial aggregates, so points of one long segment
spread over tasks; only the small p x p system meets numpy.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from .layout import FOLD, fold_clamped_affine, framed

KEYS = ("series_id", "segment_id")


def cmap(**items: Column) -> Column:
    return F.create_map(*[x for k, c in items.items() for x in (F.lit(k), c)])


def _fill(v: Column, value: Column) -> Column:
    return V.let(F.struct(v.alias("v"), value.cast("double").alias("x")), lambda s: F.transform(s["v"], lambda _: s["x"]))


def _sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def constant(seg: DataFrame) -> DataFrame:
    """Level + residual."""
    level = V.vmean(F.col("v"))
    trend = _fill(F.col("v"), level)
    return seg.withColumns({"method": F.lit("Constant"), "components": cmap(trend=trend, residual=_sub(F.col("v"), trend)),
                            "coefficients": cmap(level=level)})


def noise_model(seg: DataFrame) -> DataFrame:
    """Mean + noise level."""
    level = V.vmean(F.col("v"))
    mean = _fill(F.col("v"), level)
    return seg.withColumns({"method": F.lit("NoiseModel"), "components": cmap(mean=mean, residual=_sub(F.col("v"), mean)),
                            "coefficients": cmap(level=level, std=V.vstd(F.col("v")))})


def delta(seg: DataFrame) -> DataFrame:
    """Baseline + impulse at the largest deviation from the mean."""
    from .edits import peak_position
    k = peak_position(V.center(F.col("v")), 9)      # a peak and a trough at equal distance differ by rounding only
    s = seg.where(F.size("v") > 1).withColumn("_k", k)
    x = F.get("v", F.col("_k"))
    s = s.withColumn("_b", (V.vsum(F.col("v")) - x) / (F.size("v") - 1))
    base = _fill(F.col("v"), F.col("_b"))
    imp = V.let(F.struct("v", "_k", "_b"), lambda q: F.transform(q["v"], lambda y, i: F.when(i == q["_k"], y - q["_b"]).otherwise(0.0)))
    res = V.let(F.struct("v", "_k", "_b"), lambda q: F.transform(q["v"], lambda y, i: F.when(i == q["_k"], 0.0).otherwise(y - q["_b"])))
    return s.withColumns({"method": F.lit("Delta"), "components": cmap(baseline=base, impulse=imp, residual=res),
                          "coefficients": cmap(peak_index=F.col("_k").cast("double"), peak_amplitude=x - F.col("_b"),
                                               baseline=F.col("_b"))}).drop("_k", "_b")


# --- linear trajectory models ------------------------------------------------------------

def etm_design(steps=(), transients=(), periods=()) -> dict:
    """Basis functions of time by name: intercept, rate, steps, log/exp transients, harmonics."""
    d = {"x0": lambda t: t * 0.0 + 1.0, "linear_rate": lambda t: t}
    step = lambda ts: lambda t: F.when(t >= ts, 1.0).otherwise(0.0)
    log = lambda r, tau: lambda t: F.log1p(F.greatest(F.lit(0.0), (t - r) / tau))
    exp = lambda r, tau: lambda t: F.exp(-F.greatest(F.lit(0.0), (t - r) / tau))
    sin = lambda p: lambda t: F.sin(2 * math.pi * t / p)
    cos = lambda p: lambda t: F.cos(2 * math.pi * t / p)
    for ts in steps:
        d[f"step_at_{float(ts):.6g}"] = step(float(ts))
    for r, tau, kind in transients:
        tau = max(float(tau), 1e-12)
        if kind in ("log", "both"):
            d[f"log_{float(r):.6g}_tau{tau:.6g}"] = log(float(r), tau)
        if kind in ("exp", "both"):
            d[f"exp_{float(r):.6g}_tau{tau:.6g}"] = exp(float(r), tau)
    for p in periods:
        d[f"sin_{float(p):.6g}"], d[f"cos_{float(p):.6g}"] = sin(float(p)), cos(float(p))
    return d


def solve(gram: Column, rhs: Column) -> Column:
    """Least-squares solution of the normal equations (row-major upper triangle), Arrow batches."""
    def run(g: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np
        out = []
        for gu, y in zip(g, b):
            if gu is None or y is None or any(z is None or z != z for z in gu):
                out.append(None)
                continue
            p = len(y)
            A = np.zeros((p, p))
            A[np.triu_indices(p)] = gu
            A = A + np.triu(A, 1).T
            # Equilibrate before solving: time powers and flags differ widely in size.
            s = 1 / np.sqrt(np.where(np.diag(A) > 0, np.diag(A), 1))
            out.append((s * (np.linalg.pinv(A * s[:, None] * s, rcond=1e-13, hermitian=True) @ (s * np.asarray(y, float)))).tolist())
        return pd.Series(out)
    return F.pandas_udf(run, "array<double>")(gram, rhs)


def normal_sums(design: list[Column], y: Column) -> tuple[Column, Column]:
    """Aggregates: upper triangle of X'X and X'y."""
    p = len(design)
    return (F.array(*[F.sum(design[i] * design[j]) for i in range(p) for j in range(i, p)]),
            F.array(*[F.sum(design[i] * y) for i in range(p)]))


def linear_coefficients(points: DataFrame, design: dict, keys=KEYS, t: Column | None = None,
                        value: str = "value") -> DataFrame:
    """Coefficients map per key; fewer points than terms give the mean alone."""
    tc = (F.col("t") if t is None else t).cast("double")
    cols = [f(tc) for f in design.values()]
    g, b = normal_sums(cols, F.col(value))
    sums = points.groupBy(*keys).agg(g.alias("_g"), b.alias("_b"), F.count(value).alias("_n"), F.avg(value).alias("_m"))
    names = F.array(*[F.lit(k) for k in design])
    sums = sums.withColumn("_x", solve(F.col("_g"), F.col("_b")))
    short = F.map_from_arrays(F.array(F.lit("x0"), F.lit("linear_rate")), F.array(F.col("_m"), F.lit(0.0)))
    return sums.select(*keys, F.when(F.col("_n") < len(design), short).otherwise(F.map_from_arrays(names, "_x")).alias("coefficients"),
                       F.col("_n").alias("n"))


def etm(seg_points: DataFrame, steps=(), transients=(), periods=(), t: str = "t") -> DataFrame:
    """Fit row per segment of the trajectory model; time is the ``t`` column."""
    design = etm_design(steps, transients, periods)
    co = linear_coefficients(seg_points, design, KEYS, F.col(t))
    arr = seg_points.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), "value"))).alias("_i"))
    j = arr.join(co, list(KEYS)).withColumns({"v": F.col("_i.value"), "ts": F.col("_i.t")}).drop("_i")
    part = lambda name, f: V.let(F.struct(F.col("ts"), F.coalesce(F.try_element_at("coefficients", F.lit(name)), F.lit(0.0)).alias("c")),
                                 lambda s: F.transform(s["ts"], lambda x: s["c"] * f(x)))
    j = j.withColumn("components", F.create_map(*[x for n, f in design.items() for x in (F.lit(n), part(n, f))]))
    j = j.withColumn("residual", _sub(F.col("v"), total(F.col("components"), F.size("v"))))
    return j.withColumns({"method": F.lit("ETM"), "components": F.map_concat("components", F.create_map(F.lit("residual"), F.col("residual"))),
                          "rmse": F.sqrt(V.sq_norm(F.col("residual")) / F.size("v"))})


def total(components: Column, n: Column) -> Column:
    """Sum of all components."""
    zeros = F.array_repeat(F.lit(0.0), n)
    return F.aggregate(F.map_values(components), zeros, lambda a, c: F.zip_with(a, c, lambda x, y: x + y))


def reassemble(fit: DataFrame, out: str = "signal") -> DataFrame:
    n = F.size(F.get(F.map_values("components"), F.lit(0)))
    return fit.withColumn(out, total(F.col("components"), n))


def replace_coefficients(fit: DataFrame, new: Column) -> DataFrame:
    """Overwrite the given coefficients, keep the rest and the components."""
    keep = F.map_filter("coefficients", lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return fit.withColumn("coefficients", F.map_concat(keep, new))


def components_long(fit: DataFrame) -> DataFrame:
    c = fit.select(*KEYS, F.explode("components").alias("component", "_v"))
    return c.select(*KEYS, "component", F.posexplode("_v").alias("pos", "value"))


def coefficients_long(fit: DataFrame) -> DataFrame:
    return fit.select(*KEYS, "method", F.explode("coefficients").alias("name", "value"))


def coefficient_vector(fit: DataFrame) -> DataFrame:
    """Fixed-length vector of a fit by method; other methods give count, mean, std and max of their scalars."""
    c = lambda n: F.coalesce(F.try_element_at("coefficients", F.lit(n)), F.lit(0.0))
    steps = F.map_values(F.map_filter("coefficients", lambda k, v: k.startswith("step_at_")))
    vals = F.map_values("coefficients")
    mean_abs = F.when(F.size(steps) > 0, V.vmean(F.transform(steps, lambda x: F.abs(x)))).otherwise(0.0)
    etm_v = F.array(c("x0"), c("linear_rate"), F.size(steps).cast("double"), mean_abs)
    other = F.when(F.size(vals) == 0, F.array_repeat(F.lit(0.0), F.lit(4))).otherwise(F.array(
        F.size(vals).cast("double"), V.vmean(vals), V.vstd(vals), F.array_max(F.transform(vals, lambda x: F.abs(x)))))
    return fit.withColumn("vector", F.when(F.col("method") == "Constant", F.array(c("level")))
                          .when(F.col("method") == "ETM", etm_v).otherwise(other))


# --- seasonal splits on long series ----------------------------------------------------------

def seasonal_split(points: DataFrame, period: int, robust: bool = False, key: str = "series_id",
                   value: str = "value", tag: str = "") -> DataFrame:
    """Additive split: centred moving average, phase means (or medians) of the rest, re-centred to zero.

    The moving average runs per chunk with a halo; the phase table has at most
    ``period`` rows per series and is pre-aggregated.
    """
    h = period // 2
    x = F.col(value)
    p = framed(points, h, h, {"_full": lambda w: F.avg(x).over(w(-h, h)),
                              "_inner": lambda w: F.avg(x).over(w(-h, h - 1)) if period % 2 == 0 else F.avg(x).over(w(-h, h)),
                              "_outer": lambda w: F.avg(x).over(w(-h + 1, h)) if period % 2 == 0 else F.avg(x).over(w(-h, h))}, (key,))
    p = p.withColumn("trend", (F.col("_inner") + F.col("_outer")) / 2 if period % 2 == 0 else F.col("_full"))
    p = p.withColumn("_ph", F.col("t") % period)
    d = x - F.col("trend")
    ph = p.groupBy(key, "_ph").agg((F.median(d) if robust else F.avg(d)).alias("_s"))
    centre = ph.groupBy(key).agg(F.avg("_s").alias("_c"))
    ph = ph.join(centre, key).select(key, "_ph", (F.col("_s") - F.col("_c")).alias(f"seasonal{tag}"))
    out = p.join(ph, [key, "_ph"]).drop("_full", "_inner", "_outer", "_ph")
    return out.withColumn("residual", x - F.col("trend") - F.col(f"seasonal{tag}"))


def multi_seasonal(points: DataFrame, periods: list[int], key: str = "series_id") -> DataFrame:
    """Seasonal splits in turn, ascending.  Each series takes the periods that fit in it twice (2 p < n); a season it
    cannot have is null, and without any its trend is null and its residual the value."""
    n = points.groupBy(key).agg((F.max("t") + 1).alias("_n"))
    work = points.drop("trend", "residual").join(n, key).withColumns({"_y": F.col("value"), "_was": F.lit(None).cast("double")})
    names = []
    for p in valid_periods(points, periods, key):
        name = f"seasonal_{p}"
        fits = 2 * p < F.col("_n")
        s = seasonal_split(work, p, key=key, value="_y", tag=f"_{p}")
        s = s.withColumns({name: F.when(fits, F.col(name)), "_was": F.when(fits, F.col("trend")).otherwise(F.col("_was"))})
        work = s.withColumn("_y", F.col("_y") - F.coalesce(name, F.lit(0.0))).drop("trend", "residual")
        names.append(name)
    told = sum((F.coalesce(n, F.lit(0.0)) for n in names), F.coalesce("_was", F.lit(0.0)))
    return work.withColumn("residual", F.col("value") - told).withColumnRenamed("_was", "trend").drop("_y", "_n")


def valid_periods(points: DataFrame, periods: list[int], key: str = "series_id") -> list[int]:
    """Periods that fit twice in the longest series, ascending; shorter series are judged by themselves."""
    n = points.agg(F.max("t")).first()[0]
    return [p for p in sorted(set(periods)) if n is not None and 2 <= p and 2 * p < n + 1]


# --- baseflow --------------------------------------------------------------------------------

def baseflow(points: DataFrame, bfi_max: float = 0.8, a: float = 0.98, key: str = "series_id") -> DataFrame:
    """Two-parameter recursive filter as a parallel fold."""
    d = 1.0 - a * bfi_max
    b = fold_clamped_affine(points, F.lit((1 - bfi_max) * a / d), F.lit((1 - a) * bfi_max / d) * F.col("value"),
                            hi=F.col("value"), start=F.col("value") * bfi_max, out="baseflow", key=key)
    return b.withColumn("quickflow", F.col("value") - F.col("baseflow"))


def baseflow_array(v: Column, bfi_max: float = 0.8, a: float = 0.98) -> Column:
    """The same filter over one segment array."""
    d = 1.0 - a * bfi_max
    k1, k2 = (1 - bfi_max) * a / d, (1 - a) * bfi_max / d
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<double>").alias("o"))

    def step(s, x):
        y = F.when(s["y"].isNull(), x * bfi_max).otherwise(F.least(k1 * s["y"] + k2 * x, x))
        return F.struct(y.alias("y"), F.concat(s["o"], F.array(y)).alias("o"))
    return F.aggregate(v, start, step, lambda s: s["o"])


def calibrate_baseflow(points: DataFrame, recessions: DataFrame, fallback: float = 0.98) -> DataFrame:
    """(a, bfi_max) per series: recession constant from log ratios inside flagged spans [start, end), then the
    one-parameter filter, folded as q_t = clamp(a q_{t-1} + c_t, 0, Q_t)."""
    from .layout import attach_segments
    nxt = framed(points, 1, 1, {"_n": lambda w: F.lead("value").over(w()), "_p": lambda w: F.lag("value").over(w())})
    spans = recessions.select("series_id", "start_index", (F.col("end_index") - 2).alias("end_index"))
    in_span = attach_segments(nxt, spans, keep=("start_index", "end_index"))
    ratio = F.when((F.col("value") > 0) & (F.col("_n") > 0), F.ln(F.col("_n") / F.col("value")))
    a = in_span.groupBy("series_id").agg(F.exp(F.avg(ratio)).alias("_a"))
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    every = points.select("series_id").distinct().join(a, "series_id", "left").select(
        "series_id", clip(F.coalesce("_a", F.lit(fallback)), 0.5, 0.999).alias("a"))
    j = nxt.join(every, "series_id")
    q = fold_clamped_affine(j, F.col("a"), 0.5 * (1 + F.col("a")) * (F.col("value") - F.col("_p")),
                            hi=F.col("value"), lo=F.lit(0.0), start=F.lit(0.0), out="_q")
    s = q.groupBy("series_id", "a").agg(F.sum(F.col("value") - F.col("_q")).alias("_b"), F.sum("value").alias("_t"))
    return s.select("series_id", "a", clip(F.when(F.col("_t") > 0, F.col("_b") / F.col("_t")).otherwise(0.8), 0.05, 0.95).alias("bfi_max"))


# --- choice of fit ------------------------------------------------------------------------------

# Fit method by shape and domain; the empty domain is the fallback.
DISPATCH = {
    ("plateau", ""): "Constant", ("trend", "remote-sensing"): "LandTrendr", ("trend", ""): "ETM", ("step", ""): "ETM",
    ("spike", ""): "Delta", ("cycle", "multi-period"): "MSTL", ("cycle", ""): "STL",
    ("transient", "seismo-geodesy"): "GrAtSiD", ("transient", ""): "ETM", ("noise", ""): "NoiseModel",
}


def method_for(shape: Column, domain: Column) -> Column:
    """Fit method of a (shape, domain) pair; null for an unknown shape."""
    from ..config import lookup
    table = {f"{s}|{d}": m for (s, d), m in DISPATCH.items()}
    return F.coalesce(lookup(table, F.concat_ws("|", shape, F.coalesce(domain, F.lit("")))),
                      lookup(table, F.concat(shape, F.lit("|"))))


# --- breaks, trajectories, pursuit: bounded rounds over the fleet ----------------------------------

def _moments(points: DataFrame, value: str, key: str, t: str = "t") -> DataFrame:
    """Running sums of 1, t, x, t*x, t*t, x*x."""
    from .layout import running_sums
    x, u = F.col(value), F.col(t).cast("double")
    return running_sums(points, {"m_n": F.lit(1.0), "m_t": u, "m_x": x, "m_tx": u * x, "m_tt": u * u, "m_xx": x * x}, (key,), t)


def _rss(n, st, sx, stx, stt, sxx) -> Column:
    """Residual sum of squares of a line from moment sums."""
    vx, vt, c = sxx - sx * sx / n, stt - st * st / n, stx - st * sx / n
    return F.greatest(F.when(vt > 1e-9, vx - c * c / vt).otherwise(vx), F.lit(0.0))


MOM = ("m_n", "m_t", "m_x", "m_tx", "m_tt", "m_xx")


def break_round(pre: DataFrame, intervals: DataFrame, h: float, key: str = "series_id") -> DataFrame:
    """Best split of every open interval by residual sum of squares, with its F statistic.

    ``pre`` carries prefix moments; ``intervals``: key, a, b (end exclusive), prefix moments at both ends
    (a_*, b_*) and the least piece length h_min.
    """
    j = pre.join(intervals, key).where((F.col("t") + 1 >= F.col("a") + F.col("h_min")) & (F.col("t") + 1 <= F.col("b") - F.col("h_min")))
    left = _rss(*[F.col(m) - F.col(f"a_{m}") for m in MOM])
    right = _rss(*[F.col(f"b_{m}") - F.col(m) for m in MOM])
    full = _rss(*[F.col(f"b_{m}") - F.col(f"a_{m}") for m in MOM])
    best = j.groupBy(key, "a", "b").agg(F.min(F.struct((left + right).alias("rss"), (F.col("t") + 1).alias("k"), *MOM)).alias("_m"),
                                        F.first(full).alias("_full"))
    df = F.col("b") - F.col("a") - 4
    f = (F.col("_full") - F.col("_m.rss")) / 2.0 / (F.col("_m.rss") / df)
    return best.select(key, "a", "b", F.col("_m.k").cast("int").alias("k"), *[F.col(f"_m.{m}").alias(f"k_{m}") for m in MOM],
                       F.when((df > 0) & (F.col("_m.rss") > 0), f).alias("f_stat"), df.alias("df"))


def f_critical(df: Column) -> Column:
    """5 % point of F(2, df): closed form (df / 2) (0.05 ** (-2 / df) - 1)."""
    return df / 2.0 * (F.pow(F.lit(0.05), -2.0 / df) - 1.0)


def trend_breaks(points: DataFrame, value: str = "value", h: float = 0.15, max_depth: int = 4, key: str = "series_id") -> DataFrame:
    """Break positions by recursive best splits with an F test; depth bounds the rounds."""
    from .layout import cut_lineage
    pre = cut_lineage(_moments(points, value, key).select(key, "t", *MOM))
    end = pre.groupBy(key).agg(F.max_by(F.struct(*MOM), "t").alias("_e"), (F.max("t") + 1).alias("b"))
    open_ = end.select(key, F.lit(0).alias("a"), F.col("b").cast("int").alias("b"), *[F.lit(0.0).alias(f"a_{m}") for m in MOM],
                       *[F.col(f"_e.{m}").alias(f"b_{m}") for m in MOM], F.greatest(F.lit(2), F.rint(h * F.col("b")).cast("int")).alias("h_min"))
    found = None
    for _ in range(max_depth):
        r = break_round(pre, open_, h, key).where(F.col("f_stat") > f_critical(F.col("df")))
        hit = cut_lineage(r.join(open_, [key, "a", "b"]))
        b = hit.select(key, F.col("k").alias("break_at"))
        found = b if found is None else found.unionByName(b)
        lo = hit.select(key, "a", F.col("k").alias("b"), *[f"a_{m}" for m in MOM], *[F.col(f"k_{m}").alias(f"b_{m}") for m in MOM], "h_min")
        hi = hit.select(key, F.col("k").alias("a"), "b", *[F.col(f"k_{m}").alias(f"a_{m}") for m in MOM], *[f"b_{m}" for m in MOM], "h_min")
        open_ = lo.unionByName(hi)
    return found


def best_single_break(points: DataFrame, value: str = "value", h: float = 0.15, key: str = "series_id") -> DataFrame:
    return trend_breaks(points, value, h, 1, key)


def piecewise_trend(points: DataFrame, breaks: DataFrame, value: str = "value", key: str = "series_id") -> DataFrame:
    """Line per piece between breaks; the piece of a point is an as-of lookup."""
    from .layout import asof
    starts = breaks.select(key, F.col("break_at").alias("t"), F.col("break_at").alias("piece"))
    p = asof(points, starts, ["piece"], (key,)).withColumn("piece", F.coalesce("piece", F.lit(0)))
    l = p.groupBy(key, "piece").agg(F.regr_slope(value, "t").alias("_b"), F.regr_intercept(value, "t").alias("_a"), F.avg(value).alias("_m"))
    j = p.join(l, [key, "piece"])
    return j.withColumn("trend", F.coalesce(F.col("_a") + F.col("_b") * F.col("t"), "_m")).drop("_a", "_b", "_m")


def season_and_breaks(points: DataFrame, period: int = 12, h: float = 0.15, rounds: int = 3, harmonics: int | None = None,
                      max_depth: int = 3, key: str = "series_id"):
    """Seasonal harmonics and piecewise trend in turn; (components, breaks).  Each round is one harmonic regression and
    one break search; ``rounds`` is at most ten, as in the published procedure."""
    from .layout import cut_lineage
    k = min(3, period // 2) if harmonics is None else harmonics
    design = {}
    for i in range(1, k + 1):
        w = 2 * math.pi * i / period
        design[f"c{i}"] = (lambda w: lambda t: F.cos(t * w))(w)
        design[f"s{i}"] = (lambda w: lambda t: F.sin(t * w))(w)
    cur = points.select(key, "t", "value").withColumns({"trend": F.lit(0.0)})
    breaks = None
    for _ in range(rounds):
        work = cur.withColumn("_d", F.col("value") - F.col("trend"))
        co = linear_coefficients(work, design, (key,), value="_d").drop("n")
        t = F.col("t").cast("double")
        seas = sum((F.coalesce(F.try_element_at("coefficients", F.lit(n)), F.lit(0.0)) * f(t) for n, f in design.items()), F.lit(0.0))
        work = cut_lineage(work.join(co, key).select(key, "t", "value", seas.alias("seasonal")).withColumn("_y", F.col("value") - F.col("seasonal")))
        breaks = trend_breaks(work, "_y", h, max_depth, key)
        cur = cut_lineage(piecewise_trend(work, breaks, "_y", key).select(key, "t", "value", "seasonal", "trend"))
    return cur.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")), breaks


def vertex_fit(points: DataFrame, vertices: DataFrame, key="id") -> DataFrame:
    """Least-squares heights of inner vertices of a piecewise-linear curve with fixed ends.

    ``points``: key, t, value; ``vertices``: key, vx (sorted array of t), y0, y1.  Hat weights touch two vertices per
    point; the normal equations are group sums, solved per key.
    """
    j = points.join(vertices, key)
    i = F.greatest(F.lit(0), F.least(F.size(F.filter("vx", lambda x: x <= F.col("t"))) - 1, F.size("vx") - 2))
    j = j.withColumn("_i", i)
    a, b = F.get("vx", F.col("_i")), F.get("vx", F.col("_i") + 1)
    w = (F.col("t") - a) / (b - a)
    j = j.withColumn("_w", w)
    last = F.size("vx") - 1
    known = F.when(F.col("_i") == 0, (1 - F.col("_w")) * F.col("y0")).otherwise(0.0) + F.when(F.col("_i") + 1 == last, F.col("_w") * F.col("y1")).otherwise(0.0)
    y = F.col("value") - known
    return j.groupBy(key, "vx", "y0", "y1", "_i").agg(
        F.sum((1 - F.col("_w")) * (1 - F.col("_w"))).alias("ll"), F.sum(F.col("_w") * F.col("_w")).alias("rr"), F.sum(F.col("_w") * (1 - F.col("_w"))).alias("lr"),
        F.sum((1 - F.col("_w")) * y).alias("ly"), F.sum(F.col("_w") * y).alias("ry"), F.sum(y * y).alias("yy"))


def solve_vertices(sums: DataFrame, key="id") -> DataFrame:
    """Vertex heights and squared error from the per-piece sums."""
    g = sums.groupBy(key, "vx", "y0", "y1").agg(F.array_sort(F.collect_list(F.struct("_i", "ll", "rr", "lr", "ly", "ry", "yy"))).alias("_s"))

    def run(vx: pd.Series, y0: pd.Series, y1: pd.Series, s: pd.Series) -> pd.DataFrame:
        import numpy as np
        hs, es = [], []
        for v, a, b, rows in zip(vx, y0, y1, s):
            m = len(v)
            A, r, yy = np.zeros((m, m)), np.zeros(m), 0.0
            for q in rows:
                i = q["_i"]
                A[i, i] += q["ll"]
                A[i + 1, i + 1] += q["rr"]
                A[i, i + 1] += q["lr"]
                A[i + 1, i] += q["lr"]
                r[i] += q["ly"]
                r[i + 1] += q["ry"]
                yy += q["yy"]
            inner = np.arange(1, m - 1)
            h = np.linalg.pinv(A[np.ix_(inner, inner)]) @ r[inner] if m > 2 else np.zeros(0)
            hs.append([a, *h.tolist(), b])
            es.append(max(yy - 2 * float(h @ r[inner]) + float(h @ A[np.ix_(inner, inner)] @ h), 0.0) if m > 2 else yy)
        return pd.DataFrame({"vy": hs, "sse": es})
    u = F.pandas_udf(run, "vy array<double>, sse double")
    return g.withColumn("_f", u("vx", "y0", "y1", "_s")).select(key, "vx", "y0", "y1", F.col("_f.vy").alias("vy"), F.col("_f.sse").alias("sse"))


def trajectory(points: DataFrame, max_vertices: int = 6, penalty: float = 0.1, recovery: float = 0.25, key: str = "series_id") -> DataFrame:
    """Piecewise-linear trajectory: grow vertices at the largest residual, prune by the least error rise, choose by
    error + penalty * vertices; slopes and recovery flags.  Rounds are bounded by 4 * max_vertices."""
    from .layout import cut_lineage
    p = cut_lineage(points.select(F.col(key).alias("id"), F.col("t").cast("double").alias("t"), "value"))
    v = p.groupBy("id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.min_by("value", "t").alias("y0"), F.max_by("value", "t").alias("y1"), F.count(F.lit(1)).alias("n")).where("n > 1")
    v = cut_lineage(v.select("id", F.array("a", "b").alias("vx"), "y0", "y1"))

    def curve(d, fit):
        j = d.join(fit, "id")
        i = F.greatest(F.lit(0), F.least(F.size(F.filter("vx", lambda x: x <= F.col("t"))) - 1, F.size("vx") - 2))
        j = j.withColumn("_i", i)
        xa, xb, ya, yb = F.get("vx", F.col("_i")), F.get("vx", F.col("_i") + 1), F.get("vy", F.col("_i")), F.get("vy", F.col("_i") + 1)
        return j.withColumn("fit", ya + (yb - ya) * (F.col("t") - xa) / (xb - xa))
    for _ in range(2 * max_vertices - 2):
        fit = solve_vertices(vertex_fit(p, v))
        c = curve(p, fit).where(~F.array_contains("vx", F.col("t")))
        worst = c.groupBy("id").agg(F.max(F.struct(F.abs(F.col("value") - F.col("fit")).alias("r"), (-F.col("t")).alias("m"))).alias("_m"))
        j = v.join(worst, "id", "left")
        grow = F.coalesce(F.col("_m.r") > 1e-12, F.lit(False))
        v = cut_lineage(j.select("id", F.when(grow, F.array_sort(F.concat("vx", F.array(-F.col("_m.m"))))).otherwise(F.col("vx")).alias("vx"), "y0", "y1"))
    history = cut_lineage(solve_vertices(vertex_fit(p, v)))
    kept = history
    cur = v
    for _ in range(2 * max_vertices - 2):
        trial = cur.where(F.size("vx") > 2).withColumn("drop", F.explode(F.sequence(F.lit(1), F.size("vx") - 2)))
        trial = trial.select(F.struct("id", "drop").alias("k"), F.filter("vx", lambda x, i: i != F.col("drop")).alias("vx"), "y0", "y1", "id")
        s = solve_vertices(vertex_fit(p.withColumnRenamed("id", "_pid").join(trial.select("k", F.col("id").alias("_pid")), "_pid").drop("_pid"), trial.drop("id"), "k"), "k")
        s = s.select("k.id", "vx", "y0", "y1", "vy", "sse")
        best = s.groupBy("id").agg(F.min(F.struct("sse", "vx", "vy", "y0", "y1")).alias("_b")).select("id", "_b.*")
        best = cut_lineage(best)
        kept = kept.unionByName(best.select("id", "vx", "y0", "y1", "vy", "sse"))
        cur = best.select("id", "vx", "y0", "y1")
    k = F.size("vx")
    ok = kept.where((k <= max_vertices) | (k == 2))
    pick = ok.groupBy("id").agg(F.min(F.struct((F.col("sse") + penalty * F.size("vx")).alias("c"), "vx", "vy", "sse")).alias("_b")).select("id", "_b.*")
    slopes = F.transform(F.sequence(F.lit(0), F.size("vx") - 2), lambda i: (F.get("vy", i + 1) - F.get("vy", i)) / (F.get("vx", i + 1) - F.get("vx", i)))
    pick = pick.withColumn("slopes", slopes)
    rec = F.transform("slopes", lambda s, i: (i > 0) & (F.get("slopes", i - 1) < 0) & (s > 0) & (F.abs(F.get("vy", i) - F.get("vy", i - 1)) > recovery))
    return pick.select(F.col("id").alias(key), "vx", "vy", "slopes", F.transform(rec, lambda b: F.coalesce(b, F.lit(False))).alias("recovery"), "sse")


# Default decay grid of the pursuit, 1 .. 1000 in 20 log steps.
TAU_GRID = [10 ** (3 * k / 19) for k in range(20)]


def pursuit(points: DataFrame, max_features: int = 3, taus=TAU_GRID, top_k: int = 20, threshold: float = 0.05, key: str = "series_id") -> DataFrame:
    """Greedy transient pursuit after a line: one dictionary pass per feature, joint refit at the end.

    Every round scores the log, exp and step atoms at the candidate onsets of each series by group sums, so the
    dictionary never leaves the tasks that hold the points.
    """
    from .boundaries import onset_candidates
    from .component_edits import basis
    from .layout import cut_lineage
    line = points.groupBy(key).agg(F.regr_intercept("value", "t").alias("_a"), F.regr_slope("value", "t").alias("_b"), F.count(F.lit(1)).alias("n"))
    base = cut_lineage(points.join(line, key).select(key, F.col("t").cast("int").alias("t"), "n", (F.col("value") - F.col("_a") - F.col("_b") * F.col("t")).alias("y")))
    res = base.withColumn("value", F.col("y"))
    empty = F.array().cast("array<struct<type:string,t_ref:double,tau:double,amplitude:double>>")
    state = cut_lineage(base.groupBy(key).agg(F.max("n").alias("n")).withColumns({"features": empty, "done": F.lit(False)}))
    atoms = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(float(t)).alias("tau")) for k in ("log", "exp") for t in taus],
                    F.struct(F.lit("step").alias("type"), F.lit(1.0).alias("tau")))
    at = lambda f, t: f["amplitude"] * basis(f["type"], t, f["t_ref"], f["tau"])
    for _ in range(max_features):
        cand = onset_candidates(res.select(key, "t", "value"), top_k, 1)
        dic = cand.withColumn("_k", F.explode(atoms)).select(key, F.col("t_ref").cast("double").alias("t_ref"), "_k.type", "_k.tau")
        st = state.where("not done")
        gap = F.greatest(F.lit(1.0), 0.05 * F.col("n"))
        dup = F.exists("features", lambda f: (f["type"] == F.col("type")) & (F.abs(f["t_ref"] - F.col("t_ref")) <= gap) & (
            (F.col("type") == "step") | (F.abs(F.col("tau") / f["tau"] - 1.0) <= 0.1)))
        dic = dic.join(st, key).where(~dup).groupBy(key).agg(F.collect_list(F.struct("type", "t_ref", "tau")).alias("_d"))
        # Atom sums as arrays per point batch: one exploded pass with map-side partial sums.
        j = res.join(dic, key).select(key, "t", "value", F.explode("_d").alias("_f"))
        b = basis(F.col("_f.type"), F.col("t").cast("double"), F.col("_f.t_ref"), F.col("_f.tau"))
        s = j.groupBy(key, "_f").agg(F.sum(b * F.col("value")).alias("br"), F.sum(b * b).alias("bb"))
        norm = res.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_r"))
        best = s.where("bb > 1e-12").groupBy(key).agg(F.max(F.struct((F.abs("br") / F.sqrt("bb")).alias("s"), (F.col("br") / F.col("bb")).alias("a"), "_f")).alias("_b"))
        jj = state.join(best, key, "left").join(norm, key, "left")
        go = ~F.col("done") & F.coalesce((F.col("_r") > 1e-12) & (F.col("_b.s") / F.col("_r") >= threshold), F.lit(False))
        new = F.struct(F.col("_b._f.type").alias("type"), F.col("_b._f.t_ref").alias("t_ref"), F.col("_b._f.tau").alias("tau"), F.col("_b.a").alias("amplitude"))
        state = cut_lineage(jj.select(key, "n", F.when(go, F.concat("features", F.array(new))).otherwise(F.col("features")).alias("features"), (~go).alias("done")))
        cur = base.join(state.select(key, "features"), key)
        res = cut_lineage(cur.select(key, "t", "n", "y", (F.col("y") - F.aggregate("features", F.lit(0.0), lambda a, f: a + at(f, F.col("t").cast("double")))).alias("value")))
    # Joint refit: per pair sums of the chosen atoms.
    f = base.join(state.select(key, "features"), key)
    vec = F.transform("features", lambda x: basis(x["type"], F.col("t").cast("double"), x["t_ref"], x["tau"]))
    f = f.withColumn("_v", vec)
    pair = f.select(key, "y", F.posexplode("_v").alias("i", "bi"), "_v").select(key, "y", "i", "bi", F.posexplode("_v").alias("j", "bj"))
    g = pair.where("j >= i").groupBy(key, "i", "j").agg(F.sum(F.col("bi") * F.col("bj")).alias("g"), F.sum(F.when(F.col("i") == F.col("j"), F.col("bi") * F.col("y"))).alias("r"))
    g = g.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "g", "r"))).alias("_g"))
    gram = F.transform("_g", lambda e: e["g"])
    rhs = F.transform(F.filter("_g", lambda e: e["i"] == e["j"]), lambda e: e["r"])
    x = g.withColumn("_x", solve(gram, rhs)).select(key, "_x")
    out = state.join(x, key, "left")
    amp = F.transform("features", lambda q, i: F.struct(q["type"].alias("type"), q["t_ref"].alias("t_ref"), q["tau"].alias("tau"),
                                                        F.coalesce(F.get("_x", i), q["amplitude"]).alias("amplitude")))
    out = out.withColumn("features", amp).select(key, "features")
    j = base.join(out, key).withColumn("_e", F.col("y") - F.aggregate("features", F.lit(0.0), lambda a, q: a + at(q, F.col("t").cast("double"))))
    ex = j.groupBy(key).agg((1.0 - F.sqrt(F.sum(F.col("_e") * F.col("_e"))) / F.sqrt(F.sum(F.col("y") * F.col("y")))).alias("explained"))
    return out.join(ex, key)
