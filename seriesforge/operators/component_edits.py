"""Edits in coefficient space.

Each function takes fit rows (method, components, coefficients) and gives fit
rows; all are narrow projections over the component map, so no edit shuffles.
``fits.reassemble`` then yields the edited signal.  Parameters may be columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .edits import lerp
from .fits import _fill, total


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _size() -> Column:
    return F.size(F.get(F.map_values("components"), F.lit(0)))


def put(m: str, key: Column, value: Column) -> Column:
    """Map with one entry replaced or added."""
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value))


def drop(m: str, key: Column) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def times(a: Column, factor: Column) -> Column:
    return V.let(F.struct(a.alias("a"), factor.cast("double").alias("f")), lambda s: F.transform(s["a"], lambda x: x * s["f"]))


def coef(name: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at("coefficients", _c(name)), F.lit(default))


def scale_matching(fit: DataFrame, match, alpha) -> DataFrame:
    """Scale the components (and equally named coefficients) whose name satisfies ``match``."""
    a = _c(alpha).cast("double")
    return fit.withColumns({
        "components": F.transform_values("components", lambda k, v: F.when(match(k), times(v, a)).otherwise(v)),
        "coefficients": F.transform_values("coefficients", lambda k, v: F.when(match(k), v * a).otherwise(v))})


is_seasonal = lambda k: (k == "seasonal") | k.startswith("seasonal_")
is_harmonic = lambda k: k.startswith("sin_") | k.startswith("cos_")


def scale_amplitude(fit: DataFrame, alpha) -> DataFrame:
    """Scale: the level trend of Constant, harmonics of ETM, seasonal parts of STL and MSTL."""
    m = F.col("method")
    a = _c(alpha).cast("double")
    hit = lambda k: (((m == "Constant") & (k == "trend")) | ((m == "ETM") & is_harmonic(k))
                     | (m.isin("STL", "MSTL") & is_seasonal(k)))
    return fit.withColumns({
        "components": F.transform_values("components", lambda k, v: F.when(hit(k), times(v, a)).otherwise(v)),
        "coefficients": F.transform_values("coefficients", lambda k, v: F.when((m == "ETM") & is_harmonic(k), v * a).otherwise(v))})


def offset_level(fit: DataFrame, delta) -> DataFrame:
    """Offset: level of Constant, x0 of ETM, trend of STL and MSTL."""
    m, d = F.col("method"), _c(delta).cast("double")
    hit = lambda k: (m.isin("Constant", "STL", "MSTL") & (k == "trend")) | ((m == "ETM") & (k == "x0"))
    chit = lambda k: ((m == "Constant") & (k == "level")) | ((m == "ETM") & (k == "x0"))
    add = lambda v: V.let(F.struct(v.alias("v"), d.alias("d")), lambda s: F.transform(s["v"], lambda x: x + s["d"]))
    return fit.withColumns({
        "components": F.transform_values("components", lambda k, v: F.when(hit(k), add(v)).otherwise(v)),
        "coefficients": F.transform_values("coefficients", lambda k, v: F.when(chit(k), v + d).otherwise(v))})


# --- plateau -----------------------------------------------------------------------

def level_of() -> Column:
    return F.coalesce(F.try_element_at("coefficients", F.lit("level")),
                      V.vmean(F.try_element_at("components", F.lit("trend"))))


def raise_lower(fit: DataFrame, delta=None, alpha=None, pivot=0.0) -> DataFrame:
    """New level by a delta or by 1 + alpha about a pivot."""
    old = level_of()
    new = old + _c(delta) if delta is not None else _c(pivot) + (1.0 + _c(alpha)) * (old - _c(pivot))
    f = fit.withColumn("_n", new.cast("double"))
    return f.withColumns({"coefficients": put("coefficients", F.lit("level"), F.col("_n")),
                          "components": put("components", F.lit("trend"), _fill(F.element_at("components", F.lit("trend")), F.col("_n")))}).drop("_n")


def invert_about(signal: Column, mean) -> Column:
    return V.let(F.struct(signal.alias("v"), _c(mean).cast("double").alias("m")), lambda s: F.transform(s["v"], lambda x: 2.0 * s["m"] - x))


def _rebuilt(fit: DataFrame, method: str, comps: dict, coefs: dict) -> DataFrame:
    pairs = lambda d: F.create_map(*[x for k, c in d.items() for x in (F.lit(k), c)])
    return fit.withColumns({"method": F.lit(method), "components": pairs(comps), "coefficients": pairs(coefs)})


def _grid(f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: f(i.cast("double")))


def to_trend(fit: DataFrame, beta) -> DataFrame:
    """Level plus a line from the first point."""
    f = fit.withColumns({"_l": level_of(), "_n": _size(), "_b": _c(beta).cast("double")})
    comps = {"x0": _grid(lambda i: F.col("_l")), "linear_rate": _grid(lambda i: F.col("_b") * i), "residual": _grid(lambda i: i * 0.0)}
    return _rebuilt(f, "ETM", comps, {"x0": F.col("_l"), "linear_rate": F.col("_b")}).drop("_l", "_n", "_b")


def to_cycle(fit: DataFrame, amplitude, period, phase) -> DataFrame:
    f = fit.withColumns({"_l": level_of(), "_n": _size(), "_a": _c(amplitude).cast("double"), "_p": _c(period).cast("double"),
                         "_f": _c(phase).cast("double")})
    comps = {"trend": _grid(lambda i: F.col("_l")),
             "seasonal": _grid(lambda i: F.col("_a") * F.sin(2 * math.pi * i / F.col("_p") + F.col("_f"))),
             "residual": _grid(lambda i: i * 0.0)}
    return _rebuilt(f, "STL", comps, {"period": F.col("_p"), "amplitude": F.col("_a"), "phase": F.col("_f")}).drop("_l", "_n", "_a", "_p", "_f")


def detrend_locally(signal: Column, beta) -> Column:
    return V.let(F.struct(signal.alias("v"), _c(beta).cast("double").alias("b")),
                 lambda s: F.transform(s["v"], lambda x, i: x - s["b"] * i))


# --- trend ----------------------------------------------------------------------------

def change_slope(fit: DataFrame, alpha) -> DataFrame:
    """ETM: scale the rate.  LandTrendr: scale both slopes and re-evaluate, or collapse to the mean when alpha is 0.
    Other methods: scale every part but the residual."""
    a, m = _c(alpha).cast("double"), F.col("method")
    is_rate = lambda k: ((m == "ETM") & (k == "linear_rate")) | (~m.isin("ETM", "LandTrendr") & (k != "residual"))
    f = fit.withColumn("_n", _size())
    trend = F.try_element_at("components", F.lit("trend"))
    brk = F.coalesce(F.try_element_at("coefficients", F.lit("breakpoint")), (F.col("_n") / 2).cast("int").cast("double"))
    part = V.let(F.struct(brk.alias("k"), a.alias("a"), coef("slope_1").alias("s1"), coef("intercept_1").alias("i1"),
                          coef("slope_2").alias("s2"), coef("intercept_2").alias("i2"), F.col("_n").alias("n")),
                 lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.when(
                     i < s["k"], s["i1"] + s["a"] * s["s1"] * i).otherwise(s["i2"] + s["a"] * s["s2"] * i)))
    lt = F.when(a == 0, F.create_map(F.lit("trend"), _fill(trend, V.vmean(trend)))).otherwise(put("components", F.lit("trend"), part))
    zero_all = (~m.isin("ETM", "LandTrendr")) & (a == 0)
    scaled = F.transform_values("components", lambda k, v: F.when(is_rate(k) | zero_all, times(v, a)).otherwise(v))
    coefs = F.transform_values("coefficients", lambda k, v: F.when(
        ((m == "ETM") & (k == "linear_rate")) | ((m == "LandTrendr") & k.isin("slope_1", "slope_2")), v * a).otherwise(v))
    return f.withColumns({"components": F.when(m == "LandTrendr", lt).otherwise(scaled), "coefficients": coefs}).drop("_n")


def accelerate(fit: DataFrame, c) -> DataFrame:
    """Add a quadratic from the first point."""
    f = fit.withColumns({"_n": _size(), "_q": _c(c).cast("double")})
    return f.withColumns({"components": put("components", F.lit("acceleration"), _grid(lambda i: F.col("_q") * i * i)),
                          "coefficients": put("coefficients", F.lit("acceleration"), F.col("_q"))}).drop("_n", "_q")


def extrapolate(fit: DataFrame, first: Column, steps: int) -> DataFrame:
    """Future values on absolute times first .. first + steps - 1: ETM line, last LandTrendr piece, else the mean."""
    m = F.col("method")
    base = V.vmean(F.get(F.map_values("components"), F.lit(0)))
    f = fit.withColumn("t", F.explode(F.sequence(first, first + steps - 1)))
    v = (F.when(m == "ETM", coef("x0") + coef("linear_rate") * F.col("t"))
         .when(m == "LandTrendr", coef("intercept_2") + coef("slope_2") * F.col("t")).otherwise(base))
    return f.withColumn("value", v)


# --- step -------------------------------------------------------------------------------

def step_name(ts) -> Column:
    x = _c(ts).cast("double")
    return F.concat(F.lit("step_at_"), F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")))


def log_name(ts, tau, kind: str = "log") -> Column:
    num = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.concat(F.lit(f"{kind}_"), num(_c(ts).cast("double")), F.lit("_tau"), num(_c(tau).cast("double")))


def scale_step(fit: DataFrame, ts, alpha) -> DataFrame:
    """alpha 0 removes, -1 inverts."""
    k = step_name(ts)
    return scale_matching(fit, lambda name: name == k, alpha)


def _move(fit: DataFrame, old: Column, new: Column, amplitude: Column, basis, drop_old: bool = True) -> DataFrame:
    f = fit.withColumns({"_n": _size(), "_a": amplitude, "_o": old, "_k": new})
    comp = _grid(lambda i: F.col("_a") * basis(i))
    kill = lambda m: F.map_filter(m, lambda k, v: (k != F.col("_k")) & ((k != F.col("_o")) if drop_old else F.lit(True)))
    return f.withColumns({"components": F.map_concat(kill("components"), F.create_map(F.col("_k"), comp)),
                          "coefficients": F.map_concat(kill("coefficients"), F.create_map(F.col("_k"), F.col("_a")))}).drop("_n", "_a", "_o", "_k")


def move_step(fit: DataFrame, ts, to) -> DataFrame:
    return _move(fit, step_name(ts), step_name(to), coef(step_name(ts)), lambda i: F.when(i >= _c(to), 1.0).otherwise(0.0))


def step_to_ramp(fit: DataFrame, ts, tau) -> DataFrame:
    return _move(fit, step_name(ts), log_name(ts, tau), coef(step_name(ts)),
                 lambda i: F.log1p(F.greatest(F.lit(0.0), (i - _c(ts)) / _c(tau))))


def duplicate_step(fit: DataFrame, ts, shift, amplitude) -> DataFrame:
    new = _c(ts) + _c(shift)
    return _move(fit, step_name(ts), step_name(new), _c(amplitude).cast("double"), lambda i: F.when(i >= new, 1.0).otherwise(0.0), False)


# --- cycle -------------------------------------------------------------------------------

def flatten_cycle(fit: DataFrame) -> DataFrame:
    """Seasonal and residual to zero, trend to its mean."""
    def flat(k, v):
        return F.when(is_seasonal(k) | (k == "residual"), times(v, F.lit(0.0))).when(k == "trend", _fill(v, V.vmean(v))).otherwise(v)
    return fit.withColumn("components", F.transform_values("components", flat))


def change_period(fit: DataFrame, beta) -> DataFrame:
    """Seasonal parts resampled with wrap-around; STL period updated."""
    b = _c(beta).cast("double")

    def stretch(v):
        def at(s):
            def one(x, i):
                p = F.pmod(i / s["b"], s["n"].cast("double"))
                lo = F.floor(p).cast("int") % s["n"]
                fr = p - F.floor(p)
                return F.get(s["v"], lo) * (1.0 - fr) + F.get(s["v"], (lo + 1) % s["n"]) * fr
            return F.transform(s["v"], one)
        return V.let(F.struct(v.alias("v"), F.size(v).alias("n"), b.alias("b")), at)
    new_t = F.greatest(F.lit(2.0), F.rint(coef("period", 2.0) * b))
    return fit.withColumns({
        "components": F.transform_values("components", lambda k, v: F.when(is_seasonal(k), stretch(v)).otherwise(v)),
        "coefficients": F.when(F.col("method") == "STL", put("coefficients", F.lit("period"), new_t)).otherwise(F.col("coefficients"))})


def set_harmonic(fit: DataFrame, k: int, a, b, period=None) -> DataFrame:
    """Least-squares part of harmonic k out, a cos + b sin in (2 x 2 closed form)."""
    T = (_c(period) if period is not None else F.greatest(F.lit(2.0), F.floor(coef("period", 2.0)))).cast("double")

    def swap(v):
        w = lambda s, i: 2 * math.pi * k * i / s["T"]
        def sums(s):
            cs = F.transform(s["v"], lambda x, i: F.cos(w(s, i)))
            sn = F.transform(s["v"], lambda x, i: F.sin(w(s, i)))
            return F.struct(s["v"].alias("v"), cs.alias("c"), sn.alias("s"))
        def solve2(q):
            return F.struct(q["v"].alias("v"), q["c"].alias("c"), q["s"].alias("s"), V.dot(q["c"], q["c"]).alias("cc"), V.dot(q["s"], q["s"]).alias("ss"),
                            V.dot(q["c"], q["s"]).alias("cs"), V.dot(q["c"], q["v"]).alias("cv"), V.dot(q["s"], q["v"]).alias("sv"))
        def out(r):
            det = r["cc"] * r["ss"] - r["cs"] * r["cs"]
            x = F.when(F.abs(det) > 1e-12, (r["cv"] * r["ss"] - r["sv"] * r["cs"]) / det).otherwise(r["cv"] / r["cc"])
            y = F.when(F.abs(det) > 1e-12, (r["sv"] * r["cc"] - r["cv"] * r["cs"]) / det).otherwise(F.lit(0.0))
            return V.let(F.struct(r["v"].alias("v"), r["c"].alias("c"), r["s"].alias("s"), (_c(a) - x).alias("dx"), (_c(b) - y).alias("dy")),
                         lambda z: F.transform(z["v"], lambda e, i: e + z["dx"] * F.get(z["c"], i) + z["dy"] * F.get(z["s"], i)))
        return V.let(V.let(V.let(F.struct(v.alias("v"), T.alias("T")), sums), solve2), out)
    return fit.withColumn("components", F.transform_values("components", lambda n, v: F.when(is_seasonal(n), swap(v)).otherwise(v)))


# --- transients -------------------------------------------------------------------------------

FEATURE = "struct<type:string,t_ref:double,tau:double,amplitude:double>"


def basis(kind: Column, t: Column, t_ref: Column, tau: Column) -> Column:
    pos = F.greatest(F.lit(0.0), (t - t_ref) / tau)
    z = (t - t_ref) / tau
    return (F.when(kind == "step", F.when(t >= t_ref, 1.0).otherwise(0.0)).when(kind == "log", F.log1p(pos))
            .when(kind == "exp", F.exp(-pos)).otherwise(F.exp(-0.5 * z * z)))


def transient_of(features: Column, n: Column) -> Column:
    """Component of a feature list."""
    return V.let(F.struct(features.alias("f"), n.alias("n")), lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.aggregate(
        s["f"], F.lit(0.0), lambda acc, f: acc + f["amplitude"] * basis(f["type"], i.cast("double"), f["t_ref"], f["tau"]))))


def edit_feature(fit: DataFrame, index, change) -> DataFrame:
    """Replace feature ``index`` by ``change(feature)``; the transient component is evaluated again."""
    k = _c(index)
    new = F.transform("features", lambda f, i: F.when(i == k, change(f)).otherwise(f).cast(FEATURE))
    return _with_features(fit, new)


def _with_features(fit: DataFrame, features: Column) -> DataFrame:
    f = fit.withColumn("_n", _size()).withColumn("features", features)
    return f.withColumn("components", put("components", F.lit("transient"), transient_of(F.col("features"), F.col("_n")))).drop("_n")


def feature(kind, t_ref, tau, amplitude) -> Column:
    return F.struct(_c(kind).alias("type"), _c(t_ref).cast("double").alias("t_ref"), _c(tau).cast("double").alias("tau"),
                    _c(amplitude).cast("double").alias("amplitude"))


def remove_feature(fit: DataFrame, index) -> DataFrame:
    k = _c(index)
    kept = F.filter("features", lambda f, i: i != k)
    return _with_features(fit, kept)


def scale_feature(fit: DataFrame, index, alpha) -> DataFrame:
    return edit_feature(fit, index, lambda f: feature(f["type"], f["t_ref"], f["tau"], f["amplitude"] * _c(alpha)))


def shift_feature(fit: DataFrame, index, dt) -> DataFrame:
    return edit_feature(fit, index, lambda f: feature(f["type"], f["t_ref"] + _c(dt), f["tau"], f["amplitude"]))


def stretch_feature(fit: DataFrame, index, factor) -> DataFrame:
    """Change duration or decay: tau times factor."""
    return edit_feature(fit, index, lambda f: feature(f["type"], f["t_ref"], F.greatest(F.lit(1e-12), f["tau"] * _c(factor)), f["amplitude"]))


def duplicate_feature(fit: DataFrame, index, dt) -> DataFrame:
    f = F.get("features", _c(index))
    return _with_features(fit, F.concat("features", F.array(feature(f["type"], f["t_ref"] + _c(dt), f["tau"], f["amplitude"]).cast(FEATURE))))


def change_basis(fit: DataFrame, index, kind: str) -> DataFrame:
    """New basis with the amplitude projected from the old transient component."""
    f0 = fit.withColumn("_n", _size())
    f = F.get("features", _c(index))
    old = F.element_at("components", F.lit("transient"))
    b = V.let(F.struct(f.alias("f"), F.col("_n").alias("n")), lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: basis(
        F.lit(kind), i.cast("double"), s["f"]["t_ref"], s["f"]["tau"])))
    f0 = f0.withColumn("_amp", V.let(F.struct(old.alias("o"), b.alias("b")), lambda s: V.dot(s["o"], s["b"]) / (V.sq_norm(s["b"]) + 1e-12)))
    return edit_feature(f0, index, lambda g: feature(kind, g["t_ref"], g["tau"], F.col("_amp"))).drop("_n", "_amp")


def feature_to_step(fit: DataFrame, index) -> DataFrame:
    """Take a feature out and add a step of its amplitude at its onset."""
    f0 = fit.withColumn("_f", F.get("features", _c(index)))
    f0 = remove_feature(f0, index).withColumn("_n", _size())
    k = step_name(F.col("_f.t_ref"))
    comp = _grid(lambda i: F.when(i >= F.col("_f.t_ref"), F.col("_f.amplitude")).otherwise(0.0))
    return f0.withColumns({"components": put("components", k, comp), "coefficients": put("coefficients", k, F.col("_f.amplitude"))}).drop("_f", "_n")
