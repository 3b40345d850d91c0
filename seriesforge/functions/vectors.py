"""Column builders over ``array<double>``.

Every helper stays inside Spark expressions.  ``let`` binds an expensive
sub-expression once, because a column used inside a lambda would otherwise be
evaluated again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, by the product's exact error (Dekker's split); for finite values far from overflow."""
    def halves(x):
        hi = 134217729.0 * x - (134217729.0 * x - x)
        return hi, x - hi

    def add(q):
        (ah, al), (bh, bl) = halves(q["a"]), halves(q["b"])
        return let(F.struct(q["p"].alias("p"), q["c"].alias("c"), (((ah * bh - q["p"]) + ah * bl + al * bh) + al * bl).alias("e"), (q["p"] + q["c"]).alias("s")),
                   lambda r: r["s"] + ((r["p"] - (r["s"] - (r["s"] - r["p"]))) + (r["c"] - (r["s"] - r["p"])) + r["e"]))
    return let(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (a * b).alias("p")), add)


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def vmean(v: Column) -> Column:
    return F.try_divide(vsum(v), F.size(v))


def _stats(v: Column) -> Column:
    """Struct (v, n, mean) of an array."""
    return F.struct(v.alias("v"), F.size(v).alias("n"), vmean(v).alias("m"))


def _of_stats(v: Column, body) -> Column:
    """``body`` of (v, n, mean); v itself is bound first, as the struct names it several times."""
    return let(v, lambda w: let(_stats(w), body))


def vvar(v: Column) -> Column:
    """Population variance, two passes."""
    return _of_stats(v, lambda s: F.try_divide(F.aggregate(
        s["v"], F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"])), s["n"]))


def vstd(v: Column) -> Column:
    return F.sqrt(vvar(v))


def center(v: Column) -> Column:
    return _of_stats(v, lambda s: F.transform(s["v"], lambda x: x - s["m"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(sq_norm(v))


def unit(v: Column, floor: float = 1e-8) -> Column:
    """L2-normalised vector; null when the norm is near zero."""
    return let(v, lambda w: let(F.struct(w.alias("v"), norm(w).alias("n")),
                                lambda s: F.when(s["n"] > floor, F.transform(s["v"], lambda x: x / s["n"]))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda s, x: s + x))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def znorm(v: Column, floor: float = 1e-8) -> Column:
    """z-normalised vector, all zeros when the deviation is below ``floor``."""
    st = _of_stats(v, lambda s: F.struct(s["v"].alias("v"), s["m"].alias("m"), F.sqrt(F.aggregate(
        s["v"], F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"])) / s["n"]).alias("sd")))
    return let(st, lambda s: F.transform(
        s["v"], lambda x: F.when(s["sd"] < floor, 0.0).otherwise((x - s["m"]) / s["sd"])))


def standardise(v: Column, floor: float = 1e-8) -> Column:
    """Centre, and divide by the deviation only when it exceeds ``floor``."""
    st = _of_stats(v, lambda s: F.struct(s["v"].alias("v"), s["m"].alias("m"), F.sqrt(F.aggregate(
        s["v"], F.lit(0.0), lambda a, x: a + (x - s["m"]) * (x - s["m"])) / s["n"]).alias("sd")))
    return let(st, lambda s: F.transform(
        s["v"], lambda x: (x - s["m"]) / F.when(s["sd"] > floor, s["sd"]).otherwise(1.0)))


def diffs(v: Column) -> Column:
    """First differences, one element shorter than the input."""
    return F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))),
                      F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda b, a: b - a)


def resample(v: Column, length: Column | int) -> Column:
    """Linear interpolation of ``v`` onto ``length`` evenly spaced positions."""
    m = F.lit(length) if isinstance(length, int) else length
    st = F.struct(v.alias("v"), F.size(v).alias("n"), m.alias("m"))

    def grid(s):
        def at(i):
            pos = F.when(s["m"] > 1, i.cast("double") * (s["n"] - 1) / (s["m"] - 1)).otherwise(F.lit(0.0))
            lo = F.least(F.floor(pos).cast("int"), s["n"] - 1)
            hi = F.least(lo + 1, s["n"] - 1)
            frac = pos - lo
            return F.get(s["v"], lo) + (F.get(s["v"], hi) - F.get(s["v"], lo)) * frac
        return F.transform(F.sequence(F.lit(0), s["m"] - 1), at)

    return let(st, grid)


def acf_abs_max(v: Column) -> Column:
    """Largest absolute autocorrelation over lags 1..n/2, each lag normalised by its two halves."""
    def per_lag(s):
        def one(lag):
            left = F.slice(s["c"], F.lit(1), s["n"] - lag)
            right = F.slice(s["c"], lag + 1, s["n"] - lag)
            parts = F.struct(left.alias("l"), right.alias("r"))
            return let(parts, lambda p: let(
                F.struct(dot(p["l"], p["r"]).alias("xy"), F.sqrt(sq_norm(p["l"]) * sq_norm(p["r"])).alias("d")),
                lambda q: F.when(q["d"] == 0, 0.0).otherwise(F.abs(q["xy"] / q["d"]))))
        return F.when(sq_norm(s["c"]) == 0, F.lit(0.0)).otherwise(
            F.array_max(F.transform(F.sequence(F.lit(1), F.floor(s["n"] / 2).cast("int")), one)))

    st = F.struct(center(v).alias("c"), F.size(v).alias("n"))
    return F.when(F.size(v) >= 3, let(st, per_lag))


def softmax(v: Column) -> Column:
    """Stable softmax of an array."""
    e = let(v, lambda w: let(F.struct(w.alias("v"), F.array_max(w).alias("m")),
                             lambda s: F.transform(s["v"], lambda x: F.exp(x - s["m"]))))
    return let(e, lambda w: let(F.struct(w.alias("e"), vsum(w).alias("t")),
                                lambda s: F.transform(s["e"], lambda x: x / s["t"])))


def entropy(p: Column) -> Column:
    """Entropy of a probability array over ln(size), capped at 1; 0 when fewer than two entries."""
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 1e-15, -x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) <= 1, 0.0).otherwise(F.least(F.lit(1.0), h / F.ln(F.size(p))))


def lb_keogh(q: Column, upper: Column, lower: Column) -> Column:
    """Keogh lower bound of a query against an envelope."""
    over = F.zip_with(q, upper, lambda x, u: F.greatest(x - u, F.lit(0.0)))
    under = F.zip_with(q, lower, lambda x, l: F.greatest(l - x, F.lit(0.0)))
    return F.sqrt(sq_norm(over) + sq_norm(under))


def envelope(v: Column, radius: int) -> Column:
    """Struct (upper, lower) of sliding maxima and minima within ± radius."""
    def side(pick):
        return let(F.struct(v.alias("v"), F.size(v).alias("n")), lambda s: F.transform(
            F.sequence(F.lit(0), s["n"] - 1), lambda i: pick(F.slice(
                s["v"], F.greatest(i - radius, F.lit(0)) + 1,
                F.least(i + radius, s["n"] - 1) - F.greatest(i - radius, F.lit(0)) + 1))))
    return F.struct(side(F.array_max).alias("upper"), side(F.array_min).alias("lower"))


def encode(v: Column, length: int = 16) -> Column:
    """Shape embedding: resampled and standardised values, their differences, four summaries, unit norm."""
    def build(s):
        z = s["z"]
        d = F.concat(F.array(F.lit(0.0)), diffs(z))
        a = F.transform(z, lambda x: F.abs(x))
        tail = F.array(F.log1p(s["n"].cast("double")), vmean(a), vstd(z), F.array_max(a))
        return F.concat(z, d, tail)
    st = F.struct(standardise(resample(v, length)).alias("z"), F.size(v).alias("n"))
    return F.when(F.size(v) >= 2, unit(let(st, build)))
