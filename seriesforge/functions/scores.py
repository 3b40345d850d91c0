"""Scalar score helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(x: Column, threshold) -> Column:
    return clamp01(x / F.lit(threshold))


def inverse_ratio(x: Column, threshold) -> Column:
    return clamp01(F.lit(1.0) - x / F.lit(threshold))


def min_duration(n: Column, lo: int) -> Column:
    return clamp01(n / F.lit(lo))


def max_duration(n: Column, hi: int) -> Column:
    return F.when(n <= hi, 1.0).otherwise(clamp01(1.0 - (n - hi) / F.lit(hi)))


def bounded_duration(n: Column, lo: int, hi: int) -> Column:
    return (F.when(n.between(lo, hi), 1.0).when(n < lo, min_duration(n, lo))
            .otherwise(clamp01(1.0 - (n - hi) / F.lit(max(1, hi - lo + 1)))))


def average(*cols: Column) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / len(cols)


def sigmoid_above(x: Column, threshold: float, k: float = 10.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (x - threshold)))


def sigmoid_below(x: Column, threshold: float, k: float = 10.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (threshold - x)))


def wrap_phase(phi: Column) -> Column:
    """Wrap into [-pi, pi)."""
    return F.pmod(phi + math.pi, F.lit(2 * math.pi)) - math.pi


def snap_two_pi(x: Column, tolerance: float):
    """(nearest multiple of 2*pi, within tolerance and not zero)."""
    k = F.rint(x / (2 * math.pi))
    near = k * (2 * math.pi)
    return near, (k != 0) & (F.abs(x - near) <= tolerance)


def top2_margin(scores: Column) -> Column:
    """Gap between the two largest entries of an array."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(scores) >= 2, F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal, Abramowitz-Stegun 7.1.26 on erfc (error < 2e-7)."""
    # Fixed coefficients of the published approximation.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + p * x)
    erfc = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * erfc).otherwise(1.0 - 0.5 * erfc)


def ks_pvalue(d: Column, n: Column, terms: int = 20) -> Column:
    """Asymptotic Kolmogorov tail with the usual finite-sample factor."""
    root = F.sqrt(n.cast("double"))
    lam = (root + 0.12 + 0.11 / root) * d
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    return F.when(lam < 0.2, 1.0).otherwise(clamp01(total))
