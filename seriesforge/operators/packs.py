"""Domain label packs: detectors as column builders, labels as rows.

A detector turns a segment row (v plus optional context columns) into a match
flag, a confidence and named context values; a label adds a shape, parameters
and a predicate over those names.  All labels of a pack are evaluated in one
projection over the shared segment rows.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scores as S
from ..functions import vectors as V
from . import shapes as H

DETECTORS: dict = {}


class Row:
    """Access to the segment columns with defaults for absent context."""

    def __init__(self, columns, params):
        self.columns, self.params = set(columns), dict(params)

    def get(self, name, default=None) -> Column:
        if name in self.columns:
            d = self.params.get(name, default)
            return F.col(name) if d is None else F.coalesce(F.col(name), F.lit(d))
        return F.lit(self.params.get(name, default))

    def num(self, name, default) -> float:
        return float(self.params.get(name, default))


def register_detector(name: str):
    """Add a detector: f(row) -> (matched, confidence, {name: Column}, least length)."""
    def deco(fn):
        DETECTORS[name] = fn
        return fn
    return deco


v = lambda: F.col("v")
n = lambda: F.size("v")
sd = lambda: V.vstd(v())
half = lambda: F.floor(n() / 2).cast("int")
tiny = 1e-12


def q_median(r: Row) -> Column:
    return F.coalesce(F.col("Q_median"), H.median(v())) if "Q_median" in r.columns else H.median(v())


def _slope_conf(slope: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(slope) / (sd() + tiny))


@register_detector("eckhardt_baseflow")
def _(r):
    from .fits import baseflow_array
    b = baseflow_array(v(), r.num("BFImax", 0.8), r.num("a", 0.98))
    bfi = F.when(V.vsum(v()) > 0, V.vsum(b) / V.vsum(v())).otherwise(r.num("dry_BFI", 0.0))
    return bfi > 0.5, bfi, {"Q_mean": V.vmean(v()), "Q_median": q_median(r), "BFI": bfi, "BFImax": F.lit(r.num("BFImax", 0.8))}, 1


@register_detector("peak_detection_plus_ascending_limb_fit")
def _(r):
    thr, med, peak = r.num("peak_ratio_threshold", 3.0), q_median(r), F.array_max(v())
    rising = H.ols_slope(F.slice(v(), F.lit(1), F.greatest(F.lit(2), half()))) > 0
    lim = thr * F.greatest(med, F.lit(tiny))
    return rising & (peak > lim), S.clamp01(peak / lim - 1.0), {"peak_Q": peak, "Q_median": med, "rising_limb_detected": rising, "peak_ratio_threshold": F.lit(thr)}, 3


@register_detector("hampel_peak")
def _(r):
    med0 = H.median(v())
    dev = V.let(F.struct(v().alias("v"), med0.alias("m")), lambda s: F.transform(s["v"], lambda x: F.abs(x - s["m"])))
    mad = H.median(dev)
    score = F.array_max(dev) / F.greatest(3.0 * 1.4826 * mad, F.lit(tiny))
    med, peak = q_median(r), F.array_max(v())
    half_h = F.when(peak > med, 0.5 * (peak + med)).otherwise(peak)
    dur = V.let(F.struct(v().alias("v"), half_h.alias("h")), lambda s: F.size(F.filter(s["v"], lambda x: x >= s["h"])))
    ok = (mad > 0) & (score > 1.0) & (peak > 5.0 * F.greatest(med, F.lit(tiny)))
    return ok, S.clamp01((score - 1.0) / 4.0), {"peak_Q": peak, "Q_median": med, "duration_samples": dur, "dt": F.lit(r.num("dt", 1.0))}, 1


@register_detector("slope_sign_plus_context")
def _(r):
    s = H.ols_slope(v())
    return F.abs(s) > 0, _slope_conf(s), {"slope": s, "preceded_by_baseflow": r.get("preceded_by_baseflow", False), "follows_peak_flow": r.get("follows_peak_flow", False),
                                          "recession_slope_max": F.lit(r.num("recession_slope_max", 0.1))}, 2


@register_detector("seasonal_context_plus_transient_fit")
def _(r):
    s = H.ols_slope(v())
    weeks = F.when(s > 0, n() / max(1.0, r.num("samples_per_week", 7.0))).otherwise(0.0)
    return s > 0, S.clamp01(weeks / 8.0), {"slope": s, "sustained_rise_weeks": weeks, "is_spring": r.get("is_spring", False)}, 7


@register_detector("low_flow_threshold_plus_duration")
def _(r):
    med = q_median(r)
    low = V.let(F.struct(v().alias("v"), (0.1 * F.greatest(med, F.lit(tiny))).alias("t")), lambda s: F.size(F.filter(s["v"], lambda x: x < s["t"])))
    frac = F.when(med > 0, low / n()).otherwise(0.0)
    return frac > 0.5, S.clamp01(frac), {"low_flow_fraction": frac, "duration_days": n() / max(1.0, r.num("samples_per_day", 1.0)), "Q_median": med}, 1


def _phase(lo, hi, least):
    def f(r):
        years = H.dominant_period(v()) / r.num("samples_per_year", 12.0)
        return years > 0, F.when(years.between(lo, hi), 1.0).otherwise(0.0), {"dominant_period_years": years}, least
    return f


register_detector("mei_index_plus_period_check")(_phase(2.0, 7.0, 8))
register_detector("pdo_index_plus_period_check")(_phase(15.0, 30.0, 16))


@register_detector("timesat_threshold")
def _(r):
    lo = r.get("annual_min") if "annual_min" in r.columns else F.array_min(v())
    hi = r.get("annual_max") if "annual_max" in r.columns else F.array_max(v())
    amp = F.greatest(hi - lo, F.lit(0.0))
    thr = lo + r.num("threshold_percent", 20.0) / 100.0 * amp
    s = H.ols_slope(v())
    cross = (F.array_min(v()) <= thr) & (thr <= F.array_max(v()))
    return cross & (F.abs(s) > 0), F.least(F.lit(1.0), F.abs(s) / (amp / n() + tiny)), {"slope": s, "threshold_value": thr, "crosses_threshold": cross,
                                                                                       "is_in_window": r.get("is_in_window", True)}, 2


def _annual_ratio(r):
    hi = r.get("annual_max") if "annual_max" in r.columns else F.array_max(v())
    return hi, V.vmean(v()) / F.greatest(hi, F.lit(tiny)), n() / r.num("samples_per_day", 1.0)


@register_detector("mstl_peak_window")
def _(r):
    hi, q, days = _annual_ratio(r)
    ratio = F.when(hi > 0, q).otherwise(0.0)
    return (ratio > 0.9) & (days < 60.0), S.clamp01(ratio), {"amplitude_above_max_ratio": ratio, "duration_short": days < 60.0}, 1


@register_detector("low_amplitude_plus_duration")
def _(r):
    hi, q, days = _annual_ratio(r)
    below = F.when(hi > 0, 1.0 - q).otherwise(0.0)
    return (below > 0.8) & (days >= 60.0), S.clamp01(below), {"amplitude_below_max_ratio": below, "duration_long": days >= 60.0}, 1


@register_detector("bfast_breakpoint")
def _(r):
    a, b = H.halves(v())
    m, thr = V.vmean(b) - V.vmean(a), r.num("magnitude_threshold", -0.2)
    return m < thr, S.clamp01(F.abs(m) / max(abs(thr), tiny) - 1.0), {"negative_step_magnitude": m, "magnitude_threshold": F.lit(thr)}, 4


@register_detector("landtrendr_positive_slope_post_disturbance")
def _(r):
    s = r.get("last_slope") if "last_slope" in r.columns else H.ols_slope(v())
    least = r.num("min_recovery_slope", 0.05)
    return s > least, S.clamp01(s / max(least, tiny) - 1.0), {"slope": s, "min_recovery_slope": F.lit(least), "follows_disturbance": r.get("follows_disturbance", False)}, 2


@register_detector("slope_plus_context")
def _(r):
    s = H.ols_slope(v())
    return F.abs(s) > 0, _slope_conf(s), {"slope": s, "follows_dry_down": r.get("follows_dry_down", False), "follows_wet_up": r.get("follows_wet_up", False)}, 2


@register_detector("percentile_threshold_plus_duration")
def _(r):
    from .edits import quantile
    hi = r.get("series_p95") if "series_p95" in r.columns else quantile(v(), 0.95)
    lo = r.get("series_p5") if "series_p5" in r.columns else quantile(v(), 0.05)
    m, days = V.vmean(v()), n() / r.num("samples_per_day", 1.0)
    ok = ((m >= hi) | (m <= lo)) & (days >= 3.0)
    return ok, F.when(ok, 1.0).otherwise(0.0), {"mean_above_p95": m >= hi, "mean_below_p5": m <= lo, "duration_days": days}, 1


@register_detector("missingness_mask")
def _(r):
    gap = r.get("is_cloud_gap", False)
    frac = r.get("cloud_fraction") if "cloud_fraction" in r.columns else F.when(gap, 1.0).otherwise(0.0)
    return gap, F.when(gap, frac).otherwise(0.0), {"missingness_mask_value": gap, "cloud_fraction": frac}, 0


def _low_frequency(name):
    def f(r):
        x = H.low_frequency_share(H.power(v()), n())
        return x > 0.6, x, {"low_frequency_power_fraction": x, name: x > 0.6}, 8
    return f


register_detector("gacos_correction_residual")(_low_frequency("is_atmospheric_pattern"))
register_detector("gacos_or_pyaps_correction_residual")(_low_frequency("is_spatial_atmospheric_pattern"))


@register_detector("mstl_annual_component")
def _(r):
    d = H.dominant_period(v()) / r.num("samples_per_day", 1.0)
    ok = F.abs(d - 365.0) <= r.num("annual_tolerance_days", 30.0)
    return ok, F.when(ok, 1.0).otherwise(0.0), {"dominant_period_days": d, "is_annual_period": ok}, 8


@register_detector("etm_linear_rate")
def _(r):
    s = r.get("linear_rate_fit") if "linear_rate_fit" in r.columns else H.ols_slope(v())
    thr = r.num("velocity_threshold", 0.0)
    return F.abs(s) > thr, S.clamp01(F.abs(s) / max(thr + 1e-9, 1e-9) - 1.0), {"linear_rate": s, "velocity_threshold": F.lit(thr)}, 4


def _trigger(default):
    def f(r):
        sr = r.num("sampling_rate_hz", 1.0)
        a = max(2, round(r.num("window_sta_seconds", 1.0) * sr))
        b = max(a + 1, round(r.num("window_lta_seconds", 10.0) * sr))
        thr = r.num("threshold", default)
        def ratio(s):
            mean = lambda i, w: V.vmean(F.transform(F.slice(s["v"], F.greatest(i - w + 1, F.lit(0)) + 1, i - F.greatest(i - w + 1, F.lit(0)) + 1), lambda x: x * x))
            return F.transform(s["v"], lambda x, i: mean(i, a) / F.greatest(mean(i, b), F.lit(1e-12)))
        q = V.let(F.struct(v().alias("v")), ratio)
        top = F.array_max(q)
        return top >= thr, S.clamp01((top - thr) / max(thr, tiny)), {"sta_lta_ratio_max": top}, 8
    return f


register_detector("sta_lta")(_trigger(4.0))
register_detector("sta_lta_with_polarization")(_trigger(3.0))


def envelope(x: Column) -> Column:
    """Magnitude of the analytic signal (numpy FFT, Arrow batches)."""
    def run(s: pd.Series) -> pd.Series:
        import numpy as np
        out = []
        for row in s:
            a = np.asarray(row, float)
            k = len(a)
            h = np.zeros(k)
            h[0] = 1
            h[1:(k + 1) // 2] = 2
            if k % 2 == 0 and k:
                h[k // 2] = 1
            out.append(np.abs(np.fft.ifft(np.fft.fft(a) * h)).tolist() if k else [])
        return pd.Series(out)
    return F.pandas_udf(run, "array<double>")(x)


@register_detector("post_S_envelope_fit")
def _(r):
    env = F.col("envelope")
    floor = H.median(env) * 0.001 + 1e-12
    logs = V.let(F.struct(env.alias("e"), floor.alias("f")), lambda s: F.transform(s["e"], lambda x: F.ln(F.greatest(x, s["f"]))))
    q = V.let(H.line_of(logs), lambda s: F.struct(s["b"].alias("b"), F.aggregate(F.transform(s["v"], lambda x, i: (x - s["a"] - s["b"] * i) * (x - s["a"] - s["b"] * i)),
              F.lit(0.0), lambda a, x: a + x).alias("res"), (V.vvar(s["v"]) * s["n"]).alias("tot")))
    tau = F.when(q["b"] < 0, -1.0 / q["b"])
    quality = F.when(q["b"] < 0, S.clamp01(F.when(q["tot"] > 0, 1.0 - q["res"] / q["tot"]).otherwise(0.0))).otherwise(0.0)
    return F.coalesce(tau > 1.0, F.lit(False)), quality, {"coda_tau_samples": tau, "envelope_quality": quality}, 8


@register_detector("dispersive_wave_detection")
def _(r):
    a, b = H.halves(v())
    p, q = H.dominant_period(a), H.dominant_period(b)
    d = F.abs(p - q)
    return d > 1.0, F.least(F.lit(1.0), d / F.greatest(p + q + tiny, F.lit(1.0))), {"frequency_drift": d}, 16


@register_detector("envelope_correlation_plus_lfe")
def _(r):
    spm = max(1.0, 60.0 * r.num("sampling_rate_hz", 1.0))
    w = max(1, round(spm))
    sm = V.let(F.struct(F.col("envelope").alias("v")), lambda s: F.transform(s["v"], lambda x, i: V.vmean(F.slice(
        s["v"], F.greatest(i - w + 1, F.lit(0)) + 1, i - F.greatest(i - w + 1, F.lit(0)) + 1))))
    amp = V.vmean(sm)
    thr = F.lit(r.num("threshold", 0.0)) if "threshold" in r.params else sd() * 1.5
    return amp > thr, S.clamp01(amp / F.greatest(thr, F.lit(tiny)) - 1.0), {"low_frequency_amplitude": amp, "sustained_minutes": n() / spm, "threshold": thr,
                                                                           "sustained_threshold": F.lit(r.num("sustained_threshold", 1.0))}, 16


@register_detector("etm_step_from_known_origin")
def _(r):
    known = F.col("origin_time").isNotNull() if "origin_time" in r.columns else F.lit(False)
    m = F.coalesce(F.col("fitted_step"), H.quarter_step(v())) if "fitted_step" in r.columns else H.quarter_step(v())
    thr = r.num("detection_threshold", 0.0)
    return known & (F.abs(m) > thr), F.least(F.lit(1.0), F.abs(m) / max(thr + tiny, tiny)), {"step_magnitude": m, "origin_time_known": known, "detection_threshold": F.lit(thr)}, 4


@register_detector("fit_log_or_exp")
def _(r):
    a, b = r.get("rmse_log"), r.get("rmse_exp")
    log = a <= b
    best, other = F.least(a, b), F.greatest(a, b)
    conf = S.clamp01(1.0 - best / F.greatest(other, F.lit(tiny)))
    return a.isNotNull() | b.isNotNull(), F.coalesce(conf, F.lit(0.0)), {"basis_type": F.when(log, "log").otherwise("exp"), "follows_coseismic_offset": r.get("follows_coseismic_offset", False)}, 8


@register_detector("etm_linear_rate_ex_steps_ex_transients")
def _(r):
    s = H.ols_slope(v())
    return F.abs(s) > 0, _slope_conf(s), {"linear_rate": s, "excludes_coseismic_offset": r.get("excludes_coseismic_offset", True),
                                          "excludes_postseismic_relaxation": r.get("excludes_postseismic_relaxation", True)}, 4


@register_detector("gratsid_bump")
def _(r):
    third = F.greatest(F.lit(1), F.floor(n() / 3).cast("int"))
    a, b = F.slice(v(), F.lit(1), third), F.slice(v(), n() - third + 1, third)
    jit = lambda x: V.vstd(V.diffs(x)) / (F.abs(H.ols_slope(x)) + 1e-9)
    on, off = jit(a) < 5.0, jit(b) < 5.0
    lo, hi = r.num("min_duration_days", 7.0), r.num("max_duration_days", 365.0)
    conf = 0.5 + 0.25 * (on.cast("int") + off.cast("int"))
    return on & off, conf, {"duration_days": n() / r.num("samples_per_day", 1.0), "smooth_onset": on, "smooth_decay": off, "min_duration_days": F.lit(lo), "max_duration_days": F.lit(hi)}, 8


@register_detector("etm_harmonics")
def _(r):
    d = H.dominant_period(v()) / r.num("samples_per_day", 1.0)
    a, b = F.abs(d - 365.25) <= 30.0, F.abs(d - 182.625) <= 15.0
    return a | b, F.when(a, 1.0).when(b, 0.8).otherwise(0.0), {"is_annual": a, "is_semiannual": b}, 8


@register_detector("common_mode_pca")
def _(r):
    x = r.get("leading_share", 0.0)
    return x > 0.5, x, {"is_spatially_correlated": x > 0.5, "leading_eigenvalue_fraction": x}, 0


@register_detector("phase_jump_2pi_detector")
def _(r):
    m = H.quarter_step(v())
    k = F.rint(m / (2 * math.pi))
    off = F.abs(m - k * 2 * math.pi)
    near = off < 0.1 * math.pi
    return near & (k != 0), F.when(near, S.clamp01(1.0 - off / (0.1 * math.pi))).otherwise(0.0), {"step_magnitude": m, "is_2pi_multiple": near & (k != 0)}, 4


@register_detector("metadata_driven_step")
def _(r):
    hit = r.get("has_log_entry", False)
    return hit, F.when(hit, 1.0).otherwise(0.0), {"has_maintenance_log_entry": hit}, 0


# The three packs as (label, shape, detector, parameters, predicate in SQL).
PACKS = {
    "hydrology": [
        ("baseflow", "plateau", "eckhardt_baseflow", {"BFImax": 0.8, "a": 0.98}, "Q_mean < BFImax * Q_median"),
        ("stormflow", "transient", "peak_detection_plus_ascending_limb_fit", {"peak_ratio_threshold": 3.0}, "rising_limb_detected and peak_Q > peak_ratio_threshold * Q_median"),
        ("peak_flow", "spike", "hampel_peak", {}, "peak_Q > 5 * Q_median and duration_samples < 3 * dt"),
        ("rising_limb", "trend", "slope_sign_plus_context", {}, "slope > 0 and preceded_by_baseflow"),
        ("recession_limb", "trend", "slope_sign_plus_context", {"recession_slope_max": 0.1}, "slope < 0 and abs(slope) < recession_slope_max and follows_peak_flow"),
        ("snowmelt_freshet", "transient", "seasonal_context_plus_transient_fit", {}, "is_spring and sustained_rise_weeks >= 2"),
        ("drought", "plateau", "low_flow_threshold_plus_duration", {}, "low_flow_fraction > 0.9 and duration_days > 30"),
        ("ENSO_phase", "cycle", "mei_index_plus_period_check", {}, "dominant_period_years >= 2 and dominant_period_years <= 7"),
        ("PDO_phase", "cycle", "pdo_index_plus_period_check", {}, "dominant_period_years >= 15 and dominant_period_years <= 30"),
    ],
    "remote-sensing": [
        ("greenup", "trend", "timesat_threshold", {"threshold_percent": 20}, "slope > 0 and is_in_window and crosses_threshold"),
        ("senescence", "trend", "timesat_threshold", {"threshold_percent": 80}, "slope < 0 and is_in_window and crosses_threshold"),
        ("peak_of_season", "plateau", "mstl_peak_window", {}, "amplitude_above_max_ratio > 0.9 and duration_short"),
        ("dormancy", "plateau", "low_amplitude_plus_duration", {}, "amplitude_below_max_ratio > 0.8 and duration_long"),
        ("disturbance", "step", "bfast_breakpoint", {"magnitude_threshold": -0.2}, "negative_step_magnitude < magnitude_threshold"),
        ("recovery", "trend", "landtrendr_positive_slope_post_disturbance", {"min_recovery_slope": 0.05}, "slope > min_recovery_slope and follows_disturbance"),
        ("wet_up", "trend", "slope_plus_context", {}, "slope > 0 and follows_dry_down"),
        ("dry_down", "trend", "slope_plus_context", {}, "slope < 0 and follows_wet_up"),
        ("heatwave", "transient", "percentile_threshold_plus_duration", {}, "mean_above_p95 and duration_days >= 3"),
        ("coldwave", "transient", "percentile_threshold_plus_duration", {}, "mean_below_p5 and duration_days >= 3"),
        ("cloud_gap", "noise", "missingness_mask", {}, "missingness_mask_value"),
        ("APS", "noise", "gacos_correction_residual", {}, "is_atmospheric_pattern"),
        ("seasonal_deformation", "cycle", "mstl_annual_component", {"annual_tolerance_days": 30}, "is_annual_period"),
        ("linear_deformation", "trend", "etm_linear_rate", {"velocity_threshold": 0.0}, "abs(linear_rate) > velocity_threshold"),
    ],
    "seismo-geodesy": [
        ("P_arrival", "step", "sta_lta", {"window_sta_seconds": 1.0, "window_lta_seconds": 10.0, "threshold": 4.0}, ""),
        ("S_arrival", "step", "sta_lta_with_polarization", {"window_sta_seconds": 1.0, "window_lta_seconds": 10.0, "threshold": 3.0}, ""),
        ("coda", "transient", "post_S_envelope_fit", {}, ""),
        ("surface_waves", "cycle", "dispersive_wave_detection", {}, ""),
        ("tremor", "noise", "envelope_correlation_plus_lfe", {"sustained_threshold": 1.0}, "low_frequency_amplitude > threshold and sustained_minutes > sustained_threshold"),
        ("coseismic_offset", "step", "etm_step_from_known_origin", {"detection_threshold": 0.0}, "abs(step_magnitude) > detection_threshold and origin_time_known"),
        ("postseismic_relaxation", "transient", "fit_log_or_exp", {}, "follows_coseismic_offset and basis_type in ('log', 'exp')"),
        ("interseismic_loading", "trend", "etm_linear_rate_ex_steps_ex_transients", {}, "excludes_coseismic_offset and excludes_postseismic_relaxation"),
        ("SSE", "transient", "gratsid_bump", {"min_duration_days": 7, "max_duration_days": 365}, "duration_days >= min_duration_days and duration_days <= max_duration_days and smooth_onset and smooth_decay"),
        ("seasonal_signal", "cycle", "etm_harmonics", {}, "is_annual or is_semiannual"),
        ("common_mode_error", "noise", "common_mode_pca", {}, "is_spatially_correlated"),
        ("tropospheric_delay", "noise", "gacos_or_pyaps_correction_residual", {}, "is_spatial_atmospheric_pattern"),
        ("unwrapping_error", "step", "phase_jump_2pi_detector", {}, "is_2pi_multiple"),
        ("antenna_offset", "step", "metadata_driven_step", {}, "has_maintenance_log_entry"),
    ],
}
NEEDS_ENVELOPE = {"post_S_envelope_fit", "envelope_correlation_plus_lfe"}


def match_label(frames: DataFrame, label, gate: bool = True, shape: str = "shape") -> DataFrame:
    """``matched`` and ``confidence`` of one label for every segment row; with ``gate`` only rows of its shape can match."""
    name, want, det, params, pred = label
    rows = frames.where(F.col(shape) == want) if gate else frames
    if det in NEEDS_ENVELOPE and "envelope" not in rows.columns:
        rows = rows.withColumn("envelope", envelope(F.col("v")))
    m, c, ctx, least = DETECTORS[det](Row(rows.columns, params))
    names = {k: f"_c_{k}" for k in ctx}
    rows = rows.withColumns({names[k]: x for k, x in ctx.items()}).withColumns({"_m": m, "_f": c})
    text = re.sub(r"[A-Za-z_][A-Za-z_0-9]*", lambda w: names.get(w.group(0), w.group(0)), pred)
    ok = F.coalesce(F.expr(text), F.lit(False)) if pred else F.lit(True)
    hit = F.coalesce((n() >= least) & F.col("_m") & ok, F.lit(False))
    out = rows.withColumn("matched", hit).withColumn("confidence", F.when(F.col("matched"), F.col("_f")).otherwise(0.0))
    return out.select("series_id", "segment_id", F.lit(name).alias("semantic_label"), "matched", "confidence")


def run_pack(frames: DataFrame, pack: str | list, shape: str = "shape") -> DataFrame:
    """Matched labels of a pack, rows (series_id, segment_id, semantic_label, confidence).

    One projection over the shared segment rows; every label's columns sit behind
    its shape test, so a row only pays for the labels of its shape.
    """
    labels = PACKS[pack] if isinstance(pack, str) else pack
    rows = frames
    if any(l[2] in NEEDS_ENVELOPE for l in labels) and "envelope" not in rows.columns:
        wanted = sorted({l[1] for l in labels if l[2] in NEEDS_ENVELOPE})
        rows = rows.withColumn("envelope", envelope(F.when(F.col(shape).isin(*wanted), F.col("v")).otherwise(F.array().cast("array<double>"))))
    cols, texts, needs = {}, [], []
    for i, (name, want, det, params, pred) in enumerate(labels):
        m, c, ctx, least = DETECTORS[det](Row(frames.columns + (["envelope"] if "envelope" in rows.columns else []), params))
        gate = (F.col(shape) == want) & (n() >= least)
        names = {k: f"_c{i}_{k}" for k in ctx}
        cols.update({names[k]: F.when(gate, x) for k, x in ctx.items()})
        cols.update({f"_m{i}": F.when(gate, m), f"_f{i}": F.when(gate, c)})
        texts.append(re.sub(r"[A-Za-z_][A-Za-z_0-9]*", lambda w: names.get(w.group(0), w.group(0)), pred))
    rows = rows.withColumns(cols)
    hits = [F.when(F.col(f"_m{i}") & (F.coalesce(F.expr(t), F.lit(False)) if t else F.lit(True)),
                   F.struct(F.lit(l[0]).alias("semantic_label"), F.col(f"_f{i}").cast("double").alias("confidence"))) for i, (l, t) in enumerate(zip(labels, texts))]
    return rows.select("series_id", "segment_id", F.explode(F.array_compact(F.array(*hits))).alias("_h")).select("series_id", "segment_id", "_h.*")


def best_label(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """Most confident label per segment; null when none matched."""
    b = matches.groupBy("series_id", "segment_id").agg(F.max(F.struct("confidence", "semantic_label")).alias("_b"))
    return segments.select("series_id", "segment_id").join(b, ["series_id", "segment_id"], "left").select(
        "series_id", "segment_id", F.col("_b.semantic_label").alias("semantic_label"), F.col("_b.confidence").alias("confidence"))


def validate_pack(frames: DataFrame, labels: list) -> list[str]:
    """Problems of a user pack before use: unknown shape or detector, predicate that does not resolve or uses powers."""
    out = []
    for name, shape, det, params, pred in labels:
        if shape not in C.SHAPES:
            out.append(f"{name}: unknown shape {shape}")
        if det not in DETECTORS:
            out.append(f"{name}: unknown detector {det}")
        elif "**" in pred or re.search(r"\b(pow|power)\s*\(", pred):
            out.append(f"{name}: powers are not allowed")
        else:
            try:
                match_label(frames, (name, shape, det, params, pred), False).schema
            except Exception as exc:
                out.append(f"{name}: {str(exc).splitlines()[0][:120]}")
    return out


# --- context for the detectors ------------------------------------------------------------

def point_in_segment(segments: DataFrame, log: DataFrame, width: int = 512) -> DataFrame:
    """First log entry inside each segment (log: series_id, t); interval lookup on (series, position bucket)."""
    s = segments.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_index") / width), F.floor(F.col("end_index") / width))))
    l = log.select("series_id", F.col("t").alias("_t"), F.floor(F.col("t") / width).alias("_b"))
    m = s.join(l, ["series_id", "_b"]).where(F.col("_t").between(F.col("start_index"), F.col("end_index"))).groupBy("series_id", "segment_id").agg(
        F.min("_t").alias("log_match"))
    return segments.join(m, ["series_id", "segment_id"], "left").withColumn("has_log_entry", F.col("log_match").isNotNull())


def network_sizes(residuals: DataFrame) -> DataFrame:
    """(network, _by_t, _many): whether a network has fewer times than stations, and more than one station."""
    n = residuals.groupBy("network").agg(F.approx_count_distinct("station").alias("_ns"), F.approx_count_distinct("t").alias("_nt"),
                                         (F.min("station") < F.max("station")).alias("_many"))
    return n.select("network", (F.col("_nt") < F.col("_ns")).alias("_by_t"), "_many")


def product_sums(residuals: DataFrame, size: DataFrame) -> DataFrame:
    """(network, i, j, c): upper triangle of the matrix of product sums between stations or between times of a network,
    whichever are fewer, from residuals centred by station.  Pairs are summed in the task that forms them."""
    m = residuals.groupBy("network", "station").agg(F.avg("value").alias("_m"))
    r = residuals.join(m, ["network", "station"]).select("network", "station", "t", (F.col("value") - F.col("_m")).alias("x"))
    r = r.join(size.select("network", "_by_t"), "network")

    def pairs(of: DataFrame, own: str, other: str) -> DataFrame:
        g = of.groupBy("network", own).agg(F.array_sort(F.collect_list(F.struct(F.col(other).cast("string").alias("k"), "x"))).alias("_s"))
        p = g.select("network", F.posexplode("_s").alias("_i", "a"), "_s")
        p = p.select("network", "a", F.explode(F.slice("_s", F.col("_i") + 1, F.size("_s"))).alias("b"))
        return p.groupBy("network", F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("c"))

    return pairs(r.where("_by_t"), "station", "t").unionByName(pairs(r.where("not _by_t"), "t", "station"))


def leading_share(residuals: DataFrame) -> DataFrame:
    """Share of the leading eigenvalue of the station covariance per network (network, station, t, value).

    A missing residual counts as zero, so the matrix between times has the same leading eigenvalue and trace as that between
    stations; the smaller one meets numpy.
    """
    size = network_sizes(residuals)
    c = product_sums(residuals, size)

    def top(pdf):
        import numpy as np
        ids = {s: k for k, s in enumerate(sorted(set(pdf["i"]) | set(pdf["j"])))}
        M = np.zeros((len(ids), len(ids)))
        for i, j, x in zip(pdf["i"], pdf["j"], pdf["c"]):
            M[ids[i], ids[j]] = M[ids[j], ids[i]] = x
        e = np.maximum(np.linalg.eigvalsh(M), 0)
        return pd.DataFrame({"network": [pdf["network"].iloc[0]], "_share": [float(e[-1] / e.sum()) if e.sum() > 0 else 0.0]})
    shares = c.groupBy("network").applyInPandas(top, f"network {dict(residuals.dtypes)['network']}, _share double")
    return shares.join(size.select("network", "_many"), "network").select("network", F.when(F.col("_many"), F.col("_share")).otherwise(0.0).alias("leading_share"))
