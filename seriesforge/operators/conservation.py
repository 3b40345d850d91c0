"""Conservation laws and linear projections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import wrap_phase

# Tolerances by law; hard laws.
TOLERANCE = {"water_balance": 1e-6, "moment_balance": 1e-9, "phase_closure": 0.1, "nnr_frame": 1e-9}
HARD_LAWS = ("phase_closure", "nnr_frame")

# Default compensation by domain.
MODE_BY_DOMAIN = {"hydrology": "local", "seismo-geodesy": "coupled", "seismo_geodesy": "coupled", "geodesy": "coupled",
                  "remote-sensing": "local", "remote_sensing": "local"}


def water_balance(df: DataFrame, mode: str = "local") -> DataFrame:
    """P - ET - Q - dS: report, put on storage, or spread over the four terms."""
    r = F.col("P") - F.col("ET") - F.col("Q") - F.col("dS")
    d = df.withColumn("initial_residual", r)
    if mode == "local":
        d = d.withColumn("dS", F.col("dS") + F.col("initial_residual"))
    elif mode == "coupled":
        q = F.col("initial_residual") / 4.0
        d = d.withColumns({"P": F.col("P") - q, "ET": F.col("ET") + q, "Q": F.col("Q") + q, "dS": F.col("dS") + q})
    return d.withColumn("final_residual", r)


def moment_balance(df: DataFrame, mode: str = "local") -> DataFrame:
    """Trace of m11..m33 to zero."""
    r = F.col("m11") + F.col("m22") + F.col("m33")
    d = df.withColumn("initial_residual", r)
    if mode == "local":
        d = d.withColumn("m33", F.col("m33") - F.col("initial_residual"))
    elif mode == "coupled":
        d = d.withColumns({m: F.col(m) - F.col("initial_residual") / 3.0 for m in ("m11", "m22", "m33")})
    return d.withColumn("final_residual", r)


def phase_closure(df: DataFrame, mode: str = "local") -> DataFrame:
    """Wrapped phi_12 + phi_23 - phi_13."""
    r = wrap_phase(F.col("phi_12") + F.col("phi_23") - F.col("phi_13"))
    d = df.withColumn("initial_residual", r)
    c = F.col("initial_residual")
    if mode == "local":
        d = d.withColumn("phi_13", F.col("phi_13") + c)
    elif mode == "coupled":
        d = d.withColumns({"phi_12": F.col("phi_12") - c / 3.0, "phi_23": F.col("phi_23") - c / 3.0, "phi_13": F.col("phi_13") + c / 3.0})
    return d.withColumn("final_residual", r)


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def nnr_frame(df: DataFrame, mode: str = "local", key: str = "network") -> DataFrame:
    """No-net-rotation: group sums give the 3 x 3 system, its closed-form inverse gives omega, one row per network."""
    r = [F.col(c) for c in ("x", "y", "z")]
    v = [F.col(c) for c in ("vx", "vy", "vz")]
    net = _cross(r, v)
    rr = r[0] * r[0] + r[1] * r[1] + r[2] * r[2]
    s = df.groupBy(key).agg(*[F.sum(net[i]).alias(f"b{i}") for i in range(3)], F.count(F.lit(1)).alias("n_stations"),
                            *[F.sum((rr if i == j else F.lit(0.0)) - r[i] * r[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)])
    A = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    cof = [[A[(i + 1) % 3][(j + 1) % 3] * A[(i + 2) % 3][(j + 2) % 3] - A[(i + 1) % 3][(j + 2) % 3] * A[(i + 2) % 3][(j + 1) % 3]
            for j in range(3)] for i in range(3)]
    det = A[0][0] * cof[0][0] + A[0][1] * cof[0][1] + A[0][2] * cof[0][2]
    om = [F.try_divide(sum((cof[j][i] * F.col(f"b{j}") for j in range(1, 3)), cof[0][i] * F.col("b0")), det) for i in range(3)]
    s = s.where("n_stations >= 3").select(key, *[om[i].alias(f"w{i}") for i in range(3)], *[F.col(f"b{i}").alias(f"net{i}") for i in range(3)])
    j = df.join(s, key)
    if mode == "naive":
        return j
    turn = _cross([F.col(f"w{i}") for i in range(3)], r)
    return j.withColumns({c: v[i] - turn[i] for i, c in enumerate(("vx", "vy", "vz"))})


LAWS = {"water_balance": water_balance, "moment_balance": moment_balance, "phase_closure": phase_closure, "nnr_frame": nnr_frame}


def register_law(name: str, fn) -> None:
    """Add a law: DataFrame, mode -> DataFrame with initial_residual and final_residual."""
    LAWS[name] = fn


def enforce(df: DataFrame, law: str, mode: str = "local", tolerance: float | None = None, key: str | None = None):
    """(edited rows, audit row: max |residual| before and after, converged)."""
    if law not in LAWS:
        raise ValueError(f"unknown law {law!r}; registered: {sorted(LAWS)}")
    if mode not in ("naive", "local", "coupled"):
        raise ValueError(f"unknown mode {mode!r}")
    out = LAWS[law](df, mode)
    tol = TOLERANCE.get(law, 1e-6) if tolerance is None else tolerance
    ks = [key] if key else []
    if law == "nnr_frame":
        ks = ["network"]
        r, v = [F.col(c) for c in ("x", "y", "z")], [F.col(c) for c in ("vx", "vy", "vz")]
        net = _cross(r, v)
        a = out.groupBy(*ks).agg(F.greatest(*[F.max(F.abs(F.col(f"net{i}"))) for i in range(3)]).alias("initial"),
                                 F.greatest(*[F.abs(F.sum(n)) for n in net]).alias("final"))
    else:
        a = out.groupBy(*ks).agg(F.max(F.abs("initial_residual")).alias("initial"), F.max(F.abs("final_residual")).alias("final"))
    audit = a.withColumns({"law": F.lit(law), "mode": F.lit(mode), "tolerance": F.lit(tol), "converged": F.col("final") <= tol})
    return out, audit


def project_linear(points: DataFrame, weights: DataFrame, targets: DataFrame, mode: str = "local",
                   key: str = "series_id") -> DataFrame:
    """Least-change projection of edited points on linear constraints sum(w x) = target.

    ``points``: key, t, value, in_mask; ``weights``: constraint_id, key, t, weight; ``targets``: constraint_id,
    key, target.  Residuals and Gram sums are aggregates; one constraint per key divides by its sum of squares,
    several solve a small system per key.
    """
    if mode == "naive":
        return points.withColumn("projected", F.col("value"))
    use = F.col("in_mask") if mode == "local" else F.lit(True)
    pw = points.join(weights, [key, "t"])
    w = F.when(use, F.col("weight")).otherwise(0.0)
    r = (pw.groupBy(key, "constraint_id").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
         .join(targets, [key, "constraint_id"]).select(key, "constraint_id", (F.col("s") - F.col("target")).alias("r")))
    # Gram entries pair the few constraints that share a point.
    at = pw.groupBy(key, "t").agg(F.collect_list(F.struct("constraint_id", w.alias("w"))).alias("_c"))
    pairs = at.select(key, F.explode("_c").alias("_a"), "_c").select(key, "_a", F.explode("_c").alias("_b"))
    gram = pairs.groupBy(key, F.col("_a.constraint_id").alias("i"), F.col("_b.constraint_id").alias("j")).agg(
        F.sum(F.col("_a.w") * F.col("_b.w")).alias("g"))
    g = gram.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "g"))).alias("_g"))
    rs = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("constraint_id", "r"))).alias("_r"))
    sys = g.join(rs, key).withColumn("_n", F.size("_r"))
    single = F.array(F.try_divide(F.get("_r.r", F.lit(0)), F.get("_g.g", F.lit(0))))
    y = sys.withColumn("_y", F.when(F.col("_n") == 1, single).otherwise(_solve_full(F.col("_g.g"), F.col("_r.r"))))
    mult = y.select(key, F.explode(F.arrays_zip(F.col("_r.constraint_id").alias("constraint_id"), F.col("_y").alias("y"))).alias("_m")).select(
        key, F.col("_m.constraint_id").alias("constraint_id"), F.col("_m.y").alias("y"))
    shift = (weights.join(mult, [key, "constraint_id"]).groupBy(key, "t").agg(F.sum(F.col("weight") * F.coalesce("y", F.lit(0.0))).alias("_d")))
    j = points.join(shift, [key, "t"], "left")
    return j.withColumn("projected", F.col("value") - F.when(use, F.coalesce("_d", F.lit(0.0))).otherwise(0.0)).drop("_d")


def _solve_full(g: Column, r: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        import numpy as np
        return pd.Series([(np.linalg.pinv(np.reshape(x, (len(y), len(y)))) @ np.asarray(y, float)).tolist() if len(x) == len(y) ** 2 else None
                          for x, y in zip(a, b)])
    return F.pandas_udf(run, "array<double>")(g, r)
