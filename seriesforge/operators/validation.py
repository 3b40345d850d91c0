"""Statistical checks of edits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .scan import CHUNK, HALO, Recursion, run_ordered


def neighbour_thresholds(distances: DataFrame, key: str = "dataset", quantile: float = 0.9) -> DataFrame:
    """q90 of the unlike-neighbour distances per dataset; the distribution itself stays a table."""
    return distances.groupBy(key).agg(F.percentile("distance", F.lit(quantile)).alias("q90"), F.count(F.lit(1)).alias("n"))


def percentile_rank(x: DataFrame, reference: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Share of reference values <= value, per key, without joining rows to rows.

    Both sides are first reduced to distinct values, then cut at 256 quantile
    edges of the reference: a value counts whole bins below it from the bin table
    and runs a cumulative count only inside its own bin.  Without keys the edges
    and bins are scalar subqueries.
    """
    marks = [i / 256 for i in range(1, 256)]
    agg = (F.percentile_approx(value, marks, 10000).alias("_e"), F.count(F.lit(1)).alias("_total"))
    ref = reference.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    bin_of = F.size(F.filter("_e", lambda e: e < F.col(value)))
    if keys:
        edges = reference.groupBy(*keys).agg(*agg)
        add = lambda d: d.join(edges, keys)
    else:
        one = reference.agg(F.struct(*agg).alias("_s")).scalar()
        add = lambda d: d.withColumn("_s", one).select(*d.columns, "_s._e", "_s._total")
    r = add(ref).select(*keys, value, "_n", bin_of.alias("_b"))
    bins = r.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    packed = F.collect_list(F.struct("_b", "_n")).alias("_bins")
    xs = add(x.select(*keys, value).distinct()).withColumn("_b", bin_of).drop("_e")
    xs = xs.join(bins.groupBy(*keys).agg(packed), keys) if keys else xs.withColumn("_bins", bins.agg(packed).scalar())
    whole = F.aggregate(F.filter("_bins", lambda s: s["_b"] < F.col("_b")), F.lit(0).cast("long"), lambda a, s: a + s["_n"])
    left = xs.select(*keys, "_b", value, F.lit(1).alias("_q"), F.lit(0).cast("long").alias("_n"), whole.alias("_w"), "_total")
    none = F.lit(None).cast("long")
    right = r.select(*keys, "_b", value, F.lit(0).alias("_q"), "_n", none.alias("_w"), none.alias("_total"))
    run = W.partitionBy(*keys, "_b").orderBy(value, "_q").rowsBetween(W.unboundedPreceding, 0)
    m = left.unionByName(right).withColumn("_c", F.sum("_n").over(run)).where("_q = 1")
    return x.join(m.select(*keys, value, ((F.col("_w") + F.col("_c")) / F.col("_total")).alias("pct")), [*keys, value])


# --- distance of an edit ----------------------------------------------------------------

def edit_distance(pairs: DataFrame, nun: DataFrame | None = None, keys=("series_id", "segment_id"), metric: str = "l2",
                  eps: float = 1e-6, sparsity_min: float = 0.7) -> DataFrame:
    """Proximity and sparsity of edits (rows with value and edited), rank among unlike-neighbour distances, too-dense flag.

    ``nun``: one column ``value`` of neighbour distances.
    """
    d = F.abs(F.col("value") - F.col("edited"))
    prox = F.sqrt(F.sum(d * d)) if metric == "l2" else F.sum(d)
    g = pairs.groupBy(*keys).agg(prox.alias("proximity"), F.avg((d < eps).cast("double")).alias("sparsity"))
    if nun is None:
        return g.withColumns({"proximity_pct": F.lit(None).cast("double"), "too_dense": F.lit(False)})
    q90 = nun.agg(F.percentile("value", F.lit(0.9)).alias("q")).scalar()
    r = percentile_rank(g.select(*keys, "sparsity", F.col("proximity").alias("value")), nun.select("value"), [])
    return r.withColumn("_q", q90).select(*keys, F.col("value").alias("proximity"), "sparsity", F.col("pct").alias("proximity_pct"),
                                          ((F.col("sparsity") < sparsity_min) & (F.col("value") > F.col("_q"))).alias("too_dense"))


# --- conformal bands ----------------------------------------------------------------------

def calibrate_band(residuals: DataFrame, key: str = "series_id", alpha: float = 0.1) -> DataFrame:
    """Half-width: the (1 - alpha) quantile of absolute residuals."""
    from .layout import quantile
    return quantile(residuals, key, F.abs("residual"), 1.0 - alpha, "q0")


def adaptive_band(residuals: DataFrame, q0: DataFrame, key: str = "series_id", alpha: float = 0.1, kp: float = 0.5,
                  ki: float = 0.1, window: int = 10, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Half-width after each update.  The state, one number and ten errors, feeds back through a threshold; a long series
    runs by chunks (see ``scan``)."""
    from ..streaming.stateful import Band
    rows = residuals.join(q0, key).select(key, "t", F.abs("residual").alias("r"), "q0")
    make = lambda q, errors=(): Band(q, alpha, kp, ki, window, errors)
    band = Recursion("q double", lambda row: make(row.q0), lambda row: [make(row.q0), make(0.0)], lambda b, row: [(b.step(row.r),)],
                     lambda b: json.dumps([b.q, b.errors]), lambda text: make(*json.loads(text)))
    return run_ordered(rows, [key], band, chunk=chunk, halo=halo)


def band_check(edits: DataFrame, bands: DataFrame, key: str = "series_id") -> DataFrame:
    """Verdict of |y_post - y_pre| against the latest half-width at or before the edit."""
    from .layout import asof
    a = asof(edits, bands, ["q"], (key,))
    d = F.abs(F.col("y_post") - F.col("y_pre"))
    v = F.when(d < F.col("q"), "within").when(d < 2.0 * F.col("q"), "exceeds_alpha=0.1").otherwise("exceeds_alpha=0.05")
    return a.withColumns({"delta": d, "verdict": F.when(F.col("q").isNotNull(), v)})


# --- invalidation under noise -----------------------------------------------------------------

# Noise level by operation.
SIGMA = {"raise_lower": 0.05, "amplitude_scale": 0.05, "invert": 0.05, "replace_with_trend": 0.05, "flatten": 0.1,
         "change_slope": 0.05, "stretch_compress": 0.5, "shift_phase": 0.5}


def invalidation_rate(edits: DataFrame, score: Column, gradient_norm: Column, op: Column, threshold: float = 0.0) -> DataFrame:
    """Normal tail of margin over sigma times gradient norm for a locally linear score."""
    from ..config import lookup
    from ..functions.scores import normal_tail
    sigma = F.coalesce(lookup(SIGMA, op), F.lit(0.1))
    margin = F.abs(score - threshold)
    sd = sigma * gradient_norm
    return edits.withColumns({"sigma": sigma, "margin": margin, "invalidation_rate": F.when(sd > 0, normal_tail(margin / sd)).otherwise(0.0)})


def uniform(*parts: Column) -> Column:
    """Deterministic uniform in (0, 1) from a hash of keys; a recomputed task draws the same."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*parts: Column) -> Column:
    """Deterministic standard normal by the Box-Muller map."""
    import math
    return F.sqrt(-2.0 * F.ln(uniform(*parts, F.lit(1)))) * F.cos(2.0 * math.pi * uniform(*parts, F.lit(2)))


def invalidation_monte_carlo(vectors: DataFrame, prototypes: DataFrame, sigma: float = 0.1, n: int = 50) -> DataFrame:
    """Share of noisy copies whose nearest-prototype label differs from the original's."""
    from .prototypes import classify
    base = classify(vectors.select("id", "v"), prototypes, "neg_sq_l2").select("id", F.col("label").alias("_l"))
    s = vectors.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    noisy = s.select(F.struct("id", "rep").alias("k"), F.transform("v", lambda x, i: x + sigma * normal(F.col("id"), F.col("rep"), i)).alias("v"))
    c = classify(noisy, prototypes, "neg_sq_l2", id_col="k").select(F.col("k.id").alias("id"), "label")
    return c.join(base, "id").groupBy("id").agg(F.avg((F.col("label") != F.col("_l")).cast("double")).alias("invalidation_rate"))


# --- bootstrap -----------------------------------------------------------------------------------

# Multipliers of public 32-bit mixing hashes; products stay below 2**63.
RANGE, MIX, SPREAD = 1 << 32, 73244475, 2654435761


def mixed(x: Column) -> Column:
    """32-bit mixing hash (xor-shift and multiply, twice) that other engines can repeat.

    Each step binds its argument, which it uses twice; written out, the expression would double with every step.
    """
    bound = lambda y, f: F.get(F.transform(F.array(y), f), F.lit(0))
    for _ in range(2):
        x = bound(x, lambda y: (y.bitwiseXOR(F.shiftright(y, 16)) * MIX) % RANGE)
    return bound(x, lambda y: y.bitwiseXOR(F.shiftright(y, 16)))


def draw(rep: Column, t: Column, seed: int) -> Column:
    """Hash of (replicate, position, seed) in [0, 2**32)."""
    return mixed((mixed(rep.cast("long") + seed * 7919) + t.cast("long") * SPREAD) % RANGE)


def mixed_number(x: int) -> int:
    """``mixed`` of one number."""
    for _ in range(2):
        x = (x ^ x >> 16) * MIX % RANGE
    return x ^ x >> 16


def with_mixed(df: DataFrame, name: str) -> DataFrame:
    """``mixed`` of a column, one projection a step: a step uses its input twice and so is not folded into the next."""
    x = F.col(name)
    for _ in range(2):
        df = df.withColumn(name, (x.bitwiseXOR(F.shiftright(x, 16)) * MIX) % RANGE)
    return df.withColumn(name, x.bitwiseXOR(F.shiftright(x, 16)))


def restarts(points: DataFrame, block: Column | float, replicates: int, seed: int, key: str) -> DataFrame:
    """(key, rep, t, n, s): places where a block of a replicate begins, and the source it begins at; the draws are those of
    ``draw`` under ``seed`` and ``seed + 101``."""
    n = points.groupBy(key).agg((F.max("t") + 1).alias("n"))
    g = points.select(key, "t").join(n, key)
    g = g.withColumn("_b", block if isinstance(block, Column) else F.lit(float(block)))
    of_rep = [F.struct(F.lit(k).alias("rep"), *(F.lit(mixed_number(k + s * 7919)).cast("long").alias(c) for c, s in (("_h", seed), ("_s", seed + 101)))) for k in range(replicates)]
    g = g.withColumn("_r", F.explode(F.array(*of_rep))).select(key, "t", "n", "_b", "_r.*")
    for c in ("_h", "_s"):
        g = with_mixed(g.withColumn(c, (F.col(c) + F.col("t").cast("long") * SPREAD) % RANGE), c)
    # an outer explode keeps the filter above the projections, which it would otherwise repeat
    g = g.withColumn("_at", F.explode_outer(F.array("_h"))).where((F.col("t") == 0) | (F.col("_at") < float(RANGE) / F.col("_b")))
    return g.select(key, "rep", "t", "n", (F.col("_s") % F.col("n")).cast("long").alias("s"))


def stationary_bootstrap(points: DataFrame, block: Column | float, replicates: int, seed: int = 7, key: str = "series_id",
                         value: str = "value") -> DataFrame:
    """Resampled series (key, rep, t, value): geometric blocks with wrap-around.

    Each grid row takes the latest restart, carried per chunk, and its source value from one equi-join on the wrapped
    index.  The joins are told to merge: sizes are estimated before rows are repeated per replicate, and a grid was
    broadcast.
    """
    from .layout import running_last
    r = restarts(points, block, replicates, seed, key)
    grid = points.select(key, "t").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    g = grid.join(r.select(key, "rep", "t", F.struct("s", F.col("t").alias("at"), "n").alias("_r")).hint("merge"), [key, "rep", "t"], "left")
    c = running_last(g.select(key, "rep", "t", "_r.*"), ["s", "at", "n"], (key, "rep"))
    src = F.pmod(F.col("last_s") + F.col("t") - F.col("last_at"), F.col("last_n")).cast("int")
    c = c.select(key, "rep", "t", src.alias("_src"))
    return c.join(points.select(key, F.col("t").alias("_src"), F.col(value).alias("value")).hint("merge"), [key, "_src"]).drop("_src")


def bootstrap_moments(points: DataFrame, block: Column | float, replicates: int, seed: int = 7, key: str = "series_id", value: str = "value") -> DataFrame:
    """(key, rep, n, total, t_total): sums of value and of t * value over the replicates of ``stationary_bootstrap``.

    A block is a stretch of the source, so prefix sums at its two ends give its share; only block ends meet the points,
    never a replicate's rows.
    """
    from .layout import neighbours, running_sums
    r = restarts(points, block, replicates, seed, key).withColumn("_kr", F.struct(key, "rep"))
    r = neighbours(r, "t", ["t"], "_kr", back=False).withColumn("_last", F.col("s") + F.coalesce("next_t", "n") - F.col("t") - 1)
    p = running_sums(points.select(key, "t", F.col(value).alias("v")), {"_v": F.col("v"), "_tv": F.col("t") * F.col("v")}, (key,))
    # a stretch ends at its last source and takes off what lies before its first; one that wraps adds the whole series
    shift = F.col("t") - F.col("s")
    over = F.col("_last") >= F.col("n")
    end = lambda at, sign, move: F.struct(at.cast("int").alias("u"), F.lit(sign).alias("sign"), move.cast("double").alias("move"), F.lit(sign < 0).alias("before"))
    beyond = F.when(over, shift + F.col("n")).otherwise(shift)
    ends = F.array(end(F.col("s"), -1, shift), end(F.col("_last") % F.col("n"), 1, beyond))
    whole = F.when(over, F.array(end(F.col("n") - 1, 1, shift))).otherwise(F.array().cast("array<struct<u:int,sign:int,move:double,before:boolean>>"))
    e = r.select(key, "rep", "n", F.explode(F.concat(ends, whole)).alias("e")).select(key, "rep", "n", "e.*")
    # merged as told: sizes are estimated before rows are repeated per replicate
    j = e.join(p.select(key, F.col("t").alias("u"), "v", "_v", "_tv").hint("merge"), [key, "u"])
    own = F.when(F.col("before"), F.col("v")).otherwise(0.0)
    total, t_total = F.col("_v") - own, F.col("_tv") - own * F.col("u")
    return j.groupBy(key, "rep").agg(F.max("n").alias("n"), F.sum(F.col("sign") * total).alias("total"), F.sum(F.col("sign") * (t_total + F.col("move") * total)).alias("t_total"))


def interval(stats: DataFrame, key: str = "series_id", alpha: float = 0.05, value: str = "_s") -> DataFrame:
    """Percentile interval and two-sided p of one value per replicate."""
    s = F.col(value)
    pa, pb = F.avg((s >= 0).cast("double")), F.avg((s <= 0).cast("double"))
    return stats.groupBy(key).agg(F.percentile(s, F.lit(alpha / 2)).alias("ci_lower"), F.percentile(s, F.lit(1 - alpha / 2)).alias("ci_upper"),
                                  F.least(F.lit(1.0), 2.0 * F.least(pa, pb)).alias("p_value"), F.avg(s).alias("boot_mean"), F.stddev_pop(s).alias("boot_std"))


def bootstrap_ci(boot: DataFrame, statistic: Column, key: str = "series_id", alpha: float = 0.05) -> DataFrame:
    """Interval of a replicate statistic (an aggregate column over the replicate's rows)."""
    return interval(boot.groupBy(key, "rep").agg(statistic.alias("_s")), key, alpha)


def bootstrap_mean_ci(points: DataFrame, block: Column | float, replicates: int, seed: int = 7, key: str = "series_id", alpha: float = 0.05,
                      less: float = 0.0) -> DataFrame:
    """Interval of the mean, minus ``less``, from block ends alone."""
    m = bootstrap_moments(points, block, replicates, seed, key)
    return interval(m.withColumn("_s", F.col("total") / F.col("n") - less), key, alpha)


def coefficient_ci(points: DataFrame, edited: DataFrame, replicates: int = 50, block: float = 5.0, threshold: float = 3.0,
                   key: str = "series_id") -> DataFrame:
    """Residual bootstrap of a line fit: refit every replicate, z of the edited coefficients, extreme flag.

    ``edited``: key, x0, linear_rate.  The fit is linear, so a replicate's coefficients are the line's plus those of its
    residuals, which two moments give.
    """
    line = points.groupBy(key).agg(F.regr_intercept("value", "t").alias("a"), F.regr_slope("value", "t").alias("b"))
    r = points.join(line, key).withColumn("res", F.col("value") - F.col("a") - F.col("b") * F.col("t"))
    m = bootstrap_moments(r, block, replicates, key=key, value="res").join(line, key)
    n = F.col("n").cast("double")
    st, stt = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = (n * F.col("t_total") - st * F.col("total")) / (n * stt - st * st)
    c = m.select(key, "rep", (F.col("a") + (F.col("total") - slope * st) / n).alias("x0"), (F.col("b") + slope).alias("linear_rate"))
    c = c.unpivot([key, "rep"], ["x0", "linear_rate"], "name", "value")
    s = c.groupBy(key, "name").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.percentile("value", F.lit(0.025)).alias("ci_lower"),
                                   F.percentile("value", F.lit(0.975)).alias("ci_upper"))
    e = edited.unpivot([key], ["x0", "linear_rate"], "name", "edited")
    z = (F.col("edited") - F.col("m")) / F.greatest("sd", F.lit(1e-12))
    return s.join(e, [key, "name"]).withColumns({"z": z, "is_extreme": F.abs(z) > threshold}).drop("m", "sd")


# --- surrogates -----------------------------------------------------------------------------------

def settle(x, y, max_iter: int = 100, tol: float = 1e-6):
    """Rows of ``y``, shuffles of the rows of ``x``, moved towards the spectrum of ``x`` with its values kept.

    All rows advance together; a row leaves when its own step settles.
    """
    import numpy as np
    n = x.shape[1]
    rank, amp = np.sort(x, 1), np.abs(np.fft.rfft(x, axis=1))
    live, prev = np.arange(len(x)), np.full(len(x), np.inf)
    for _ in range(max_iter):
        f = np.fft.rfft(y[live], axis=1)
        z = np.fft.irfft(amp[live] * np.exp(1j * np.angle(f)), n=int(n), axis=1)
        new = np.take_along_axis(rank[live], np.argsort(np.argsort(z, 1), 1), 1)
        gap = ((new - y[live]) ** 2).mean(1)
        y[live] = new
        go = np.abs(prev[live] - gap) >= tol
        prev[live] = gap
        live = live[go]
        if not len(live):
            break
    return y


def surrogate(v: Column, seed: Column, max_iter: int = 100, tol: float = 1e-6) -> Column:
    """Surrogate with the same values and nearly the same spectrum (numpy FFT in Arrow batches)."""
    import pandas as pd

    def run(a, s):
        import numpy as np
        out = pd.Series([None] * len(a), dtype=object)
        lengths = a.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = np.stack(a.iloc[at].to_numpy()).astype(float)
            y = np.stack([np.random.default_rng(abs(int(h))).permutation(r) for r, h in zip(x, s.iloc[at])])
            for i, row in zip(at, settle(x, y, max_iter, tol)):
                out.iat[int(i)] = row.tolist()
        return out
    run.__annotations__ = {"a": pd.Series, "s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(v, seed)


def ordinal_entropy(v: Column, m: int = 4) -> Column:
    """Permutation entropy of an array."""
    from ..functions import vectors as V
    def ent(p):
        u = F.array_distinct(p)
        return V.let(F.struct(p.alias("p"), u.alias("u"), F.size(p).alias("n")), lambda s: F.aggregate(s["u"], F.lit(0.0), lambda a, x: a + V.let(
            F.size(F.filter(s["p"], lambda y: y == x)) / s["n"], lambda q: -q * F.ln(q))))
    def pats(s):
        return F.transform(F.sequence(F.lit(0), s["n"] - m), lambda i: F.concat_ws(",", F.transform(F.array_sort(F.transform(
            F.slice(s["v"], i + 1, m), lambda x, k: F.struct(x.alias("x"), k.alias("k")))), lambda e: e["k"].cast("string"))))
    return F.when(F.size(v) >= m, V.let(V.let(F.struct(v.alias("v"), F.size(v).alias("n")), pats), ent)).otherwise(0.0)


def ordinal_entropies(x, m: int = 4):
    """Permutation entropy of each row of a matrix; patterns are coded as integers."""
    import numpy as np
    rows, n = x.shape
    if n < m:
        return np.zeros(rows)
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, m, axis=1), axis=2, kind="stable")
    code = (order * m ** np.arange(m)).sum(axis=2) + np.arange(rows)[:, None] * m ** m
    share = np.sort(np.bincount(code.ravel(), minlength=rows * m ** m).reshape(rows, -1), axis=1) / code.shape[1]
    return -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1)


def _entropy_test(v: Column, edited: Column, seed: Column, n: int) -> Column:
    """Mean and deviation of the surrogates' entropy, entropy of the edit and p, all surrogates of a segment at once."""
    def run(a, e, s):
        import numpy as np
        out = np.zeros((len(a), 4))
        sizes = a.map(len).to_numpy()
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            step = max(1, 1_000_000 // max(1, n * size))
            for at in (same[i:i + step] for i in range(0, len(same), step)):
                x = np.repeat(np.stack(a.iloc[at].to_numpy()).astype(float).reshape(len(at), size), n, axis=0)
                y = np.concatenate([np.random.default_rng(abs(int(h))).permuted(x[i * n:(i + 1) * n], axis=1) for i, h in enumerate(s.iloc[at])])
                q = ordinal_entropies(settle(x, y) if size else y).reshape(len(at), n)
                out[at, 0], out[at, 1] = q.mean(axis=1), q.std(axis=1)
                out[at, 2] = [ordinal_entropies(np.asarray(r, float)[None])[0] for r in e.iloc[at]]
                far = np.abs(q - out[at, :1]) >= np.abs(out[at, 2:3] - out[at, :1])
                out[at, 3] = (1.0 + far.sum(axis=1)) / (n + 1.0)
        return pd.DataFrame(out, columns=["q_mean", "q_std", "q_edit", "p_value"])
    run.__annotations__ = {"a": pd.Series, "e": pd.Series, "s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "q_mean double, q_std double, q_edit double, p_value double")(v, edited, seed)


def surrogate_test(segments: DataFrame, n: int = 50, keys=("series_id", "segment_id"), statistic=ordinal_entropy, seed: int = 0) -> DataFrame:
    """Statistic of the edited segment against surrogates of the original (columns v, edited); two-sided p.

    With the default statistic a segment's surrogates are drawn and measured together in one batch; a statistic given as
    a Column function fans segments out over replicates, spread by (segment, replicate).
    """
    if statistic is ordinal_entropy:
        t = segments.withColumn("_t", _entropy_test(F.col("v"), F.col("edited"), F.xxhash64(*keys, F.lit(seed)), n))
        return t.select(*keys, "_t.q_edit", "_t.q_mean", "_t.q_std", "_t.p_value")
    f = segments.select(*keys, "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep")).repartition(*keys, "rep")
    s = f.withColumn("_x", surrogate(F.col("v"), F.xxhash64(*keys, "rep", F.lit(seed)))).withColumn("q", statistic(F.col("_x"))).select(*keys, "q")
    m = s.groupBy(*keys).agg(F.avg("q").alias("q_mean"), F.stddev_pop("q").alias("q_std"))
    e = segments.select(*keys, statistic(F.col("edited")).alias("q_edit")).join(m, list(keys))
    k = s.join(e, list(keys)).groupBy(*keys).agg(F.count_if(F.abs(F.col("q") - F.col("q_mean")) >= F.abs(F.col("q_edit") - F.col("q_mean"))).alias("_k"))
    return e.join(k, list(keys)).withColumn("p_value", (1.0 + F.col("_k")) / (n + 1.0)).drop("_k")


# --- stationarity --------------------------------------------------------------------------------

# Published critical values, unit-root statistic with constant and level statistic.
ADF_TABLE = [(-4.5, 0.0002), (-3.96, 0.0016), (-3.43, 0.01), (-3.12, 0.025), (-2.86, 0.05), (-2.57, 0.10), (-2.2, 0.2), (-1.57, 0.5), (-0.44, 0.9), (0.6, 0.99)]
KPSS_TABLE = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]


def interpolate(x: Column, table: list) -> Column:
    """Piecewise-linear lookup in a constant table, ends held."""
    out = F.when(x <= table[0][0], table[0][1])
    for (a, p), (b, q) in zip(table, table[1:]):
        out = out.when(x <= b, p + (x - a) / (b - a) * (q - p))
    return out.otherwise(table[-1][1])


def unit_root(points: DataFrame, lags: int = 1, key: str = "series_id") -> DataFrame:
    """t statistic of the level in the lagged-difference regression and its interpolated p."""
    import pandas as pd
    from .fits import normal_sums
    from .layout import framed
    k = lags + 1
    p = framed(points, k, 0, {f"_l{i}": lambda w, i=i: F.lag("value", i).over(w()) for i in range(1, k + 1)}, (key,)).where(F.col(f"_l{k}").isNotNull())
    d = [F.col(f"_l{i}") - F.col(f"_l{i + 1}") for i in range(1, lags + 1)]
    X = [F.lit(1.0), F.col("_l1"), *d]
    y = F.col("value") - F.col("_l1")
    g, b = normal_sums(X, y)
    s = p.groupBy(key).agg(g.alias("g"), b.alias("b"), F.sum(y * y).alias("yy"), F.count(F.lit(1)).alias("n"))

    def tstat(gs, bs, yy, ns):
        import numpy as np
        out = []
        for gu, bb, q, n in zip(gs, bs, yy, ns):
            m = len(bb)
            A = np.zeros((m, m))
            A[np.triu_indices(m)] = gu
            A = A + np.triu(A, 1).T
            inv = np.linalg.pinv(A)
            c = inv @ np.asarray(bb, float)
            s2 = max(q - float(c @ bb), 0.0) / max(n - m, 1)
            se = (s2 * inv[1, 1]) ** 0.5 if inv[1, 1] > 0 else 0.0
            out.append(float(c[1] / se) if se > 0 else float("nan"))
        return pd.Series(out)
    tstat.__annotations__ = {a: pd.Series for a in ("gs", "bs", "yy", "ns", "return")}
    r = s.withColumn("adf_t", F.pandas_udf(tstat, "double")("g", "b", "yy", "n"))
    return r.select(key, "adf_t", F.when(~F.isnan("adf_t"), interpolate(F.col("adf_t"), ADF_TABLE)).alias("adf_p"))


def level_stationarity(points: DataFrame, lags: int = 4, key: str = "series_id") -> DataFrame:
    """Level statistic: mean squared partial sums over the long-run variance (triangular weights)."""
    from .layout import running_sums
    from .metrics import lag_correlations
    m = points.groupBy(key).agg(F.avg("value").alias("_m"), F.var_pop("value").alias("_v"), F.count(F.lit(1)).alias("_n"))
    r = running_sums(points.join(m, key), {"_s": F.col("value") - F.col("_m")}, (key,))
    e = r.groupBy(key, "_n", "_v").agg((F.sum(F.col("_s") * F.col("_s")) / (F.col("_n") * F.col("_n"))).alias("_e"))
    rho = lag_correlations(points, lags, key).select(key, "rho")
    w = F.aggregate(F.transform("rho", lambda x, i: 2.0 * (1.0 - (i + 1) / (lags + 1)) * x), F.lit(1.0), lambda a, x: a + x)
    j = e.join(rho, key).withColumn("kpss", F.try_divide("_e", F.col("_v") * w))
    return j.select(key, "kpss", interpolate(F.col("kpss"), KPSS_TABLE).alias("kpss_p"))


def stationarity_verdict(pre: DataFrame, post: DataFrame, window: DataFrame | None = None, lags: int = 1, alpha: float = 0.05,
                         tolerance: float = 0.2, key: str = "series_id") -> DataFrame:
    """Unit-root and level tests before and after an edit, verdict, and whether the break of the edited series lies in
    the edit window widened by ``tolerance`` (window: key, start, end)."""
    both = lambda d, tag: unit_root(d, lags, key).join(level_stationarity(d, 4, key), key).select(
        key, F.col("adf_p").alias(f"adf_{tag}"), F.col("kpss_p").alias(f"kpss_{tag}"))
    j = both(pre, "pre").join(both(post, "post"), key)
    st = lambda tag: (F.col(f"adf_{tag}") < alpha) & (F.col(f"kpss_{tag}") >= alpha)
    j = j.withColumns({"_a": st("pre"), "_b": st("post")})
    v = (F.when(F.col("_a").isNull() | F.col("_b").isNull(), "undetermined").when(F.col("_a") & ~F.col("_b"), "edit_introduced_nonstationarity")
         .when(~F.col("_a") & F.col("_b"), "edit_reduced_nonstationarity").when(F.col("_a"), "stationary_preserved").otherwise("nonstationary_preserved"))
    j = j.withColumn("verdict", v).drop("_a", "_b")
    if window is None:
        return j
    from .fits import best_single_break
    b = best_single_break(post, key=key).join(window, key)
    slack = tolerance * (F.col("end") - F.col("start"))
    b = b.select(key, "break_at", ((F.col("break_at") >= F.col("start") - slack) & (F.col("break_at") <= F.col("end") + slack)).alias("break_consistent"))
    return j.join(b, key, "left")


def detrend(points: DataFrame, key: str = "series_id") -> DataFrame:
    line = points.groupBy(key).agg(F.regr_intercept("value", "t").alias("_a"), F.regr_slope("value", "t").alias("_b"))
    return points.join(line, key).withColumn("value", F.col("value") - F.coalesce(F.col("_a") + F.col("_b") * F.col("t"), F.lit(0.0))).drop("_a", "_b")


def whiten(points: DataFrame, order: int = 1, key: str = "series_id") -> DataFrame:
    """Residual of an autoregression with constant, fitted by normal equations per series."""
    from .fits import linear_coefficients
    from .layout import framed
    p = framed(points, order, 0, {f"_l{i}": lambda w, i=i: F.lag("value", i).over(w()) for i in range(1, order + 1)}, (key,)).where(F.col(f"_l{order}").isNotNull())
    names = {"c": lambda t: t * 0.0 + 1.0, **{f"l{i}": (lambda i: lambda t: F.col(f"_l{i}"))(i) for i in range(1, order + 1)}}
    co = linear_coefficients(p, names, (key,)).drop("n")
    fit = F.element_at("coefficients", F.lit("c")) + sum(F.element_at("coefficients", F.lit(f"l{i}")) * F.col(f"_l{i}") for i in range(1, order + 1))
    return p.join(co, key).select(key, "t", (F.col("value") - fit).alias("value"))


# --- joint tests -------------------------------------------------------------------------------------

def permutation_p(samples: DataFrame, keys: list[str], replicates: int = 100, cap: int = 500) -> DataFrame:
    """Quadratic discrepancy of two bounded samples and its permutation p.

    ``samples``: keys, side, id, value.  The kernel of a key is at most 2 cap wide, so it is built once and only the
    side signs are permuted, from a generator seeded by the key.
    """
    from .metrics import capped_sample
    s = capped_sample(samples, [*keys, "side"], F.xxhash64("id"), cap)
    g = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("side", "id", "value"))).alias("_r"))
    g = g.select(*keys, F.col("_r.value").alias("_v"), F.size(F.filter("_r", lambda e: e["side"] == "x")).alias("_nx"), F.xxhash64(*keys).alias("_h"))

    def run(v: pd.Series, nx: pd.Series, h: pd.Series) -> pd.DataFrame:
        import numpy as np
        rows = []
        for row, k, seed in zip(v, nx, h):
            x, n = np.asarray(row, float), len(row)
            d = np.abs(x[:, None] - x[None])
            med = float(np.median(d[np.triu_indices(n, 1)])) if n > 1 else 1.0
            bw = med if med > 0 else 1.0
            K = np.exp(-d * d / (2 * bw * bw))
            w = np.where(np.arange(n) < k, 1.0 / k, -1.0 / (n - k))
            obs, rng = float(w @ K @ w), np.random.default_rng(abs(int(seed)))
            P = np.stack([rng.permutation(w) for _ in range(replicates)])
            hits = int((np.einsum("ij,jk,ik->i", P, K, P, optimize=True) >= obs).sum())
            rows.append((obs, bw, (1 + hits) / (1.0 + replicates)))
        return pd.DataFrame(rows, columns=["mmd2", "bandwidth", "p_value"])
    u = F.pandas_udf(run, "mmd2 double, bandwidth double, p_value double")
    return g.where("_nx > 0 and _nx < size(_v)").withColumn("_o", u("_v", "_nx", "_h")).select(*keys, "_o.*")


def conservation_significance(pre: DataFrame, post: DataFrame, replicates: int = 50, permutations: int = 50, key: str = "series_id") -> DataFrame:
    """Residual interval after, energy ratio test, and discrepancy of before against after, one row per key."""
    from .metrics import variance_ratio
    ci = bootstrap_mean_ci(post, 5.0, replicates, key=key)
    both = pre.select(key, F.lit("pre").alias("side"), "value").unionByName(post.select(key, F.lit("post").alias("side"), "value"))
    vr = variance_ratio(both, [key]).select(key, "ratio", "f_statistic", F.col("p_value").alias("ratio_p"))
    s = pre.select(key, F.lit("x").alias("side"), F.col("t").alias("id"), "value").unionByName(post.select(key, F.lit("y").alias("side"), F.col("t").alias("id"), "value"))
    mm = permutation_p(s, [key], permutations).select(key, "mmd2", F.col("p_value").alias("mmd_p"))
    return ci.join(vr, key).join(mm, key)


def donor_shift(windows: DataFrame, context: DataFrame, replicates: int = 50, block: int = 3, key: str = "edit_id", seed: int = 7) -> DataFrame:
    """Linear discrepancy of a donor window against its context with a block-permuted p.

    Both: key, i (position), value.  Window and context stand one after another and are cut into blocks of ``block``
    rows; every replicate orders the blocks by a hash, rows keep their order inside a block, and the first rows form the
    window again.  Each value is used once per replicate.  Positions of a block follow from the sizes of the blocks
    before it, so only blocks are ranked.
    """
    from .metrics import mmd_linear
    obs = mmd_linear(windows.withColumn("side", F.lit("x")).unionByName(context.withColumn("side", F.lit("y"))), [key])
    nw = windows.groupBy(key).agg(F.count(F.lit(1)).alias("_w"))
    pooled = windows.select(key, F.col("i").alias("t"), "value").unionByName(
        context.join(nw, key).select(key, (F.col("i") + F.col("_w")).cast("int").alias("t"), "value"))
    pooled = pooled.withColumn("_k", F.floor(F.col("t") / block).cast("long"))
    blocks = pooled.groupBy(key, "_k").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_t0"))
    blocks = blocks.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    order = W.partitionBy(key, "rep").orderBy(draw(F.col("rep"), F.col("_k"), seed), "_k").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_to", F.coalesce(F.sum("_n").over(order), F.lit(0))).select(key, "_k", "rep", "_t0", "_to")
    b = pooled.join(blocks, [key, "_k"]).select(key, "rep", (F.col("_to") + F.col("t") - F.col("_t0")).cast("int").alias("t"), "value").join(nw, key)
    side = F.when(F.col("t") < F.col("_w"), "x").otherwise("y")
    s = b.select(key, "rep", side.alias("side"), F.when(F.col("t") < F.col("_w"), F.col("t")).otherwise(F.col("t") - F.col("_w")).alias("i"), "value")
    m = mmd_linear(s, [key, "rep"]).select(key, "rep", F.col("mmd2").alias("_m")).join(obs, key)
    p = m.groupBy(key).agg(((1 + F.count_if(F.col("_m") >= F.col("mmd2"))) / F.lit(1.0 + replicates)).alias("p_value"))
    return obs.join(p, key)


# --- coefficient-space stability --------------------------------------------------------------------

def coefficient_stability(fits: DataFrame, prototypes: DataFrame, target: Column, n: int = 40, kappa: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """Target-class probability under noise on the line coefficients: mean minus kappa deviations, flip share.

    ``fits``: id, x0, rate, sigma_x0, sigma_rate, residual array.  Noise is drawn by hash; the signal is rebuilt from
    the formula and scored against class prototypes.
    """
    from .prototypes import classify
    from ..functions import vectors as V
    temperature = 0.2
    f = fits.withColumn("target", target)
    s = f.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n))))
    a = F.when(F.col("rep") == 0, F.col("x0")).otherwise(F.col("x0") + F.col("sigma_x0") * normal(F.col("id"), F.col("rep"), F.lit("a")))
    b = F.when(F.col("rep") == 0, F.col("rate")).otherwise(F.col("rate") + F.col("sigma_rate") * normal(F.col("id"), F.col("rep"), F.lit("b")))
    s = s.withColumns({"_a": a, "_b": b}).withColumn("v", F.transform("residual", lambda r, i: F.col("_a") + F.col("_b") * i + r))
    s = s.select(F.struct("id", "rep", "target").alias("id"), "v")
    # softmax share of the target from its own score, the best score and the best label's share; a target without a
    # prototype has none
    own = s.select("id", "v", F.col("id.target").alias("_t")).join(prototypes.select(F.col("label").alias("_t"), "prototype"), "_t", "left")
    own = own.select("id", (V.dot(F.col("v"), F.col("prototype")) / temperature).alias("_own"))
    c = classify(s, prototypes, "cosine", temperature).join(own, "id")
    c = c.select("id.*", "label", F.coalesce(F.exp(F.col("_own") - F.col("score")) * F.col("confidence"), F.lit(0.0)).alias("p"))
    base = c.where("rep = 0").select("id", F.col("label").alias("_l"))
    g = c.where("rep > 0").join(base, "id").groupBy("id").agg(F.avg("p").alias("mu"), F.stddev_pop("p").alias("sigma"),
                                                          F.avg((F.col("label") != F.col("_l")).cast("double")).alias("invalidation_rate"))
    return g.withColumn("cs", F.col("mu") - kappa * F.col("sigma")).withColumn("is_robust", F.col("cs") > threshold)


def stability_bound(terms: DataFrame, margin: DataFrame, key: str = "id") -> DataFrame:
    """Closed-form bound: normal mass of margin over the propagated deviation.

    ``terms``: key, name, sigma, dp (derivative of the probability in that coefficient); ``margin``: key, margin.
    """
    from ..functions.scores import normal_tail
    v = terms.where("sigma > 0").groupBy(key).agg(F.sum(F.col("sigma") * F.col("sigma") * F.col("dp") * F.col("dp")).alias("_v"))
    j = margin.join(v, key, "left")
    return j.select(key, F.when(F.coalesce("_v", F.lit(0.0)) <= 0, 1.0).otherwise(1.0 - normal_tail(
        F.col("margin") / F.greatest(F.sqrt("_v"), F.lit(1e-6)))).alias("bound"))


# --- diversity ------------------------------------------------------------------------------------------

def diversity(accepted: DataFrame, kernel: str = "latent_euclidean", reg: float = 1e-6, key: str = "session_id") -> DataFrame:
    """Log-determinant of the kernel of a session's accepted edits (key, seq, v); null under two.

    The determinant needs the whole session matrix, so one session is one small numpy call.
    """
    import pandas as pd

    def run(pdf):
        import numpy as np
        x = np.stack(pdf.sort_values("seq")["v"].to_numpy())
        n = len(x)
        if n < 2:
            return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [n], "log_det": [None], "bandwidth": [None]}).astype({"log_det": float, "bandwidth": float})
        if kernel == "shapelet_edit":
            sd = x.std(1, keepdims=True)
            x = (x - x.mean(1, keepdims=True)) / np.where(sd < 1e-12, 1, sd)
        if kernel == "dtw_rbf":
            from ..functions.kernels import dtw
            d = np.zeros((n, n))
            i, j = np.triu_indices(n, 1)
            d[i, j] = d[j, i] = dtw(x[i], x[j], max(1, round(0.1 * x.shape[1])))
        else:
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        bw = np.median(d[np.triu_indices(n, 1)])
        bw = bw if bw > 0 else 1.0
        K = 1 / (1 + d) if kernel == "shapelet_edit" else np.exp(-d ** 2 / (2 * bw * bw))
        sign, ld = np.linalg.slogdet(K + reg * np.eye(n))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [n], "log_det": [ld if sign > 0 else -np.inf], "bandwidth": [bw]})
    return accepted.select(key, "seq", "v").groupBy(key).applyInPandas(run, f"{key} {dict(accepted.dtypes)[key]}, n int, log_det double, bandwidth double")


def incremental_diversity(accepted: DataFrame, reg: float = 1e-6, key: str = "session_id") -> DataFrame:
    """Log-determinant after each accepted edit by rank-one updates; bandwidth frozen at the second edit."""
    from ..streaming.stateful import LogDet
    rows = accepted.select(key, "seq", "v").repartition(key).sortWithinPartitions(key, "seq")

    def run(batches):
        import pandas as pd
        cur, st = None, None
        for pdf in batches:
            out = []
            for s, q, v in zip(pdf[key], pdf["seq"], pdf["v"]):
                if s != cur:
                    cur, st = s, LogDet(reg)
                out.append((s, q, st.add(v)))
            yield pd.DataFrame(out, columns=[key, "seq", "log_det"])
    t = dict(accepted.dtypes)
    return rows.mapInPandas(run, f"{key} {t[key]}, seq {t['seq']}, log_det double")
