"""How points are laid out over tasks.

A series may hold a third of all rows, so nothing here puts a whole series in
one task.  Indexing works per time bucket plus bucket offsets, framed windows
work per chunk with a halo, running folds work per chunk plus chunk offsets,
and interval lookups join on (series, position bucket).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.vectors import fused

CHUNK = 4096          # points of one series handled together by a framed window
FOLD = 256            # points folded by one ordered array expression
BUCKET = 512          # width of a position bucket in interval joins


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names; one of our own only in local mode."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint()


def index_series(df: DataFrame, key, order: list[str], bucket: Column, out: str = "t") -> DataFrame:
    """0-based position of each row in its series.

    ``bucket`` must grow with the first ordering column.  Rows are ranked inside
    (series, bucket); bucket sizes, pre-aggregated before their shuffle, give the
    offset.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (rows.join(offsets, [*keys, "_bucket"])
            .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("int"))
            .drop("_bucket", "_off"))


def quantile(df: DataFrame, key: str, value: Column, p: float, out: str, width: float = 1 / 64) -> DataFrame:
    """Linearly interpolated quantile of each series from the two rows around its rank.

    Bucket sizes tell which value buckets hold the ranks, and only their rows are ordered.  The rows' own values are
    mixed with one rounding of the lower share, as the SQL twins do, so comparisons of a value with its own quantile
    agree.
    """
    rows = df.select(key, value.cast("double").alias("_x")).where("_x is not null").withColumn("_b", F.floor(F.col("_x") / width))
    sizes = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    every = W.partitionBy(key)
    before = every.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    at = (F.sum("_n").over(every) - 1) * F.lit(p)
    sizes = sizes.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_at": at})
    held = sizes.where((F.col("_off") <= F.ceil("_at")) & (F.floor("_at") < F.col("_off") + F.col("_n"))).drop("_n")
    rank = F.col("_off") + F.row_number().over(W.partitionBy(key, "_b").orderBy("_x")) - 1
    near = rows.join(held.hint("merge"), [key, "_b"]).withColumn("_r", rank)
    ends = near.groupBy(key).agg(F.max(F.when(F.col("_r") == F.floor("_at"), F.col("_x"))).alias("_lo"),
                                 F.max(F.when(F.col("_r") == F.ceil("_at"), F.col("_x"))).alias("_hi"), F.max(F.col("_at") - F.floor("_at")).alias("_w"))
    return ends.select(key, fused(1.0 - F.col("_w"), F.col("_lo"), F.col("_w") * F.col("_hi")).alias(out))


def with_halo(points: DataFrame, before: int, after: int, size: int = CHUNK, t: str = "t") -> DataFrame:
    """Copy each point into every chunk whose frames [t-before, t+after] can reach it.

    Adds ``chunk`` and ``home``; run the window over (series, chunk) and keep
    ``home`` rows.  With before + after far below ``size`` the copies are few.
    """
    size = max(size, before + after, 1)
    lo = F.greatest(F.floor((F.col(t) - after) / size), F.lit(0))
    hi = F.floor((F.col(t) + before) / size)
    return (points.withColumn("chunk", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
            .withColumn("home", F.col("chunk") == F.floor(F.col(t) / size)))


def framed(points: DataFrame, before: int, after: int, cols: dict, keys=("series_id",), t: str = "t",
           size: int = CHUNK) -> DataFrame:
    """Add window columns over the frame [-before, +after]; ``cols`` maps name -> f(window spec builder).

    The builder is called as ``w(lo, hi)`` and gives a rows frame; ``w()`` is the
    ordered spec without a frame for lag and lead.
    """
    base = W.partitionBy(*keys, "chunk").orderBy(t)

    def w(lo=None, hi=None):
        return base if lo is None else base.rowsBetween(lo, hi)

    out = with_halo(points, before, after, size, t)
    out = out.withColumns({name: f(w) for name, f in cols.items()})
    return out.where("home").drop("chunk", "home")


def running_sums(points: DataFrame, cols: dict[str, Column], keys=("series_id",), t: str = "t",
                 size: int = CHUNK) -> DataFrame:
    """Inclusive running sums per series by chunk sums plus chunk offsets."""
    rows = points.withColumn("_c", F.floor(F.col(t) / size))
    rows = rows.withColumns({f"_v_{n}": c for n, c in cols.items()})
    totals = rows.groupBy(*keys, "_c").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in cols])
    before = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    offs = totals.select(*keys, "_c", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
                                        for n in cols])
    inside = W.partitionBy(*keys, "_c").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(offs, [*keys, "_c"])
    out = out.withColumns({n: F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}") for n in cols})
    return out.drop("_c", *[f"_v_{n}" for n in cols], *[f"_o_{n}" for n in cols])


def running_last(rows: DataFrame, cols: list[str], keys=("series_id",), t: str = "t", size: int = CHUNK,
                 tie: str | None = None) -> DataFrame:
    """Carry the latest non-null struct of ``cols`` forward (an as-of fill) by chunk carry plus local carry.

    Adds ``last_<col>``; a row counts as set when its first column is not null.
    """
    item = F.when(F.col(cols[0]).isNotNull(), F.struct(*cols))
    order = [t] + ([tie] if tie else [])
    r = rows.withColumns({"_c": F.floor(F.col(t) / size), "_it": item})
    edge = r.where("_it is not null").groupBy(*keys, "_c").agg(F.max_by("_it", F.struct(*order)).alias("_e"))
    every = r.select(*keys, "_c").distinct().join(edge, [*keys, "_c"], "left")
    before = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    every = every.select(*keys, "_c", F.last("_e", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_c").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumn("_here", F.last("_it", ignorenulls=True).over(inside)).join(every.hint("merge"), [*keys, "_c"])   # rows lie by these keys already
    near = F.coalesce("_here", "_carry")
    return r.withColumns({f"last_{c}": near[c] for c in cols}).drop("_c", "_it", "_here", "_carry")


def asof(left: DataFrame, right: DataFrame, cols: list[str], keys=("series_id",), t: str = "t", size: int = CHUNK) -> DataFrame:
    """Latest right row at or before each left row; right times come first on ties."""
    types, lt = dict(right.dtypes), dict(left.dtypes)
    extra = [c for c in left.columns if c not in keys and c != t]
    l = left.select(*keys, t, *extra, *[F.lit(None).cast(types[c]).alias(f"_r_{c}") for c in cols], F.lit(1).alias("_side"))
    r = right.select(*keys, F.col(t).cast(lt[t]).alias(t), *[F.lit(None).cast(lt[c]).alias(c) for c in extra],
                     *[F.col(c).alias(f"_r_{c}") for c in cols], F.lit(0).alias("_side"))
    f = running_last(l.unionByName(r), [f"_r_{c}" for c in cols], keys, t, size, "_side")
    return f.where("_side = 1").select(*keys, t, *extra, *[F.col(f"last__r_{c}").alias(c) for c in cols])


def fold_clamped_affine(points: DataFrame, a: Column, c: Column, hi: Column | None = None, lo: Column | None = None,
                        start: Column | None = None, out: str = "y", key: str = "series_id", t: str = "t",
                        levels: int = 2) -> DataFrame:
    """Ordered recursion y_t = clamp(a_t * y_{t-1} + c_t, lo_t, hi_t), in parallel inside one series.

    Clamped affine maps (a >= 0) are closed under composition, so each chunk
    reduces to one (a, c, lo, hi) record; chunk entry states follow from those
    records, level by level, and each chunk is then replayed from its entry
    state.  The first row gives ``start``.
    """
    inf = float("inf")
    first = F.col(t) == 0
    init = (F.lit(0.0) if start is None else start).cast("double")
    put = lambda col, other: F.when(first, init).otherwise(col if col is not None else F.lit(other)).cast("double")
    maps = points.select(key, F.col(t).cast("long").alias("_i"), F.when(first, 0.0).otherwise(a.cast("double")).alias("_a"),
                         put(c, 0.0).alias("_k"), put(lo, -inf).alias("_l"), put(hi, inf).alias("_h"))
    states = _affine_states(maps, key, levels)
    return points.join(states.select(key, F.col("_i").cast("int").alias(t), F.col("_y").alias(out)), [key, t])


def _clamp(x, lo, hi):
    return F.least(F.greatest(x, lo), hi)


def _affine_states(maps: DataFrame, key: str, levels: int) -> DataFrame:
    """State after each map; columns (key, _i, _y)."""
    chunk = F.floor(F.col("_i") / FOLD) if levels else F.lit(0).cast("long")
    packed = (maps.withColumn("_c", chunk).groupBy(key, "_c")
              .agg(F.array_sort(F.collect_list(F.struct("_i", "_a", "_k", "_l", "_h"))).alias("_items")))
    if levels:
        inf = float("inf")
        identity = F.struct(F.lit(1.0).alias("_a"), F.lit(0.0).alias("_k"), F.lit(-inf).alias("_l"), F.lit(inf).alias("_h"))

        def compose(s, x):
            through = lambda v: F.when(x["_a"] == 0, x["_k"]).otherwise(x["_a"] * v + x["_k"])
            return F.struct((x["_a"] * s["_a"]).alias("_a"), through(s["_k"]).alias("_k"),
                            _clamp(through(s["_l"]), x["_l"], x["_h"]).alias("_l"),
                            _clamp(through(s["_h"]), x["_l"], x["_h"]).alias("_h"))
        total = F.aggregate("_items", identity, compose)
        heads = packed.select(key, F.col("_c").alias("_i"), total.alias("_t")).select(key, "_i", "_t.*")
        entry = _affine_states(heads, key, levels - 1).select(
            key, (F.col("_i") + 1).alias("_c"), F.col("_y").alias("_y0"))
        packed = packed.join(entry, [key, "_c"], "left")
    else:
        packed = packed.withColumn("_y0", F.lit(None).cast("double"))

    def step(s, x):
        y = _clamp(F.when(x["_a"] == 0, x["_k"]).otherwise(x["_a"] * s["y"] + x["_k"]), x["_l"], x["_h"])
        return F.struct(y.alias("y"), F.concat(s["o"], F.array(F.struct(x["_i"].alias("_i"), y.alias("_y")))).alias("o"))
    replay = F.aggregate(
        "_items", F.struct(F.coalesce("_y0", F.lit(0.0)).alias("y"),
                           F.array().cast("array<struct<_i:bigint,_y:double>>").alias("o")), step, lambda s: s["o"])
    return packed.select(key, F.explode(replay).alias("_r")).select(key, "_r._i", "_r._y")


def attach_segments(points: DataFrame, segments: DataFrame, pad: Column | int = 0, width: int = BUCKET,
                    keep=("segment_id", "start_index", "end_index", "label")) -> DataFrame:
    """Points ⋈ segments on start-pad <= t <= end+pad within a series.

    Both sides meet on (series, position bucket), so one long series spreads over
    tasks; a point lies in one bucket, so no duplicates arise.
    """
    pad = F.lit(pad) if isinstance(pad, int) else pad
    s = segments.select("series_id", *keep, (F.greatest(F.col("start_index") - pad, F.lit(0))).alias("_lo"),
                        (F.col("end_index") + pad).alias("_hi"))
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    # Segment columns win over equally named point columns.
    p = points.drop(*[c for c in keep if c in points.columns]).withColumn("_b", F.floor(F.col("t") / width))
    return (p.join(s, ["series_id", "_b"]).where(F.col("t").between(F.col("_lo"), F.col("_hi")))
            .drop("_b", "_lo", "_hi"))


def tile_runs(points: DataFrame, label: str = "label", key: str = "series_id", t: str = "t") -> DataFrame:
    """Segments of equal consecutive labels (gaps and islands).

    Runs are numbered by a running sum of change flags and closed by a
    pre-aggregated groupBy, so a hot series never sits in one task.
    """
    flagged = framed(points.select(key, t, label), 1, 0, {"_prev": lambda w: F.lag(label).over(w())}, (key,), t)
    change = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(label)), 1).otherwise(0)
    runs = running_sums(flagged, {"_run": change}, (key,), t)
    return (runs.groupBy(key, "_run").agg(F.min(t).alias("start_index"), F.max(t).alias("end_index"),
                                          F.first(label).alias(label)).drop("_run"))


def neighbours(df: DataFrame, order: str, cols: list[str], key: str = "series_id", size: int = CHUNK,
               back: bool = True) -> DataFrame:
    """Add prev_* (or next_*) values of the neighbouring row in a series ordered by an integer column.

    Lag inside (series, chunk); the row at a chunk edge takes the edge row of the
    nearest non-empty chunk, found on the small chunk table.
    """
    tag = "prev_" if back else "next_"
    rows = df.withColumn("_c", F.floor(F.col(order) / size))
    item = F.struct(*cols)
    edge = rows.groupBy(key, "_c").agg((F.max_by if back else F.min_by)(item, order).alias("_e"))
    chunks = W.partitionBy(key).orderBy("_c")
    edge = edge.select(key, "_c", (F.lag if back else F.lead)("_e").over(chunks).alias("_edge"))
    inside = W.partitionBy(key, "_c").orderBy(order)
    rows = rows.withColumn("_near", (F.lag if back else F.lead)(item).over(inside)).join(edge.hint("merge"), [key, "_c"])    # rows lie by these keys already
    near = F.coalesce("_near", "_edge")
    return rows.withColumns({tag + c: near[c] for c in cols}).drop("_c", "_near", "_edge")


def expand_labels(segments: DataFrame) -> DataFrame:
    """One row per covered index."""
    return segments.withColumn("t", F.explode(F.sequence("start_index", "end_index")))


def contiguity(segments: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Per series: number of order violations and whether the tiling covers the series."""
    chk = neighbours(segments, "start_index", ["end_index"]).withColumn(
        "bad", (F.col("end_index") < F.col("start_index")) |
        (F.coalesce(F.col("prev_end_index"), F.lit(-1)) + 1 != F.col("start_index")))
    out = chk.groupBy("series_id").agg(
        F.sum(F.col("bad").cast("int")).alias("violations"), F.max("end_index").alias("last_index"),
        F.count(F.lit(1)).alias("n_segments"))
    if lengths is not None:
        out = out.join(lengths, "series_id").withColumn(
            "covers", (F.col("violations") == 0) & (F.col("last_index") == F.col("series_length") - 1))
    return out


def boundaries_to_segments(boundaries: DataFrame, lengths: DataFrame) -> DataFrame:
    """Segments from a boundary list; the last one ends the series; numbered segment-001 on."""
    zero = lengths.select("series_id", F.lit(0).alias("boundary"))
    every = boundaries.select("series_id", F.col("boundary").cast("int").alias("boundary")).unionByName(zero)
    n = neighbours(every, "boundary", ["boundary"], back=False)
    n = index_series(n, "series_id", ["boundary"], F.floor(F.col("boundary") / CHUNK), "_no").join(lengths, "series_id")
    return n.select("series_id", F.format_string("segment-%03d", F.col("_no") + 1).alias("segment_id"), F.col("boundary").alias("start_index"),
                    (F.coalesce("next_boundary", "series_length") - 1).cast("int").alias("end_index"))
