"""Streams that arrive out of order, and recursions that run by chunks."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seriesforge.operators import boundaries, prototypes, sessions, validation
from seriesforge.operators.layout import cut_lineage
from seriesforge.operators.scan import Recursion, run_ordered
from seriesforge.streaming import ordered, queries

START = dt.datetime(2024, 1, 1)
ROWS = "sid long, ts timestamp, event_id long, v double"
SUM = ordered.Step("total double, n long", "event_id long, total double, n long", lambda: [0.0, 0], lambda t, n: [t, n], lambda s: tuple(s),
                   lambda s, r: [(r.event_id, *(s.__setitem__(slice(None), [s[0] + r.v, s[1] + 1]) or s))])


def files(spark, folder, batches):
    for rows in batches:
        data = [(s, None if m is None else START + dt.timedelta(minutes=m), e, v) for s, m, e, v in rows]
        spark.createDataFrame(data, ROWS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_out_of_order_stream_loses_no_row(spark, tmp_path):
    batches = [[(1, 10, 1, 1.0), (1, 30, 3, 3.0), (2, 5, 9, 9.0)], [(1, 20, 2, 2.0), (1, 200, 5, 5.0), (2, 6, 10, 1.0)],
               [(1, 5, 0, 0.5), (1, 190, 4, 4.0), (1, 300, 6, 6.0), (None, 4, 7, 7.0), (2, 7, 11, 2.0), (1, 190, 4, 4.0)], [(1, 1, 100, 100.0), (2, 400, 12, 3.0), (2, None, 13, 1.0)]]
    stream = files(spark, f"{tmp_path}/in", batches)
    got, late = ordered.run_in_order(stream, f"{tmp_path}/run", "sid", ["ts", "event_id"], SUM, "30 minutes")
    by_key = {}
    for r in sorted(got.collect(), key=lambda r: (r.sid, r.n)):
        by_key.setdefault(r.sid, []).append((r.event_id, r.total))
    assert by_key == {1: [(0, 0.5), (1, 1.5), (2, 3.5), (3, 6.5), (4, 10.5), (4, 14.5), (5, 19.5), (6, 25.5)], 2: [(9, 9.0), (10, 10.0), (11, 12.0), (12, 15.0)]}
    assert late.columns == ["sid", "ts", "event_id", "v"]
    assert sorted((r.event_id, r.ts) for r in late.collect() if r.ts) == [(7, START + dt.timedelta(minutes=4)), (100, START + dt.timedelta(minutes=1))]
    assert late.count() == 3 and got.count() + late.count() == sum(map(len, batches))


def test_equal_times_and_trailing_counts(spark, tmp_path):
    rows = [(1, 0, 1, 1.0), (1, 0, 2, 0.0), (1, 60 * 24 * 7, 3, 1.0), (1, 60 * 24 * 7 + 1, 4, 1.0)]
    stream = files(spark, f"{tmp_path}/in", [rows[2:], rows[:2]]).select(F.col("sid").alias("session_id"), "ts", "event_id", (F.col("v") > 0).alias("is_valid"))
    got, late = queries.trailing_validity(stream, delay="30 days")
    assert sorted((r.event_id, r.n_window, r.rate) for r in got.collect()) == [(1, 1, 1.0), (2, 2, 0.5), (3, 3, 2 / 3), (4, 2, 1.0)] and late.count() == 0


def compared(make, tolerance=0.0):
    """Rows by chunks equal those of one pass."""
    key = lambda r: tuple(str(x) for x in r[:3])
    whole, parts = (sorted(map(tuple, make(chunk).collect()), key=key) for chunk in (10**8, None))
    assert len(whole) == len(parts)
    for a, b in zip(whole, parts):
        assert a == b or all(x == y or abs(x - y) <= tolerance for x, y in zip(a, b)), (a, b)


@pytest.fixture(scope="module")
def long_series(spark):
    long = spark.range(12_000).select(F.lit(1).cast("long").alias("series_id"), F.col("id").cast("int").alias("t"), (F.abs(F.randn(3)) * F.when(F.col("id") % 4000 > 2000, 2.0).otherwise(1.0)).alias("residual"))
    short = spark.range(40).select(F.lit(2).cast("long").alias("series_id"), F.col("id").cast("int").alias("t"), F.rand(1).alias("residual"))
    return cut_lineage(long.unionByName(short))


@pytest.mark.parametrize("halo", [256, 2])
def test_band_by_chunks(spark, long_series, halo):
    q0 = validation.calibrate_band(long_series)
    compared(lambda chunk: validation.adaptive_band(long_series, q0, chunk=chunk or 1000, halo=halo))


def test_change_probability_by_chunks(spark, long_series):
    values = long_series.withColumnRenamed("residual", "value")
    compared(lambda chunk: boundaries.change_probabilities(values, 10.0, chunk=chunk or 1500), 1e-9)


def test_memory_by_chunks(spark):
    v = F.array(*[F.rand(k) + (F.col("id") % 700 > 300).cast("int") * (k % 2) for k in range(4)])
    rows = cut_lineage(spark.range(6000).select(F.lit(1).alias("session_id"), F.lit("a").alias("label"), (F.col("id") * 7).alias("seq"), F.rand(5).alias("confidence"), v.alias("v")))
    compared(lambda chunk: prototypes.update_memory(rows, chunk=chunk or 700))


def test_tips_by_chunks(spark):
    rows = spark.range(6000).select(F.lit(1).alias("session_id"), (F.col("id") * 3).alias("seq"), F.explode(F.sequence(F.lit(0), (F.rand(7) * 3).cast("int"))).alias("rank"))
    rows = rows.withColumns({"rule_id": F.concat(F.lit("r"), F.col("rank") + (F.rand(8) * 3).cast("int")), "modality": F.when(F.rand(9) < 0.7, "cf").otherwise("contrastive"), "severity": (F.rand(10) * 3 + 1).cast("int")})
    rows = cut_lineage(rows.dropDuplicates(["session_id", "seq", "rule_id"]))
    compared(lambda chunk: sessions.emit_tips(rows, chunk=chunk or 700))


def test_state_that_never_forgets_is_finished_in_order(spark):
    """No candidate meets the true state, so rounds run out and the rest is finished row by row."""
    points = spark.range(3000).select(F.lit("s").alias("series_id"), F.col("id").cast("int").alias("t"), (F.col("id") % 7).cast("double").alias("value"))

    def add(s, row):
        s[0] = s[0] + row.value
        return [(s[0],)]
    total = Recursion("total double", lambda row: [0.0], lambda row: [[-1.0]], add, lambda s: str(s[0]), lambda text: [float(text)])
    got = {r.t: r.total for r in run_ordered(points, ["series_id"], total, chunk=100, halo=10, rounds=2).collect()}
    want, s = {}, 0.0
    for t in range(3000):
        s += t % 7
        want[t] = s
    assert got == want


@pytest.mark.parametrize("q", [0.01, 1e-9, 0.0])
def test_smoother_gains_at_any_step(spark, q):
    from seriesforge.operators import edits
    n, r = 6000, 2.0
    got = {x.t: (x.filtered, x.smoothed) for x in edits.kalman_smooth(spark.range(n).select(F.lit(1).alias("series_id"), F.col("id").cast("int").alias("t"), F.sin(F.col("id") * 0.37).alias("value")), q, r).collect()}
    values = [math.sin(t * 0.37) for t in range(n)]
    x, p, forward, after = None, r, [], []
    for v in values:
        g = p / (p + r)
        x = v if x is None else x + g * (v - x)
        forward.append(x)
        after.append((1 - g) * p)
        p = after[-1] + q
    s, back = forward[-1], [forward[-1]]
    for t in range(n - 2, -1, -1):
        s = forward[t] + after[t] / (after[t] + q) * (s - forward[t])
        back.append(s)
    for t in range(n):
        assert got[t] == pytest.approx((forward[t], back[n - 1 - t]), rel=1e-9, abs=1e-9)


def test_taper_of_the_phase_shift():
    from seriesforge.operators.edits import turned_share
    assert turned_share(20).tolist() == pytest.approx([0, 1 / 3, 2 / 3] + [1] * 13 + [0, 1 / 3, 2 / 3, 1])
    assert turned_share(3).tolist() == [1, 1, 1] and turned_share(4).tolist() == [0, 1, 1, 1]


def test_moments_of_block_ends_equal_the_replicates(spark):
    points = cut_lineage(spark.range(700).select((F.col("id") % 2).alias("series_id"), F.floor(F.col("id") / 2).cast("int").alias("t"), F.randn(4).alias("value")).unionByName(
        spark.createDataFrame([(9, 0, 2.5)], "series_id long, t int, value double")))
    for block in (3.0, 60.0, 1e9):
        rows = validation.stationary_bootstrap(points, block, 8).groupBy("series_id", "rep").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("a"), F.sum(F.col("t") * F.col("value")).alias("b"))
        want = {(r.series_id, r.rep): (r.n, r.a, r.b) for r in rows.collect()}
        got = {(r.series_id, r.rep): (r.n, r.total, r.t_total) for r in validation.bootstrap_moments(points, block, 8).collect()}
        assert set(got) == set(want) and len(got) == 24
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-7)
