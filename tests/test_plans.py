"""Plans that keep costly parts from being worked out again for each element or row."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["e33_scale_season", "e33_replace_with_flat", "e34_change_period", "e35_set_harmonic"])
def test_phase_means_are_worked_out_once_a_projection(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("UnsafeArrayData") for line in plan.split("\n")) <= 6


def test_segment_encoding_is_worked_out_once(spark):
    from pyspark.sql import functions as F

    from seriesforge.operators import prototypes as P
    from seriesforge.plans import pipelines as L
    rows = spark.range(3).select(F.col("id").alias("series_id"), F.lit("a").alias("segment_id"), F.lit(0).alias("start_index"), F.lit(3).alias("end_index"),
                                 F.array(*[F.col("id") * k + 0.5 for k in range(4)]).alias("v"))
    plan = L.label_segments(rows.localCheckpoint(), P.default_support(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("floor") + line.count("FLOOR") for line in plan.split("\n")) <= 12
    assert plan.count("ln(") + plan.count("log1p") + plan.count("LOG1P") <= 4


def test_user_statistic_shares_batches(spark):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from seriesforge import registry as G
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"series_id": rng.integers(0, 7, 900), "rep": rng.integers(0, 20, 900), "value": rng.normal(size=900)})

    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")     # replicates go over batch edges
    try:
        out = G.user_statistic(spark.createDataFrame(pdf), middle)
        assert "AggregateInPandas" not in out._jdf.queryExecution().toString()
        got = out.toPandas().sort_values("series_id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = pdf.groupby(["series_id", "rep"])["value"].median().groupby("series_id").mean()
    np.testing.assert_allclose(got["boot_mean"], want)
