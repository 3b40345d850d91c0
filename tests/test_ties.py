"""Queries against SQL on events of few distinct values, where comparisons meet ties that differ by rounding only."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from seriesforge.operators import stats as S
from tests.compare import TABLES, compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def ties(tmp_path_factory):
    d = tmp_path_factory.mktemp("ties")
    duckdb.connect().execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 86) AS ts, CAST(hash(i*3+2) % 900 AS BIGINT) AS user_id,
        ['click','view','purchase','signup','error'][CAST(hash(i*11+5) % 5 AS INT) + 1] AS event_type, CAST(hash(i*7+3) % 61 AS DOUBLE) AS value, '{{}}' AS props
        FROM range(30000) r(i) ORDER BY 1) TO '{d}/events.parquet' (FORMAT parquet)""")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SF}/{t}.parquet", d / f"{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["a06_peak_score", "a18_bump", "d01_baseflow", "f02_delta_fit", "g01_shape_classifier", "v03_adaptive_band"])
def test_ties_equal_sql(spark, ties, name):
    status, n, _, info = compare(spark, duck(ties), ties, name, QUERIES[name], ORACLE[name])
    assert status == "OK", (status, n, info)


@pytest.mark.parametrize("name", ["a05_context_contrast", "p20_chunk_scores"])
def test_equal_means_of_segment_and_context_equal_sql(spark, ties, name):
    """Eleven segments have exactly the mean of their context; six of these means differ by rounding when added in order."""
    status, n, _, info = compare(spark, duck(ties), ties, name, QUERIES[name], ORACLE[name])
    assert status == "OK", (status, n, info)


def test_peak_between_equal_neighbours(spark):
    sp = spark.createDataFrame([(s, 0, t, x) for s, v in enumerate([(0.02, 0.82, 0.02), (0.02, 0.02, 2.12, 0.02)]) for t, x in enumerate(v)], "series_id long, segment_id int, t int, value double")
    got = {r["series_id"]: r["peak_score"] for r in S.peak_score(sp).collect()}
    assert got[0] == pytest.approx(0.8e8) and got[1] == pytest.approx(2.1e8)
