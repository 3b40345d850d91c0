"""Greedy spaced choice by chunks against the plain loop."""

import numpy as np
import pandas as pd

from seriesforge.operators import boundaries as B

RNG = np.random.default_rng(7)


def greedy(pdf, k, spacing):
    out = []
    for s, p in sorted(zip(-pdf["score"], pdf["pos"])):
        if len(out) < k and all(abs(p - x) >= spacing for x in out):
            out.append(p)
    return sorted(out)


def series(n, score):
    pos = np.sort(RNG.choice(4 * n, n, replace=False))
    return pd.DataFrame({"pos": pos.astype("int32"), "score": score(n)})


def test_many_spaced_positions_are_chosen_by_chunks(spark):
    # random scores, equal ones (a chain of ties from the left) and falling ones (a chain through all chunks)
    parts = {1: series(3000, lambda n: RNG.random(n)), 2: series(2000, lambda n: RNG.integers(0, 4, n) / 4.0), 3: series(2500, lambda n: np.ones(n)), 4: series(2500, lambda n: 1.0 - np.arange(n) / n)}
    rows = spark.createDataFrame(pd.concat([p.assign(series_id=s) for s, p in parts.items()]))
    got = B.spaced(rows, 9, size=144).toPandas()
    for s, p in parts.items():
        assert sorted(got[got.series_id == s]["pos"]) == greedy(p, len(p), 9)
    few = B.spaced_top_k(rows, 400, 9)
    assert "collect_list" not in few._jdf.queryExecution().toString()
    got = few.toPandas()
    for s, p in parts.items():
        assert sorted(got[got.series_id == s]["pos"]) == greedy(p, 400, 9)
