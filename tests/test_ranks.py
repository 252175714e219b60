"""Ranks from histograms against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import ranks


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    values = np.r_[rng.integers(-5, 40, 400).astype(float), rng.random(300), -rng.random(50), 1e12 + rng.integers(0, 3, 50), [0.0, -0.0]]
    frame = pd.DataFrame({"v": rng.permutation(values), "g": rng.choice([1.0, 2.0, np.nan], len(values))})
    frame.loc[frame.index % 37 == 0, "v"] = np.nan
    return pd.concat([frame, pd.DataFrame({"v": [7.0, np.nan], "g": [9.0, 10.0]})], ignore_index=True)


def test_ranks(spark, rows):
    values = [(i, None if pd.isna(v) else v, None if pd.isna(g) else int(g)) for i, v, g in rows.itertuples()]
    df = spark.createDataFrame(values, "i int, v double, g int")
    got = ranks.with_percent_rank(ranks.with_average_rank(df, "v", ["g"], "mean"), "v", ["g"], "low").collect()
    assert len(got) == len(rows)
    groups = rows.groupby("g", dropna=False)["v"]
    mean = groups.rank() / groups.transform("count")
    others = groups.transform("count") - 1
    low = (groups.rank(method="min") - 1) / others.where(others > 0, 1)
    for r in got:
        if r.v is None:
            assert r.mean is None and r.low is None
        else:
            assert r.mean == pytest.approx(mean[r.i]) and r.low == pytest.approx(low[r.i])


def test_ranges_never_fall(spark):
    values = sorted({*np.random.default_rng(1).normal(size=200).tolist(), *(10.0**k for k in range(-12, 16)), 0.0, -1e9})
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.value_range(F.col("v")).alias("r"))
    found = [r.r for r in sorted(df.collect(), key=lambda r: r.v)]
    assert found == sorted(found)


def test_no_task_holds_a_group(spark, rows):
    """Windows over rows are cut by range; only the ranges' sums are accumulated per group."""
    df = spark.createDataFrame([(1, 2.0)], "g int, v double")
    plan = ranks.value_positions(df, "v", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "N_TIES" in line:
            assert "_RANGE" in line.split("],")[1]
