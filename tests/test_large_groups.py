"""Exact quantiles of few groups of any size: the rows are neither moved nor sorted, ties and null keys count."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from leafmill.operators import robust


@pytest.fixture
def no_threshold(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_rows_meet_broadcast_bounds(spark, no_threshold):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = robust.large_stats(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "collect_list" not in plan


def test_ties_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(robust, "SKETCH", 100)
    rng = np.random.default_rng(7)
    groups = {
        "even": rng.normal(0, 50, 6000), "ties": rng.integers(-2, 3, 5001).astype(float), "one": np.full(4000, 3.5),
        "ends": np.r_[np.full(3000, -1e9), np.full(3000, 1e9)], "small": rng.normal(0, 1, 7), "single": np.array([2.0]),
    }
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.975, 1.0)
    got = {r["g"]: r for r in robust.exact_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g]["n"] == len(v)
        assert [got[g][f"q{k}"] for k in range(len(shares))] == pytest.approx(list(np.quantile(v, shares)), rel=1e-12, abs=1e-9)
    stats = {r["g"]: r for r in robust.large_stats(df, ["g"], "v").collect()}
    for g, v in groups.items():
        med = np.median(v)
        want = [med, robust.MAD_SCALE * np.median(abs(v - med)), np.quantile(v, 0.975)]
        assert [stats[g][c] for c in ("med", "mad", "p975")] == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_null_keys_and_groups_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None), ("b", 2.0), ("b", None)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in robust.large_stats(df, ["g"], "v").collect()}
    assert got == {None: (2, 2.5, pytest.approx(1.5 * robust.MAD_SCALE), pytest.approx(3.925)), "a": (0, None, None, None), "b": (1, 2.0, 0.0, 2.0)}
