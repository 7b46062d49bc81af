"""Rank selection against the built-in percentile and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardioframe.functions import order, stats
from cardioframe.operators import qc

SHARES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.75, "e": 1.0}


def groups():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=9001).tolist(), "ties": rng.integers(0, 4, 6000).astype(float).tolist(), "one value": [7.5] * 3000, "wide": (10.0 ** rng.uniform(-200, 200, 5000) * rng.choice([-1, 1], 5000)).tolist(),
        "small": [3.0, 1.0], "hole": [0.0] * 2500 + [1.0] * 2500, "nothing": [None, None, float("nan")], "some nulls": [None, float("inf")] * 800 + rng.normal(size=4000).tolist(),
    }


def test_selected_ranks_equal_numpy(spark):
    df = spark.createDataFrame([(k, v) for k, vs in groups().items() for v in vs], "g string, v double").repartition(4)
    got = {r["g"]: r for r in order.quantiles(df, ["g"], {n: ("v", q) for n, q in SHARES.items()}, most=60).collect()}
    plain = {r["g"]: r for r in order.quantiles(df, ["g"], {n: ("v", q) for n, q in SHARES.items()}).collect()}
    assert set(got) == set(groups())
    for k, vs in groups().items():
        known = [v for v in vs if v is not None and np.isfinite(v)]
        for n, q in SHARES.items():
            assert got[k][n] == plain[k][n], (k, n)
            assert got[k][n] == (pytest.approx(np.quantile(known, q), rel=1e-9, abs=1e-12) if known else None)


def test_several_columns_and_no_keys(spark):
    rng = np.random.default_rng(8)
    x, y = rng.exponential(size=5000), rng.integers(0, 1000, 5000)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y int").repartition(3)
    got = order.quantiles(df, [], {"mx": ("x", 0.5), "my": ("y", 0.5), "qy": ("y", 0.9)}, most=100).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(np.median(x)), np.median(y), pytest.approx(np.quantile(y, 0.9)))]


def test_no_task_brings_a_group_together(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("v"), F.lit(1).alias("g"))
    plan = order.quantiles(df, ["g"], {"m": ("v", 0.5)}, most=50)
    (r,) = plan.collect()
    assert r["m"] == 9999.5
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in text


def test_spread_of_large_groups(spark):
    rng = np.random.default_rng(5)
    v = {g: rng.normal(g, g + 1, 3000) for g in (0, 1, 2)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in v.items() for x in xs], "g int, v double")
    got = {r["g"]: r["v_mad"] for r in stats.mad(df, ["g"], ["v"], most=40).collect()}
    assert got == {g: pytest.approx(1.4826 * np.median(np.abs(xs - np.median(xs)))) for g, xs in v.items()}
    both = {r["g"]: (r["v_median"], r["v_sd"]) for r in stats.median_and_sd(df, ["g"], ["v"], most=40).collect()}
    assert both == {g: (pytest.approx(np.median(xs)), pytest.approx(np.std(xs, ddof=1))) for g, xs in v.items()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g int, v double")
    assert order.quantiles(none, ["g"], {"m": ("v", 0.5)}).count() == 0
    assert order.quantiles(none, [], {"m": ("v", 0.5)}).collect()[0]["m"] is None
    assert qc.classes(spark.createDataFrame([], "a double, b double, sd double"), "a", "b", "sd").count() == 0
