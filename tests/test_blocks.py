"""Series in blocks equal the one-task forms, whatever the size of a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardioframe.operators import beats, blocks, series
from cardioframe.operators.series import Series

S = Series(("k",), ("t",))


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k, n in ((1, 1), (2, 5), (3, 64), (4, 333)):
        x = np.round(10 * np.sin(np.arange(n) / 3) + 4 * rng.normal(size=n))
        rows += [(k, t + 1, float(v)) for t, v in enumerate(x)]
    # long flat parts, runs over several blocks and peaks far apart
    rows += [(5, t + 1, float(v)) for t, v in enumerate([0] * 40 + [9] + [0] * 90 + [5, 9, 5, 9] + [0] * 70 + [3] * 50)]
    return spark.createDataFrame(rows, "k int, t long, x double").repartition(4).cache()


def rows(d):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())


@pytest.mark.parametrize("size", [7, 64])
def test_points_beats_and_runs(df, size):
    b = blocks.Blocks(("k",), "t", size)
    width = 9
    points, want = blocks.turning_points(df, b, "x", width), beats.turning_points(df, S, "x", width)
    cols = ["k", "t", "x", "kind", "threshold"]
    assert rows(points.select(cols)) == rows(want.select(cols))
    assert rows(blocks.find_beats(points, b, "x", "t")) == rows(beats.find_beats(want, S, "x", "t"))
    cols = ["k", "first", "last", "n", "centre"]
    for flag in (F.col("x") == 0, F.lit(True)):
        assert rows(blocks.islands(df, b, flag).select(cols)) == rows(series.islands(df, S, flag).select(cols))


@pytest.mark.parametrize("size", [7, 64])
def test_a_threshold_that_equals_a_value_but_for_rounding(spark, size):
    x = [0, 58.63, 51.9, 94.87, 49.62, 40.28, 54.78, 16.54, 89.17, 94.87, 97.65, 15.09, 40.16, 10, 20, 10]
    tied = spark.createDataFrame([(1, t + 1, float(v)) for t, v in enumerate(x)], "k int, t long, x double")
    points = blocks.turning_points(tied, blocks.Blocks(("k",), "t", size), "x", 12)
    assert points.where("t = 2").select("kind").collect() == [("P",)]


@pytest.mark.parametrize("size", [3, 50])
def test_windows_with_a_halo(df, size):
    b = blocks.Blocks(("k",), "t", size)
    forms = {"peak": lambda s: series.window_peaks(s, "x", 4), "mean": lambda s: series.rolling_mean(s, "x", 5), "ahead": lambda s: series.count_ahead(s, F.col("x") > 0, 5), "diff": lambda s: F.col("x") - s.lag("x")}
    got = blocks.with_windows(df, b, 5, 5, **forms)
    assert rows(got.select("k", "t", *forms)) == rows(df.select("k", "t", *(f(S).alias(n) for n, f in forms.items())))


def test_numbers_of_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = blocks.numbered(df, ["k"], ["o"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in range(3):
        mine = sorted((r["o"], r["place"]) for r in got if r["k"] == k)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))


def test_a_long_series_is_dealt_out(spark):
    df = spark.range(1, 200_001).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.sin(F.col("id") / 5) * 10).alias("x"))
    b = blocks.Blocks(("k",), "t", 4096)
    sizes = b.laid(df, 400, 400).groupBy("__block").count().agg(F.max("count")).first()[0]
    assert sizes <= 4096 + 800
    found = blocks.find_beats(blocks.turning_points(df, b, "x"), b, "x", "t")
    assert found.count() == found.agg(F.max("beat")).first()[0] > 6000
