import math

import pytest
from pyspark.sql import functions as F

from cardioframe.functions import stats
from cardioframe.operators import beats, joins, qc, series
from cardioframe.operators.series import Series

S = Series(("k",), ("t",))


def frame(spark, values, key=1):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "k int, t int, x double")


def column(df, c):
    return [r["v"] for r in df.select("t", c.alias("v")).orderBy("t").collect()]


def places(df, c):
    return [i + 1 for i, v in enumerate(column(df, c)) if v]


def test_local_extrema_find_both_shoulders_of_a_plateau(spark):
    assert places(frame(spark, [0, 1, 0, 2, 2, 0]), series.local_extrema(S, "x")) == [2, 4, 5]


def test_window_peaks_drop_what_a_larger_neighbour_exceeds(spark):
    assert places(frame(spark, [0, 1, 0, 2, 2, 0]), series.window_peaks(S, "x", 3)) == [4, 5]


def test_rolling_mean_ends_where_values_run_out(spark):
    assert column(frame(spark, [1, 2, 3, 4]), series.rolling_mean(S, "x", 3)) == [2, 3, None, None]


def test_rolling_median_repeats_the_last_value(spark):
    assert column(frame(spark, [1, 5, 2, 8]), series.rolling_median(S, "x", 3)) == [2, 5, 8, 8]


def test_forward_threshold_looks_ahead_and_pads_with_the_median_of_the_last_means(spark):
    got = series.forward_threshold(frame(spark, range(1, 9)), S, "x", 3)
    assert column(got, F.col("threshold")) == [2, 3, 4, 5, 6, 4.5, 4.5, 4.5]


def test_forward_threshold_of_a_short_series_takes_a_third_of_it(spark):
    got = series.forward_threshold(frame(spark, [1, 2, 3, 4, 5, 6]), S, "x", 400)
    assert column(got, F.col("threshold"))[0] == 1.5


#: The second value is the mean of the twelve from it on, but for the rounding of their sum: it is over it only if they are added from the last one back.
TIED = [0, 58.63, 51.9, 94.87, 49.62, 40.28, 54.78, 16.54, 89.17, 94.87, 97.65, 15.09, 40.16, 10, 20, 10]


def test_forward_threshold_adds_values_from_the_last_one_back(spark):
    got = column(series.forward_threshold(frame(spark, TIED), S, "x", 12), F.col("threshold"))
    back = forth = 0.0
    for v, w in zip(reversed(TIED[1:13]), TIED[1:13], strict=True):
        back, forth = back + v, forth + w
    assert got[1] == back / 12 < TIED[1] == forth / 12
    points = beats.turning_points(frame(spark, TIED), S, "x", 12)
    assert points.where("t = 1").select("kind").collect() == [("P",)]


def test_islands_and_their_rounded_centres(spark):
    got = series.islands(frame(spark, [0, 0, 1, 0, 0, 0]), S, F.col("x") == 0).orderBy("first").collect()
    assert [(r["first"], r["last"], r["n"], r["centre"]) for r in got] == [(1, 2, 2, 2), (4, 6, 3, 5)]


def test_run_lengths_keep_their_running_end(spark):
    got = series.run_lengths(frame(spark, [1, 1, 2, 2, 2, 1]), S, "x").orderBy("run").collect()
    assert [(r["value"], r["length"], r["end"]) for r in got] == [(1, 2, 2), (2, 3, 5), (1, 1, 6)]


@pytest.mark.parametrize(("values", "true", "literal"), [([1, 1, 0, 0, 1], 2, 2), ([1, 0, 1, 0], 3, 0), ([1], 0, None)])
def test_reversals(spark, values, true, literal):
    stepped = series.steps(frame(spark, values), S, "x")
    got = stepped.groupBy("k").agg(F.coalesce(series.reversals(S, "x"), F.lit(0)).alias("a"), series.reversals(S, "x", literal=True).alias("b")).first()
    assert (got["a"], got["b"]) == (true, literal)


def test_mad_and_arrhythmia_index(spark):
    df = frame(spark, [10, 15, None])
    assert stats.mad(df, ["k"], ["x"]).first()["x_mad"] == pytest.approx(3.7065)
    assert df.select(stats.arrhythmia_index(F.col("x"))).first()[0] == pytest.approx(0.282843, abs=1e-6)


def test_quantiles_interpolate(spark):
    df = frame(spark, [1, 2, 4, 9])
    assert [df.select(stats.quantile(F.col("x"), q)).first()[0] for q in (0, 0.25, 0.5, 0.75, 1)] == [1, 1.75, 3, 5.25, 9]


def test_trapezoid(spark):
    df = frame(spark, [0, 1, 1, 0]).withColumn("p", series.trapezoid(S, "x"))
    assert df.agg(F.sum("p")).first()[0] == 2.0


def test_empty_series(spark):
    empty = frame(spark, [])
    assert series.forward_threshold(empty, S, "x").count() == 0
    assert series.islands(empty, S, F.col("x") == 0).count() == 0


def test_intervals_of_hand_worked_beats(spark):
    df = spark.createDataFrame([(1, 0, 6), (1, 10, 18), (1, 25, 30)], "k int, start int, end int")
    got = beats.intervals(df, ("k",)).orderBy("start").collect()
    assert [[r[c] for r in got] for c in ("SI", "deltaSI", "deltaSIplus", "HP", "DI")] == [[6, 8, 5], [2, -3, None], [-3, None, None], [10, 15, None], [4, 7, None]]


def test_beats_of_a_synthetic_trace(spark):
    period, n = 40, 12
    df = frame(spark, [50 + 30 * (1 - math.cos(2 * math.pi * i / period)) / 2 for i in range(period * n)])
    points = beats.turning_points(df, S, "x", 80)
    found = beats.find_beats(points, S, "x", "t").orderBy("beat").collect()
    assert [r["peak"] for r in found] == [period * k + period // 2 for k in range(1, len(found) + 1)]
    assert len(found) >= n - 3
    summary = beats.summary(beats.intervals(beats.find_beats(points, S, "x", "t"), ("k",)), ("k",)).first()
    assert summary["HP_median"] == period and summary["AI"] == 0
    assert summary["FS"] == pytest.approx(0.375)


def test_landmarks_are_in_order(spark):
    df = frame(spark, [50 + 30 * (1 - math.cos(2 * math.pi * i / 40)) / 2 for i in range(400)])
    found = beats.find_beats(beats.turning_points(df, S, "x", 80), S, "x", "t")
    rows = beats.rows_of_beats(df, found, S, "x", "t")
    order = ["tt10p", "tt25p", "tt50p", "tt75p", "tt90p", "peaked", "tt90r", "tt75r", "tt50r", "tt25r", "tt10r"]
    for r in beats.landmarks(rows, ("k", "beat")).collect():
        times = [r[c] for c in order]
        assert times == sorted(times)


def test_landmarks_take_the_first_sample_under_a_level_though_it_rebounds(spark):
    rows = spark.createDataFrame([(1, 1, t, float(y)) for t, y in enumerate([0, 0.6, 1, 0.4, 0.8, 0.05, 0.3])], "k int, beat int, time int, relative double")
    got = beats.landmarks(rows, ("k", "beat")).first()
    assert (got["peaked"], got["tt50p"], got["tt90r"], got["tt50r"], got["tt10r"]) == (2, 1, 3, 3, 5)


def test_long_and_short_series_have_their_own_windows(spark):
    long, short = [float((7 * i) % 31) for i in range(450)], [float((5 * i) % 13) for i in range(30)]
    df = frame(spark, long).unionByName(frame(spark, short, key=2))
    got = {(r["k"], r["t"]): r["threshold"] for r in series.forward_threshold(df, S, "x", 400).collect()}
    assert all(got[1, i] == pytest.approx(sum(long[i : i + 400]) / 400) for i in range(50)) and all(got[2, i] == pytest.approx(sum(short[i : i + 10]) / 10) for i in range(20))


def test_flat_and_single_rows_have_no_beats(spark):
    for values in ([5] * 50, [1]):
        assert beats.find_beats(beats.turning_points(frame(spark, values), S, "x", 10), S, "x", "t").count() == 0


def test_bins_are_half_open_and_the_last_point_stays(spark):
    points = spark.createDataFrame([(1, t) for t in (0, 1, 2, 3, 5, 9)], "k int, at int")
    borders = spark.createDataFrame([(1, b) for b in (1, 3, 9)], "k int, b int")
    got = joins.last_in_bin(joins.bins(points, borders, ["k"], "at", "b"), ["k"], "at").orderBy("bin").collect()
    assert [(r["bin"], r["at"]) for r in got] == [(1, 2), (2, 5)]


def test_classes_leave_traces_without_metrics_unclassified(spark):
    df = spark.createDataFrame([("a", 0.9, 0.9, 1.0), ("b", 0.8, 0.9, 1.1), ("c", 0.5, 0.6, 2.5), ("d", None, None, None)], "csv string, a double, b double, s double")
    got = {r["csv"]: r["quality"] for r in qc.classes(df, "a", "b", "s").collect()}
    assert got == {"a": "excellent", "b": "excellent", "c": "good", "d": "n.t."}
