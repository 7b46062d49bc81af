"""From a made-up movie, whose walls beat in two stretches, to the result tables."""

import pytest
from pyspark.sql import functions as F

from cardioframe.operators import analysis, tables

MOVIE = "G1_007_3wf_a_b_c.cxd"
WIDTH, HEIGHT, FRAMES, PERIOD, STEP, SCALE = 280, 40, 330, 40, 0.005, 0.5
HOW = analysis.Settings(width=120, more_than=5, step=None, side=64, radius=None)


@pytest.fixture(scope="module")
def movie(spark):
    """A band of light whose rims move in two stretches, each with a place of the largest movement; the wave runs to the right."""
    places = spark.range(1, WIDTH + 1).select(F.col("id").cast("int").alias("x")).crossJoin(spark.range(FRAMES).select(F.col("id").cast("int").alias("t")))
    x, t = F.col("x"), F.col("t")
    swing = F.when(x.between(30, 120), 3 + 3 * F.exp(-F.pow((x - 75) / 18, 2))).when(x.between(160, 250), 2 + 3 * F.exp(-F.pow((x - 205) / 18, 2))).otherwise(0.0)
    phase = F.pmod(t - x * 0.05, F.lit(float(PERIOD))) / PERIOD
    pull = swing * F.when(phase < 0.5, F.pow(F.sin(phase * 6.283185307), 2)).otherwise(0.0)
    # the upper rim moves further than the lower one
    col = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda y: 1 / (1 + F.exp((F.abs(y - 19.5) - 13 + pull * F.when(y < 20, 1.0).otherwise(0.6)) * 1.5)))
    columns = places.select(F.lit(MOVIE).alias("recording"), "t", "x", col.alias("col")).repartition(4).cache()
    movies = spark.createDataFrame([(MOVIE, WIDTH, HEIGHT, FRAMES, SCALE, STEP)], "recording string, width int, height int, frames int, resolution double, time_interval double")
    meta = spark.createDataFrame([(f"{MOVIE}_new_meta_data.csv",)], "file string").select("file", *(F.lit("86400").alias(k) for k in tables.META_KEYS))
    mapping = spark.createDataFrame([("G_1", "c", "control", "tin", "NKX2-5", "stock 7")], "CODE string, cross string, type string, fly string, human string, stocks string")
    return columns, movies, meta, mapping


def test_a_movie_becomes_tables(spark, movie):
    columns, movies, meta, mapping = movie
    kymographs, marks = analysis.cut_movies(columns, movies, HOW)
    cuts = {r["xpos"] for r in kymographs.select("xpos").distinct().collect()}
    # a column behind the place of the largest movement of each stretch
    assert any(abs(c - 76) <= 2 for c in cuts) and any(abs(c - 206) <= 2 for c in cuts)
    assert kymographs.count() == FRAMES * len(cuts)
    seen = marks.collect()
    assert len(seen) >= 5 and {r["direction"] for r in seen if r["delta"]} == {0}

    traces, quality = analysis.trace_kymographs(kymographs, movies, HOW)
    classes = {r["csv"]: r["quality"] for r in quality.collect()}
    assert len(classes) == len(cuts) and set(classes.values()) & {"excellent", "good"}
    used = analysis.usable(traces, quality)
    out = analysis.tabulate(used, marks, analysis.results.meta_table(meta), mapping, HOW)
    last = out["final_all_data"].collect()
    assert {r["Xpos"] for r in last} == {int(c.split("Xpos_")[1].split(".")[0]) for c in {r["csv"] for r in used.select("csv").distinct().collect()}}
    for r in last:
        assert r["HP_median"] == pytest.approx(PERIOD * STEP, rel=0.1) and 0 < r["FS"] < 1 and r["EDD"] > r["ESD"] > 0
        assert (r["fly_gene"], r["stocks"], r["flyID"], r["Age"], r["Sex"]) == ("tin", "stock 7", "G1_007_3wf", "3", "f") and str(r["cxd_recordingday"]) == "1970-01-02"
        assert r["anterograde_percent"] == 0 and r["retrograde_speed"] < 0
    (fly,) = out["final_all_data_per_fly"].collect()
    assert fly["flyID"] == "G1_007_3wf" and fly["reversals_median"] == 0
    (kind,) = out["master_table"].collect()
    assert kind["Code"] == "G13f" and kind["n"] == len(last) and 0.3 < kind["coverage"] <= 1


def test_a_movie_that_does_not_move_has_no_rows(spark, movie):
    columns, movies, meta, mapping = movie
    still = columns.where("x <= 60").withColumn("col", F.transform("col", lambda v: F.lit(0.5)))
    kymographs, marks = analysis.cut_movies(still, movies.withColumn("width", F.lit(60)), HOW)
    assert kymographs.count() == 0 and marks.count() == 0
