import pytest
from pyspark.sql import functions as F

from cardioframe.functions import dates, naming, stats
from cardioframe.operators import joins, tables

NAME = "CRISPR0002_017_3wf_10x_r1_note.cxd_peak_2_at Xpos_331.tiff_traced.jpg"


def test_names_come_apart(spark):
    df = spark.createDataFrame([(NAME,), ("odd",)], "n string")
    c = F.col("n")
    got = df.select(naming.code(c), naming.number(c), naming.age(c), naming.sex(c), naming.comment(c), naming.coded(c), naming.fly_id(c), naming.xpos(c), naming.movie(c), naming.masked_peak(c)).collect()
    assert tuple(got[0]) == ("CRISPR0002", 17, "3", "f", "note", "CRISPR00023f", "CRISPR0002_017_3wf", 331, "CRISPR0002_017_3wf_10x_r1_note.cxd", NAME.replace("peak_2", "peak_X"))
    assert tuple(got[1])[1:] == (None, None, None, "none", None, None, None, None, "odd")


def test_suffixes(spark):
    df = spark.createDataFrame([("CRISPR00023f",)], "n string")
    assert df.select(naming.without_age_sex(F.col("n"))).first()[0] == "CRISPR0002"


def test_sunday_weeks_agree_with_strftime(spark):
    import datetime

    days = [datetime.date(2017, 12, 25) + datetime.timedelta(i) for i in range(0, 3000, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", dates.year_week(F.col("d")).alias("w")).collect()
    assert all(r["w"] == r["d"].strftime("%Y-%U") for r in got)


def test_camera_epoch(spark):
    got = spark.range(1).select(dates.unix_seconds(F.lit(11644444801)).alias("s"), F.date_format(dates.day(dates.unix_seconds(F.lit(11644444801))), "yyyy-MM-dd").alias("d")).first()
    assert tuple(got) == (1, "1970-01-01")


def test_stroke_volume(spark):
    got = spark.range(1).select(stats.stroke_volume(F.lit(4.0), F.lit(2.0)), stats.fractional_shortening(F.lit(0.0), F.lit(2.0))).first()
    assert got[0] == pytest.approx(9.424778, abs=1e-6) and got[1] is None


def test_lookup_never_multiplies_rows(spark):
    facts = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    dim = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in joins.lookup(facts, dim, "k", ["v"]).collect()) == [(0, None), (1, "a"), (2, None)]


def test_rescue_takes_good_traces_of_movies_without_an_excellent_one(spark):
    df = spark.createDataFrame([("m1", "good"), ("m1", "excellent"), ("m2", "good"), ("m3", "n.t.")], "cxd string, quality string")
    assert [r["cxd"] for r in joins.rescue(df, "quality", "cxd").collect()] == ["m2"]


def test_scale_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.5, None)], "f double, m double")
    assert [r[0] for r in df.select(tables.scale_factor(F.col("f"), F.col("m"))).collect()] == [1.3, 0.5]
    with pytest.raises(Exception, match="no calibration found: m.cxd"):
        df.select(tables.scale_factor(F.nullif(F.col("f"), F.lit(1.0)), F.col("m"), F.lit("m.cxd"))).collect()


def test_usable_movies_compare_numbers(spark):
    df = spark.createDataFrame([("a", 200_000_000, "1000", "0.005"), ("b", 200_000_000, "1000", "9e-3"), ("c", 200_000_000, "1000", "0.02"), ("d", 1, "1000", "0.005"), ("e", 200_000_000, "30", "0.005")], "file string, size long, sizeT string, time_interval string")
    assert sorted(r["file"] for r in tables.usable_movies(df).collect()) == ["a", "b"]


def test_segment_and_per_fly(spark):
    df = spark.createDataFrame([("f", "m", 10, 1.0), ("f", "m", 30, 3.0), ("f", "m", 30, 5.0)], "fly string, movie string, x int, v double")
    assert sorted(r["segment"] for r in tables.segment(df, "x").collect()) == ["anterior", "posterior", "posterior"]
    assert [tuple(r) for r in tables.per_fly(df, "fly", ["v"], ["movie"]).collect()] == [("f", 3.0, "m")]


def test_pivot_and_melt(spark):
    kv = spark.createDataFrame([("f", "sizeX", "10"), ("f", "sizeT", "300")], "file string, L1 string, value string")
    wide = tables.pivot_kv(kv, "file")
    assert (wide.first()["sizeX"], wide.first()["sizeT"], wide.first()["sizeY"]) == ("10", "300", None)
    assert tables.melt(wide, ["file"], ["sizeX", "sizeT"]).count() == 2
