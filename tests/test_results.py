"""The result tables: published names and orders, runs that are seen whole or not at all, and numbers of labels."""

import pytest
from pyspark.sql import functions as F

from cardioframe.operators import results, tables
from cardioframe.plans import result_queries
from cardioframe.sources import readers, writers

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The first orders and all their lines."""
    folder = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderkey <= 60").write.parquet(f"{folder}/orders.parquet")
    spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey <= 60").write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{DATA}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    return folder


@pytest.fixture(scope="module")
def named(spark, small):
    return result_queries._assembled(spark, small)


def test_columns_are_those_published(named):
    assert len(named) == 15
    assert len(named["meta_data_all"].columns) == 30 and len(named["all_data_table"].columns) == 56 and len(named["final_all_data"].columns) == 57 and len(named["master_table"].columns) == 23
    last = named["final_all_data"].columns
    assert [last[k - 1] for k in (1, 3, 11, 14, 20, 23, 24, 27, 37, 44, 45, 54, 57)] == ["CODE", "flyID", "Xpos", "EDD", "relaxtime", "min.velocity", "max.velocity", "MAD_DI", "tt10r_median", "anterograde_percent", "segment", "jpg_noX", "stocks"]
    assert named["all_data_table"].columns[9] == "CODE.x" and named["all_data_table"].columns[38] == "CODE.y"
    assert named["EDD_data"].columns == ["EDD", "L1", "CODE", "human", "fly", "type"]
    assert named["final_all_data_per_fly"].columns[-2:] == ["reversals_median", "reversals_SD"] and "stocks" in named["final_all_data_per_fly_anterior"].columns


def test_segments_part_the_recordings(named):
    parts = [named[f"final_all_data_{s}"].count() for s in ("anterior", "posterior")]
    assert min(parts) > 0 and sum(parts) == named["final_all_data"].count()


def test_a_run_is_seen_when_all_its_tables_are_there(spark, named, tmp_path):
    some = {k: named[k] for k in ("master_table", "FS_data")}
    folder = str(tmp_path / "out")
    assert readers.tables_of(spark, folder) == {}
    writers.table(some["FS_data"], f"{folder}/runs/broken/FS_data")  # a run that ended early
    assert readers.tables_of(spark, folder) == {}
    writers.tables(some, folder)
    first = readers.tables_of(spark, folder)
    assert set(first) == set(some) and first["FS_data"].count() == some["FS_data"].count()
    writers.tables({"master_table": some["master_table"].limit(1)}, folder)
    again = readers.tables_of(spark, folder)
    assert set(again) == {"master_table"} and again["master_table"].count() == 1 and again["master_table"].columns == some["master_table"].columns


def test_labels_are_numbered_in_order(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "a", ""]], "v string")
    assert sorted((r["v"], r["n"]) for r in results.ordinals(df, "v", "n").collect()) == [("", 1), ("a", 2), ("b", 3), ("c", 4)]


def test_catalog_numbers_recordings_and_levels(spark):
    names = ["G1_007_3wf_a_b_c.cxd_peak_1_at Xpos_5.tiff_traced.jpg", "G1_007_3wf_a_b_c.cxd_peak_2_at Xpos_9.tiff_traced.jpg", "G2_001_1wm_a_b_.cxd_peak_1_at Xpos_3.tiff_traced.jpg", "X9_1_1wm_a_b_c.cxd_peak_1_at Xpos_3.tiff_traced.jpg"]
    files = spark.createDataFrame([(n,) for n in reversed(names)], "jpg string")
    mapping = spark.createDataFrame([("G_1", "x", "t2", "f1", "h9"), ("G_2", "y", "t1", "f2", "h1"), ("G_1", "z", "t3", "f3", "h5")], "CODE string, cross string, type string, fly string, human string")
    got = {r["jpg"]: r for r in results.catalog(files, mapping).collect()}
    assert [got[n]["index"] for n in names] == [1, 2, 3, 4] and [(got[n]["i"], got[n]["j"]) for n in names] == [(1, 1), (1, 2), (2, 1), (3, 1)]
    # the first row of a code counts; levels are those of the whole mapping
    assert [(got[n]["cross"], got[n]["sorting"], got[n]["group"]) for n in names] == [("x", 3, 2)] * 2 + [("y", 1, 1), (None, None, None)]
    assert got[names[2]]["comment"] in ("", "none") and got[names[0]]["flyID"] == "G1_007_3wf" and got[names[0]]["Genotype"] == "G13f"


def test_dates_of_a_list_come_before_those_of_metadata(spark):
    wide = spark.createDataFrame([("A_1_3wf_x.cxd_new_meta_data.csv", "86400"), ("B_1_3wf_x.cxd_new_meta_data.csv", "0")], "file string, created_unix_from_file string")
    wide = wide.select("file", *(F.col(c) if c in wide.columns else F.lit("1").alias(c) for c in tables.META_KEYS))
    listed = spark.createDataFrame([("A_1_3wf_other.cxd", "864000")], "cxd_file string, cxd_date string")
    got = {r["CODE"]: r for r in results.meta_table(wide, listed).collect()}
    assert (str(got["A"]["cxd_recordingday"]), got["A"]["cxd_file"], got["A"]["cxd_week_year"]) == ("1970-01-11", "A_1_3wf_other.cxd", "02 1970")
    assert (str(got["B"]["cxd_recordingday"]), got["B"]["cxd_file"], str(got["B"]["recordingday"])) == ("1970-01-01", None, "1970-01-01")
    alone = {r["CODE"]: r for r in results.meta_table(wide).collect()}
    assert alone["A"]["cxd_file"] == "A_1_3wf_x.cxd" and str(alone["A"]["cxd_recordingday"]) == "1970-01-02"


def test_listings_tell_files_apart(spark, tmp_path):
    for name in ("a.cxd", "a.cxd_peak_1_at Xpos_2.tiff", "a.cxd_peak_1_at Xpos_2.tiff.csv", "a.cxd_directionmarks.csv"):
        (tmp_path / name).write_text("x")
    got = {k: sorted(r["file"] for r in df.collect()) for k, df in readers.listings(spark, str(tmp_path)).items()}
    assert got == {"movies": ["a.cxd"], "kymographs": ["a.cxd_peak_1_at Xpos_2.tiff"], "traces": ["a.cxd_peak_1_at Xpos_2.tiff.csv"], "pictures": [], "directions": ["a.cxd_directionmarks.csv"], "metadata": []}


def test_finished_recordings_are_not_written_again(spark, tmp_path):
    folder = str(tmp_path / "kv")
    kv = lambda *rows: spark.createDataFrame(rows, "recording string, L1 string, value string")
    writers.append_unfinished(kv(("7", "sizeX", "10"), ("7", "sizeT", "300"), ("b.cxd", "sizeX", "20")), folder, "recording")
    writers.append_unfinished(kv(("7", "sizeX", "other"), ("c.cxd", "sizeX", "30")), folder, "recording")
    got = sorted((r["recording"], r["L1"], r["value"]) for r in spark.read.schema("L1 string, value string, recording string").parquet(folder).collect())
    assert got == [("7", "sizeT", "300"), ("7", "sizeX", "10"), ("b.cxd", "sizeX", "20"), ("c.cxd", "sizeX", "30")]


def test_last_characters(spark):
    from cardioframe.functions import naming

    df = spark.createDataFrame([("CRISPR3f",), ("f",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(naming.last(F.col("t"), 2)).collect()] == ["3f", "f", "", None]
