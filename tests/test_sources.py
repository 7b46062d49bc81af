import os
import time

from pyspark.sql import functions as F

from cardioframe.sources import readers, writers
from cardioframe.streaming import traces

DUMP = "Width = 1000\nHeight = 400\nSizeT = 300\nDimension order = XYCZT (certain)\nfactor\t: 1;um\nmagnification: 10;x\nCapture Region: 1\nFile Info Last Field Date  Time: 11644444805\nno separator\n" + "".join(
    f"Field {k} Time_From_Start: {0.005 * k}\nField {k} Time_From_Last: {0.005 if k else 0.0}\n" for k in range(12)
)


def test_metadata_of_a_dump(spark, tmp_path):
    (tmp_path / "m.txt").write_text(DUMP)
    got = {r["L1"]: r["value"] for r in readers.metadata(readers.metadata_lines(spark, str(tmp_path))).collect()}
    assert (got["sizeX"], got["sizeT"], got["sizeC"], got["orderCertain"]) == ("1000", "300", "1", "XYCZT(certain)")
    assert float(got["resolution"]) == 6.5 and abs(float(got["time_interval"]) - 0.055 / 12) < 1e-9 and got["imageCount"] == "11"
    assert got["created_unix_from_file"] == "5"
    bare = readers.metadata(readers.metadata_lines(spark, str(tmp_path)).where("key not like 'File Info%'"))
    assert bare.where("L1 = 'created_unix_from_file'").first()["value"] == "1"


def test_mapping_with_a_mark_and_underscores(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿CODE,cross,type,Gal4-line,UAS-line,Gene,human ortholog,DIOPT,Stock collection\nAB_1,c,t,g,u,tin,NKX2-5,9,s")
    assert [tuple(r) for r in readers.mapping(spark, str(tmp_path)).collect()] == [("AB1", "c", "t", "tin", "NKX2-5", "g;u;s")]


def test_traces_stage_and_listing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,distance,up,down,up_bright,down_bright,down_norm,up_norm,distance_norm\n0,5,1,6,0,0,0,0,0\n")
    rows = readers.traces(spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [("a.csv", 0.0, 5.0)]
    assert [r["file"] for r in readers.listing(spark, str(tmp_path), "*.csv").collect()] == ["a.csv"]
    out = str(tmp_path / "out")
    assert readers.finished(spark, out) is None
    writers.stage(rows, out, by="csv")
    assert readers.finished(spark, out).count() == 1
    run = writers.tables({"t": rows}, str(tmp_path / "final"))
    assert spark.read.option("header", True).csv(str(tmp_path / "final" / "runs" / run / "t")).count() == 1


def test_only_new_files_are_read(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = lambda h: spark.sql(f"select timestamp'2024-01-01 {h:02d}:10:00' as ts, 1L as user_id, 2.0D as value")
    for h in (1, 9):
        rows(h).write.mode("append").parquet(src)
        stream = traces.activity(traces.frames(spark, src, "ts timestamp, user_id long, value double"))
        traces.run_once(stream, out, check).awaitTermination()
    done = spark.read.parquet(out).collect()
    assert [(r["start"].hour, r["frames"], r["mean"]) for r in done] == [(1, 1, 2.0)]


def test_staged_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = shuffles()
    staged = writers.staged(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left and {r["k"] for r in staged.collect()} == set(range(7))
    writers.dropped(staged)
    assert not os.path.exists(staged.staged_path)
