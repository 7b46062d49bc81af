"""Quality of traces, beats on corrected series, the store of series, and small readers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardioframe.operators import beats, qc
from cardioframe.operators.series import Series
from cardioframe.sources import readers, writers

S = Series(("k",), ("t",))


def traces(spark, named):
    rows = [(csv, t, float(u), float(d), float(d - u), float(n)) for csv, cols in named.items() for t, (u, d, n) in enumerate(zip(*cols, strict=True))]
    return spark.createDataFrame(rows, "csv string, t int, up double, down double, distance double, distance_norm double")


def test_quality_classes_and_rescue(spark):
    t = np.arange(200)
    rng = np.random.default_rng(0)
    smooth = lambda a, p: 50 + a * np.sin(t / p)
    named = {f"G1_{k}_3wf_a_b_c.cxd_peak_1_at Xpos_9.tiff.csv": (smooth(5, 9 + k), smooth(-7, 9 + k), smooth(1, 9)) for k in range(5)}
    # its edges are noisy and alike, their difference is smooth
    noise = rng.normal(size=200) * 3
    named["G2_7_3wf_a_b_c.cxd_peak_1_at Xpos_9.tiff.csv"] = (smooth(5, 9) + noise, 80 + noise, smooth(1, 9))
    named["G2_8_3wf_a_b_c.cxd_peak_1_at Xpos_9.tiff.csv"] = (np.full(200, 3.0), smooth(5, 9), smooth(1, 9))
    named["G2_9_3wf_a_b_c.cxd_peak_1_at Xpos_9.tiff.csv"] = ([1.0], [2.0], [0.0])
    table = qc.quality_table(traces(spark, named))
    got = {r["csv"].split("_")[1]: r for r in table.collect()}
    assert {k: r["quality"] for k, r in got.items()} == {**{str(k): "excellent" for k in range(5)}, "7": "good", "8": "n.t.", "9": "n.t."}
    assert {n: got["8"][n] for n in qc.FLAT} == qc.FLAT and got["9"]["sd"] is None
    d = np.diff(named["G2_7_3wf_a_b_c.cxd_peak_1_at Xpos_9.tiff.csv"][0])
    assert got["7"]["autocorr_up"] == pytest.approx(np.corrcoef(d[:-1], d[1:])[0, 1]) and got["7"]["smoothie_up"] == pytest.approx(d.std(ddof=1))
    assert (got["7"]["Xpos"], got["7"]["CODE"], got["7"]["cxd"], got["7"]["jpeg"]) == (9, "G2", "G2_7_3wf_a_b_c.cxd", "G2_7_3wf_a_b_c.cxd_peak_1_at Xpos_9.tiff_traced.jpg")
    (saved,) = qc.rescued(table).collect()
    assert (saved["ID"], saved["value"]) == ("7", 1)
    assert sorted((r["quality"], r["value"]) for r in qc.tally(table).where("cxd like 'G2_7%'").collect()) == [("excellent", 0), ("good", 1), ("n.t.", 0)]


def test_metrics_of_flat_traces_are_unknown(spark):
    df = spark.createDataFrame([(1, t, 5.0) for t in range(9)], "k int, t int, x double")
    (r,) = qc.trace_metrics(df, S, "x").collect()
    assert r["smooth_x"] == 0 and r["autocorr_x"] is None


def test_beats_of_a_drifting_recording(spark):
    """Peaks are found though the diameter drifts further than it beats; diameters are those of the original."""
    t = np.arange(1200)
    beat = np.where(t % 60 < 30, 10 * np.sin(np.pi * (t % 60) / 30), 0)
    distance = 200 - 0.05 * t - beat + 0.02 * ((t % 3) - 1)
    df = spark.createDataFrame([(1, int(k), float(v)) for k, v in zip(t, distance, strict=True)], "k int, t int, distance double")
    frames, found = beats.of_recordings(df, S, "t", "distance", width=120)
    got = found.orderBy("beat").collect()
    assert 15 <= len(got) <= 20 and all(abs(r["peak"] % 60 - 15) <= 2 for r in got)
    assert all(r["peak_x"] == round(-distance[r["peak"]], 2) and r["start_x"] == round(-distance[r["start"]], 2) for r in got)
    rows = beats.transients(frames, found, S, "t").toPandas()
    each = rows.groupby("beat")
    assert (each.size() > 10).all() and (each["time"].min() == 0).all() and np.allclose(rows["diameter"], [round(distance[k], 2) for k in rows["timestamp"]])
    assert np.allclose(rows["from_EDD"] + rows["delta"], -np.median([r["start_x"] for r in got])) and rows["distance"].max() == 1


def test_areas_outside_are_left_out(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, None), (1, 3, -2.0), (2, 1, None)], "k int, beat int, auc double")
    assert sorted(r["beat"] for r in beats.of_usual_area(df, ("k",)).collect()) == [1, 3]


def test_stored_series_need_no_shuffle(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") % 9).alias("k"), F.col("id").alias("t"), F.sin(F.col("id") / 30).alias("x"))
    stored = writers.series_store(df, ["k"], ["t"], "stored_series", str(tmp_path / "s"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = beats.find_beats(beats.turning_points(stored, S, "x", 50), S, "x", "t")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() > 0 and "Exchange" not in plan and "Window" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table stored_series")


def test_lists_of_dates_are_optional(spark, tmp_path):
    assert readers.file_dates(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "some.csv").write_text("C:\\d\\a.cxd\t17 Jan\nx/b.cxd\nx/a.cxd\t9 Feb\n")
    got = {r["cxd_file"]: r["cxd_date"] for r in readers.file_dates(spark, str(tmp_path / "some.csv")).collect()}
    assert got == {"a.cxd": "17", "b.cxd": None}


def test_direction_marks_are_read_whatever_their_header(spark, tmp_path):
    (tmp_path / "a.cxd_directionmarks.csv").write_text('"41","492","delta","direction","slope","speed","rsq"\n10,20,-10,0,0.5,-3.5,0.9\n20,,NA,NA,0.1,NA,0.2\n')
    got = sorted(readers.directions(spark, str(tmp_path)).collect(), key=lambda r: r["t_first"])
    assert (got[0]["delta"], got[0]["direction"], got[0]["csv"]) == (-10.0, 0, "a.cxd_directionmarks.csv") and got[1]["direction"] is None and got[1]["rsq"] == 0.2
