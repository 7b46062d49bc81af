"""Bright areas and kymograph positions against plain code that takes borders off two by two."""

import statistics

import numpy as np
import pytest

from cardioframe.operators import areas
from cardioframe.sources import writers

KEYS = ["movie"]
SCHEMA = "movie int, x int, v double"


def plain_areas(values, window, least):
    n, mean = len(values), sum(values) / len(values)
    kind = [v >= mean for v in values]
    padded = kind + [kind[-1]] * (window - 1)
    edges = [i + 1 for i in range(n) if statistics.median(100 if b else 1 for b in padded[i : i + window]) == 50.5]
    if not edges:
        return []
    begin = kind[0] if len(set(kind[: edges[0]])) == 1 else kind[edges[0] - 1]
    b = ([1] if begin else []) + edges
    while len(b) >= 2 and b[1] - b[0] < least:
        b = b[2:]
    return ([(1, b[0], b[1])] if len(b) > 1 else []) + ([(2, b[2], b[3])] if len(b) > 3 else [])


def found(spark, series, window=30, least=60):
    df = spark.createDataFrame([(k, x + 1, float(v)) for k, s in enumerate(series) for x, v in enumerate(s)], SCHEMA)
    rows = areas.bright_areas(areas.borders(df, KEYS, "x", "v", window), KEYS, least).collect()
    return {k: sorted((r["area"], r["first"], r["last"]) for r in rows if r["movie"] == k) for k in range(len(series))}


def stripes(*widths, bright=False):
    out = []
    for w in widths:
        out += [float(bright)] * w
        bright = not bright
    return out


CASES = {
    "dark first": stripes(100, 90, 80, 90, 100),
    "bright first": stripes(100, 90, 80, 90, 100, bright=True),
    "all narrow": stripes(60, 40, 60, 40, 60, 40, 60),
    "narrow first": stripes(60, 40, 60, 90, 60, 40, 60),
    "one area": stripes(60, 120, 60),
    "no border": [1.0] * 200,
    "one border": stripes(100, 100),
    "speckled beginning": [1.0, 0.0] * 20 + stripes(60, 90, 60),
    "ends bright": stripes(70, 80, 70, 80),
}


def test_areas_equal_the_published_fold(spark):
    rng = np.random.default_rng(4)
    series = [*CASES.values()] + [rng.random(rng.integers(1, 60)).round(2).tolist() for _ in range(30)]
    got = found(spark, series)
    assert {k: got[k] for k in range(len(CASES))} == {k: plain_areas(s, 30, 60) for k, s in enumerate(CASES.values())}
    assert got[2] == got[5] == [] and len(got[0]) == len(got[1]) == 2 and len(got[4]) == 1
    small = found(spark, series, 6, 4)
    assert small == {k: plain_areas(s, 6, 4) for k, s in enumerate(series)}


def test_positions_are_the_brightest_peaks_of_both_areas(spark):
    values = [0.0] * 20
    for x, v in ((4, 5), (7, 9), (10, 9), (15, 3), (19, 8)):
        values[x - 1] = float(v)
    df = spark.createDataFrame([(0, x + 1, v) for x, v in enumerate(values)], SCHEMA)
    rows = spark.createDataFrame([(0, 1, 1, 12), (0, 2, 13, 20)], "movie int, area int, first int, last int")
    got = areas.kymograph_positions(df, rows, KEYS, "x", "v", reach=2).orderBy("peak_no").collect()
    # the second of two equal peaks is not taken; each lies one column behind its peak, inside the image
    assert [(r["peak_no"], r["xpos"]) for r in got] == [(1, 8), (2, 5), (3, 20), (4, 16)]


def test_an_area_without_a_peak_leaves_the_other(spark):
    df = spark.createDataFrame([(0, x, float(x == 30)) for x in range(1, 41)], SCHEMA)
    rows = spark.createDataFrame([(0, 1, 1, 12), (0, 2, 20, 40)], "movie int, area int, first int, last int")
    assert [(r["peak_no"], r["xpos"]) for r in areas.kymograph_positions(df, rows, KEYS, "x", "v").collect()] == [(1, 31)]


def test_profile_sums_what_varies_most(spark):
    sd = [[1.0, 2.0, 3.0], [4.0, 8.0, 6.0]]
    df = spark.createDataFrame([(0, x + 1, y, v) for x, c in enumerate(sd) for y, v in enumerate(c)], "movie int, x int, y int, sd double")
    got = {r["x"]: r for r in areas.column_profile(df, KEYS).collect()}
    # the third quartile is 5.5
    assert got[1]["total"] == 0 and got[2]["total"] == pytest.approx(14 / 8) and got[2]["area"] == pytest.approx(np.trapezoid([0, 1, 0.75]))


def test_cuts_read_the_folders_of_their_columns_only(spark, tmp_path):
    columns = spark.createDataFrame([(m, t, x, [float(m), float(x), float(t)]) for m in (1, 2) for t in range(4) for x in range(1, 21)], "movie int, t int, x int, col array<double>")
    writers.stack(columns, KEYS, str(tmp_path / "stack"))
    assert len(list((tmp_path / "stack").glob("x=*"))) == 20
    positions = spark.createDataFrame([(1, 1, 7), (1, 2, 9), (2, 1, 9)], "movie int, peak_no int, xpos int")
    df = areas.kymographs(spark.read.parquet(str(tmp_path / "stack")), positions, KEYS)
    got = sorted((r["movie"], r["peak_no"], r["xpos"], r["t"], r["col"]) for r in df.collect())
    assert got == sorted((m, k, x, t, [float(m), float(x), float(t)]) for m, k, x in ((1, 1, 7), (1, 2, 9), (2, 1, 9)) for t in range(4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
