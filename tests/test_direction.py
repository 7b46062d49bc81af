"""Direction of beats: synthetic waves whose direction and speed are known, and borders and marks against plain code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardioframe.operators import direction

KEYS = ["movie"]


def wave(spark, back=False, frames=300, beats=(60, 130, 200, 260), width=240, height=20, lag=0.1):
    """Image columns that darken at their rims when a contraction passes, ``lag`` frames later for each column to the right (left, going back)."""
    t, x = np.arange(frames)[:, None], np.arange(1, width + 1)[None, :]
    late = lag * (x if not back else width - x)
    dip = sum(np.exp(-(((t - b - late) / 6.0) ** 2)) for b in beats)
    rows = [("m", int(k), int(c + 1), [float(1 - dip[k, c])] * 4 + [0.5] * (height - 8) + [float(1 - dip[k, c])] * 4) for k in range(frames) for c in range(0, width, 4)]
    columns = spark.createDataFrame(rows, "movie string, t int, x int, col array<double>")
    movies = spark.createDataFrame([("m", width, height, frames, 0.5, 0.01, [30])], "movie string, width int, height int, frames int, resolution double, time_interval double, peaks array<int>")
    return columns, movies


@pytest.mark.parametrize("back", [False, True])
def test_a_wave_has_its_direction_and_speed(spark, back):
    columns, movies = wave(spark, back)
    got = direction.movie_directions(columns, movies, KEYS).orderBy("bin").collect()
    # a wave to the right reaches the last position later: delta is negative and the direction 0
    assert [r["direction"] for r in got] == [1 if back else 0] * 4
    assert {(r["xpos_first"], r["xpos_last"]) for r in got} == {(21, 120)}
    for r in got:
        assert (r["slope"] < 0) == back and abs(abs(r["delta"]) - 9.9) <= 1.5
        assert r["speed"] == pytest.approx((99 * 0.5) / (r["delta"] * 0.01))


def test_positions_are_those_of_a_24th_of_the_width(spark):
    place = lambda w, found=None: spark.range(1).select(direction.positions(F.lit(w), F.array(*map(F.lit, found)) if found else None).alias("p")).first()["p"]
    assert place(1000) == [41 * k for k in range(1, 13)]
    assert place(1000, [7, 990, 82, 500]) == sorted({21, 979, 82, 500, *(41 * k for k in range(1, 13))})
    assert place(60) == [21, 22, 24, 26, 28, 30]


def test_stripes_take_the_rims_as_published(spark):
    # of 100 rows 35 at the top and 36 at the bottom
    columns = spark.createDataFrame([("m", 0, x, [float(r) for r in range(1, 101)]) for x in (10, 31, 52)], "movie string, t int, x int, col array<double>")
    movies = spark.createDataFrame([("m", 100, [31, 200])], "movie string, height int, places array<int>")
    got = direction.stripes(columns, movies, KEYS).collect()
    rim = [*range(1, 36), *range(65, 101)]
    assert [(r["xpos"], round(r["profile"], 9)) for r in got] == [(31, round(sum(rim) / len(rim), 9))]


def test_runs_that_touch_an_end_are_no_borders(spark):
    peaks = spark.createDataFrame([("m", t) for t in (10, 20, 20, 30)], "movie string, t long")
    assert sorted(r["border"] for r in direction.borders(peaks, KEYS, "t", 3).collect()) == [14, 24]


def test_runs_at_the_ends_count_where_frames_are_given(spark):
    peaks = spark.createDataFrame([("a", 10), ("a", 20), ("a", 24), ("b", 1), ("b", 30), (None, 6)], "movie string, t int")
    movies = spark.createDataFrame([("a", 40), ("b", 30), ("c", 9), (None, 7)], "movie string, frames int")
    got = sorted(((r["movie"] or "", r["border"]) for r in direction.borders(peaks, ["movie"], "t", 2, movies).collect()))

    def plain(at, n):
        free = [k for k in range(1, n + 1) if not any(k <= p <= k + 2 for p in at)]
        runs = [[k for k in free if k - free.index(k) == i] for i in sorted({k - free.index(k) for k in free})]
        return [round((r[0] + r[-1]) / 2) for r in runs]

    assert got == [(m, b) for m, at, n in (("", [6], 7), ("a", [10, 20, 24], 40), ("b", [1, 30], 30), ("c", [], 9)) for b in plain(at, n)]


def published_borders(peaks, frames, w):
    """Starts and ends of runs of frames that see no peak, paired in their order, as first published."""
    seen = [None] + [sum(i <= p <= i + w for p in peaks) for i in range(1, frames - w + 1)]
    n = len(seen) - 1
    starts = [i for i in range(2, n) if seen[i - 1] and not seen[i]]
    ends = [i for i in range(2, n) if not seen[i] and seen[i + 1]]
    if not starts or not ends:
        return []
    ends = (ends + [None] * len(starts))[: len(starts)]
    return sorted({round((s + (s if e is None else e)) / 2) for s, e in zip(starts, ends, strict=True)})


def test_literal_borders_pair_as_published(spark):
    rng = np.random.default_rng(2)
    cases = [sorted(rng.choice(np.arange(1, 61), rng.integers(1, 8), replace=False).tolist()) for _ in range(40)]
    peaks = spark.createDataFrame([(k, int(t)) for k, c in enumerate(cases) for t in c], "movie int, t long")
    for w in (0, 2, 5):
        found = direction.gaps(peaks, KEYS, "t").withColumn("usable", F.lit(60))
        got = {k: set() for k in range(len(cases))}
        for r in direction._centres(found, KEYS, F.lit(w), "usable").collect():
            got[r["movie"]].add(r["border"])
        assert {k: sorted(v) for k, v in got.items()} == {k: published_borders(c, 60, w) for k, c in enumerate(cases)}


def marked(spark, rows, positions):
    """Marks of one movie from (bin, position, frame)."""
    registered = spark.createDataFrame([("m", *r) for r in rows], "movie string, bin long, xpos long, t long")
    places = spark.createDataFrame([("m", p) for p in positions], "movie string, xpos long")
    movies = spark.createDataFrame([("m", 2.0, 0.5)], "movie string, resolution double, time_interval double")
    return {r["bin"]: r for r in direction.marks(registered, places, movies, KEYS, "xpos", "t").collect()}


def test_one_pair_of_positions_serves_all_beats(spark):
    # the first position lacks a beat and still counts; the last lacks two and does not
    rows = [(b, p, 100 * b + p) for b in range(4) for p in (1, 2, 3, 4) if (b, p) not in ((0, 1), (1, 4), (2, 4), (3, 2))]
    got = marked(spark, rows, [1, 2, 3, 4])
    assert {(r["xpos_first"], r["xpos_last"]) for r in got.values()} == {(1, 3)} and set(got) == {0, 1, 2, 3}
    assert got[0]["t_first"] is None and got[0]["direction"] is None and got[1]["direction"] == 0


def test_gaps_of_the_outer_positions_leave_the_direction_open(spark):
    rows = [(b, p, 100 * b + p) for b in range(4) for p in (1, 2, 3) if (b, p) != (0, 1)] + [(4, p, 400 + p) for p in (1, 2)]
    got = marked(spark, rows, [1, 2, 3])
    # counts 2, 3, 3, 3, 2: only beats of three stay
    assert set(got) == {1, 2, 3} and all(r["direction"] == 0 and r["delta"] == -2 and r["speed"] == (3 - 1) * 2.0 / (-2 * 0.5) for r in got.values())


def test_the_slope_decides_where_no_position_has_all_beats(spark):
    # each of five beats lacks another one of five positions
    rows = [(b, p, 100 * b + 10 - p) for b in range(5) for p in range(1, 6) if p != b + 1]
    got = marked(spark, rows, range(1, 6))
    assert set(got) == set(range(5)) and all((r["xpos_first"], r["xpos_last"]) == (1, 5) for r in got.values())
    assert got[0]["t_first"] is None and got[0]["slope"] < 0 and got[0]["direction"] == 1 and got[0]["speed"] is None
    assert got[2]["direction"] == 1 and got[2]["delta"] == 4


def test_beats_that_many_positions_lack_go_first(spark):
    beats = {0: range(1, 5), 1: [1, 2, 3, 4, 7, 8, 9, 10, 11], 2: range(1, 11), 3: range(5, 15), 4: [*range(1, 7), *range(11, 15)]}
    got = marked(spark, [(b, p, 100 * b + p) for b, ps in beats.items() for p in ps], range(1, 15))
    # the first is under the mean of the counts 4, 9 and 10; no position has all others, so the one that five lack goes
    assert set(got) == {2, 3, 4} and {(r["xpos_first"], r["xpos_last"]) for r in got.values()} == {(1, 14)}
    apart = {0: range(1, 7), 1: range(7, 13), 2: range(4, 10)}
    assert marked(spark, [(b, p, 100 * b + p) for b, ps in apart.items() for p in ps], range(1, 13)) == {}


def test_ends_that_peak_at_once_are_told_by_a_trusted_slope(spark):
    up = [(0, 1, 50), (0, 2, 40), (0, 3, 45), (0, 4, 60), (0, 5, 50)]
    (r,) = marked(spark, up, range(1, 6)).values()
    assert r["delta"] == 0 and r["speed"] is None and r["slope"] > 0 and r["direction"] == (1 if r["rsq"] > 0.15 else 0)


def test_no_peaks_and_no_rows(spark):
    flat = spark.createDataFrame([("m", 1, t, 1.0) for t in range(40)], "movie string, xpos int, t int, v double")
    movies = spark.createDataFrame([("m", 40, 1.0, 1.0)], "movie string, frames int, resolution double, time_interval double")
    assert direction.beat_directions(flat, movies, KEYS, "xpos", "t", "v").count() == 0
    assert direction.beat_directions(flat.where("t < 0"), movies, KEYS, "xpos", "t", "v", literal=True).count() == 0
