"""Beats of a series: extrema, thresholds, the valley-peak-valley pattern, intervals and landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import series, signal
from .series import Series

#: Heights of a beat, as shares of its amplitude, at which landmarks are taken on either side of the peak.
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)


def turning_points(df: DataFrame, s: Series, x: str, width: int = 400) -> DataFrame:
    """Peaks over the threshold and valleys under it, with ``kind`` (P or V) and ``place``; a peak right after a peak is dropped."""
    marked = series.forward_threshold(df, s, x, width)
    marked = marked.withColumns({"place": s.number(), "__p": series.local_extrema(s, x), "__v": series.local_extrema(s, x, valleys=True)})
    kind = F.when(F.col("__p") & (F.col(x) > F.col("threshold")), "P").when(F.col("__v") & (F.col(x) < F.col("threshold")), "V")
    points = marked.withColumn("kind", kind).where("kind is not null").drop("__p", "__v")
    repeat = (F.col("kind") == "P") & F.coalesce(s.lag("kind") == "P", F.lit(False))
    return points.withColumn("__again", repeat).where(~F.col("__again")).drop("__again")


def find_beats(points: DataFrame, s: Series, x: str, t: str) -> DataFrame:
    """A row for each valley, peak, valley in a row: beat (ordinal), start, peak and end times and values."""
    near = points.select(*s.keys, *s.order, "kind", *(f(c).alias(f"{n}_{k}") for n, f in (("before", s.lag), ("after", s.lead)) for k, c in (("kind", "kind"), ("t", t), ("x", x), ("place", "place"))), F.col(t).alias("peak"), F.col(x).alias("peak_x"), F.col("place").alias("peak_place"))
    found = near.where((F.col("kind") == "P") & (F.col("before_kind") == "V") & (F.col("after_kind") == "V"))
    return found.select(
        *s.keys, s.number().alias("beat"), F.col("before_t").alias("start"), "peak", F.col("after_t").alias("end"), F.col("before_x").alias("start_x"), "peak_x", F.col("after_x").alias("end_x"),
        F.col("before_place").alias("start_place"), "peak_place", F.col("after_place").alias("end_place"),
    )


def intervals(beats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds SI (systolic interval), deltaSI, deltaSIplus, HP (heart period) and DI (diastolic interval); the last beats have nulls."""
    w = Window.partitionBy(*keys).orderBy("start")
    out = beats.withColumn("SI", F.col("end") - F.col("start"))
    out = out.withColumns({"deltaSI": F.lead("SI").over(w) - F.col("SI"), "HP": F.lead("start").over(w) - F.col("start")})
    return out.withColumns({"deltaSIplus": F.lead("deltaSI").over(w), "DI": F.col("HP") - F.col("SI")})


def rows_of_beats(df: DataFrame, beats: DataFrame, s: Series, x: str, t: str, more_than: int = 10, trim: bool = True) -> DataFrame:
    """A row for each frame of each beat, for beats of over ``more_than`` frames.

    time (from the beat's start), distance, from_start (change since the start), relative (its share of the
    largest one, as it is where that is 0), velocity (0 at first). trim: leave out the frames before the one that precedes the first
    movement; time then starts anew, the other columns stay.
    """
    numbered = df.withColumn("place", s.number())
    # places of beats are listed and joined by place, so frames don't meet all beats of their series
    places = beats.select(*s.keys, "beat", F.explode(F.sequence(F.col("start_place").cast("int"), F.col("end_place").cast("int"))).alias("place"))
    inside = numbered.join(places, [*s.keys, "place"])
    b = Series((*s.keys, "beat"), ("place",))
    out = inside.withColumn("__n", F.count("*").over(b.whole)).where(F.col("__n") > more_than)
    first = lambda c: F.first(c).over(b.w)
    out = out.withColumns({"time": F.col(t) - first(t), "from_start": F.col(x) - first(x)})
    most = F.max("from_start").over(b.whole)
    out = out.withColumn("relative", F.when(most == 0, F.col("from_start")).otherwise(F.try_divide(F.col("from_start"), most)))
    out = out.withColumn("velocity", F.coalesce(F.try_divide(F.col("from_start") - b.lag("from_start"), F.col("time") - b.lag("time")), F.lit(0.0)))
    if trim:
        out = out.withColumn("__rn", b.number())
        moved = F.min(F.when(F.col("velocity") != 0, F.col("__rn"))).over(b.whole)
        out = out.withColumn("__from", moved).where(F.col("__rn") >= F.coalesce(F.col("__from") - 1, F.lit(1)))
        out = out.withColumn("time", F.col("time") - F.first("time").over(b.w)).drop("__rn", "__from")
    return out.drop("__n")


def landmarks(rows: DataFrame, keys: tuple[str, ...], y: str = "relative", t: str = "time") -> DataFrame:
    """When each beat peaks, first passes each level before that and is first under it after that; from raw samples."""
    w = Window.partitionBy(*keys)
    top = rows.withColumn("__top", F.max(y).over(w))
    peaked = top.withColumn("peaked", F.min(F.when(F.col(y) == F.col("__top"), F.col(t))).over(w))
    up = [series.first_crossing(y, t, v, F.col(t) <= F.col("peaked")).alias(f"tt{round(100 * v)}p") for v in LEVELS]
    down = [series.first_below(y, t, v, F.col(t) > F.col("peaked")).alias(f"tt{round(100 * v)}r") for v in reversed(LEVELS)]
    return peaked.groupBy(*keys).agg(F.max("peaked").alias("peaked"), *up, *down)


def auc(rows: DataFrame, keys: tuple[str, ...], order: str, y: str = "relative") -> DataFrame:
    s = Series(keys, (order,))
    return rows.withColumn("__part", series.trapezoid(s, y)).groupBy(*keys).agg(F.sum("__part").alias("auc"))


def of_usual_area(areas: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Beats whose area is known and lies between the quartiles 0 and 4 of its series, so those without one go."""
    w = Window.partitionBy(*keys)
    ends = areas.where("auc is not null").withColumns({"__low": F.min("auc").over(w), "__high": F.max("auc").over(w)})
    return ends.where("auc between __low and __high").drop("__low", "__high")


def of_recordings(traces: DataFrame, s: Series, t: str, distance: str, width: int = 400, wm: int = 20, ws: int = 20, digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """Frames and beats of recordings of diameters, as published: frames have ``x`` (the diameter turned over and rounded) and ``corrected`` (``x`` less its baseline).

    Peaks, valleys and the threshold are those of ``corrected``; values, and so the diameters at the beginning (start_x) and the
    peak (peak_x) of a beat, are those of ``x``.
    """
    turned = traces.withColumn("x", F.round(-F.col(distance), digits))
    frames = signal.with_baseline(turned, s, "x", wm, ws)
    return frames, find_beats(turning_points(frames, s, "corrected", width), s, "x", t)


def transients(frames: DataFrame, beats: DataFrame, s: Series, t: str, more_than: int = 10) -> DataFrame:
    """A row for each frame of each beat: keys, beat, time (from the first frame that is kept), distance (share of the beat's largest change), diameter, timestamp, delta (change since the beat began), from_EDD and velocity.

    frames, beats: as of_recordings() gives them. Leading frames without movement go, then beats without a known area, then beats of
    ``more_than`` frames or fewer. from_EDD is the recording's diameter at the beginning of beats (their median) less delta.
    """
    keys = (*s.keys, "beat")
    rows = rows_of_beats(frames, beats, s, "x", t, more_than=0, trim=True)
    known = of_usual_area(auc(rows, keys, "place"), s.keys).select(*keys)
    rows = rows.join(known, list(keys), "left_semi").withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") > more_than)
    rest = beats.groupBy(*s.keys).agg((-F.median("start_x")).alias("__edd"))
    return rows.join(rest, list(s.keys)).select(
        *keys, "time", F.col("relative").alias("distance"), (-F.col("x")).alias("diameter"), F.col(t).alias("timestamp"), F.col("from_start").alias("delta"), (F.col("__edd") - F.col("from_start")).alias("from_EDD"), "velocity"
    )


def summary(beats_with_intervals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each series: beats, median heart period, arrhythmia index, EDD, ESD and FS."""
    return beats_with_intervals.groupBy(*keys).agg(
        F.count("*").alias("beats"), F.median("HP").alias("HP_median"), stats.arrhythmia_index(F.col("HP")).alias("AI"), F.median("peak_x").alias("EDD"), F.median("start_x").alias("ESD"),
        F.median(stats.fractional_shortening(F.col("peak_x"), F.col("start_x"))).alias("FS"),
    )


def timing(df: DataFrame, s: Series, t: str, beats: DataFrame, rows: DataFrame) -> DataFrame:
    """total_time (frames times their median spacing), coverage (time in beats over all time) and beats a second."""
    spaced = df.withColumn("__dt", F.col(t) - s.lag(t)).groupBy(*s.keys).agg((F.count("*") * F.median("__dt")).alias("total_time"))
    used = rows.groupBy(*s.keys, "beat").agg(F.max("time").alias("t")).groupBy(*s.keys).agg(F.sum("t").alias("used"), F.count("*").alias("kept"))
    out = spaced.join(used, list(s.keys), "left")
    return out.select(*s.keys, "total_time", F.try_divide("used", "total_time").alias("coverage"), F.try_divide(F.coalesce("kept", F.lit(0)), F.round("total_time", 2)).alias("heart_rate"))
