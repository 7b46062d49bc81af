"""Direction of beats along a heart: from image columns to marks of each beat.

Positions along the heart have a brightness over time each (``stripes``). Its peaks are pooled, gaps between
them part the recording into beats (``adaptive_borders``), each position's last peak in a beat is registered
(``register``), and the first and last position that have nearly all beats tell direction and speed (``marks``).
``beat_directions`` is the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import joins, series
from .series import Series


def positions(width: Column, found: Column | None = None, points: int = 12, reach: int = 20) -> Column:
    """Evenly spaced columns of the left half of an image and those in ``found``, moved inside by ``reach`` and one more, each once and in order."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(width / (2 * points)))
    every = F.sequence(step, F.greatest(step, F.floor(width / 2)), step)
    every = every if found is None else F.concat(every, F.coalesce(found.cast("array<bigint>"), F.expr("cast(array() as array<bigint>)")))
    return F.array_sort(F.array_distinct(F.transform(every, lambda x: F.least(F.greatest(x, F.lit(reach + 1).cast("long")), width.cast("long") - reach - 1))))


def stripes(columns: DataFrame, movies: DataFrame, keys: list[str], reach: int = 20, share: float = 0.35) -> DataFrame:
    """keys, xpos, t, profile: mean brightness within ``reach`` columns of each position, of the rows at the rims.

    columns: keys, x, t, col (an image column, an array from its first row). movies: keys, height, places (array of positions).
    The rims are the first ``share`` of rows (rounded down) and, as published, one row more at the end. A column is summed
    where it is read, so what is shuffled is one number for each frame and position.
    """
    height = F.col("height").cast("int")
    extent = F.floor(height * share).cast("int")
    rim = F.concat(F.slice("col", F.lit(1), extent), F.slice("col", height - extent, extent + 1))
    # the columns of each position are listed, so columns meet their positions by equal keys, and a stack in folders by x is pruned
    wanted = movies.select(*keys, "height", F.explode("places").alias("xpos"))
    near = wanted.select(*keys, "height", "xpos", F.explode(F.sequence(F.col("xpos") - reach, F.col("xpos") + reach)).alias("x"))
    each = columns.join(near, [*keys, "x"])
    total = each.select(*keys, "xpos", "t", F.aggregate(rim, F.lit(0.0), lambda a, v: a + v).alias("__s"), F.size(rim).alias("__n"))
    return total.groupBy(*keys, "xpos", "t").agg((F.sum("__s") / F.sum("__n")).alias("profile"))


def profile_peaks(profile: DataFrame, keys: list[str], x: str, t: str, value: str, smooth: int = 10, reach: int = 10) -> DataFrame:
    """keys, x and frame (from 1) of each position's peaks: where the mean of ``smooth`` values, scaled to 0..1 and turned over, is the largest within ``reach`` frames."""
    s = Series((*keys, x), (t,))
    means = profile.select(*keys, x, t, series.rolling_mean(s, value, smooth).alias("__m")).where("__m is not null")
    turned = means.withColumn("__v", series.flipped(series.min_max(s, "__m")))
    return turned.withColumns({"__p": series.window_peaks(s, "__v", reach), "frame": s.number().cast("long")}).where("__p").select(*keys, x, "frame")


def wanted(peaks: DataFrame, places: DataFrame, keys: list[str], x: str, t: str) -> DataFrame:
    """keys, start, beats: the first window (the whole part of the standard deviation of steps between pooled peaks) and how many borders a recording should have (the whole part of the mean number of peaks of its positions).

    places: keys, x, a row for each position, those without a peak too
    """
    pooled = Series(tuple(keys), (t, x))
    start = peaks.withColumn("__d", F.col(t) - pooled.lag(t)).groupBy(*keys).agg(F.coalesce(F.floor(F.stddev_samp("__d")).cast("int"), F.lit(0)).alias("start"), F.count("*").alias("__n"))
    return start.join(places.groupBy(*keys).agg(F.count("*").alias("__k")), keys).select(*keys, "start", F.floor(F.col("__n") / F.col("__k")).alias("beats"))


def gaps(peaks: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, p, q: neighbouring frames with a peak; before the first one p is null, after the last one q."""
    w = Window.partitionBy(*keys).orderBy("__t")
    each = peaks.select(*keys, F.col(t).cast("long").alias("__t")).distinct().withColumns({"__q": F.lead("__t").over(w), "__first": F.row_number().over(w) == 1})
    none = F.lit(None).cast("long")
    after, before = F.struct(F.col("__t").alias("p"), F.col("__q").alias("q")), F.struct(none.alias("p"), F.col("__t").alias("q"))
    return each.select(*keys, F.explode(F.when(F.col("__first"), F.array(before, after)).otherwise(F.array(after))).alias("__g")).select(*keys, "__g.p", "__g.q")


def _centres(found: DataFrame, keys: list[str], width: Column, frames: str | None = None) -> DataFrame:
    """Borders of gaps() for a window: centres of the frames, between two peaks, that have no peak in the ``width`` frames ahead.

    Only runs with a peak on both sides count. frames: the column with the number of frames a window may begin in; with it,
    starts and ends of runs are paired as first published: those before the first peak have an end and those after the
    last one a start, so all pairs are one off where the first frames are free.
    """
    start, end = F.col("p") + 1, F.col("q") - width - 1
    if frames is None:
        return found.where(width >= 0).where(end >= start).select(*keys, F.bround((start + end) / 2, 0).cast("long").alias("border"))
    most = F.col(frames) - width
    begins = F.when(F.col("q").isNull(), F.when(start <= most - 1, start)).when(end >= start, start)
    ends = F.when(F.col("p").isNull(), F.when(end >= 2, end)).when(end >= start, end)
    both = found.where(width >= 0).select(*keys, F.col("p").isNull().alias("__first"), F.coalesce("p", F.lit(-1)).alias("__at"), begins.alias("__s"), ends.alias("__e")).where("__s is not null or __e is not null")
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("__at")
    paired = F.when(F.max("__first").over(whole), F.lag("__e").over(order)).otherwise(F.coalesce("__e", "__s"))
    out = both.withColumns({"__with": paired, "__ends": F.count("__e").over(whole)}).where("__s is not null and __ends > 0")
    return out.select(*keys, F.bround((F.col("__s") + F.col("__with")) / 2, 0).cast("long").alias("border"))


def borders(peaks: DataFrame, keys: list[str], t: str, width: int, movies: DataFrame | None = None) -> DataFrame:
    """Borders between beats: centres of the runs of frames with no peak in the ``width`` frames ahead.

    movies (keys, frames): with it, runs before the first peak and after the last one count too, and a recording without a
    peak is one run; without it only runs inside two peaks do
    """
    if movies is not None:
        # the recording's ends stand as peaks: the last run ends with the last frame, whatever the width
        ends = movies.select(*keys, F.explode(F.array(F.lit(0).cast("long"), F.col("frames").cast("long") + width + 1)).alias(t))
        peaks = peaks.select(*keys, F.col(t).cast("long").alias(t)).unionByName(ends)
    return _centres(gaps(peaks, keys, t).where("p is not null and q is not null"), keys, F.lit(width))


def adaptive_borders(peaks: DataFrame, movies: DataFrame, keys: list[str], t: str, wanted: DataFrame, rounds: int = 10, literal: bool = False) -> DataFrame:
    """borders() (inside two peaks) of each recording with a window of its own, and 0 and its number of frames. movies: keys, frames; wanted: keys, start (its first window), beats (how many borders it should have).

    A window grows while there are over 1.2 times as many borders, and shrinks while there are under 0.8 times
    as many, at most ``rounds`` times. All windows that may be taken are laid out beside each gap between two
    peaks, and counted in one job. literal: as first published, see _centres(); movies then also has ``usable``, the frames that have a mean
    """
    steps = F.sequence(F.lit(-rounds), F.lit(rounds))
    tries = gaps(peaks, keys, t).join(wanted.select(*keys, "start"), keys)
    if literal:
        tries = tries.join(movies.select(*keys, "usable"), keys)
    else:
        tries = tries.where("p is not null and q is not null")
    tries = tries.select("*", F.explode(steps).alias("__step"))
    found = _centres(tries, [*keys, "__step"], F.col("start") + F.col("__step"), "usable" if literal else None)
    counts = wanted.select(*keys, "beats", F.explode(steps).alias("__step")).join(found.groupBy(*keys, "__step").agg(F.count("*").alias("__n")), [*keys, "__step"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)) + 2)
    first = F.max(F.when(F.col("__step") == 0, F.col("__n")))
    over, under = F.col("__n") > 1.2 * F.col("beats"), F.col("__n") < 0.8 * F.col("beats")
    grown, shrunk = F.min(F.when((F.col("__step") > 0) & ~over, F.col("__step"))), F.max(F.when((F.col("__step") < 0) & ~under, F.col("__step")))
    beats = F.first("beats")
    step = F.when(first > 1.2 * beats, F.coalesce(grown, F.lit(rounds))).when(first < 0.8 * beats, F.coalesce(shrunk, F.lit(-rounds))).otherwise(0)
    chosen = counts.groupBy(*keys).agg(step.alias("__step"))
    ends = movies.select(*keys, F.explode(F.array(F.lit(0).cast("long"), F.col("frames").cast("long"))).alias("border"))
    return found.join(chosen, [*keys, "__step"]).select(*keys, "border").unionByName(ends).distinct()


def register(peaks: DataFrame, found: DataFrame, keys: list[str], x: str, t: str) -> DataFrame:
    """keys, x, bin and frame of the last peak of each position between two borders."""
    return joins.last_in_bin(joins.bins(peaks.select(*keys, x, t), found, keys, t, "border"), [*keys, x], t)


def marks(registered: DataFrame, places: DataFrame, movies: DataFrame, keys: list[str], x: str, t: str, most_missing: int = 4, trusted: float = 0.15) -> DataFrame:
    """Direction marks: a row for each beat that enough positions saw.

    Columns: keys, bin, xpos_first, xpos_last, t_first, t_last, delta, direction (1 where the first position peaks later), slope (of
    positions, numbered in order, over frames), speed, rsq. places: keys, x; movies: keys, resolution, time_interval.

    Beats count that as many positions registered as the mean of the different counts. One pair of positions serves all
    beats of a recording: the first and the last that lack fewer than two of them, if some position lacks none. Else
    beats that more than ``most_missing`` positions lack go first; if still no position has all, the outermost positions are
    taken, and the slope decides where one of them lacks the beat (a negative one is direction 1). Where both peak at
    once, a slope whose rsq is over ``trusted`` decides, as published: a positive one is direction 1.
    """
    of = Window.partitionBy(*keys)
    ordered = Window.partitionBy(*keys).orderBy(x)
    numbered = places.select(*keys, x).distinct().withColumns({"__place": F.row_number().over(ordered).cast("long"), "__all": F.count("*").over(of)})
    rows = registered.join(numbered, [*keys, x])
    # the mean of the different counts of a recording: each count, divided among the rows that have it
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "bin"))).withColumn("__alike", F.count("*").over(Window.partitionBy(*keys, "__n")))
    usual = F.sum(F.col("__n") / F.col("__alike")).over(of) / F.round(F.sum(1 / F.col("__alike")).over(of), 0)
    # a hair of rounding must not drop a beat that has the mean itself
    rows = rows.withColumn("__kept", F.col("__n") >= usual - 1e-9)

    def judged(df: DataFrame, kept: Column, suffix: str) -> DataFrame:
        """How many beats are kept, and whether a position has them all."""
        df = df.withColumn(f"__bins{suffix}", F.coalesce(F.round(F.sum(F.when(kept, 1 / F.col("__n"))).over(of), 0), F.lit(0.0)))
        df = df.withColumn(f"__have{suffix}", F.count_if(kept).over(Window.partitionBy(*keys, "__place")))
        return df.withColumn(f"__whole{suffix}", F.max(F.col(f"__have{suffix}") == F.col(f"__bins{suffix}")).over(of))

    rows = judged(rows, F.col("__kept"), "1")
    rows = judged(rows.withColumn("__use", F.col("__kept") & (F.col("__whole1") | (F.col("__all") - F.col("__n") <= most_missing))), F.col("__use"), "2")
    few = F.col("__bins2") - F.col("__have2") < 2
    # a position without any peak lacks fewer than two beats only if there is but one
    outer = (F.col("__bins2") < 2) | ~F.col("__whole2")
    first = F.when(outer, 1).otherwise(F.min(F.when(few, F.col("__place"))).over(of))
    last = F.when(outer, F.col("__all")).otherwise(F.max(F.when(few, F.col("__place"))).over(of))
    rows = rows.withColumns({"__first": first, "__last": last}).where("__use")
    at = lambda c: F.max(F.when(F.col("__place") == F.col(c), F.col(t)))
    beats = rows.groupBy(*keys, "bin", "__first", "__last", "__whole2").agg(
        at("__first").alias("t_first"), at("__last").alias("t_last"), F.regr_slope("__place", t).alias("slope"), stats.adjusted_r2(F.col("__place"), F.col(t)).alias("rsq"),
    )
    column = lambda name, to: numbered.select(*keys, F.col("__place").alias(name), F.col(x).alias(to))
    beats = beats.join(column("__first", "xpos_first"), [*keys, "__first"]).join(column("__last", "xpos_last"), [*keys, "__last"]).join(movies.select(*keys, "resolution", "time_interval"), keys)
    delta = F.col("t_first") - F.col("t_last")
    by_time = F.when(delta.isNotNull(), (delta > 0).cast("int")).when(~F.col("__whole2") & (F.col("slope") != 0), (F.col("slope") < 0).cast("int"))
    direction = F.when((delta == 0) & (F.col("rsq") > trusted) & (F.col("slope") != 0), (F.col("slope") > 0).cast("int")).otherwise(by_time)
    speed = F.try_divide((F.col("xpos_last") - F.col("xpos_first")) * F.col("resolution"), delta * F.col("time_interval"))
    return beats.select(*keys, "bin", "xpos_first", "xpos_last", "t_first", "t_last", delta.alias("delta"), direction.alias("direction"), "slope", stats.finite(speed).alias("speed"), "rsq")


def beat_directions(profile: DataFrame, movies: DataFrame, keys: list[str], x: str, t: str, value: str, smooth: int = 10, reach: int = 10, rounds: int = 10, literal: bool = False) -> DataFrame:
    """marks() of recordings from the brightness of their positions (keys, x, t, value; a row for each frame, without gaps). movies: keys, frames, resolution, time_interval.

    A position that never peaks still counts as one. literal: see adaptive_borders()
    """
    peaks = profile_peaks(profile, keys, x, t, value, smooth, reach)
    places = profile.select(*keys, x).distinct()
    held = movies.withColumn("usable", F.col("frames") - (smooth - 1))
    found = adaptive_borders(peaks, held, keys, "frame", wanted(peaks, places, keys, x, "frame"), rounds, literal)
    return marks(register(peaks, found, keys, x, "frame"), places, movies, keys, x, "frame")


def movie_directions(columns: DataFrame, movies: DataFrame, keys: list[str], **how) -> DataFrame:
    """beat_directions() of movies from their image columns (keys, x, t, col). movies: keys, width, height, frames, resolution, time_interval, peaks (columns chosen before, or null)."""
    laid = movies.withColumn("places", positions(F.col("width"), F.col("peaks")))
    return beat_directions(stripes(columns, laid, keys), movies, keys, "xpos", "t", "profile", **how)


def summarise(found: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Share of anterograde beats, mean speeds by direction, and reversals."""
    s = Series(tuple(keys), (order,))
    stepped = series.steps(found, s, "direction")
    return stepped.groupBy(*keys).agg(
        F.try_divide(F.count_if(F.col("direction") == 1), F.count("direction")).alias("anterograde_percent"),
        F.avg(F.when(F.col("direction") == 1, F.col("speed"))).alias("anterograde_speed"),
        F.avg(F.when(F.col("direction") == 0, F.col("speed"))).alias("retrograde_speed"),
        series.reversals(s, "direction").alias("reversals"),
    )
