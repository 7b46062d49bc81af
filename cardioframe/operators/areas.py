"""Bright areas of a heart along its length, and the positions at which kymographs are cut.

A movie's pixels vary where the heart's wall moves. Columns that vary more than the mean are bright; where a window of
columns is bright by exactly half, a border lies; borders two by two enclose the areas in which peaks are looked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import series
from .series import Series


def column_profile(sd: DataFrame, keys: list[str], value: str = "sd", q: float = 0.75) -> DataFrame:
    """keys, x, total and area of each image column: sum and trapezoid integral of what lies at or over the quantile of the movie; the rest counts as 0.

    sd: keys, x, y, value in long form (one row for each pixel, y without gaps). Values are scaled by the movie's largest.
    """
    limit = sd.groupBy(*keys).agg(stats.quantile(F.col(value), q).alias("__q"), F.max(value).alias("__top"))
    kept = F.when(F.col(value) < F.col("__q"), 0.0).otherwise(F.try_divide(F.col(value), F.col("__top")))
    each = sd.join(limit, keys).select(*keys, "x", "y", kept.alias("__v"))
    found = each.groupBy(*keys, "x").agg(F.sum("__v").alias("total"), F.min_by("__v", "y").alias("__a"), F.max_by("__v", "y").alias("__z"), F.count("*").alias("__n"))
    # a trapezoid of unit spacing leaves out half of both ends; a single row has no area
    return found.select(*keys, "x", "total", F.when(F.col("__n") > 1, F.col("total") - (F.col("__a") + F.col("__z")) / 2).otherwise(0.0).alias("area"))


def borders(profile: DataFrame, keys: list[str], x: str, value: str, window: int = 30) -> DataFrame:
    """keys, place (its number among borders), border: columns from which on half of ``window`` columns are bright; in a movie that begins bright the first column comes before them.

    The last column stands in for those that a window lacks. A movie begins as its first column does, or, if the columns
    up to the first border are not all alike, as that border's column.
    """
    s = Series(tuple(keys), (x,))
    lit = profile.withColumn("__b", (F.col(value) >= F.avg(value).over(s.whole)).cast("int"))
    ahead = s.rows(0, window - 1)
    end = s.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.sum("__b").over(ahead) + (window - F.count("*").over(ahead)) * F.last("__b").over(end)
    marked = lit.withColumns({"__edge": 2 * inside == window, "__rn": s.number()})
    # columns up to a border: those before it and its own
    marked = marked.withColumns({"__low": F.min("__b").over(s.rows(Window.unboundedPreceding, 0)), "__high": F.max("__b").over(s.rows(Window.unboundedPreceding, 0)), "__begin": F.first("__b").over(end)})
    edges = marked.where("__edge").withColumn("place", F.row_number().over(s.w))
    bright = F.when(F.col("__low") == F.col("__high"), F.col("__begin")).otherwise(F.col("__b")) == 1
    starts = edges.where("place = 1").select(*keys, bright.alias("__bright"))
    first = profile.groupBy(*keys).agg(F.min(x).alias("border")).join(starts.where("__bright"), keys).select(*keys, F.lit(1).alias("place"), "border")
    moved = edges.join(starts, keys).select(*keys, (F.col("place") + F.col("__bright").cast("int")).alias("place"), F.col(x).alias("border"))
    return first.unionByName(moved)


def bright_areas(found: DataFrame, keys: list[str], least: int = 60) -> DataFrame:
    """keys, area, first, last: the first pair of borders that is ``least`` wide (area 1) and the pair after it, however wide (area 2).

    Borders are taken two by two; narrow pairs before the first wide one are passed over, and a movie whose borders
    run out has no area.
    """
    pairs = found.groupBy(*keys, F.floor((F.col("place") - 1) / 2).alias("__pair")).agg(F.min("border").alias("first"), F.max("border").alias("last"), F.count("*").alias("__n")).where("__n = 2")
    wide = F.min(F.when(F.col("last") - F.col("first") >= least, F.col("__pair"))).over(Window.partitionBy(*keys))
    out = pairs.withColumn("area", (F.col("__pair") - wide + 1).cast("int"))
    return out.where(F.col("area").between(1, 2)).select(*keys, "area", "first", "last")


def kymograph_positions(profile: DataFrame, areas: DataFrame, keys: list[str], x: str, value: str, reach: int = 3, most: int = 3, q: float = 0.75) -> DataFrame:
    """keys, peak_no, xpos: columns of the largest ``most`` peaks of each area, brighter ones first, those of area 1 before those of area 2.

    Values under an area's quantile count as that quantile. Of peaks that are equally bright the first stands for all. As published a
    position is one column behind its peak, and never behind the last column of the image; equal positions count once.
    """
    profile = profile.select(*keys, x, F.col(value).alias("__value"))
    inside = profile.join(areas, keys).where(F.col(x).between(F.col("first"), F.col("last")))
    s = Series((*keys, "area"), (x,))
    clamped = inside.withColumn("__q", F.percentile("__value", F.lit(q)).over(s.whole)).withColumn("__v", F.greatest("__value", "__q"))
    peaks = clamped.withColumn("__p", series.window_peaks(s, "__v", reach)).where("__p")
    ranked = peaks.withColumn("__k", F.row_number().over(s.whole.orderBy(F.desc("__v"), x))).where(F.col("__k") <= most)
    first = ranked.groupBy(*keys, "area", "__v").agg(F.min(x).alias("__x"))
    width = profile.groupBy(*keys).agg(F.max(x).alias("__last"))
    placed = first.join(width, keys).withColumn("xpos", F.least(F.col("__x") + 1, F.col("__last"))).groupBy(*keys, "xpos").agg(F.min(F.struct("area", (-F.col("__v")).alias("v"))).alias("__o"))
    return placed.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("__o", "xpos")).alias("peak_no"), "xpos")


def kymographs(stack: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, peak_no, xpos, t, col: the columns of movies at their positions.

    stack: keys, t, x, col. Where it is a table in folders by x (writers.stack()), the positions choose the folders before they are read: the
    condition that they lie inside the image, which all do, is what lets Spark look for their folders at run time.
    """
    chosen = positions.where("xpos >= 1").select(*keys, "peak_no", F.col("xpos").alias("x"))
    return stack.join(chosen, [*keys, "x"]).select(*keys, "peak_no", F.col("x").alias("xpos"), "t", "col")
