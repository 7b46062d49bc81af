"""Series of any length, dealt out in blocks of frames.

The operators of series.py and beats.py hold a series in one task. Here a series is cut into blocks of ``size`` frames. What looks
at neighbours gets a halo: rows of the next blocks within its reach. What carries a state from frame to frame (an open run, the kind of the
last turning point) is worked out in each block, and one row for each block hands the state on. Results equal the one-task forms.

Frames are numbered from 1 in column ``t``; numbered() makes such numbers without bringing a series together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import writers
from . import series
from .series import Series


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Rows numbered from 1 within each series, by ``order``, however long it is.

    Rows are dealt to ranges of (keys, order), numbered within each, and moved on by the rows of the ranges before: a row for each range and series.
    """
    ranged = writers.staged(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    local = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return local.join(sizes.drop("__n"), [*keys, "__part"]).withColumn(name, F.col("__before") + F.col("__i")).drop("__part", "__i", "__before")


@dataclass(frozen=True)
class Blocks:
    """keys: columns that name a series; t: its frame numbers, from 1; size: frames of a block."""

    keys: tuple[str, ...]
    t: str
    size: int = 1 << 16

    @property
    def series(self) -> Series:
        """The series of a block."""
        return Series((*self.keys, "__block"), (self.t,))

    def of(self, t: Column) -> Column:
        return F.floor((t - 1) / self.size)

    def laid(self, df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
        """Rows with ``__block``, and again for the blocks that look back ``before`` or ahead ``after`` frames to them; ``__own`` tells a block's own rows."""
        t = F.col(self.t)
        first, last = F.greatest(self.of(t - after), F.lit(0)), self.of(t + before)
        return df.withColumn("__block", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__block") == self.of(t))

    def own(self, df: DataFrame) -> DataFrame:
        return df.where("__own").drop("__own", "__block")

    def handed_on(self, rows: DataFrame, state: Column, name: str) -> DataFrame:
        """``state`` of the last row of the nearest block before that has rows, on the rows of each block (``__block``); null in the first."""
        each = rows.groupBy(*self.keys, "__block").agg(F.max_by(F.struct(state.alias("s")), F.col(self.t)).alias("__s"))
        passed = each.withColumn(name, F.lag("__s").over(Window.partitionBy(*self.keys).orderBy("__block"))["s"]).drop("__s")
        return rows.join(passed, [*self.keys, "__block"])

    def handed_back(self, rows: DataFrame, state: Column, name: str) -> DataFrame:
        """``state`` of the first row of the nearest block after that has rows."""
        each = rows.groupBy(*self.keys, "__block").agg(F.min_by(F.struct(state.alias("s")), F.col(self.t)).alias("__s"))
        passed = each.withColumn(name, F.lead("__s").over(Window.partitionBy(*self.keys).orderBy("__block"))["s"]).drop("__s")
        return rows.join(passed, [*self.keys, "__block"])


def with_windows(df: DataFrame, b: Blocks, before: int, after: int, **columns) -> DataFrame:
    """Adds columns that look at most ``before`` frames back and ``after`` ahead: each a function of the block's Series."""
    laid = b.laid(df, before, after)
    return b.own(laid.withColumns({name: f(b.series) for name, f in columns.items()}))


def forward_threshold(df: DataFrame, b: Blocks, x: str, width: int = 400, tail: int = 6) -> DataFrame:
    """series.forward_threshold() in blocks."""
    n = df.groupBy(*b.keys).agg(F.count("*").alias("__n")).withColumn("__w", F.when(F.col("__n") >= width, F.lit(width)).otherwise(F.greatest(F.lit(1), F.floor(F.col("__n") / 3).cast("int"))))
    laid = b.laid(df, after=width - 1).join(n, list(b.keys)).withColumn("__at", 2 * width * F.col(b.t) / F.col("__w"))
    ahead = Window.partitionBy(*b.keys, "__block").orderBy(F.desc("__at")).rangeBetween(1 - 2 * width, 0)
    means = b.own(laid.withColumn("__mean", F.avg(x).over(ahead)))
    real = F.col("__n") - F.col("__w") + 1
    late = means.where(F.col(b.t).between(real - tail + 1, real)).groupBy(*b.keys).agg(F.median("__mean").alias("__tail"))
    return means.join(late, list(b.keys)).withColumn("threshold", F.when(F.col(b.t) < real, F.col("__mean")).otherwise(F.col("__tail"))).drop("__n", "__w", "__at", "__mean", "__tail")


def turning_points(df: DataFrame, b: Blocks, x: str, width: int = 400) -> DataFrame:
    """beats.turning_points() in blocks: only the kind of the last point goes from block to block."""
    marked = with_windows(forward_threshold(df, b, x, width), b, 1, 1, __p=lambda s: series.local_extrema(s, x), __v=lambda s: series.local_extrema(s, x, valleys=True))
    kind = F.when(F.col("__p") & (F.col(x) > F.col("threshold")), "P").when(F.col("__v") & (F.col(x) < F.col("threshold")), "V")
    points = marked.withColumns({"kind": kind, "place": F.col(b.t), "__block": b.of(F.col(b.t))}).where("kind is not null").drop("__p", "__v")
    before = b.handed_on(points, F.col("kind"), "__was")
    last = F.coalesce(b.series.lag("kind"), F.col("__was"))
    return before.withColumn("__again", (F.col("kind") == "P") & F.coalesce(last == "P", F.lit(False))).where("not __again").drop("__again", "__was", "__block")


def find_beats(points: DataFrame, b: Blocks, x: str, t: str) -> DataFrame:
    """beats.find_beats() in blocks: neighbouring points across a seam are handed on and back, and beats are numbered by blocks."""
    whole = F.struct(F.col("kind").alias("kind"), F.col(t).alias("t"), F.col(x).alias("x"), F.col("place").alias("place"))
    rows = points.withColumn("__block", b.of(F.col(b.t))).withColumn("__me", whole)
    rows = b.handed_back(b.handed_on(rows, F.col("__me"), "__on"), F.col("__me"), "__back")
    near = rows.select(*b.keys, "__block", b.t, "__me", F.coalesce(b.series.lag("__me"), F.col("__on")).alias("__a"), F.coalesce(b.series.lead("__me"), F.col("__back")).alias("__z"))
    found = near.where("__me.kind = 'P' and __a.kind = 'V' and __z.kind = 'V'").withColumn("__i", F.row_number().over(b.series.w))
    before = Window.partitionBy(*b.keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy(*b.keys, "__block").agg(F.count("*").alias("__k")).withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    return found.join(sizes, [*b.keys, "__block"]).select(
        *b.keys, (F.col("__before") + F.col("__i")).alias("beat"), F.col("__a.t").alias("start"), F.col("__me.t").alias("peak"), F.col("__z.t").alias("end"), F.col("__a.x").alias("start_x"), F.col("__me.x").alias("peak_x"), F.col("__z.x").alias("end_x"),
        F.col("__a.place").alias("start_place"), F.col("__me.place").alias("peak_place"), F.col("__z.place").alias("end_place"),
    )


def islands(df: DataFrame, b: Blocks, flag: Column) -> DataFrame:
    """series.islands() in blocks: runs of each block, and those that touch a seam put together."""
    rows = df.select(*b.keys, F.col(b.t).alias("__t"), b.of(F.col(b.t)).alias("__block"), flag.alias("__f")).where("__f")
    order = Window.partitionBy(*b.keys, "__block").orderBy("__t")
    runs = rows.withColumn("__g", F.col("__t") - F.row_number().over(order)).groupBy(*b.keys, "__block", "__g").agg(F.min("__t").alias("first"), F.max("__t").alias("last"))
    touches = ((F.col("first") - 1) % b.size == 0) | (F.col("last") % b.size == 0)
    seam = Window.partitionBy(*b.keys).orderBy("first")  # two runs of a block at most
    new = F.coalesce(F.lag("last").over(seam) + 1 != F.col("first"), F.lit(True)).cast("int")
    chained = runs.where(touches).withColumn("__new", new).withColumn("__chain", F.sum("__new").over(seam))
    joined = chained.groupBy(*b.keys, "__chain").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__chain")
    found = runs.where(~touches).select(*b.keys, "first", "last").unionByName(joined)
    return found.withColumns({"n": F.col("last") - F.col("first") + 1, "centre": F.bround((F.col("first") + F.col("last")) / 2, 0).cast("long")})
