"""Ordered-series operators: a table, the keys of its series, their order and a value column.

All take the same window, so operators that are chained share one exchange and one sort. A series lies in
one task: recordings have thousands of frames, not billions, and there are many of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """keys: columns that name a series; order: columns that order it without ties."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self):
        return Window.partitionBy(*self.keys)

    def rows(self, start: int, end: int):
        return self.w.rowsBetween(start, end)

    def lag(self, c, k: int = 1) -> Column:
        return F.lag(c, k).over(self.w)

    def lead(self, c, k: int = 1) -> Column:
        return F.lead(c, k).over(self.w)

    def number(self) -> Column:
        return F.row_number().over(self.w)

    def size(self) -> Column:
        return F.count("*").over(self.whole)


def local_extrema(s: Series, x: str, valleys: bool = False) -> Column:
    """True where the slope's sign falls (rises, for valleys); both shoulders of a plateau count, ends don't."""
    v = -F.col(x) if valleys else F.col(x)
    return F.coalesce(F.signum(s.lead(v) - v) - F.signum(v - s.lag(v)) < 0, F.lit(False))


def window_peaks(s: Series, x: str, m: int) -> Column:
    """Local maxima that no value within m places on either side exceeds."""
    v = F.col(x)
    tops = (v >= F.max(v).over(s.rows(-m, -1))) & (v >= F.max(v).over(s.rows(1, m)))
    return F.coalesce(local_extrema(s, x) & tops, F.lit(False))


def rolling_mean(s: Series, x: str, width: int) -> Column:
    """The mean of a value and the width - 1 after it; null where fewer are left."""
    frame = s.rows(0, width - 1)
    return F.when(F.count(x).over(frame) == width, F.avg(x).over(frame))


def rolling_median(s: Series, x: str, width: int) -> Column:
    """The median of a value and the width - 1 after it; the last value stands in for those that are missing, as if it were repeated."""
    last = F.last(x).over(s.whole.orderBy(*s.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    frame = s.rows(0, width - 1)
    values = F.collect_list(x).over(frame)
    full = F.sort_array(F.concat(values, F.array_repeat(last, F.greatest(F.lit(0), width - F.size(values)))))
    low, high = (width - 1) // 2 + 1, width // 2 + 1
    return (F.element_at(full, low) + F.element_at(full, high)) / 2


def forward_threshold(df: DataFrame, s: Series, x: str, width: int = 400, tail: int = 6) -> DataFrame:
    """Adds ``threshold``: the mean of the ``width`` values from each place on (a third of the series, if it is shorter than that).

    The last place with a whole window and those after it take the median of the last ``tail`` means. Values are added from the last one of a
    window back: where a value equals its mean but for rounding, the order of the sum decides which of them is over the other.
    """
    n, rn = s.size(), s.number()
    wide = F.when(n >= width, F.lit(width)).otherwise(F.greatest(F.lit(1), F.floor(n / 3).cast("int")))
    out = df.withColumns({"__n": n, "__rn": rn, "__w": wide}).withColumn("__at", 2 * width * F.col("__rn") / F.col("__w"))
    # counted in windows (of 2 * width units each), all series look just under one window ahead, though their widths differ
    ahead = Window.partitionBy(*s.keys).orderBy(F.desc("__at")).rangeBetween(1 - 2 * width, 0)
    real = F.col("__n") - F.col("__w") + 1
    out = out.withColumn("__mean", F.avg(x).over(ahead))
    late = F.when(F.col("__rn").between(real - tail + 1, real), F.col("__mean"))
    out = out.withColumn("__tail", F.median(late).over(s.whole)).withColumn("threshold", F.when(F.col("__rn") < real, F.col("__mean")).otherwise(F.col("__tail")))
    return out.drop("__n", "__rn", "__w", "__at", "__mean", "__tail")


def count_ahead(s: Series, flag: Column, width: int) -> Column:
    """How many flagged places lie in the width + 1 places from each one on."""
    return F.count_if(flag).over(s.rows(0, width))


def islands(df: DataFrame, s: Series, flag: Column) -> DataFrame:
    """The runs of flagged places: keys, first and last place, their number and the rounded centre."""
    marked = df.select(*s.keys, s.number().alias("__rn"), flag.alias("__f"))
    order = Window.partitionBy(*s.keys).orderBy("__rn")
    runs = marked.where("__f").withColumn("__g", F.col("__rn") - F.row_number().over(order))
    found = runs.groupBy(*s.keys, "__g").agg(F.min("__rn").alias("first"), F.max("__rn").alias("last"), F.count("*").alias("n"))
    return found.drop("__g").withColumn("centre", F.bround((F.col("first") + F.col("last")) / 2, 0).cast("long"))


def run_lengths(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Runs of equal values: their value, length and running end."""
    marked = df.withColumn("__new", F.when(F.coalesce(F.col(value) != s.lag(value), F.lit(True)), 1).otherwise(0)).withColumn("__rn", s.number())
    numbered = marked.withColumn("run", F.sum("__new").over(s.w))
    return numbered.groupBy(*s.keys, "run").agg(F.first(value).alias("value"), F.count("*").alias("length"), F.max("__rn").alias("end"))


def min_max(s: Series, x: str) -> Column:
    low, high = F.min(x).over(s.whole), F.max(x).over(s.whole)
    return F.try_divide(F.col(x) - low, high - low)


def share_of_max(s: Series, x: str) -> Column:
    return F.try_divide(F.col(x), F.max(x).over(s.whole))


def flipped(x: Column) -> Column:
    return 1 - x


def top(df: DataFrame, s: Series, x: str, n: int) -> DataFrame:
    """The n largest values of each series with their rank; earlier places win ties."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*s.keys).orderBy(F.desc(x), *s.order)))
    return ranked.where(F.col("rank") <= n)


def trapezoid(s: Series, x: str) -> Column:
    """The part of an integral, with unit spacing, between a place and the next; its sum is the integral."""
    return (F.col(x) + s.lead(x)) / 2


def reversals(s: Series, direction: str, literal: bool = False):
    """An aggregate over rows with ``__step`` = |difference of directions| (from steps()).

    literal: as first published, null without a difference and 0 unless steps of 0 and 1 both occur.
    """
    turned = F.sum(F.when(F.col("__step") != 0, 1).otherwise(0))
    if not literal:
        return turned
    kinds = F.count_distinct("__step")
    return F.when(kinds == 0, None).when(kinds == 1, 0).otherwise(turned)


def steps(df: DataFrame, s: Series, direction: str) -> DataFrame:
    return df.withColumn("__step", F.abs(F.col(direction) - s.lag(direction)))


def first_crossing(x: str, t: str, level: float, after: Column | None = None) -> Column:
    """An aggregate: the first time the value is over a level, of the rows for which ``after`` holds."""
    over = F.col(x) > level
    return F.min(F.when(over & after if after is not None else over, F.col(t)))


def first_below(x: str, t: str, level: float, after: Column) -> Column:
    """An aggregate: the first time the value is under a level, of the rows for which ``after`` holds."""
    return F.min(F.when((F.col(x) < level) & after, F.col(t)))


def nth_over_mean(df: DataFrame, s: Series, x: str, n: int) -> DataFrame:
    """keys and the place of the n-th value over the mean of its series."""
    over = df.select(*s.keys, s.number().alias("place"), F.col(x).alias("__x"), F.avg(x).over(s.whole).alias("__m")).where("__x > __m")
    ranked = over.withColumn("__k", F.row_number().over(Window.partitionBy(*s.keys).orderBy("place")))
    return ranked.where(F.col("__k") == n).select(*s.keys, "place")
