"""Statistics as column expressions; grouping is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order

#: Makes the median absolute deviation agree with the standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def quantile(x: Column, q: float) -> Column:
    """Interpolated between the two nearest values (type 7), exact."""
    return F.percentile(x, F.lit(q))


def arrhythmia_index(period: Column) -> Column:
    return F.try_divide(F.stddev_samp(period), F.median(period))


def adjusted_r2(y: Column, x: Column) -> Column:
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return 1 - F.try_divide((1 - F.regr_r2(y, x)) * (n - 1), n - 2)


def correlation(x: Column, y: Column) -> Column:
    """Of the rows that have both; null where one of them never changes, for which the built-in one raises an error."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def fractional_shortening(edd: Column, esd: Column) -> Column:
    return F.try_divide(edd - esd, edd)


def stroke_volume(edd: Column, esd: Column) -> Column:
    return F.lit(3.141592653589793) / 4 * (edd * edd - esd * esd)


def rmse(model: Column, seen: Column) -> Column:
    return F.sqrt(F.avg((model - seen) * (model - seen)))


def finite(x: Column) -> Column:
    """NaN and infinities become null: aggregates here leave out nulls only."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def mad(df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_mad", most: int = 1_000_000) -> DataFrame:
    """Scaled median absolute deviation of each column within the groups of ``keys``; see order.quantiles() for ``most``."""
    middle = order.quantiles(df, keys, {f"__m_{c}": (c, 0.5) for c in columns}, most)
    away = df.join(middle, keys).select(*keys, *(F.abs(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in columns))
    spread = order.quantiles(away, keys, {f"{c}{suffix}": (c, 0.5) for c in columns}, most)
    return spread.select(*keys, *((F.lit(MAD_SCALE) * F.col(f"{c}{suffix}")).alias(f"{c}{suffix}") for c in columns))


def median_and_sd(df: DataFrame, keys: list[str], columns: list[str], most: int = 1_000_000) -> DataFrame:
    """``<c>_median`` and ``<c>_sd`` of each column; see order.quantiles() for ``most``."""
    middle = order.quantiles(df, keys, {f"{c}_median": (c, 0.5) for c in columns}, most)
    spread = df.groupBy(*keys).agg(*(F.stddev_samp(c).alias(f"{c}_sd") for c in columns))
    return middle.join(spread, keys).select(*keys, *(f"{c}_{name}" for c in columns for name in ("median", "sd")))
