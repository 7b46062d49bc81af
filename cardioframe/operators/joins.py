"""Joins whose meaning differs from a plain one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def lookup(facts: DataFrame, dim: DataFrame, key: str, order: list) -> DataFrame:
    """A dictionary join: each row meets the first row of its key and never multiplies. Small dimensions are broadcast by Spark's own size check."""
    return facts.join(first_per_key(dim, [key], order), key, "left")


def unfinished(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose output is not there yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def members(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def rescue(all_traces: DataFrame, quality: str, key: str) -> DataFrame:
    """Good traces of movies that have no excellent one."""
    excellent = all_traces.where(F.col(quality) == "excellent").select(key)
    return all_traces.where(F.col(quality) == "good").join(excellent, key, "left_anti")


def bins(points: DataFrame, borders: DataFrame, keys: list[str], at: str, border: str) -> DataFrame:
    """Points with the bin [border, next border) they fall into, by one ordered pass over both.

    Borders and points are laid in one series, so that no point meets every border: a point lies behind the
    last border at or before it. The last border closes the last bin and opens none.
    """
    order = Window.partitionBy(*keys).orderBy(border)
    opened = borders.select(*keys, F.col(border).alias("__at"), F.row_number().over(order).alias("__bin"), F.lead(border).over(order).alias("__next"))
    both = points.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*(c for c in points.columns if c not in keys)).alias("__row"))
    both = both.unionByName(opened.select(*keys, "__at", F.lit(0).alias("__side"), "__bin", "__next"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumns({"bin": F.last("__bin", ignorenulls=True).over(w), "__end": F.last(F.when(F.col("__side") == 0, F.struct("__next"))  , ignorenulls=True).over(w)["__next"]})
    return held.where("__side = 1 and bin is not null and __end is not null").select(*keys, "__row.*", "bin")


def last_in_bin(binned: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Where several points fall into one bin, the last stays."""
    return binned.groupBy(*keys, "bin").agg(F.max(at).alias(at))


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Each row beside a one-row aggregate."""
    return df.crossJoin(F.broadcast(one_row))


def coalesced(df: DataFrame, name: str, *choices: Column) -> DataFrame:
    return df.withColumn(name, F.coalesce(*choices))
