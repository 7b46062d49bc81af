"""Exact order statistics of groups of any size, by rank selection.

A median needs the values in order, and the built-in exact percentile keeps every different value of a group in one
place. Where a group is too large for that, ranks are counted instead: an approximate quantile grid gives a range of values that
holds the wanted rank, the rows below and inside it are counted exactly, and the range is narrowed until few enough rows are
inside (or one value fills it). Only these rows are ever brought together. Each round is one aggregation with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import writers

#: Steps of the grid, and one over the error of its ranks.
_GRID, _ACCURACY = 128, 10_000


def _value(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other, keys) if keys else df.crossJoin(F.broadcast(other))  # one row


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], most: int = 1_000_000) -> DataFrame:
    """keys and a column for each name in ``wanted`` (name: column and share): the quantile between the two nearest values (type 7).

    NaN and infinities count as nulls; a group without a value has null. most: how many values of a group one task may bring together; larger groups
    are narrowed by rounds, which end after about log(size / most) / log(40) of them
    """
    columns = sorted({c for c, _ in wanted.values()})
    base = df.select(*keys, *(_value(c).alias(f"__v{k}") for k, c in enumerate(columns)))
    value = {name: f"__v{columns.index(c)}" for name, (c, _) in wanted.items()}
    counted = base.groupBy(*keys).agg(F.count("*").alias("__n"))
    if (counted.agg(F.max("__n").alias("n")).first()["n"] or 0) <= most:
        return base.groupBy(*keys).agg(*(F.percentile(value[name], F.lit(q)).alias(name) for name, (_, q) in wanted.items()))

    # each quantile lies between two ranks, which are looked for one by one
    sides = {f"{name}{side}": (value[name], q, side) for name, (_, q) in wanted.items() for side in ("<", ">")}
    unknown = F.lit(None).cast("double")
    ranges = base.groupBy(*keys).agg(*(_seen(F.col(v), q, side, F.count(v), unknown, unknown).alias(name) for name, (v, q, side) in sides.items()))
    while True:
        ranges = writers.staged(ranges)
        left = F.greatest(*(F.max(F.when(F.col(f"{name}.found").isNull(), F.col(f"{name}.inside"))) for name in sides), F.lit(0).cast("long"))
        if (ranges.agg(left.alias("n")).first()["n"] or 0) <= most:
            break
        rows = _beside(base, ranges.select(*keys, *(_narrow(F.col(name), most).alias(name) for name in sides)), keys)
        ranges = rows.groupBy(*keys).agg(*(_seen(F.col(v), q, side, F.first(F.col(f"{name}.n")), F.col(f"{name}.lo"), F.col(f"{name}.hi"), F.col(f"{name}.found")).alias(name) for name, (v, q, side) in sides.items()))
    known = ranges.select(*keys, *(F.struct(*(F.col(f"{name}.{p}").alias(p) for p in ("n", "rank", "lo", "hi", "under", "found"))).alias(name) for name in sides))
    rows = _beside(base, known, keys)
    held = [F.struct(F.first(name).alias("b"), F.sort_array(F.collect_list(F.when(F.col(f"{name}.found").isNull() & _between(F.col(v), F.col(f"{name}.lo"), F.col(f"{name}.hi")), F.col(v)))).alias("x")).alias(name) for name, (v, _, _) in sides.items()]
    found = rows.groupBy(*keys).agg(*held)

    def quantile(name: str, q: float) -> Column:
        at = (F.col(f"{name}<.b.n") - 1) * F.lit(q)
        low, high = _picked(F.col(f"{name}<")), _picked(F.col(f"{name}>"))
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*keys, *(quantile(name, q).alias(name) for name, (_, q) in wanted.items()))


def _between(x: Column, lo: Column, hi: Column) -> Column:
    """Strictly inside a range whose ends may be unknown."""
    return x.isNotNull() & (lo.isNull() | (x > lo)) & (hi.isNull() | (x < hi))


def _seen(x: Column, q: float, side: str, n: Column, lo: Column, hi: Column, found: Column | None = None) -> Column:
    """An aggregate: of a rank and a range (lo, hi) whose ends are values or unknown, how many values lie at or under lo, and a grid of those inside; the rank's value where it is one of the ends."""
    at = (n - 1) * F.lit(q)
    rank = (F.floor(at) if side == "<" else F.ceil(at)) + 1
    first = (lambda c: F.first(c)) if found is not None else (lambda c: c)
    inside = _between(x, lo, hi)
    below, under, among = F.count_if(x < lo), F.count_if(x <= lo), F.count_if(inside)
    upto = F.count_if(x <= hi)
    end = F.when((rank > below) & (rank <= under), first(lo)).when((rank > under + among) & (rank <= upto), first(hi))
    held = F.when(inside, x)
    return F.struct(
        n.alias("n"), rank.cast("long").alias("rank"), first(lo).alias("lo"), first(hi).alias("hi"), under.alias("under"), among.alias("inside"), F.min(held).alias("least"), F.max(held).alias("most"),
        F.percentile_approx(held, [k / _GRID for k in range(_GRID + 1)], _ACCURACY).alias("grid"), (F.coalesce(first(found), end) if found is not None else F.lit(None).cast("double")).alias("found"),
    )


def _narrow(b: Column, most: int) -> Column:
    """The range between the grid's steps around the rank, wider by one step and the grid's error; one that is small enough stays. Its ends are values inside, so at least these are settled."""
    at = (b["rank"] - b["under"]) / b["inside"] * _GRID
    spare = 1 + _GRID * 2 / _ACCURACY
    first, last = F.floor(at - spare).cast("int"), F.ceil(at + spare).cast("int")
    stays = b["found"].isNotNull() | (b["inside"] <= most)
    lo = F.when(stays, b["lo"]).when(first <= 0, b["least"]).otherwise(F.get(b["grid"], first))
    hi = F.when(stays, b["hi"]).when(last >= _GRID, b["most"]).otherwise(F.get(b["grid"], last))
    return F.struct(b["n"].alias("n"), lo.alias("lo"), hi.alias("hi"), b["found"].alias("found"))


def _picked(g: Column) -> Column:
    b, x = g["b"], g["x"]
    place = b["rank"] - b["under"]
    missed = F.raise_error(F.lit("a rank lies outside the range that was chosen for it")).cast("double")
    return F.when(b["n"] > 0, F.when(b["found"].isNotNull(), b["found"]).when((place > 0) & (place <= F.size(x)), F.get(x, (place - 1).cast("int"))).otherwise(missed))
