"""Line dedup by distinct-site spread.

Each line is hashed; HyperLogLog sketches of the sites that hold it merge by aggregation. Lines whose
estimate is clearly at or over the threshold are boilerplate, lines near it get an exact distinct count,
and boilerplate lines are removed from every document.

A line counts without the white space around it; lines without a word are never removed. Edge cases: a
null text stays null and an empty one empty; a null source is a site of its own; repeated rows have the
same site; a document of boilerplate only keeps its row with an empty text; an empty table gives an empty
result; very long texts are split like others; other columns are handed on whatever their names, but for
n_lines and n_removed, which remove() overwrites if it is to count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

_BLANK = " \t\n\x0b\x0c\r"


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """96 bits of hash of a line; null for a line without a word."""
    bare = F.trim(line, F.lit(_BLANK))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h1"), F.hash(bare).alias("h2")))


def _site_lines(docs: DataFrame) -> DataFrame:
    """h1, h2 and site of each different line of a document."""
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.explode(F.array_distinct(F.transform(_split(F.col("text")), _key))).alias("k"))
    return rows.where("k is not null").select("k.h1", "k.h2", "site")


def boilerplate(docs: DataFrame, least_sites: int = 10, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """h1, h2 of the lines that at least ``least_sites`` sites hold.

    lg_k: the sketches have 2 ** lg_k registers, so their standard error is 1.04 / 2 ** (lg_k / 2)
    band: estimates within this share of the threshold are counted exactly; many standard errors wide
    """
    lines = _site_lines(docs)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sites"))
    spread = kit.stage(sketched.select("h1", "h2", F.hll_sketch_estimate("sites").alias("estimate")).where(F.col("estimate") >= least_sites * (1 - band)))
    sure, near = spread.where(F.col("estimate") > least_sites * (1 + band)), spread.where(F.col("estimate") <= least_sites * (1 + band))
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= least_sites)
    return sure.select("h1", "h2").unionByName(exact.select("h1", "h2"))


def remove(docs: DataFrame, counts: bool = True, **how) -> DataFrame:
    """The rows and columns of ``docs`` with boilerplate lines gone from ``text``; with ``counts`` also n_lines (with a word) and n_removed. ``how``: the parameters of boilerplate()."""
    found = kit.stage(boilerplate(docs, **how))
    lines = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.transform(_split(F.col("text")), _key))).alias("k")).where("k is not null").select("id", "k.h1", "k.h2")
    of_doc = lines.join(found, ["h1", "h2"]).groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    # a row travels as one struct, so that no column of it clashes with those made here
    own = lambda c: F.col("row").getField(c)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    held = rows.join(of_doc, own("doc_id").eqNullSafe(of_doc["id"]), "left").select("row", "gone")
    kept = F.filter(_split(own("text")), lambda x: ~F.coalesce(F.array_contains(F.col("gone"), _key(x)), F.lit(False)))
    text = F.when(F.col("gone").isNull(), own("text")).otherwise(F.array_join(kept, "\n"))
    words = lambda c: F.coalesce(F.size(F.filter(_split(F.coalesce(c, F.lit(""))), lambda x: F.trim(x, F.lit(_BLANK)) != "")), F.lit(0)).cast("long")
    full = held.select("row", text.alias("kept"))
    names = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    more = [words(own("text")).alias("n_lines"), (words(own("text")) - words(F.col("kept"))).alias("n_removed")] if counts else []
    return full.select(*((F.col("kept") if c == "text" else own(c)).alias(c) for c in names), *more)
