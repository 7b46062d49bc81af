"""Spans of regular expressions in whole texts, with DataFrame functions only.

A span is (kind, start, end, value); start and end count code points, end is exclusive. Patterns are
written without backtracking over long runs (possessive, and starting only where a run starts), so very
long words and digit runs stay linear; each finds what its plain form finds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:long,end:long,value:string>"
#: Of so many matches positions are summed one by one; longer lists are summed block by block.
_BLOCK = 128
_BLANKS = r"[\x20\x09-\x0D]+"


def none() -> Column:
    """No spans."""
    return F.expr(f"cast(array() as array<{SPAN}>)")


def matches(text: Column, kind: str, pattern: str, gate: Column | None = None, before: int = 0, start: str = "") -> Column:
    """All leftmost non-overlapping matches of ``pattern``, as an array of spans with ``before``, the text that leads to them.

    gate: where it is not true nothing is looked for; it must hold for every text with a match.
    before: how many words before a match are given, earlier matches included and runs of blanks as one blank; for
        patterns that match whole words only
    start: what stands before the text itself
    """
    # both lists are arguments, not used inside a lambda, where they would be made again for each element
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, gap: F.struct(gap.alias("gap"), v.alias("value")))
    spans = F.transform(_placed(pairs, before, start), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before")))
    none = F.expr("cast(array() as array<struct<kind:string,start:long,end:long,value:string,before:string>>)")
    return F.when(gate, spans).otherwise(none) if gate is not None else spans


def _placed(pairs: Column, before: int, start: str) -> Column:
    """start, end and text before of each pair (gap, value) that follow one another; the last pair has a gap only. Lists are built in blocks, as growing one long list copies it each time."""
    item = "struct<start:long,end:long,before:string,value:string>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit(start).alias("tail"), F.expr(f"cast(array() as array<{item}>)").alias("block"), F.expr(f"cast(array() as array<array<{item}>>)").alias("done"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        # it ends in a blank, so one field more than words is kept
        lead = F.substring_index(F.concat(acc["tail"], F.regexp_replace(x["gap"], _BLANKS, " ")), " ", -before - 1) if before else acc["tail"]
        tail = F.concat(lead, x["value"]) if before else acc["tail"]
        new = F.array(F.struct(start.alias("start"), end.alias("end"), lead.alias("before"), x["value"].alias("value")))
        full = F.size(acc["block"]) >= _BLOCK
        grown = F.struct(end.alias("at"), tail.alias("tail"), F.when(full, new).otherwise(F.concat(acc["block"], new)).alias("block"), F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"))
        return F.when(x["value"].isNull(), acc).otherwise(grown)

    return F.aggregate(pairs, first, add, lambda acc: F.concat(F.flatten(acc["done"]), acc["block"]))


def plain(spans: Column) -> Column:
    """Spans without the text before them."""
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def ordered(spans: Column, kinds: tuple[str, ...], kind_first: bool) -> Column:
    """Sorted by kind (as listed) and start, or by start and kind; then by end."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(*([rank(x).alias("k"), x["start"].alias("s")] if kind_first else [x["start"].alias("s"), rank(x).alias("k")]), x["end"].alias("e"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
