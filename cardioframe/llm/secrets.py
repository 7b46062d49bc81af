"""Secret scans: base patterns, and how many repositories and owners hold each candidate.

Every candidate value is hashed and counted over the whole corpus: a document stands for a repository and
its source for the owner. A value that many owners hold, or many repositories of one owner, is an example
that is copied; one that few of both hold looks live, and its span is added as ``live``. Candidates are the
values of base spans and long tokens of mixed letters and digits.

Edge cases: a null or empty text has no spans; repeated rows count as one repository; a null source is one
owner of its own; an empty table gives an empty result; very long texts are searched whole, by patterns that
don't backtrack; of other columns only source is read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit, spans

KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: A long run of the letters of base64 and URLs.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"


def _assigned(value: Column) -> Column:
    """What an assignment gives: all after the first separator, without blanks and a quote."""
    return F.regexp_extract(value, r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)


def base_spans(text: Column) -> Column:
    """The base spans of a text that is not null, by start and kind."""
    assign = F.filter(spans.matches(text, "assign", ASSIGN, text.rlike("[:=]")), lambda x: F.length(_assigned(x["value"])) >= 6)
    access = F.filter(spans.matches(text, "access", ACCESS, F.contains(text, F.lit("AKIA"))), lambda x: F.length(x["value"]) >= 20)
    found = F.concat(*(spans.plain(x) for x in (assign, access, spans.matches(text, "hex", HEX, text.rlike("[0-9a-f]{24}")))))
    return spans.ordered(found, KINDS, kind_first=False)


def _candidates(text: Column, base: Column) -> Column:
    """start, end and value of what may be a secret: one for each value and place."""
    at = lambda start, end, value: F.struct(start.alias("start"), end.alias("end"), value.alias("value"))
    of_base = F.transform(base, lambda x: F.when(x["kind"] == "assign", at(x["end"] - F.length(_assigned(x["value"])), x["end"], _assigned(x["value"]))).otherwise(at(x["start"], x["end"], x["value"])))
    long = F.filter(spans.matches(text, "token", TOKEN, text.rlike("[A-Za-z0-9+/_=-]{20}")), lambda x: x["value"].rlike("[0-9].*[0-9].*[0-9]") & x["value"].rlike("[A-Za-z].*[A-Za-z]"))
    return F.array_distinct(F.concat(of_base, F.transform(long, lambda x: at(x["start"], x["end"], x["value"]))))


def find(docs: DataFrame, most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """doc_id, base, spans, n_live, n_example and candidates (start, end, value, repositories and owners that hold the value, example).

    A value is an example if over ``most_owners`` owners hold it, or over ``most_repositories`` repositories of one owner.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = kit.base_columns(docs, F.col("source").cast("string").alias("owner")).select("doc_id", "owner", text.alias("text"))
    rows = rows.select("doc_id", "owner", "text", base_spans(F.col("text")).alias("base"))
    seen = kit.stage(rows.select("doc_id", "owner", "base", _candidates(F.col("text"), F.col("base")).alias("c")).withColumn("row", F.monotonically_increasing_id()))
    each = seen.select("row", "doc_id", "owner", F.explode("c").alias("c")).select("row", "doc_id", "owner", "c.*", F.sha2("c.value", 256).alias("hash"))
    by_owner = each.groupBy("hash", "owner", "doc_id").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    spread = by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.max("repositories").alias("most"))
    spread = spread.select("hash", "repositories", "owners", ((F.col("owners") > most_owners) | (F.col("most") > most_repositories)).alias("example"))
    span = F.struct(F.lit("live").alias("kind"), F.col("start"), F.col("end"), F.col("value"))
    of_row = each.join(spread, "hash").groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(~F.col("example"), span))).alias("live"),
        F.count_if("example").alias("n_example"),
        F.sort_array(F.collect_list(F.struct("start", "end", "value", "repositories", "owners", "example"))).alias("candidates"),
    )
    none = F.expr("cast(array() as array<struct<start:long,end:long,value:string,repositories:long,owners:long,example:boolean>>)")
    out = seen.select("row", "doc_id", "base").join(of_row, "row", "left")
    live = F.coalesce("live", spans.none())
    return out.select("doc_id", "base", spans.ordered(F.concat("base", live), KINDS, kind_first=False).alias("spans"), F.size(live).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"), F.coalesce("candidates", none).alias("candidates"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and strings of what find() returns."""
    return found.select(
        "doc_id",
        *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["start"], x["end"], x["repositories"], x["owners"])), ",").alias("candidates"),
    )
