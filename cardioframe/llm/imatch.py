"""Document fingerprints by I-Match, with DataFrame functions only.

Terms whose document frequency lies in a band of inverse document frequency make the lexicon. Of a text's
distinct terms those of the lexicon are kept, sorted, and hashed once for each of several randomised
subsets of the lexicon. Two texts agree on a subset exactly if they differ in none of its terms, so the
share of subsets on which they agree says how alike they are.

Subsets come in CHAINS chains of LEVELS, each level a quarter of the one before: a term's md5 says to which
it belongs. Sparse levels tell long texts apart and dense ones short texts; likeness() looks at the
sparsest level that says enough. The sparsest level is there for texts of any size: without it two different
texts with over CROWD * 4 ** 4 terms would have one fingerprint.

The lexicon is collected: a term in it is in ``low`` of all documents at least, so it has at most
(mean number of distinct terms of a document) / ``low`` terms however large the corpus is.

Edge cases: a null text is an empty one; texts without a term have one fingerprint; a text with under ``least``
terms of the lexicon is fingerprinted by all its terms; of repeated rows each is fingerprinted, equal texts
equally; of the rows of one doc_id each follows the other by text; rows without a doc_id come last in
the order of doc_id; a document that is alone follows itself; an empty table gives an empty result; very
long texts are taken whole; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kit

CHAINS = 16
#: Of each level, how many quarters are taken: subsets hold a 4th, a 16th, a 64th and a 256th of the lexicon.
LEVELS = (1, 2, 3, 4)
#: Hex digits of a signature, what stands for no term and for a level that is too dense for a text.
DIGITS, NOTHING, SKIPPED = 4, "----", "++++"
#: A level is left out where more terms than this are expected in a subset, but for the sparsest one.
CROWD = 16
#: A level says enough if so many of its subsets hold a term of either text.
ENOUGH = 8
_BUCKETS = 1 << 15
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and characters beyond ASCII, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAPS, -1)), "")


def lexicon(docs: DataFrame, low: float = 0.001, high: float = 0.1) -> Column:
    """The terms that ``low`` to ``high`` of all documents hold, as a constant: an array of buckets by hash, each its terms between blanks."""
    texts = kit.base_columns(docs).select("text")
    n = texts.count()
    each = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    kept = each.where(F.col("count").between(low * n, high * n)).select("term", _bucket(F.col("term")).alias("b"))
    found: dict[int, list[str]] = {}
    for r in kept.collect():
        found.setdefault(r["b"], []).append(r["term"])
    lines = "\n".join(" ".join(["", *sorted(found.get(b, ())), ""]) for b in range(_BUCKETS))
    # one text that is taken apart once, while the plan is made: terms hold no blanks and no ends of lines
    return F.split(F.lit(lines), "\n", -1)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(_BUCKETS)).cast("int")


def fingerprint(all_terms: Column, lex: Column, least: int = 8, skip_last: bool = False) -> Column:
    """The signatures of all subsets, level by level, as one text of DIGITS characters each. skip_last: see fingerprints()"""
    inside = F.filter(all_terms, lambda t: F.contains(F.get(lex, _bucket(t)), F.concat(F.lit(" "), t, F.lit(" "))))
    chosen = _let(F.array_sort(inside), lambda c: F.when(F.size(c) >= least, c).otherwise(F.array_sort(all_terms)))
    hashed = F.transform(chosen, lambda t: F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("h")))
    return _let(hashed, lambda c: F.array_join(F.transform(F.array_repeat(c, CHAINS), lambda x, i: _chain(x, i, skip_last)), ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chain(c: Column, i: Column, skip_last: bool) -> Column:
    """The four signatures of a chain: each level is looked for among the terms of the one before, if that was not left out."""
    first, second = (lambda x: F.substring(x["h"], 2 * i + 1, F.lit(1))), (lambda x: F.substring(x["h"], 2 * i + 2, F.lit(1)))
    tests = (lambda x: first(x) < "4", lambda x: first(x) == "0", lambda x: second(x) < "4", lambda x: second(x) == "0")
    n = F.size(c)

    def level(k: int, left: Column) -> Column:
        """Signatures of the k-th level (from 0) and the sparser ones; ``left`` holds the terms of the level before."""
        crowded = n > CROWD * 4 ** (k + 1) if k < 3 or skip_last else F.lit(False)
        # the third level asks for the second's digit, and is never looked for among all terms where the second was left out
        test = tests[k] if k != 2 else lambda x: (first(x) == "0") & tests[2](x)
        test = test if k != 3 else lambda x: (first(x) == "0") & tests[3](x)
        return _let(F.when(crowded, left).otherwise(F.filter(left, test)), lambda x: F.concat(F.when(crowded, SKIPPED).otherwise(_sign(x)), level(k + 1, x)) if k < 3 else F.when(crowded, SKIPPED).otherwise(_sign(x)))

    return level(0, c)


def _sign(x: Column) -> Column:
    return F.when(F.size(x) == 0, NOTHING).otherwise(F.substring(F.md5(F.array_join(F.transform(x, lambda y: y["t"]), " ").cast("binary")), 1, DIGITS))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1: the share of agreeing subsets among those that hold a term of either text.

    The sparsest level with ENOUGH such subsets counts, else the one with the most of them (the sparsest of these).
    """
    slot = lambda c, k, i: F.substring(c, DIGITS * (len(LEVELS) * i + k) + 1, F.lit(DIGITS))

    def level(k: int) -> Column:
        says = F.filter(F.sequence(F.lit(0), F.lit(CHAINS - 1)), lambda i: (slot(a, k, i) != slot(b, k, i)) | ~slot(a, k, i).isin(NOTHING, SKIPPED))

        def judged(said: Column) -> Column:
            used, same = F.size(said), F.size(F.filter(said, lambda i: slot(a, k, i) == slot(b, k, i)))
            # levels with enough subsets rank by sparseness, the others by how many they have
            return F.struct(F.when(used >= ENOUGH, 1000 + k).otherwise(used * 10 + k).alias("rank"), F.try_divide(same.cast("double"), used.cast("double")).alias("share"))

        return _let(says, judged)

    best = F.greatest(*(level(k) for k in range(len(LEVELS))))
    return F.when(a == b, 1.0).otherwise(F.coalesce(best["share"], F.lit(0.0)))


def _split_points(ids: DataFrame, parts: int) -> list[int]:
    shares = [k / parts for k in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * parts)).alias("p")).first()["p"] if shares else []
    return sorted(set(found or []), reverse=True)


def _part(splits: list[int]) -> Column:
    """How many split points lie above a doc_id, found in two steps; a null lies below all."""
    some = max(1, int(len(splits) ** 0.5))
    blocks = [splits[k : k + some] for k in range(0, len(splits), some)]
    doc = F.col("doc_id")
    text = lambda xs: ",".join(map(str, xs))
    longs = lambda c: F.split(c, ",").cast("array<bigint>")
    if not blocks:
        return F.lit(0)
    firsts = longs(F.lit(text(b[0] for b in blocks)))
    each = F.split(F.lit(";".join(map(text, blocks))), ";")
    block = F.size(F.filter(firsts, lambda s: s > doc))
    return F.when(doc.isNull(), len(splits)).when(block == 0, 0).otherwise((block - 1) * some + F.size(F.filter(longs(F.get(each, block - 1)), lambda s: s > doc)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, ghost and next_text: what follows by descending doc_id (then by text); the last row is followed by the first.

    Rows are dealt to ranges of doc_id, and each range also gets the first row of the range after it, marked as
    a ghost, so one shuffle lets every row see the next one. Ghosts stay in, for later steps on the same order.
    """
    spark = docs.sparkSession
    base = kit.base_columns(docs).withColumn("text", F.coalesce("text", F.lit("")))
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = base.withColumn("part", _part(_split_points(base.select("doc_id"), parts)))
    starts = placed.groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()  # a row for each range
    starts.sort(key=lambda r: r["part"])
    listed = ";".join(f"{starts[k - 1]['part']}:{'' if r['doc_id'] is None else r['doc_id']}" for k, r in enumerate(starts))
    pairs = F.transform(F.split(F.lit(listed), ";"), lambda x: F.split(x, ":"))
    ghosts = spark.range(1 if starts else 0).select(F.explode(pairs).alias("p")).select(F.col("p")[0].cast("int").alias("part"), F.col("p")[1].try_cast("long").alias("first"))
    extra = base.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "part", F.lit(True).alias("ghost"))
    rows = placed.withColumn("ghost", F.lit(False)).unionByName(extra)
    return rows.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame, low: float = 0.001, high: float = 0.1, least: int = 8, skip_last: bool = False) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (whole characters, rounded down) replaced by the beginning of the next
    row's text. low, high: the band, as shares of documents that hold a term; least: texts with fewer terms of the
    lexicon use all their terms; skip_last: leave out the sparsest level too where it is crowded, as OP12_SQL does and the query does not, so
    that texts with over CROWD * 4 ** 4 terms have no signature and all look alike
    """
    lex = lexicon(docs, low, high)
    n = F.length("text").cast("long")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - third).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = with_next(docs).select("part", "ghost", "doc_id", "text", n.alias("n_chars"), edited.alias("edited"))
    each = rows.select("part", "ghost", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(terms(F.col("text")), lex, least, skip_last).alias("fingerprint"), fingerprint(terms(F.col("edited")), lex, least, skip_last).alias("edited_fingerprint"))
    after = each.withColumn("__next", F.lead("fingerprint").over(_order())).where("not ghost")
    return after.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next")).alias("near_next"))
