"""Personal data: base patterns, and identifiers found by bootstrapping from their contexts.

Base spans are the seeds; each counts as one token, whatever blanks are in it. What else looks like an
identifier is a word with '@' or four digits outside them. The lexical patterns of a token are the two words
before it (or the start of the text), its label alone (the word before it, where that ends in ':' or '='), and
the frame of a label and the word after. Words are those around the token's own word, base spans in them are one sign.
Patterns and instances form a graph whose two sides are scored in turn: a pattern by
the mean score of the instances it leads to, an instance by how likely it is that any of its patterns is
right; seeds score 1. Tokens that no base pattern found but trusted patterns lead to become ``ctx`` spans.
A single word or frame without a label is no pattern, and two words are one only if enough of their places in
the whole corpus lead to tokens: words as common as 'of the' stand before all kinds of things.
DataFrame functions only.

Edge cases: a null or empty text has no spans; repeated rows get the spans of their own text each; without
trusted patterns only base spans are there; ties don't arise, as all scores over the bound count; an empty
table gives an empty result; very long texts are searched whole, by patterns that don't backtrack; of other
columns none is read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit, spans

KINDS = ("email", "ip", "card", "phone")
_W = r"\x20\x09-\x0D"
#: The asked patterns, with possessive loops and lookbehinds that leave their matches as they are.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+(?<=[\x200-9-]{2})"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: The characters of base spans, and those of a private block that stand for them, each at its own place, while tokens are looked for.
_OWN = "".join(map(chr, range(32, 127)))
_SIGNS = "".join(chr(0xE000 + ord(c)) for c in _OWN)
_SIGN = f"{_SIGNS[0]}-{_SIGNS[-1]}"
#: What a text has of that block itself becomes this character.
_OTHER = chr(0xF8FF)
#: A run of signs, or a word with an '@' or a digit and without signs; the latter is tried once at the start of each word.
TOKEN = rf"[{_SIGN}]++|(?<![^{_W}])[^{_W}@0-9{_SIGN}]*+[@0-9][^{_W}{_SIGN}]*+(?![^{_W}])"
#: Two words that stand for the start of a text, so that its first tokens have a pattern as well.
_START = "^ ^ "


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Doubling every second digit from the right, the sum of all digits ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).otherwise(d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _rules(text: Column) -> dict[str, tuple[str, Column, Callable[[Column], Column]]]:
    """By kind: the pattern, what holds for every text with a match, and which matches count."""
    digits = lambda v: F.length(_digits(v))
    return {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda v: v.isNotNull()),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")),
        "card": (CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), lambda v: digits(v).between(13, 19) & _luhn(_digits(v))),
        "phone": (PHONE, F.contains(text, F.lit("+")) & text.rlike("[0-9]"), lambda v: digits(v).between(9, 15)),
    }


def base_spans(text: Column) -> Column:
    """The base spans of a text that is not null, by kind and start."""

    def of_kind(kind: str, pattern: str, gate: Column, counts: Callable[[Column], Column]) -> Column:
        return spans.plain(F.filter(spans.matches(text, kind, pattern, gate), lambda x: counts(x["value"])))

    return F.concat(*(of_kind(k, *_rules(text)[k]) for k in KINDS))


def _signed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``signed``: the text with signs in place of base spans, as long as the text and with all else where it was.

    Kinds are taken in turn, so where spans overlap the earlier kind has all of its own. A step for each, as a
    column that is used several times inside one expression would be computed each time.
    """
    text = F.col("signed")
    out = docs.withColumn("signed", F.when(F.col("text").rlike(f"[{_SIGN}]"), F.translate("text", _SIGNS, _OTHER * len(_SIGNS))).otherwise(F.col("text")))

    def pieces(pattern: str, counts: Callable[[Column], Column]) -> Column:
        after_gap = lambda v: F.when(counts(v), F.translate(v, _OWN, _SIGNS)).otherwise(F.coalesce(v, F.lit("")))
        return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, v: F.concat(gap, after_gap(v)))

    for pattern, gate, counts in _rules(text).values():
        out = out.withColumn("signed", F.when((F.size("base") > 0) & gate, F.array_join(pieces(pattern, counts), "")).otherwise(text))
    return out


def _alike(words: Column) -> Column:
    """Base spans as one sign, digits made alike and letters lower."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(words), f"[{_SIGN}]+", _SIGNS[0]), "[0-9]", "0"))


def _following() -> Column:
    """For each token of ``signed`` the word after the token's own word; empty at the end."""
    values, gaps = F.regexp_extract_all("signed", F.lit(TOKEN), F.lit(0)), F.split("signed", TOKEN, -1)
    rest = lambda gap, v: F.concat(F.regexp_replace(gap, rf"^[^{_W}]+", ""), F.coalesce(v, F.lit("")))
    word = lambda gap, v: F.regexp_extract(rest(gap, v), rf"[^{_W}]+", 0)
    # the words between two tokens, and where there are none the second token
    return F.zip_with(F.slice(gaps, 2, 1 << 30), F.slice(values, 2, 1 << 30), word)


def _patterns(before: Column, after: Column) -> Column:
    """The patterns of a token, each once."""
    lead = _alike(F.regexp_replace(before, "[^ ]*$", ""))
    label = F.substring_index(lead, " ", -1)
    is_label = label.rlike(r"\p{L}.*[:=]$")
    return F.array_compact(F.array(F.concat(F.lit("2 "), lead), F.when(is_label, F.concat(F.lit("1 "), label)), F.when(is_label & (after != ""), F.concat(F.lit("f "), label, F.lit(" "), _alike(after)))))


#: Into so many parts the rows of one pattern or value are dealt wherever they are joined.
_PARTS = 16


def _dealt(rows: DataFrame, few: DataFrame, key: list[str], by: str, how: str = "inner") -> DataFrame:
    """A join on ``key``, of which ``few`` has each once: a frequent key's rows are dealt out by ``by``, so no task has them all."""
    each = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(_PARTS)).cast("int")).join(each, [*key, "part"], how).drop("part")


def _places(docs: DataFrame) -> DataFrame:
    """pattern, for each two words of each text (two signs of the start before it) that another word follows."""
    words = F.filter(F.split(F.concat(F.lit(_START), _alike(F.coalesce(F.col("text").cast("string"), F.lit("")))), f"[{_W}]+", -1), lambda w: w != "")
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2), lambda a, b: F.concat(F.lit("2 "), a, F.lit(" "), b))
    return docs.select(words.alias("w")).where(F.size("w") > 2).select(F.explode(pairs).alias("pattern"))


def discover(seen: DataFrame, places: DataFrame | None = None, support: int = 3, trust: float = 0.8, rounds: int = 3, share: float = 0.1) -> DataFrame:
    """row and a list of ctx spans, for rows with any. seen: row, tokens (array of start, end, value, patterns, seed).

    places: a row (pattern) for each place of any pattern in the corpus, whatever follows; those of patterns that have
        the support are counted, so Spark broadcasts these while they are few and filters by them before a shuffle otherwise
    share: this part of a pattern's places at least must lead to tokens; patterns that ``places`` does not hold always count
    support: how many different seeds must follow a pattern
    trust: the score from which a pattern counts and an instance is accepted; rounds: of scoring
    """
    use = seen.select("row", F.explode("tokens").alias("t")).select("row", "t.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges = use.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("uses"))
    known = edges.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count("*").alias("n"), F.sum("uses").alias("uses")).where((F.col("seeds") >= support) & (F.col("seeds") < F.col("n"))).select("pattern", "uses")
    if places is not None:
        known = kit.stage(known)
        met = places.join(known, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("met"))
        known = known.join(met, "pattern", "left").where(F.col("uses") >= share * F.coalesce("met", F.lit(0)))
    known, edges = known.select("pattern"), edges.drop("uses")
    edges = kit.stage(_dealt(edges, known, ["pattern"], "value", "left_semi"))
    scored = edges.select("pattern", "value", "seed", F.col("seed").cast("double").alias("score"))
    for _ in range(rounds):
        conf = scored.groupBy("pattern").agg(F.avg("score").alias("conf"))
        doubt = _dealt(edges, conf, ["pattern"], "value").groupBy("value").agg(F.max("seed").alias("s"), F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf")))).alias("doubt"))
        inst = doubt.select("value", F.when(F.col("s") > 0, 1.0).otherwise(1 - F.exp("doubt")).alias("score"))
        scored = kit.stage(_dealt(edges, inst, ["value"], "pattern").select("pattern", "value", "seed", "score"))
    conf = scored.groupBy("pattern").agg(F.avg("score").alias("conf")).where(F.col("conf") >= trust)
    fresh = _dealt(scored.where((F.col("seed") == 0) & (F.col("score") >= trust)), conf, ["pattern"], "value", "left_semi").select("pattern", "value")
    found = _dealt(use.where("seed = 0"), fresh, ["pattern", "value"], "row", "left_semi")
    span = F.struct(F.lit("ctx").alias("kind"), F.col("start"), F.col("end"), F.col("value"))
    return found.groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("more"))


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, base (array of spans), spans (base ones and discovered ones). ``how``: the parameters of discover()."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = kit.base_columns(docs).select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    able = F.col("signed").rlike(rf"[@{_SIGN}]|[0-9](?:[^{_W}0-9]*+[0-9]){{3}}")
    token = spans.matches(F.col("signed"), "token", TOKEN, able, before=2, start=_START)
    seed = lambda x: x["value"].rlike(f"^[{_SIGN}]")
    both = F.zip_with(token, F.when(able, _following()), lambda x, after: F.struct(x.alias("x"), after.alias("after")))
    both = F.filter(both, lambda y: seed(y["x"]) | F.contains(y["x"]["value"], F.lit("@")) | (F.length(_digits(y["x"]["value"])) >= 4))
    token = F.transform(
        both,
        lambda y: F.struct(
            y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), F.translate(y["x"]["value"], _SIGNS, _OWN).alias("value"),
            _patterns(y["x"]["before"], F.coalesce(y["after"], F.lit(""))).alias("patterns"), seed(y["x"]).cast("int").alias("seed"),
        ),
    )
    seen = kit.stage(_signed(base).select("doc_id", "base", token.alias("tokens")).withColumn("row", F.monotonically_increasing_id()))
    more = discover(seen.where(F.size("tokens") > 0).select("row", "tokens"), _places(docs), **how)
    # a base span that overlaps one of an earlier kind may reach into a word that is taken for a token
    apart = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    out = seen.select("row", "doc_id", "base").join(more, "row", "left")
    return out.select("doc_id", "base", F.concat("base", F.coalesce(apart, spans.none())).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and strings of what find() returns."""
    return found.select(
        "doc_id",
        *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
        spans.count(F.col("spans"), "ctx").alias("n_ctx"),
    )
