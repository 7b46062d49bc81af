"""Language identification by compression.

For each language a zstandard raw-content dictionary holds text known to be in it. A text is encoded with
every dictionary; the smallest encoding names the language, and narrow margins are rejected. Long texts are
encoded in blocks, each with the dictionary alone before it, and the sizes of all blocks are added up: else
the text's own history would take over from the dictionary and margins would shrink as texts get longer.
All texts are encoded with the same settings.

Edge cases: a null text, and one without a letter (of Unicode's class L), are ``und`` with score 0 and
rejected. Where encodings are equally small, the language that comes first in the alphabet is taken, with
margin 0. Without any training text everything is ``und``; an empty table gives an empty result; repeated rows
are judged alike; very long texts are encoded whole, block by block. identify() reads doc_id and text only and
keep_identified() hands all columns on as they are, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kit

_LETTER = regex.compile(r"\p{L}")
#: All but letters and the marks that go with them.
_REST = regex.compile(r"[^\p{L}\p{M}]+")


def _plain(text: str) -> bytes:
    """Lower-case words with single spaces around them: what is encoded, so that capitals and symbols don't hide a language."""
    return _REST.sub(" ", f" {text.lower()} ").encode()


def train(docs: DataFrame, labelled: Column, texts: int = 60, size: int = 110 << 10, most_languages: int = 1000) -> dict[str, bytes]:
    """A raw-content dictionary per language from a bounded sample of labelled texts.

    texts: how many texts of each language are taken, those with the smallest hash of doc_id and text
    size: bytes of a dictionary; each text adds an equal share from its middle, so that no text fills it
    most_languages: more labels than that are an error, as the dictionaries would outgrow a task
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), labelled.alias("use"))
    rows = named.where("use and lang is not null and lang <> '' and lang <> 'und' and text is not null").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not counts:
        return {}
    # rows far over a language's cut go before any is ranked, so about 1.5 * texts rows of each language meet
    cuts = docs.sparkSession.createDataFrame([(r["lang"], kit.cut(texts, r["n"])) for r in counts], "lang string, cut long")
    key = kit.draw("doc_id", "text")
    ranked = rows.join(F.broadcast(cuts), "lang").where(key <= F.col("cut")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id", "text"))).where(F.col("k") <= texts)
    # the middle of each text only: 4 bytes a character at most, cut before it leaves the executor
    share = size // max(1, texts)
    middle = F.expr(f"substr(text, cast(greatest(1, length(text) div 2 - {share // 2}) as int), {share})")
    out: dict[str, bytes] = {}
    for r in ranked.select("lang", "k", middle.alias("m")).orderBy("lang", "k").collect():
        out[r["lang"]] = (out.get(r["lang"], b"") + _plain(r["m"]))[:size]
    return {k: v for k, v in out.items() if v}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 12, least_match: int = 3, block: int = 16 << 10):
        """level, least_match: of zstandard, for all texts; block: bytes that are encoded at a time; the whole text is, block after block."""
        self.langs, self.block, self.coders = sorted(dictionaries), block, []
        for x in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(level, source_size=block, dict_size=len(dictionaries[x]), min_match=least_match, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """The language, a score from 0 to 1 and the margin: how much smaller the smallest encoding is than the next."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0
        data = _plain(text)
        sizes = [sum(len(c.compress(data[at : at + self.block])) for at in range(0, len(data), self.block)) for c in self.coders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        score = 1 / sum(2.0 ** -min(60, s - best) for s in sizes)
        margin = 1 - best / sizes[order[1]] if len(order) > 1 else 1.0
        return self.langs[order[0]], score, margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected (the margin is under ``least_margin``, or there is no language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for piece in kit.pieces(batches):
            found = [classify(t) for t in piece.texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[0] == "und" or x[2] < least_margin for x in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return kit.map_texts(kit.base_columns(docs), run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], least_margin: float = 0.01) -> DataFrame:
    """The rows of documents whose language is told, with all the columns of documents; others go."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for batch in batches:
            keep = []
            for t in batch.column(batch.schema.get_field_index("text")):
                lang, _, margin = classify(t.as_py())
                keep.append(lang != "und" and margin >= least_margin)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return kit.map_texts(docs, run, schema)
