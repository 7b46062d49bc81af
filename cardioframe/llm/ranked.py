"""Ranked lexical search by blocked dense multiplication.

Each query item scores every document: the sum, over the item's terms, of a term's weight times its impact
in the document, all in integers. One pass over the texts counts the items' terms in each document; that
table is staged. A second pass lays tiles of documents (their impacts, on the columns that occur in the
tile) beside tiles of items (their weights) and multiplies them with BLAS. Products are of whole numbers
in float64 and are cut into vocabulary tiles whose sums stay under 2 ** 53, so every partial sum is exact;
partial sums are added as 64-bit integers. A task keeps the best documents of each item, ties by doc_id, and
Spark merges them in two rounds, so no task sees more than its share.

Terms are compared by 64-bit hashes of their bytes. Items are taken in blocks of bounded size: a pass over
the documents for each, as a block is broadcast.

Edge cases: a null or empty text has no term and is no document of the statistics; an item without a term
finds nothing; items that are repeated (same item_id and text) are answered once, different texts of one item_id
each; an item_id may be null; of repeated rows each is ranked; rows without a doc_id come last among ties;
empty tables give an empty result; very long texts are taken whole; only doc_id and text (item_id and text) are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit, topk

#: Upper bound of an impact.
_IMPACT = 1_000_000
_EXACT = float(1 << 52)
#: Stands for a missing doc_id inside a task, so that it comes last among ties.
_NO_ID = np.iinfo(np.int64).max
#: Documents and items of a tile.
_DOCS, _ITEMS = 512, 256
_TABLE_BITS = 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32


def _words(piece: kit.Piece) -> kit.Words:
    """Terms of a piece: maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return kit.Words(SimpleNamespace(buf=_FOLD[piece.buf], off=piece.off, n=piece.n))


class Items:
    """Some items: their distinct terms (hashes, sorted) and, item by item, places and repeats of theirs."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, found = ids, [np.zeros(0, np.uint64)] * len(ids)
        batch, at = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), 0
        for piece in kit.pieces([batch]):
            words = _words(piece)
            hashes = words.hashes()
            for k in range(piece.n):
                found[at + k] = hashes[words.first[k] : words.first[k + 1]]
            at += piece.n
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        pairs = [np.unique(np.searchsorted(self.vocabulary, x), return_counts=True) for x in found]
        self.item = np.repeat(np.arange(len(ids)), [len(t) for t, _ in pairs])
        self.term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in pairs)]).astype(np.int64)
        self.repeats = np.concatenate([np.zeros(0, np.int64), *(c for _, c in pairs)]).astype(np.int64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.vocabulary)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def counts(self, words: kit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, terms (places in the vocabulary) and how often each occurs, in order."""
        hashes = words.hashes()
        near = np.flatnonzero(self.table[self._slot(hashes)])
        term = np.searchsorted(self.vocabulary, hashes[near])
        hit = self.vocabulary[np.minimum(term, len(self.vocabulary) - 1)] == hashes[near] if len(self.vocabulary) else np.zeros(len(near), bool)
        key, tf = np.unique(words.doc[near[hit]].astype(np.int64) * (len(self.vocabulary) + 1) + term[hit], return_counts=True)
        return key // (len(self.vocabulary) + 1), key % (len(self.vocabulary) + 1), tf


def count_terms(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms of the text), terms and tfs: how often the items' terms occur in each document."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            words = _words(piece)
            doc, term, tf = shared.value.counts(words)
            ends = np.searchsorted(doc, np.arange(piece.n + 1)).astype(np.int32)
            lists = lambda x, kind, e=ends: pa.ListArray.from_arrays(pa.array(e), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(words.count.astype(np.int64)), lists(term, pa.int32()), lists(tf, pa.int64())], ["doc_id", "n", "terms", "tfs"])

    return kit.map_texts(kit.base_columns(docs), run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(df: Column, n_docs: int) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """1,000,000,000 tf div (1000 tf + 12 m), with m = 75 + (25 n N) div L."""
    m = 75 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def multiply(impact: np.ndarray, weights: np.ndarray, exact: float = _EXACT) -> np.ndarray:
    """Documents x terms times terms x items, of whole numbers, as exact 64-bit integers.

    Terms are taken in tiles whose sums, at most, stay under twice ``exact``; a term that alone could pass it is
    multiplied in integers.
    """
    most = weights.max(axis=1, initial=0) * _IMPACT
    out = np.zeros((impact.shape[0], weights.shape[1]), np.int64)
    for c in np.flatnonzero(most > exact):
        out += impact[:, c].astype(np.int64)[:, None] * weights[c].astype(np.int64)[None, :]
    small = np.flatnonzero(most <= exact)
    tile = (np.cumsum(most[small]) // exact).astype(np.int64)
    for t in np.unique(tile):
        use = small[tile == t]
        out += (impact[:, use] @ weights[use]).astype(np.int64)
    return out


def _scored(counted: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (place in the block), doc_id, score: each task's best documents of each item."""
    shared = counted.sparkSession.sparkContext.broadcast((items.item, items.term, items.repeats * weights[items.term], len(items.ids), len(items.vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, value, n_items, n_vocabulary = shared.value
        best, place = topk.Best(n_items, k, 1), np.full(n_vocabulary, -1)
        tiles = [(a, np.searchsorted(item, a), np.searchsorted(item, a + _ITEMS)) for a in range(0, n_items, _ITEMS)]
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS):
                part = batch.slice(at, _DOCS)
                lists = part.column(2)
                size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                own, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                if not len(own):
                    continue
                row = np.repeat(np.arange(part.num_rows), size)
                value_in = impacts(tf, part.column(1).to_numpy()[row], n_docs, n_terms)
                ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                cols = np.unique(own)
                place[cols] = np.arange(len(cols))
                impact = np.zeros((part.num_rows, len(cols)))
                impact[row, place[own]] = value_in
                for a, lo, hi in tiles:
                    here = place[term[lo:hi]]
                    use = here >= 0
                    inside, column = np.unique(here[use], return_inverse=True)
                    if len(inside):
                        w = np.zeros((len(inside), min(_ITEMS, n_items - a)))
                        w[column, item[lo:hi][use] - a] = value[lo:hi][use]
                        score = multiply(impact[:, inside], w)
                        doc, of = np.nonzero(score >= best.least[a : a + w.shape[1]])
                        best.add(of + a, ids[doc], score[doc, of])
                place[cols] = -1
        doc = pa.array(best.id, mask=best.id == _NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(best.key), doc, pa.array(best.score)], ["item", "doc_id", "score"])

    return kit.map_texts(counted.select("doc_id", "n", "terms", "tfs"), run, "item long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, k: int = 20, most_terms: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, those with a score above 0.

    most_terms: a block of items, which the driver gathers and broadcasts, has about so many words at most
    (an item of more words is a block of its own)
    """
    spark = docs.sparkSession
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = wanted.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // (4 * most_terms)))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        counted = kit.stage(count_terms(docs, items))
        totals = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["docs"] or not len(items.vocabulary):
            continue
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = np.zeros(len(items.vocabulary), np.int64)
        for r in held.select("term", weight(F.col("count"), totals["docs"]).alias("w")).collect():  # a row for each term of the block at most
            weights[r["term"]] = r["w"]
        top = topk.merged(_scored(counted, items, weights, totals["docs"], totals["terms"], k), "item", "doc_id", k)
        named = F.get(F.split(F.lit(",".join("" if i is None else str(i) for i in items.ids)), ",", -1), F.col("item").cast("int")).try_cast("long")
        out = out.unionByName(top.select(named.alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
