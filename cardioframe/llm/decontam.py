"""Benchmark decontamination with spaced seeds.

Fixed masks choose some of the words of a window, so a hash of the chosen words survives substitutions in
the others. Hashes of the benchmark meet those of the documents; around each hit the two texts are laid
side by side and the stretch that agrees best, substitutions included, is measured.

The masks leave no gap: two texts side by side in which no mask fits have a best stretch of four agreeing
words at most (with a penalty of two or more for a substitution), so each passage that scan() accepts by
five words or more is laid side by side. Items of five words, of which four are enough, have a mask of
four; of shorter items the share asks for every word, so each has one mask of all its words.
A text that holds such a short item, of one word perhaps, may be anything: ``passage`` tells
whether an item of five words or more is in it, and what removes documents goes by that.

Words are compared in lower case (A-Z) and without ASCII punctuation. Edge cases: a null or empty text is
clean; an item without a word is found nowhere, any other is looked for; repeated items count once each, the
smallest id names a tie; repeated rows are judged alike; an empty table gives an empty result; very long texts
are compared whole; of other columns only doc_id and text are read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: 1: the word at this place is compared; 0: it may be anything.
MASKS = ("11111", "111011", "110111", "111101", "101111", "1111", "111", "11", "1")
#: How many masks, the first ones, longer items have; an item of up to five words has the one that is given here.
_LONG = 5
_SHORT = {5: 5, 4: 5, 3: 6, 2: 7, 1: 8}
_TABLE_BITS = 22
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = True


class _Plain(kit.Words):
    """Words whose hashes leave out ASCII punctuation."""

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        counts = self.is_word & ~_PUNCT[self.buf]
        total = np.concatenate([[0], np.cumsum(counts)])
        at = total[:-1] - total[self.start[np.maximum(self.index, 0)]]
        value = np.where(counts, self.buf.astype(np.uint64) + np.uint64(1), np.uint64(0)) * kit._NEAR[at & 0xFFFF]
        if at.max() > 0xFFFF:
            value *= np.where(at > 0xFFFF, kit._FAR[(at >> 16) & 0xFFF], np.uint64(1))
        return kit.mix(np.add.reduceat(value, self.start))


def _seeds(words: kit.Words, hashes: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows of a mask that lie in one text."""
    shape = MASKS[mask]
    n = len(hashes) - len(shape) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(mask + 1))
    for j, c in enumerate(shape):
        if c == "1":
            total += hashes[j : j + n] * kit._ORDER[j]
    at = np.flatnonzero(words.doc[:n] == words.doc[len(shape) - 1 :])
    return at, kit.mix(total[at])


class Index:
    """Seeds of some benchmark items, sorted by hash."""

    def __init__(self, ids: list, texts: list[str]):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        self.ids, self.items, seeds = ids, [], []
        for piece in kit.pieces([batch]):
            words = _Plain(piece, lower=True)
            hashes = words.hashes()
            base = len(self.items)
            self.items += [hashes[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
            for m, shape in enumerate(MASKS):
                at, h = _seeds(words, hashes, m)
                item = words.doc[at]
                n = words.count[item]
                use = n > max(_SHORT) if m < _LONG else np.isin(n, [k for k, own in _SHORT.items() if own == m])
                seeds.append((h[use], base + item[use], (at - words.first[item])[use], np.full(use.sum(), m)))
        h, item, at, mask = (np.concatenate(x) for x in zip(*seeds, strict=True)) if seeds else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at, self.masks = h[order], item[order].astype(np.int32), at[order].astype(np.int32), set(mask.tolist())
        self.words, self.size = np.concatenate([np.zeros(0, np.uint64), *self.items]), np.array([len(x) for x in self.items], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def diagonals(self, words: kit.Words, hashes: np.ndarray) -> np.ndarray:
        """Rows (item, first word of the item if it began in the text, document), each once."""
        out = [np.zeros((0, 3), np.int64)]
        for m in sorted(self.masks):
            at, h = _seeds(words, hashes, m)
            hit = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            at, h = at[hit], h[hit]
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            n = hi - lo
            seed = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            where = np.repeat(at, n)
            out.append(_each_once(np.column_stack([self.item[seed], where - self.at[seed], words.doc[where]])))
        return _each_once(np.concatenate(out))

    def agreeing(self, words: kit.Words, hashes: np.ndarray, diagonals: np.ndarray, most: int = 1 << 22) -> np.ndarray:
        """How many words agree over the whole length of each diagonal; of about ``most`` words at a time."""
        item, at, doc = diagonals.T
        lo = np.maximum(at, words.first[doc])
        n = np.minimum(at + self.size[item], words.first[doc + 1]) - lo
        own = self.first[item] + lo - at
        out, ends, a = np.zeros(len(n), np.int64), np.cumsum(n), 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
            step = np.arange(n[a:b].sum()) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            same = hashes[np.repeat(lo[a:b], n[a:b]) + step] == self.words[np.repeat(own[a:b], n[a:b]) + step]
            out[a:b] = np.add.reduceat(same, np.cumsum(n[a:b]) - n[a:b], dtype=np.int64)
            a = b
        return out


def _each_once(rows: np.ndarray) -> np.ndarray:
    """Different rows in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def _best_stretch(same: np.ndarray, penalty: int) -> tuple[int, int, int]:
    """Start, end and matches of the stretch with the largest sum of 1 for a match and -penalty for a substitution."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -penalty))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmax(total[: end + 1] == low[end]))
    return start, end, int(same[start:end].sum())


def scan(docs: DataFrame, shared: Broadcast, least_words: int = 13, least_share: float = 0.8, penalty: int = 2, row: str | None = None) -> DataFrame:
    """doc_id, n_hits (places laid side by side), n_overlap (words that agree in the best stretch), item_id, contaminated, passage (by an item of five words or more), for the items of one index, which is broadcast.

    A stretch counts with ``least_words`` words that agree, or with ``least_share`` of an item's words.
    row: a column of longs that is handed on
    """
    more = [row] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for piece in kit.pieces(batches):
            words = _Plain(piece, lower=True)
            hashes = words.hashes()
            hits, best, found, passage = np.zeros(piece.n, np.int64), np.zeros(piece.n, np.int64), np.full(piece.n, -1), np.zeros(piece.n, bool)
            beside = idx.diagonals(words, hashes)
            hits += np.bincount(beside[:, 2], minlength=piece.n)
            # a stretch has no more agreeing words than the whole diagonal
            agree = idx.agreeing(words, hashes, beside)
            able = (agree >= least_words) | (agree >= least_share * idx.size[beside[:, 0]])
            beside, agree = beside[able], agree[able]
            # those that agree most come first, so most others cannot be better and are passed over
            order = np.lexsort((beside[:, 0], -agree, beside[:, 2]))
            for (item, at, doc), most in zip(beside[order].tolist(), agree[order].tolist(), strict=True):
                own = idx.items[item]
                long = len(own) >= max(_SHORT)
                if (passage[doc] or not long) and (most < best[doc] or most == best[doc] and found[doc] >= 0 and idx.ids[item] >= idx.ids[found[doc]]):
                    continue
                lo, hi = max(at, words.first[doc]), min(at + len(own), words.first[doc + 1])
                _, _, agree = _best_stretch(hashes[lo:hi] == own[lo - at : hi - at], penalty)
                if agree < least_words and agree < least_share * len(own):
                    continue
                passage[doc] |= long
                if agree > best[doc] or agree == best[doc] and (found[doc] < 0 or idx.ids[item] < idx.ids[found[doc]]):
                    best[doc], found[doc] = agree, item
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in more), piece.column("doc_id"), pa.array(hits), pa.array(best), pa.array([idx.ids[i] if i >= 0 else None for i in found.tolist()], pa.int64()), pa.array(found >= 0), pa.array(passage)],
                [*more, "doc_id", "n_hits", "n_overlap", "item_id", "contaminated", "passage"],
            )

    return kit.map_texts(kit.base_columns(docs, *more), run, "".join(f"{c} long, " for c in more) + "doc_id long, n_hits long, n_overlap long, item_id long, contaminated boolean, passage boolean")


def find(docs: DataFrame, benchmark: DataFrame, most_words: int = 400_000, **how) -> DataFrame:
    """What scan() returns for the whole benchmark, a row for each document.

    most_words: an index that is broadcast has about so many words at most (some 100 bytes each); a larger
    benchmark is taken in blocks of that size, one after the other, so the driver holds one of them: a pass
    over the documents for each, staged, and the passes are merged row by row; for that, documents are staged
    once with a number for each row.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // most_words))
    if blocks > 1:
        docs = kit.stage(kit.base_columns(docs).withColumn("row", F.monotonically_increasing_id()))
        how["row"] = "row"
    passes = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows]))
        found = scan(docs, shared, **how)
        if blocks == 1:
            return found
        passes.append(kit.stage(found))
        shared.destroy()
    best = F.max(F.when(F.col("contaminated"), F.struct("n_overlap", (-F.col("item_id")).alias("i"))))
    merged = reduce(DataFrame.unionByName, passes).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_hits").alias("n_hits"), best.alias("b"), F.max("passage").alias("passage"))
    return merged.select("doc_id", "n_hits", F.coalesce("b.n_overlap", F.lit(0).cast("long")).alias("n_overlap"), (-F.col("b.i")).alias("item_id"), F.col("b").isNotNull().alias("contaminated"), "passage")
