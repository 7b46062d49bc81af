"""Statistics of whole texts, computed for many documents at once on their bytes.

Rules, anomaly scores and quality classifiers take their inputs from here. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

#: Whole counts, as rules use them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that don't depend on a text's length, as models use them.
RATIOS = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "bang_per_word", "bar_per_word", "wordless_share",
    "distinct_share", "same_as_last", "words_per_line", "short_line_share", "top_word_share", "long_word_share", "stop_per_word", "commas_per_word", "non_ascii_share", "brace_per_word",
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[off[1:]] - total[off[:-1]]


def _repeats(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, how many of its group have its value, and whether an earlier one has it."""
    if not len(value):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))
    run = np.cumsum(new) - 1
    times, later = np.empty(len(value), np.int64), np.empty(len(value), bool)
    times[order], later[order] = np.bincount(run)[run], ~new  # lexsort is stable
    return times, later


def measure(piece: kit.Piece) -> dict[str, np.ndarray]:
    """COUNTS (whole numbers) and RATIOS of each document of a piece."""
    words = kit.Words(piece)
    buf, off, n = piece.buf, piece.off, piece.n
    hashes = words.hashes()
    count = words.count
    begins = (buf & 0xC0) != 0x80
    word_chars, chars = _sums(begins & words.is_word, off), _sums(begins, off)
    symbols = _sums(_SYMBOLS[buf], off)
    # lines: their bytes hashed as one word each, by document
    cut = buf == 10
    line_first = np.zeros(len(buf), bool)
    line_first[off[:-1][off[:-1] < len(buf)]] = True
    line_first[1:] |= cut[:-1]
    line_at = np.flatnonzero(line_first)
    line_doc = np.searchsorted(off, line_at, "right") - 1
    line_no = np.cumsum(line_first) - 1
    if len(line_at):
        place = np.arange(len(buf)) - line_at[line_no]
        value = np.where(cut, np.uint64(0), buf.astype(np.uint64) + np.uint64(1)) * kit._NEAR[place & 0xFFFF]
        if place.max() > 0xFFFF:
            value *= np.where(place > 0xFFFF, kit._FAR[(place >> 16) & 0xFFF], np.uint64(1))
        line_hash = kit.mix(np.add.reduceat(value, line_at))
        line_words = np.bincount(line_no[words.start], minlength=len(line_at))
    else:
        line_hash, line_words = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    real = line_words > 0
    line_doc, line_hash, line_words = line_doc[real], line_hash[real], line_words[real]
    _, later = _repeats(line_doc, line_hash)
    per = lambda mask, group: np.bincount(group, mask, n).astype(np.int64)
    lines, dup_lines = np.bincount(line_doc, minlength=n), per(later, line_doc)
    # words that lie in a three-word window found twice
    at, window = words.windows(hashes, 3)
    times, _ = _repeats(words.doc[at], window)
    repeated = per(kit.covered(len(hashes), at[times > 1], 3), words.doc)
    # words
    same, again = _repeats(words.doc, hashes)
    size = words.end - words.start
    most = np.zeros(n, np.int64)
    np.maximum.at(most, words.doc, same)
    next_same = np.zeros(len(hashes), bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    w, c, ln = np.maximum(count, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    has_letter = np.zeros(len(hashes), bool)
    if len(hashes):
        letter = ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122)) | (buf >= 0xC3)
        has_letter = np.bitwise_or.reduceat(letter & words.is_word, words.start)
    upper, digit = _sums((buf >= 65) & (buf <= 90), off), _sums((buf >= 48) & (buf <= 57), off)
    ascii_text = _sums(buf < 128, off)
    punct = _sums(((buf > 32) & (buf < 48)) | ((buf > 57) & (buf < 65)) | ((buf > 90) & (buf < 97)) | ((buf > 122) & (buf < 127)), off)
    out = {"n_words": count, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated}
    out |= {
        "log_words": np.log1p(count), "chars_per_word": word_chars / w, "symbols_per_word": (symbols - _sums(buf == 124, off)) / w, "dup_line_share": dup_lines / ln, "repeat_share": repeated / w,
        "upper_share": upper / c, "digit_share": digit / c, "punct_share": punct / c, "bang_per_word": _sums(buf == 33, off) / w, "bar_per_word": _sums(buf == 124, off) / w,
        "wordless_share": per(~has_letter, words.doc) / w, "distinct_share": per(~again, words.doc) / w, "same_as_last": per(next_same, words.doc) / w, "words_per_line": np.log1p(count / ln),
        "short_line_share": per(line_words <= 3, line_doc) / ln, "top_word_share": most / w, "long_word_share": per(size > 14, words.doc) / w, "stop_per_word": _sums(buf == 46, off) / w,
        "commas_per_word": _sums(buf == 44, off) / w, "non_ascii_share": (np.diff(off) - ascii_text) / c, "brace_per_word": _sums((buf == 123) | (buf == 125) | (buf == 91) | (buf == 93) | (buf == 60) | (buf == 62), off) / w,
    }
    return out


def matrix(found: dict[str, np.ndarray], names: tuple[str, ...]) -> np.ndarray:
    """A row for each document, a column for each statistic."""
    return np.column_stack([found[x].astype(np.float64) for x in names]) if len(found["n_words"]) else np.zeros((0, len(names)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, use: Column | None = None, names: tuple[str, ...] = RATIOS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, labels and ids of at most ``most`` labelled documents, those with the smallest hash of doc_id.

    ``most`` bounds what reaches the driver: most * (len(names) + 2) numbers. Rows without a 0/1 label are
    left out; of several labels of a document the largest counts. Ids are broadcast, at most ``most`` of them.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.where(use) if use is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = kit.drawn(marks, most, marks.count(), "doc_id")
    texts = kit.base_columns(docs).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            rows = matrix(measure(piece), names)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(names), dtype=np.int32)), pa.array(rows.ravel()))], ["doc_id", "y", "x"])

    # one row for each doc_id before any of them reach the driver; of its different texts the one with the smallest statistics stands for it
    measured = kit.map_texts(texts, run, "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r"))
    got = measured.select("doc_id", "r.y", "r.x").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(names))
    return x, got["y"].to_numpy(np.int64), got["doc_id"].to_numpy(np.int64)
