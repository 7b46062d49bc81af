"""Quality rules with an isolation forest over rule statistics.

Trees of random splits are laid over statistics of documents labelled good; a document that few splits
isolate is unlike them. Splits are drawn from the range of the statistics alone, so all labelled documents
count: each task counts its rows at the ends of all trees, and only the sums reach the driver. The largest
score that is still kept is calibrated on all labelled rows, by running sums over ranges of paths.

Edge cases: a null or empty text has zero counts and fails the base rule; repeated rows are scored alike;
without labelled rows of both kinds the method keeps all that passes the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import order
from . import kit, stats

FEATURES = tuple(x for x in stats.RATIOS if x not in ("log_words", "words_per_line", "non_ascii_share", "distinct_share", "top_word_share", "short_line_share", "commas_per_word", "stop_per_word", "long_word_share", "chars_per_word"))


def _expected(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees in flat arrays: a row for each tree, a column for each place of a heap of ``depth`` levels."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray  # where a row stops there: its depth and what is expected below
    depth: int
    usual: float

    @classmethod
    def draw(cls, low: np.ndarray, high: np.ndarray, trees: int = 128, depth: int = 12, seed: int = 7) -> Forest:
        """Splits of all places, before any row is counted.

        A cut is drawn from the part of the box from ``low`` to ``high`` that the splits above leave, not
        only between values seen: a side without any usual row ends at once, so what falls there has a
        short path even in a column where usual rows are all alike.
        """
        rng = np.random.default_rng(seed)
        places = (1 << (depth + 1)) - 1
        feature, cut, path = np.full((trees, places), -1), np.zeros((trees, places)), np.zeros((trees, places))
        wide = np.flatnonzero(high > low)
        for t in range(trees if len(wide) else 0):
            lo, hi = low[None, :].astype(np.float64), high[None, :].astype(np.float64)
            for at in range(depth):
                n = np.arange(1 << at)
                f = rng.choice(wide, len(n))
                c = rng.uniform(lo[n, f], hi[n, f])
                feature[t, n + len(n) - 1], cut[t, n + len(n) - 1] = f, c
                lo, hi = np.repeat(lo, 2, 0), np.repeat(hi, 2, 0)
                hi[2 * n, f] = lo[2 * n + 1, f] = c
        return cls(feature, cut, path, depth, 1.0)

    def count(self, x: np.ndarray) -> np.ndarray:
        """How many rows end at each place of the last level: a row for each tree that draw() made."""
        out = np.zeros((len(self.feature), 1 << self.depth), np.int64)
        rows = np.arange(len(x))
        for t, (feature, cut) in enumerate(zip(self.feature, self.cut, strict=True)):
            place = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (x[rows, np.maximum(feature[place], 0)] > cut[place])
            out[t] = np.bincount(place - len(out[t]) + 1, minlength=len(out[t]))
        return out

    def settle(self, counts: np.ndarray, size: int = 256) -> Forest:
        """End trees where under two of ``size`` rows would lie, if they were spread as all that were counted."""
        scale = min(1.0, size / max(1, int(counts[0].sum()))) if len(counts) else 1.0
        for at in range(self.depth, -1, -1):
            here = slice((1 << at) - 1, (1 << (at + 1)) - 1)
            n = counts * scale
            self.path[:, here] = at + _expected(n)
            self.feature[:, here][n < 2] = -1
            counts = counts[:, ::2] + counts[:, 1::2] if at else counts
        return self

    @classmethod
    def grow(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 128, size: int = 256, depth: int = 12, seed: int = 7) -> Forest:
        """A forest over rows in memory."""
        forest = cls.draw(low, high, trees, depth, seed)
        forest.settle(forest.count(x), size)
        forest.usual = max(1e-9, float(np.median(forest.paths(x)))) if len(x) else 1.0
        return forest

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            place = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[place]
                if (f < 0).all():
                    break
                place = np.where(f < 0, place, 2 * place + 1 + (x[rows, np.maximum(f, 0)] > cut[place]))
            total += path[place]
        return total / max(1, len(self.feature))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-path / usual path): 0.5 for a usual row, nearer to 1 the sooner a row stands alone."""
        return self.score_of(self.paths(x))

    def score_of(self, paths: np.ndarray) -> np.ndarray:
        return 2.0 ** (-paths / self.usual)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray, least_words: int = 50, most_repeated: int = 50) -> np.ndarray:
    """Too few words, or over ``most_repeated`` percent of them in repeated windows."""
    return (n_words < least_words) | (100 * n_repeat_words > most_repeated * n_words)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, len(FEATURES))


_COUNTED = "doc_id long, " + ", ".join(f"{c} long" for c in stats.COUNTS) + ", base_failed boolean"


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rule, base_failed and x (the statistics that the trees look at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            found = stats.measure(piece)
            counts = [pa.array(found[c].astype(np.int64)) for c in stats.COUNTS]
            failed = pa.array(base_failed(found["n_words"], found["n_repeat_words"]))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *counts, failed, _lists(stats.matrix(found, FEATURES))], ["doc_id", *stats.COUNTS, "base_failed", "x"])

    return kit.map_texts(kit.base_columns(docs), run, f"{_COUNTED}, x array<double>")


def labelled(measured: DataFrame, labels: DataFrame, use: Column | None = None) -> DataFrame:
    """doc_id, x, y of all labelled documents that pass the base rule: the others are not the method's to judge.

    Rows without a 0/1 label are left out; of several labels of a document the largest counts, of its different texts the one with
    the smallest statistics.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.where(use) if use is not None else marks
    both = measured.join(marks.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id")
    one = both.groupBy("doc_id").agg(F.min(F.struct("x", "n_words", "n_repeat_words", "base_failed", "y")).alias("r"))
    return one.where("not r.base_failed").select("doc_id", "r.x", "r.y")


def _counted(good: DataFrame, forest: Forest) -> np.ndarray:
    """Forest.count() of all rows: tasks hand on the places that have any, and only their sums are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((forest.count(_matrix(b)) for b in batches if b.num_rows), np.zeros((len(forest.feature), 1 << forest.depth), np.int64))
        tree, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[tree, place])], ["tree", "place", "n"])

    found = kit.map_texts(good.select("x"), run, "tree int, place int, n long").groupBy("tree", "place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(forest.feature), 1 << forest.depth), np.int64)
    out[found["tree"], found["place"]] = found["n"]
    return out


def calibrate(paths: DataFrame, good_lost: float = 0.01) -> float:
    """The shortest path to keep, from path and y of each row: it parts good from bad rows best, and at most a share ``good_lost`` of good ones has a shorter one.

    Different paths are dealt to ranges, the longest first; a row of sums for each range is collected, and rows before a path are
    counted inside its range.
    """
    spark = paths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = paths.groupBy("path").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    dealt = kit.stage(each.repartitionByRange(parts, F.desc("path")).withColumn("part", F.spark_partition_id()))
    sums = sorted(dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect())
    good, bad = (sum(r[c] for r in sums) for c in ("good", "bad"))
    if not good or not bad:
        return -np.inf
    before = [(r["part"], *(sum(q[c] for q in sums[:k]) for c in ("good", "bad"))) for k, r in enumerate(sums)]
    before = spark.createDataFrame(before, "part int, good_before long, bad_before long")
    upto = Window.partitionBy("part").orderBy(F.desc("path"))
    running = lambda c: F.sum(c).over(upto) + F.col(f"{c}_before")
    tries = dealt.join(F.broadcast(before), "part").select("path", "good", running("good").alias("kept_good"), running("bad").alias("kept_bad"))
    least = min(good - 1, int(np.ceil(good * (1 - good_lost))))
    gain = (1 - F.col("kept_bad") / bad) - (1 - F.col("kept_good") / good)
    return tries.where((F.col("good") > 0) & (F.col("kept_good") > least)).agg(F.max(F.struct(gain.alias("gain"), "path")).alias("r")).first()["r"]["path"]


def fit(docs: DataFrame, labels: DataFrame, trees: int = 128, size: int = 256, use: Column | None = None) -> tuple[Forest | None, float]:
    """A forest and its threshold, from all labelled documents."""
    return fit_measured(measure(docs), labels, trees, size, use)


def fit_measured(measured: DataFrame, labels: DataFrame, trees: int = 128, size: int = 256, use: Column | None = None) -> tuple[Forest | None, float]:
    """fit() from what measure() gives."""
    rows = kit.stage(labelled(measured, labels, use))
    ends = [F.struct(*(f(F.col("x")[k]).alias(f"c{k}") for k in range(len(FEATURES)))).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    box = rows.agg(F.count_if(F.col("y") == 1).alias("good"), *ends).first()
    if not box["good"]:
        return None, np.inf
    forest = Forest.draw(np.array(box["low"], np.float64), np.array(box["high"], np.float64), trees)
    forest.settle(_counted(rows.where("y = 1"), forest), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("y")), pa.array(forest.paths(_matrix(b)))], ["y", "path"])

    paths = kit.stage(kit.map_texts(rows.select("x", "y"), run, "y int, path double"))
    forest.usual = max(1e-9, order.quantiles(paths.where("y = 1"), [], {"usual": ("path", 0.5)}).first()["usual"])
    shortest = calibrate(paths)
    kit.drop(rows, paths)
    return forest, float(forest.score_of(np.array([shortest]))[0])


def judge(docs: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """doc_id, the counts of the base rule, base_failed, anomaly (0 to 1), kept."""
    return judge_measured(measure(docs), forest, threshold)


def judge_measured(measured: DataFrame, forest: Forest | None, threshold: float) -> DataFrame:
    """judge() from what measure() gives."""
    names = ["doc_id", *stats.COUNTS, "base_failed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = [b.column(b.schema.get_field_index(c)) for c in names]
                score = forest.score(_matrix(b)) if forest is not None else np.zeros(b.num_rows)
                kept = ~same[-1].to_numpy(zero_copy_only=False) & (score <= threshold)
                yield pa.RecordBatch.from_arrays([*same, pa.array(score), pa.array(kept)], [*names, "anomaly", "kept"])

    return kit.map_texts(measured, run, f"{_COUNTED}, anomaly double, kept boolean")


def find(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge() by what fit() learns from the same documents, whose statistics are taken once."""
    measured = kit.stage(measure(docs))
    return judge_measured(measured, *fit_measured(measured, labels))
