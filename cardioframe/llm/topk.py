"""The k best rows of each of many keys: within a task, and merged over tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Best:
    """The k best ids of each key so far: higher scores first, then smaller ids. ``least``: what a score must reach to come in, by key."""

    def __init__(self, keys: int, k: int, least: int | np.ndarray):
        self.k, self.least = k, np.full(keys, least, np.int64)
        self.full = np.zeros(keys, bool)
        self.key, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores that reach ``least``; ties with it may still come in by their id."""
        if not len(key):
            return
        key, ids, score = np.concatenate([self.key, key]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        rank = np.arange(len(order)) - np.searchsorted(key, key)
        last, keep = rank == self.k - 1, rank < self.k
        self.least[key[last]], self.full[key[last]] = score[last], True
        self.key, self.id, self.score = key[keep], ids[keep], score[keep]


def merged(found: DataFrame, key: str, ids: str, k: int, salts: int = 256) -> DataFrame:
    """``found`` with ``rank``: the k best rows of each key.

    Each salt's best come first, so that one task never gets what all tasks found for a key.
    """
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last(ids))
    some = found.withColumn("salt", F.spark_partition_id() % salts).withColumn("r", F.row_number().over(order(key, "salt"))).where(F.col("r") <= k)
    return some.withColumn("rank", F.row_number().over(order(key))).where(F.col("rank") <= k).drop("salt", "r")
