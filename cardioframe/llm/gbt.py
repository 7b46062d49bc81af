"""A quality classifier: histogram gradient-boosted trees over document statistics.

Values are binned at quantiles of the training sample; a level of a tree is grown from sums of gradients
per bin. Trees end up as flat arrays, which a batch of documents walks with numpy, a level at a time.

Edge cases: a null or empty text has zero statistics and a score like any other; without labels of both
kinds the score is the share of label 1 (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import kit, stats

FEATURES = stats.RATIOS


@dataclass
class Trees:
    """feature, cut: (trees, inner places of a heap); leaf: (trees, 2 ** depth)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            place = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                place = 2 * place + 1 + (x[rows, feature[place]] > cut[place])
            raw += leaf[place - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Trees:
    """least: the smallest sum of second derivatives on either side of a split."""
    n, m = x.shape
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Trees(np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1)), np.zeros((0, 1 << depth)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # bin b: edge b - 1 < value <= edge b
    raw = np.full(n, base)
    out_f, out_c, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, split_at = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), np.full((1 << depth) - 1, bins)
        place = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            local = place - first
            gs, hs = (np.stack([np.bincount(local * bins + binned[:, j], v, wide * bins).reshape(wide, bins) for j in range(m)], 1) for v in (g, h))
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            flat = gain.reshape(wide, -1)
            best = flat.argmax(1)
            for i in np.flatnonzero(flat[np.arange(wide), best] > 1e-6):
                j, b = divmod(int(best[i]), bins)
                if b < len(edges[j]):
                    feature[first + i], cut[first + i], split_at[first + i] = j, edges[j][b], b
            place = 2 * place + 1 + (binned[np.arange(n), feature[place]] > split_at[place])
        local = place - ((1 << depth) - 1)
        leaf = -rate * np.bincount(local, g, 1 << depth) / (np.bincount(local, h, 1 << depth) + l2)
        raw += leaf[local]
        out_f.append(feature), out_c.append(cut), out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_c), np.array(out_l), base)


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, most: int = 20_000, **how) -> Trees:
    """Trees from at most ``most`` labelled documents for which ``use`` holds."""
    x, y, _ = stats.labelled_sample(docs, labels, "quality", most, use, FEATURES)
    return train(x, y, **how)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score (0 to 1, higher: good likelier), predicted (1 from 0.5 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            p = trees.score(stats.matrix(stats.measure(piece), FEATURES))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return kit.map_texts(kit.base_columns(docs), run, "doc_id long, score double, predicted int")
