"""Hard negatives of anchors by threshold joins with norm bounds (L2AP).

Vectors are whole numbers. A join finds all pairs (anchor, row) whose inner product reaches the anchor's
threshold. Dimensions are put in one order, those that carry most of the anchors' squares first. Of a row
only the leading dimensions are indexed: the rest of it is so short that, even beside the longest rest of an
anchor, it cannot reach the threshold by itself. Scores are accumulated over the indexed dimensions, a tile
of them at a time; after each a pair is given up once its partial score and the product of the norms that remain
cannot reach the threshold; what is left is finished from the dimensions that were not indexed.

Thresholds start high and are lowered for the anchors (or windows of scores) that have too few rows yet, until all
are full or have seen every row that may count. Within a task the threshold of a full window also rises to its worst row.

Anchors are taken in blocks of bounded size, each broadcast: a stated set of queries against all rows.

Edge cases: rows with a null vec_id, label or vector, or a null or non-finite component take no part; where
vectors differ in length, what a shorter one lacks is 0; ties go to the smaller vec_id; of repeated rows each is a row
of its own, but repeated anchors are answered once, and rows with an anchor's own vec_id are never its
positives; an anchor without positives, or a window without rows, gives no rows; an empty table gives an empty result; only
the three columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit, topk

#: Dimensions of a tile, and pairs that a task looks at together.
_TILE, _PAIRS = 8, 1 << 20
#: Inner products under this are exact in float64.
_EXACT = float(1 << 52)
#: Shares of an anchor's own squared norm at which the search for positives starts and goes on, before all rows are looked at.
POSITIVE_SHARES = (0.5, 0.25)
#: Shares of a window's upper end at which the search for negatives starts and goes on, before the whole window is looked at.
NEGATIVE_SHARES = (0.8, 0.5)
_ALL = -(1 << 62)


def prepared(embeddings: DataFrame, shift: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """vec_id, label and q (whole numbers) of the rows that take part; where vec_id is divisible by ``shift`` the label moves on by one."""
    x = F.col("embedding")
    known = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding")).where("vec_id is not null and label is not null").where(known)
    moved = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long")).alias("q"))


def _dense(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` whole numbers; shorter ones are filled up with 0, longer ones cut, as an anchor has 0 there."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dims), np.int64)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row, flat = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
    use = at < dims
    out[row[use], at[use]] = flat[use]
    return out


class Anchors:
    """A block of anchors, their dimensions in the order of the block, and the norms that remain from each tile on."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[list[int]]):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.dims = max(map(len, vectors), default=0)
        q = np.zeros((len(ids), self.dims), np.int64)
        for k, v in enumerate(vectors):
            q[k, : len(v)] = v
        self.order = np.argsort(-(q.astype(float) ** 2).sum(0), kind="stable")
        self.q = q[:, self.order]
        self.cuts = [*range(0, self.dims, _TILE), self.dims]
        self.rest = remaining(self.q, self.cuts)

    def own(self) -> np.ndarray:
        """Squared norms."""
        return (self.q.astype(float) ** 2).sum(1)


def remaining(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of the rows from each cut on."""
    squares = x.astype(float) ** 2
    return np.sqrt(np.column_stack([squares[:, c:].sum(1) for c in cuts]))


def pairs_over(anchors: Anchors, use: np.ndarray, x: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (places in ``use``), rows and scores of all pairs with a score of theta (one for each of ``use``) or more."""
    q, rest, cuts = anchors.q[use], anchors.rest[use], anchors.cuts
    left = remaining(x, cuts)
    exact = bool(len(x)) and rest[:, 0].max(initial=0) * left[:, 0].max(initial=0) < _EXACT
    q, x = (q.astype(float), x.astype(float)) if exact else (q, x)
    able = lambda bound, least: bound * (1 + 1e-9) + 1e-3 >= least  # noqa: E731  rounding gives no pair up
    with np.errstate(divide="ignore", invalid="ignore"):
        cap = np.where(rest > 0, theta[:, None] / rest, np.where(theta[:, None] > 0, np.inf, -np.inf)).min(0)
    # tiles of a row that are indexed: from the first on, to where the rest is too short for every anchor
    indexed = np.argmax(np.column_stack([~able(left, cap[None, :]), np.ones(len(x), bool)]), axis=1)
    last = len(cuts) - 1
    score = np.zeros((len(use), len(x)), x.dtype)
    alive = np.zeros(score.shape, bool)
    alive[:, indexed > 0] = True
    for t in range(last):
        rows = np.flatnonzero((indexed > t) & alive.any(0))
        if not len(rows):
            break
        part = score[:, rows] + q[:, cuts[t] : cuts[t + 1]] @ x[rows, cuts[t] : cuts[t + 1]].T
        score[:, rows] = part
        alive[:, rows] &= able(part + rest[:, t + 1, None] * left[None, rows, t + 1], theta[:, None])
    a, r = np.nonzero(alive)
    total = score[a, r].astype(np.int64)
    done = np.minimum(indexed[r], last)
    for t in np.unique(done[done < last]):
        some = done == t
        total[some] += np.einsum("ij,ij->i", q[a[some], cuts[t] :], x[r[some], cuts[t] :]).astype(np.int64)
    keep = total >= theta[a]
    return a[keep], r[keep], total[keep]


def _search(rows: DataFrame, anchors: Anchors, window: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """window, vec_id, score: each task's k best rows of each window.

    window: the anchor of each window; low, high: the scores that count; same: rows with the anchor's label (not its vec_id), else with another one
    """
    shared = rows.sparkSession.sparkContext.broadcast((anchors, window, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, window, low, high = shared.value
        use, of = np.unique(window, return_inverse=True)
        best = topk.Best(len(window), k, low)
        first = np.searchsorted(of, np.arange(len(use) + 1))  # windows of an anchor follow one another
        for batch in batches:
            ids, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _dense(batch.column(2), anchors.dims)[:, anchors.order]
            step = max(16, _PAIRS // max(1, len(use)))
            for at in range(0, len(ids), step):
                theta = np.minimum.reduceat(best.least, first[:-1])
                a, r, score = pairs_over(anchors, use, x[at : at + step], theta)
                r = r + at
                alike = label[r] == anchors.labels[use[a]]
                ok = alike & (ids[r] != anchors.ids[use[a]]) if same else ~alike
                a, r, score = a[ok], r[ok], score[ok]
                n = first[a + 1] - first[a]
                pair = np.repeat(np.arange(len(a)), n)
                w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[a][pair]
                inside = (score[pair] >= best.least[w]) & (score[pair] <= high[w])
                best.add(w[inside], ids[r][pair][inside], score[pair][inside])
        yield pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.id), pa.array(best.score)], ["window", "vec_id", "score"])

    return kit.map_texts(rows.select("vec_id", "label", "q"), run, "window long, vec_id long, score long")


def _filled(rows: DataFrame, anchors: Anchors, window: np.ndarray, starts: list[np.ndarray], high: np.ndarray, same: bool, k: int) -> list[tuple[np.ndarray, DataFrame]]:
    """Rounds of _search() with lower and lower thresholds (``starts``, the last of which lets every row in that counts): windows that a round filled or that were in the last one, and its k best rows of each window asked for."""
    open_, out = np.arange(len(window)), []
    for low in starts:
        if not len(open_):
            break
        best = topk.merged(_search(rows, anchors, window[open_], low[open_], high[open_], same, k), "window", "vec_id", k)
        best = kit.stage(best)
        count = np.zeros(len(open_), np.int64)
        for r in best.groupBy("window").count().collect():  # a row for each window of the block at most
            count[r["window"]] = r["count"]
        full = (count == k) if low is not starts[-1] else np.ones(len(open_), bool)
        out.append((np.where(full, open_, -1), best))
        open_ = open_[~full]
    return out


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, most_anchors: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``, their positives the first rows of their label, the
    negatives of a positive the first rows of other labels from ``least`` to ``most`` percent of its score.
    most_anchors: about so many are held by the driver and broadcast at a time (with 64 dimensions some 2 MB)
    """
    spark = embeddings.sparkSession
    rows = kit.stage(prepared(embeddings))
    chosen = rows.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-chosen.count() // most_anchors))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(blocks):
        block = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        anchors = Anchors([r["vec_id"] for r in block], [r["label"] for r in block], [r["q"] for r in block])
        own, none = anchors.own(), np.full(len(block), 1 << 62)
        starts = [np.ceil(own * s).astype(np.int64) for s in POSITIVE_SHARES] + [np.full(len(block), _ALL)]
        pairs = []
        for full, best in _filled(rows, anchors, np.arange(len(block)), starts, none, True, positives):
            pairs += [(int(full[r["window"]]), r["rank"], r["vec_id"], r["score"]) for r in best.collect() if full[r["window"]] >= 0]  # some rows for each anchor of the block
        # a window is a positive's span of scores; those of one anchor follow one another
        pairs = sorted(p for p in pairs if p[3] >= 0)
        if not pairs:
            continue
        at, score = np.array([p[0] for p in pairs]), np.array([p[3] for p in pairs], np.int64)
        low, high = -((-least * score) // 100), most * score // 100
        starts = [np.maximum(low, np.ceil(high * s).astype(np.int64)) for s in NEGATIVE_SHARES] + [low]
        for full, best in _filled(rows, anchors, at, starts, high, False, negatives):
            named = [(k, int(anchors.ids[pairs[w][0]]), pairs[w][2], pairs[w][3]) for k, w in enumerate(full.tolist()) if w >= 0]
            names = spark.createDataFrame(named, "window long, anchor_id long, positive_id long, positive_score long")
            out = out.unionByName(best.join(F.broadcast(names), "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out
