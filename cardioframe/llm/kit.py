"""What the operators share: tables staged in the shared folder, and numpy views of whole texts.

Texts reach numpy as the UTF-8 bytes of an Arrow column. All separators are ASCII, so words are found
on bytes. A batch is cut into pieces of about ``PIECE`` bytes between documents, which bounds the memory
of a task whatever the partition holds; a document is never cut.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE = 1 << 20
#: Rows that Spark hands to Python at a time, unless the session says another number: its default of 10,000 texts is tens of MB in each worker and executor.
ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Random odd multipliers of the hash sums; the seed is fixed, so all tasks and runs agree.
_RNG = np.random.default_rng(20240229)
_NEAR, _FAR, _ORDER = (_RNG.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1) for n in (1 << 16, 1 << 12, 64))
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of its own only in a session on one machine that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it cuts the lineage, and the files outlive executors.

    Shuffle files of the finished write are released, since the table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path  # for drop()
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def base_columns(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and ``more``), whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of ROWS rows. The number is a setting of the session, read when the job runs; one that the user has set stays."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS) == "10000":
        conf.set(_ROWS, str(ROWS))
    return df.mapInArrow(run, schema)


_DRAW = 1 << 30


def draw(*columns: str) -> Column:
    """A hash of a row from 0 to 2 ** 30, by which samples take the smallest."""
    return F.pmod(F.xxhash64(*columns), F.lit(_DRAW))


def cut(most: int, total: int) -> int:
    """The draw() under which about 1.5 times ``most`` of ``total`` rows lie, and some twenty more."""
    return int(min(1.0, 1.5 * most / max(1, total) + 20 / max(1, total)) * _DRAW)


def drawn(rows: DataFrame, most: int, total: int, *columns: str) -> DataFrame:
    """The ``most`` of ``total`` rows with the smallest draw(); ties by the columns.

    Rows far over the expected cut are left out before the limit, so a task hands on about its share of the
    sample and not ``most`` rows, however many tasks there are.
    """
    return rows.where(draw(*columns) <= cut(most, total)).orderBy(draw(*columns), *columns).limit(most)


class Piece:
    """Some whole texts: their bytes, where each begins, and what the columns beside them hold."""

    def __init__(self, batch: pa.RecordBatch, texts: pa.Array):
        self.batch, self.n, self.texts = batch, len(texts), texts
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + self.n + 1].astype(np.int64)
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[Piece]:
    """Pieces of about PIECE bytes of text; a null text is an empty one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE)))
            yield Piece(batch.slice(at, to - at), texts.slice(at, to - at))
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit sum."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a piece: where each starts and ends, its document and the first word of each document."""

    def __init__(self, piece: Piece, lower: bool = False):
        buf, off, size = piece.buf, piece.off, len(piece.buf)
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        self.buf, self.piece = buf, piece
        self.is_word = word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[off[:-1][off[:-1] < size]] = False
        after[off[1:][off[1:] > 0] - 1] = False
        first = word & ~before
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, off)  # n + 1 of them
        self.count = np.diff(self.first)

    @functools.cached_property
    def index(self) -> np.ndarray:
        """The word that a byte belongs to."""
        begins = np.zeros(len(self.buf), bool)
        begins[self.start] = True
        return np.cumsum(begins) - 1

    @functools.cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.piece.n), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begins = np.cumsum(size) - size  # among the bytes of words
        at = np.arange(begins[-1] + size[-1], dtype=np.int32) - np.repeat(begins.astype(np.int32), size)
        long = size.max() > 0x10000
        value = _NEAR[at & 0xFFFF if long else at]
        value *= self.buf[self.is_word].astype(np.uint64) + np.uint64(1)
        if long:
            value *= np.where(at > 0xFFFF, _FAR[(at >> 16) & 0xFFF], np.uint64(1))
        return mix(np.add.reduceat(value, begins))

    def windows(self, hashes: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words, and hashes, of all runs of k words that lie in one document."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.full(n, np.uint64(k + (salt << 8)))
        for j in range(k):
            total += hashes[j : j + n] * _ORDER[(j + 32 * salt) & 63]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(total[at])


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n words a window of k words that starts at one of ``at`` covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + k, n), -1)
    return np.cumsum(step[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def codepoints_before(piece: Piece) -> np.ndarray:
    """For each byte, how many characters begin before it (one entry more than bytes)."""
    return np.concatenate([[0], np.cumsum((piece.buf & 0xC0) != 0x80)])
