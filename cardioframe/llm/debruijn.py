"""Substring dedup by De Bruijn compaction.

The edges of the graph are the runs of k words (a window); a window goes from the node of its first k - 1
words to that of its last k - 1, and the hashes of both nodes name it. Only windows that start in several
documents matter, so these are found first: every window has a minimizer, the least hash of its short word
runs, which equal windows share, and windows whose minimizer occurs in one document only are left out before
any window is shuffled. Neighbouring windows of one minimizer travel together as a run; each different run is
taken apart once, and its edges are aggregated to their first document and a place in it.

A node that one edge enters and one edge leaves, at the same place of the same source, is a joint, and the
place names it. Edges of a block of 16 places contract at the joints between them by an aggregation of bits;
from there on paths contract by joins on their joints: those at places that are an odd number of 16 words
first, then of 32, 64 ... words, so each join halves what is left. Runs of documents follow the paths
they lie on as spans, and a span counts only if its words have the digest of those at its source coordinates.

The words of spans whose source is an earlier document are removed. Edge cases: a null text has no words;
texts under k words have no window; rows with a null doc_id keep all words and are no source; repeated
rows are one document; rows of one doc_id with different texts are no sources of one another and lose places
of their own text each; of equal windows of one document any may name the place of the source; an empty table
gives an empty result; very long texts are held whole by one task each; of other columns only doc_id and text
are read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kit


def _minimizers(words: kit.Words, hashes: np.ndarray, k: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and minimizers of all windows of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(len(hashes) - short + 1, np.uint64(short))
    for j in range(short):
        total += hashes[j : j + len(total)] * kit._ORDER[63 - j]
    total = kit.mix(total)
    least = total[:n].copy()
    for j in range(1, k - short + 1):
        np.minimum(least, total[j : j + n], out=least)
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    return at, least[at]


def _marks(docs: DataFrame, k: int, short: int) -> DataFrame:
    """m, doc_id: the different minimizers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            words = kit.Words(piece)
            at, m = _minimizers(words, words.hashes(), k, short)
            doc = words.doc[at]
            new = np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]))[: len(m)]
            doc, m = doc[new], m[new]
            order = np.lexsort((m, doc))
            doc, m = doc[order], m[order]
            new = np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]))[: len(m)]
            yield pa.RecordBatch.from_arrays([pa.array(kit.signed(m[new])), piece.column("doc_id").take(pa.array(doc[new]))], ["m", "doc_id"])

    return kit.map_texts(docs.select("doc_id", "text"), run, "m long, doc_id long")


def _runs(docs: DataFrame, k: int, short: int) -> DataFrame:
    """The windows of docs (doc_id, copy, text, shared) whose minimizer is in ``shared``, neighbours of one minimizer together: nodes (hashes, one more than windows), doc_id, copy, at.

    A run has at most k - 1 windows, so the words of its first and last node are all of its words, and these two and its length name it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            words = kit.Words(piece)
            hashes = words.hashes()
            at, m = _minimizers(words, hashes, k, short)
            doc = words.doc[at]
            lists = piece.column("shared")
            owner = np.repeat(np.arange(piece.n), np.diff(lists.offsets.to_numpy()))
            key = lambda d, x: kit.mix(x + d.astype(np.uint64) * kit._ORDER[1])
            known = np.sort(key(owner, lists.flatten().to_numpy().view(np.uint64)))
            mine = key(doc, m)
            place = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            use = known[place] == mine if len(known) else np.zeros(len(mine), bool)
            at, doc, m = at[use], doc[use], m[use]
            begins, node = words.windows(hashes, k - 1)
            nodes = np.zeros(len(hashes) + 1, np.uint64)
            nodes[begins] = node
            new = np.append(True, (at[1:] != at[:-1] + 1) | (m[1:] != m[:-1]))[: len(at)]  # windows of two documents are never neighbours
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            starts = np.flatnonzero(rank % (k - 1) == 0)
            size = np.diff(np.append(starts, len(at))) + 1
            offsets = np.append(0, np.cumsum(size))
            at, doc = at[starts], doc[starts]
            flat = nodes[np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(kit.signed(flat))), piece.column("doc_id").take(pa.array(doc)), piece.column("copy").take(pa.array(doc)), pa.array((at - words.first[doc]).astype(np.int32))],
                ["nodes", "doc_id", "copy", "at"],
            )

    return kit.map_texts(docs, run, "nodes array<long>, doc_id long, copy long, at int")


def told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and copy, which tells texts of one doc_id apart: 0 where a doc_id has one row, else a hash of the text."""
    rows = kit.base_columns(docs)
    several = kit.stage(rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null"))
    return rows.join(several, "doc_id", "left").select("doc_id", "text", F.when(F.col("rows").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text")).alias("copy"))


#: Places of a block, within which paths contract by their joints' bits before any join.
BLOCK = 16


def compact(edges: DataFrame) -> DataFrame:
    """source, source_copy, at, windows: the nonbranching paths of a graph, staged. edges: u, v, source, source_copy, source_at, each edge once.

    Each edge is in one path. A path is also one stretch of its source, so a cycle ends where its places do.
    Rounds grow with the logarithm of the longest text; the table of a round is about half the one before it.
    """
    origin = ["source", "source_copy"]
    ends = edges.select(F.col("u").alias("node"), *origin, F.col("source_at").alias("place"), F.lit(1).alias("leaves"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), *origin, (F.col("source_at") + 1).alias("place"), F.lit(0).alias("leaves")))
    same = [F.min(c).eqNullSafe(F.max(c)).alias(f"same_{c}") for c in (*origin, "place")]
    nodes = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("leaves").alias("out"), *(F.min(c).alias(c) for c in (*origin, "place")), *same)
    joints = kit.stage(nodes.where("degree = 2 and out = 1 and same_source and same_source_copy and same_place").select(*origin, "place"))
    # blocks of places: the bits of their edges, of their joints, and of the joint at the next block's first place
    bit = lambda place: F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(BLOCK)))
    mark = lambda df, place, edge, joint: df.select(*origin, F.floor(place / BLOCK).cast("int").alias("block"), edge.alias("edge"), joint.alias("joint"))
    none, at, place = F.lit(0), F.col("source_at"), F.col("place")
    marked = mark(edges, at, bit(at), none).unionByName(mark(joints, place, none, bit(place)))
    marked = marked.unionByName(mark(joints.where(F.pmod(place, F.lit(BLOCK)) == 0), place - 1, none, F.lit(1 << BLOCK)))
    blocks = marked.groupBy(*origin, "block").agg(F.bit_or("edge").alias("edge"), F.bit_or("joint").alias("joint"))
    inner = f"(joint & {(1 << BLOCK) - 2})"
    begins = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.getbit(F.expr(f"edge & ~{inner}"), i) == 1)
    pieces = blocks.select(*origin, "block", "joint", F.expr(inner).alias("inner"), F.explode(begins).alias("i"))
    # a piece goes on for as many edges as there are joints in a row after its first one
    more = "bit_count(((inner >> (i + 1)) ^ ((inner >> (i + 1)) + 1)) >> 1)"
    pieces = pieces.select(*origin, "joint", (F.col("block") * BLOCK + F.col("i")).alias("at"), "i", F.expr(f"cast(1 + {more} as int)").alias("windows"))
    border = lambda i, b: (i == b) & (F.getbit("joint", F.lit(b)) == 1)
    paths = kit.stage(pieces.select(*origin, "at", "windows", border(F.col("i"), 0).alias("before"), border(F.col("i") + F.col("windows"), BLOCK).alias("after")))
    lowest = lambda place: place.bitwiseAND(-place)
    rounds = (joints.agg(F.max(lowest(place))).first()[0] or 0).bit_length()
    tables = [joints, paths]
    for r in range(BLOCK.bit_length() - 1, rounds):
        left_open = tables[-1].where("before or after")
        joins_after = F.col("after") & (lowest(F.col("at") + F.col("windows")) == 1 << r)
        joins_before = F.col("before") & (lowest(F.col("at")) == 1 << r)
        first = left_open.where(joins_after).withColumn("place", F.col("at") + F.col("windows"))
        second = left_open.where(joins_before).select(*origin, F.col("at").alias("place"), F.col("windows").alias("more"), F.col("after").alias("on"))
        merged = first.join(second, [*origin, "place"]).select(*origin, "at", (F.col("windows") + F.col("more")).alias("windows"), "before", F.col("on").alias("after"))
        tables.append(kit.stage(left_open.where(~joins_after & ~joins_before).unionByName(merged)))
    done = [t.where("not before and not after").select(*origin, "at", "windows") for t in tables[1:]]
    out = kit.stage(reduce(DataFrame.unionByName, done))
    kit.drop(*tables)
    return out


def spans(docs: DataFrame, k: int = 13, short: int = 5) -> DataFrame:
    """doc_id, copy, at, windows, source, source_copy, source_at: the stretches of compacted paths that documents share with an earlier one, staged. docs: as told_apart() gives them.

    k: words of a window; short: words of the runs that minimizers are chosen from
    """
    texts = docs.where("doc_id is not null")
    marks = kit.stage(_marks(texts, k, short))
    several = marks.groupBy("m").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("m")
    shared = kit.stage(marks.join(several, "m").groupBy("doc_id").agg(F.collect_list("m").alias("shared")))
    kit.drop(marks)
    runs = kit.stage(_runs(texts.join(shared, "doc_id"), k, short))
    kit.drop(shared)
    # each different run once, with its first document and the last one
    different = kit.stage(runs.groupBy("nodes").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("copy", "doc_id").alias("source_copy"), F.min_by("at", "doc_id").alias("at")))
    windows = different.select("*", F.explode(F.sequence(F.lit(0), F.size("nodes") - 2)).alias("i"))
    windows = windows.select(F.col("nodes")[F.col("i")].alias("u"), F.col("nodes")[F.col("i") + 1].alias("v"), "i", "source", "last", "source_copy", "at", (F.col("at") + F.col("i")).alias("source_at"))
    first = windows.groupBy("u", "v").agg(F.min("source").alias("source"), F.max("last").alias("last"), F.min_by("source_copy", "source").alias("source_copy"), F.min_by("source_at", "source").alias("source_at"))
    graph = kit.stage(first.where("source < last").drop("last"))
    paths = compact(graph)
    # an edge finds its path among those of its block, which are as many as the block has places at most
    of_block = lambda place: F.floor(place / BLOCK).cast("int")
    end = F.col("at") + F.col("windows")
    places = paths.select("source", "source_copy", F.col("at").alias("path"), end.alias("end"), F.explode(F.sequence(of_block(F.col("at")), of_block(end - 1))).alias("block"))
    placed = graph.withColumn("block", of_block(F.col("source_at"))).join(places, ["source", "source_copy", "block"]).where("source_at >= path and source_at < end")
    placed = kit.stage(placed.select("u", "v", "source", "source_copy", "source_at", "path"))
    kit.drop(paths, graph)
    # the stretches of each different run on paths: a window between two of one path and shift consists of their words, so stretches have no gaps
    place = [F.col("source").alias("run_source"), F.col("source_copy").alias("run_copy"), F.col("at").alias("run_at")]  # where it was found first, which is less to shuffle than its hashes
    met = windows.select("u", "v", "i", *place).join(placed, ["u", "v"])
    met = met.groupBy("run_source", "run_copy", "run_at", "source", "source_copy", "path", (F.col("source_at") - F.col("i")).alias("origin")).agg(F.min("i").alias("i"), F.count("*").cast("int").alias("windows"))
    met = kit.stage(met)
    kit.drop(placed)
    name = [F.col("nodes")[0].alias("head"), F.element_at("nodes", -1).alias("tail"), F.size("nodes").alias("long")]
    named = kit.stage(met.join(different.select(*name, *place), ["run_source", "run_copy", "run_at"]).drop("run_source", "run_copy", "run_at"))
    kit.drop(met, different)
    here = runs.select(*name, "doc_id", "copy", "at").join(named, ["head", "tail", "long"]).where("doc_id > source")
    found = kit.stage(here.select("doc_id", "copy", (F.col("at") + F.col("i")).alias("at"), "windows", "source", "source_copy", "path", (F.col("origin") - F.col("at")).alias("shift")))
    kit.drop(runs, named)
    # repeated rows of a document say the same; they can only be where texts are told apart
    hits = found.where("copy = 0").unionByName(found.where("copy <> 0").distinct())
    along = ["doc_id", "copy", "source", "source_copy", "path", "shift"]
    stretches = kit.stage(hits.groupBy(*along).agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("windows")).alias("end"), F.sum("windows").cast("int").alias("windows")))
    whole = F.col("end") - F.col("at") == F.col("windows")
    # a document that leaves a path and meets it again has several spans: places less the windows before them are one number in each
    before = F.coalesce(F.sum("windows").over(Window.partitionBy(*along).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    broken = hits.join(stretches.where(~whole).select(*along), along, "left_semi").withColumn("run", F.col("at") - before)
    parts = broken.groupBy(*along, "run").agg(F.min("at").alias("at"), F.sum("windows").cast("int").alias("windows"))
    out = stretches.where(whole).drop("end").unionByName(parts.drop("run"))
    out = kit.stage(out.select("doc_id", "copy", "at", "windows", "source", "source_copy", (F.col("at") + F.col("shift")).alias("source_at")))
    kit.drop(stretches, found)
    return out


class _Joined:
    """The words of a piece, each with one space after it, as bytes; ``at`` is where each begins (one entry more than words)."""

    def __init__(self, words: kit.Words):
        self.at = np.append(0, np.cumsum(words.end - words.start + 1))
        out, body = np.full(self.at[-1], 32, np.uint8), np.ones(self.at[-1], bool)
        body[self.at[1:] - 1] = False
        out[body] = words.buf[words.is_word]
        self.bytes = out.tobytes()

    def digest(self, at: int, n: int) -> bytes:
        """Of n words from ``at`` on, joined by one space."""
        return hashlib.blake2b(self.bytes[self.at[at] : self.at[at + n] - 1], digest_size=16).digest()

    def without(self, first: int, end: int, gone: list[tuple[int, int]]) -> tuple[bytes, int]:
        """The words from ``first`` to ``end`` outside the stretches ``gone``, joined by one space, and how many are inside."""
        left, removed, place = [], 0, first
        for a, b in sorted(gone):
            if b > place:
                left.append(self.bytes[self.at[place] : self.at[max(a, place)]])
                removed += b - max(a, place)
                place = b
        left.append(self.bytes[self.at[place] : self.at[end]])
        return b"".join(left)[:-1], removed


def source_digests(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """source, source_copy, source_at, windows, digest: of the words that the spans have at their sources."""
    places = found.groupBy("source", "source_copy").agg(F.collect_set(F.struct("source_at", "windows")).alias("places"))
    places = places.select(F.col("source").alias("doc_id"), F.col("source_copy").alias("copy"), F.col("places.source_at").alias("at"), F.col("places.windows").alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            words = kit.Words(piece)
            joined, first = _Joined(words), words.first.tolist()
            for d, (at, windows) in enumerate(zip(piece.column("at").to_pylist(), piece.column("windows").to_pylist(), strict=True)):
                owner = pa.array([d] * len(at))
                digests = [joined.digest(first[d] + a, w + k - 1) for a, w in zip(at, windows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(owner), piece.column("copy").take(owner), pa.array(at, pa.int32()), pa.array(windows, pa.int32()), pa.array(digests, pa.binary())],
                    ["source", "source_copy", "source_at", "windows", "digest"],
                )

    # repeated rows of a document give equal digests
    return kit.map_texts(docs.join(places, ["doc_id", "copy"]), run, "source long, source_copy long, source_at int, windows int, digest binary").distinct()


def remove(docs: DataFrame, k: int = 13, short: int = 5, kept: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by one space). kept: False leaves that column out."""
    rows = told_apart(docs)
    found = spans(rows, k, short)
    digests = kit.stage(source_digests(rows, found, k))
    known = found.join(digests, ["source", "source_copy", "source_at", "windows"])
    of_doc = known.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("at", "windows", "digest")).alias("gone")).select("doc_id", "copy", *(F.col(f"gone.{c}").alias(c) for c in ("at", "windows", "digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            words = kit.Words(piece)
            joined, first = _Joined(words), words.first.tolist()
            texts, removed = [], []
            for d, lists in enumerate(zip(*(piece.column(c).to_pylist() for c in ("at", "windows", "digest")), strict=True)):
                spans = ((first[d] + a, w + k - 1, digest) for a, w, digest in zip(*(x or () for x in lists), strict=True))
                text, n = joined.without(first[d], first[d + 1], [(a, a + n) for a, n, digest in spans if joined.digest(a, n) == digest])
                texts.append(text)
                removed.append(n)
            out = [piece.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            if kept:
                out.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(out)])

    texts = rows.join(of_doc, ["doc_id", "copy"], "left")
    return kit.map_texts(texts, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept)
