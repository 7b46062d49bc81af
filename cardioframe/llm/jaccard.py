"""N-gram Jaccard join on token-combination prefixes, exact, without all pairs of a group.

A document is the set of its 5-word shingles (words split at white space, A-Z in lower case); with fewer
words its whole sequence is its one shingle, without words the set is empty. Two documents are linked when
their sets overlap in at least 80 % of their union.

Equal sets are one class. A sketch of shingle counts over the whole corpus gives each shingle a level of
frequency, 0 for rare ones; all sets are ordered by level, then by hash. Sets of u and v shingles that are
linked overlap in a = 4/9 (u + v) at least, so they share a shingle among the first u - a + 1 and v - a + 1,
and two among one more. Rare prefix shingles are indexed alone. Frequent ones are indexed in combinations of
two, in sets of up to ``small`` shingles; larger sets, whose combinations would be too many, index them alone
under a key of their own, as do small sets that a larger one can be linked with. An entry knows its place, so
it is put only under the narrow bands of sizes for which its place lies in the prefix: for sets of equal size
that is a ninth of the set, not a fifth.

In a round, sets that share a key are verified against one pivot, the set in which the key comes first, which
has fewest shingles of its own; of several pivots a set takes the one that it shares most keys with. Then
only pairs that still lie in two components are verified one by one. So each link is found or is a link
inside one component. Before whole sets are compared, bitmaps of parities bound how much they differ.

Edge cases: a null text is an empty set; empty sets are linked with nothing, also not with one another;
rows with a null doc_id have no component and link nothing; repeated rows are equal sets of one class, and
rows of one doc_id with different texts are judged by their own texts; an empty table gives an empty result;
very long texts are sets like others, held by one task each; of other columns only doc_id and text are read,
so their names cannot clash; ties between pivots go to the smaller salted number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit
from .components import components

WORDS, PERCENT = 5, 80
_CELLS, _BLOCKS = 22, 16
#: Sizes of a band lie within this ratio; sets that can be linked are at most 1.25 apart.
_BAND = 1.25**0.25
_TAG = np.uint64(0x9E3779B97F4A7C15)
#: Orders in which pivots are the first: node ids XOR these.
_SALTS = tuple(int(x) for x in np.random.default_rng(5).integers(0, 2**62, 64))


def shingles(words: kit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of the different shingles of a piece, sorted by document and hash."""
    hashes = words.hashes()
    at, h = words.windows(hashes, WORDS)
    docs, out = [words.doc[at]], [h]
    for k in range(1, WORDS):
        short = np.flatnonzero(words.count == k)
        if len(short):
            total = np.full(len(short), np.uint64(k))
            for j in range(k):
                total += hashes[words.first[short] + j] * kit._ORDER[j]
            docs.append(short)
            out.append(kit.mix(total))
    doc, h = np.concatenate(docs), np.concatenate(out)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))[: len(doc)]
    return doc[new], h[new]


def _digests(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and 128 bits of hash of each document's set."""
    first = np.searchsorted(doc, np.arange(n + 1))
    total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    a, b = total(kit.mix(h ^ _TAG)), total(kit.mix(h * _TAG + np.uint64(77)))
    d1, d2 = a[first[1:]] - a[first[:-1]], b[first[1:]] - b[first[:-1]]
    return np.diff(first), kit.signed(kit.mix(d1)), kit.signed(kit.mix(d2))


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _CELLS)).astype(np.int64)


def _measure(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, d1, d2), and of the count sketch of each task (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _CELLS, np.uint32)
        for piece in kit.pieces(batches):
            doc, h = shingles(kit.Words(piece, lower=True))
            np.add.at(counts, _cells(h), 1)
            n, d1, d2 = _digests(doc, h, piece.n)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), pa.array(d1), pa.array(d2), pa.nulls(piece.n, pa.int32()), pa.nulls(piece.n, pa.binary())], names)
        if counts.any():
            size = len(counts) // _BLOCKS
            blocks = [_packed(counts[i * size : (i + 1) * size]) for i in range(_BLOCKS)]
            none = pa.nulls(_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names)

    names = ["doc_id", "n", "d1", "d2", "block", "counts"]
    return kit.map_texts(kit.base_columns(docs), run, "doc_id long, n long, d1 long, d2 long, block int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    """Most counts are small or zero, so they shrink well."""
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.int64)


def _levels(measured: DataFrame, spread: int = 32) -> np.ndarray:
    """The level of each cell: 0 where it holds about as many shingles as most cells, else one more with each doubling of the excess. A byte a cell, 4 MB whatever the corpus.

    Sketches of tasks are added up in two steps, so that no task adds more than its share.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = _unpacked(counts.as_py())
                sums[block] = sums[block] + x if block in sums else x
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed(x)], pa.binary())], ["block", "counts"])

    rows = measured.where("block is not null").select("block", "counts")
    part = rows.repartition(spread, "block", F.xxhash64("counts")).mapInArrow(add, "block int, counts binary")
    got = part.repartition(_BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect()
    counts = np.zeros((_BLOCKS, (1 << _CELLS) // _BLOCKS), np.int64)
    for r in got:
        counts[r["block"]] += _unpacked(bytes(r["counts"]))
    usual = float(np.median(counts))
    noise = 3 * np.sqrt(usual) + 3
    excess = (counts.ravel() - usual) / noise
    return np.where(excess > 1, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def prefix_keys(doc: np.ndarray, h: np.ndarray, n: int, levels: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, index keys of their longest prefixes, and the place of each; doc and h as shingles() gives them.

    The place of a combination is that of its later shingle less one, as two shingles are shared in a prefix
    that is longer by one.
    """
    level = levels[_cells(h)]
    order = np.lexsort((h, level, doc))
    doc, h, hot = doc[order], h[order], level[order] > 0
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)
    length = size + (-PERCENT * size // 100) + 1  # n - ceil(0.8 n) + 1
    place, of = np.arange(len(h)) - first[doc], size[doc]
    within = (place < length[doc]) & (of > 1)  # a set of one shingle is linked with equal sets only
    cold = within & ~hot
    alone = within & hot & (of > small * PERCENT // 100 - 1)
    docs, keys, places = [doc[cold], doc[alone]], [h[cold], kit.mix(h[alone] + _TAG)], [place[cold], place[alone]]
    more = (place <= length[doc]) & hot & (of > 1) & (of <= small)
    for d in np.unique(doc[more & within]):
        at = np.flatnonzero(more[first[d] : first[d + 1]])
        own = h[first[d] + at]
        i, j = np.triu_indices(len(own), 1)
        a, b = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
        keys.append(kit.mix(a * kit._ORDER[0] + b * kit._ORDER[1]))
        docs.append(np.full(len(i), d))
        places.append(at[j] - 1)
    return np.concatenate(docs), np.concatenate(keys), np.concatenate(places)


def _entries(docs: DataFrame, levels: np.ndarray, small: int) -> DataFrame:
    """key, d1, at: the index. Equal sets of a piece are indexed once."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            doc, h = shingles(kit.Words(piece, lower=True))
            _, d1, _ = _digests(doc, h, piece.n)
            _, once = np.unique(d1, return_index=True)
            use = np.zeros(piece.n, bool)
            use[once] = True
            doc, h = doc[use[doc]], h[use[doc]]
            of, key, place = prefix_keys(doc, h, piece.n, shared.value, small)
            yield pa.RecordBatch.from_arrays([pa.array(kit.signed(key)), pa.array(d1[of]), pa.array(place.astype(np.int32))], ["key", "d1", "at"])

    return kit.map_texts(kit.base_columns(docs.where("doc_id is not null")), run, "key long, d1 long, at int")


def parities(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document a bitmap of at least four bits a shingle, a power of two, in which a bit says whether an odd number of shingles falls on it: all bitmaps one after the other as 64-bit numbers, and the first of each (n + 1 of them)."""
    size = np.bincount(doc, minlength=n)
    bits = np.left_shift(np.int64(64), np.ceil(np.log2(np.maximum(1, size / 16))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(bits)])
    odd = np.bincount(first[doc] + (h & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=first[-1]) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64), first // 64


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """c, n, tokens and bits (parities()) of the classes in ``wanted`` (c, doc_id, d1, d2), from the text of one document each; repeated rows give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kit.pieces(batches):
            doc, h = shingles(kit.Words(piece, lower=True))
            n, d1, d2 = _digests(doc, h, piece.n)
            first = np.searchsorted(doc, np.arange(piece.n + 1)).astype(np.int32)
            bits, begins = parities(doc, h, piece.n)
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for at, x in ((first, kit.signed(h)), (begins, bits))]
            rows = pa.RecordBatch.from_arrays([piece.column("c"), pa.array(n), *lists], ["c", "n", "tokens", "bits"])
            same = (d1 == piece.column("d1").to_numpy()) & (d2 == piece.column("d2").to_numpy())
            yield rows.filter(pa.array(same))

    texts = kit.base_columns(docs).join(wanted.select("doc_id", "c", "d1", "d2"), "doc_id")
    return kit.map_texts(texts, run, "c long, n long, tokens array<long>, bits array<long>")


def _fits(a: Column, b: Column) -> Column:
    """Sets of these sizes can be linked."""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _linked(common: Column, both: Column) -> Column:
    """Whether an overlap of ``common`` links sets of ``both`` shingles together."""
    return 100 * common >= PERCENT * (both - common)


def _differ(x: Column, y: Column) -> Column:
    """In how many bits two bitmaps differ, at most as many as shingles lie in one set only. The longer one, if it is, is twice as long and folded."""
    xor = lambda a, b: F.zip_with(a, b, lambda p, q: p.bitwiseXOR(q))
    folded = lambda a, n: F.when(F.size(a) == n, a).otherwise(xor(F.slice(a, 1, n), F.slice(a, n + 1, n)))
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(xor(folded(x, n), folded(y, n)), F.lit(0), lambda a, w: a + F.bit_count(w))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of those pairs u, v of classes whose sets are linked. Pairs whose bitmaps differ in too many bits are settled first, so that whole sets move only for pairs that can be linked."""

    def side(df: DataFrame, name: str, what: str) -> DataFrame:
        return df.select(F.col("c").alias(name), F.col("n").alias(f"n{name}"), F.col(what).alias(f"x{name}"))

    both = F.col("nu") + F.col("nv")
    near = pairs.join(side(sets, "u", "bits"), "u").join(side(sets, "v", "bits"), "v")
    near = kit.stage(near.where(9 * _differ(F.col("xu"), F.col("xv")) <= both).select("u", "v").distinct())
    needed = near.select(F.col("u").alias("c")).unionByName(near.select(F.col("v").alias("c"))).distinct()
    few = kit.stage(sets.select("c", "n", "tokens").join(needed, "c", "left_semi"))
    common = F.size(F.array_intersect("xu", "xv")).cast("long")
    out = kit.stage(near.join(side(few, "u", "tokens"), "u").join(side(few, "v", "tokens"), "v").where(_linked(common, both)).select("u", "v").distinct())
    kit.drop(few, near)
    return out


def _open(labelled: DataFrame) -> DataFrame:
    """Entries under keys that more than one component shares."""
    keys = labelled.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return labelled.join(keys, "key", "left_semi")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def _overlap(n: Column, m: Column) -> Column:
    """The least overlap that links sets of n and m shingles."""
    return F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT))


def _banded(entries: DataFrame) -> DataFrame:
    """Keys made narrower by set size, with ``lesser``: whether the entry's place is in the prefix for sets at least as large as its own.

    An entry lies under the band of its own size and under those of the smaller sets for which its place is in
    the prefix; so linked sets meet in the band of the smaller one. Keys without two sets, one of them lesser,
    are left out, and of keys with the same sets one stays, as the others would only find the same pairs.
    """
    log = float(np.log(_BAND))
    band = lambda n: F.floor(F.log(n.cast("double")) / log).cast("int")
    least = F.ceil(F.lit(PERCENT) * F.col("n") / 100)
    lowest = lambda b: F.greatest(least, F.ceil(F.pow(F.lit(_BAND), b) - 1e-6))
    fit = F.filter(F.sequence(band(least), band(F.col("n"))), lambda b: F.col("at") <= F.col("n") - _overlap(F.col("n"), F.least(F.col("n"), lowest(b))))
    lesser = (F.col("band") == band(F.col("n"))) & (F.col("at") <= F.col("n") - _overlap(F.col("n"), F.col("n")))
    each = entries.select("key", "c", "n", "at", F.explode(fit).alias("band")).select(F.xxhash64("key", "band").alias("key"), "c", "n", "at", lesser.alias("lesser"))
    alike = each.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.bool_or("lesser").alias("some"), F.bit_xor(F.xxhash64("c", "lesser")).alias("x"), F.bit_xor(F.xxhash64("c", "lesser", F.lit(1))).alias("y"))
    kept = alike.where("a < b and some").groupBy("a", "b", "x", "y").agg(F.min("key").alias("key")).select("key")
    return each.join(kept, "key", "left_semi")


def _within(n: str, at: str, m: str, at_m: str) -> Column:
    """The sizes can be linked, and both places lie in the prefixes for them."""
    a = _overlap(F.col(n), F.col(m))
    return _fits(F.col(n), F.col(m)) & (F.col(at) <= F.col(n) - a) & (F.col(at_m) <= F.col(m) - a)


def _pairs(entries: DataFrame, count_links: bool, most: int = 16) -> DataFrame:
    """u, v: a class whose entry is lesser, and one at least as large under the same key, of sizes that can be linked, in two components unless links are counted.

    most: a pair is made under the first of the keys that it shares, as far as the first ``most`` keys of both tell.
    Places are not compared here: of keys with the same sets, which have other places, one has been kept.
    """
    first = lambda rows, name: rows.groupBy("c").agg(F.slice(F.sort_array(F.collect_list("key")), 1, most).alias(name))
    lesser = entries.where("lesser").join(first(entries.where("lesser"), "low"), "c").select("key", "c", "n", "root", "low")
    other = entries.join(first(entries, "low2"), "c").select("key", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("root").alias("root2"), "low2")
    both = F.array_intersect("low", "low2")
    larger = (F.col("n") < F.col("n2")) | (F.col("n") == F.col("n2")) & (F.col("c") < F.col("c2"))
    rule = F.lit(True) if count_links else F.col("root") != F.col("root2")
    keep = rule & larger & _fits(F.col("n"), F.col("n2")) & ((F.size(both) == 0) | (F.array_min(both) == F.col("key")))
    return lesser.join(other, "key").where(keep).select(F.col("c").alias("u"), F.col("c2").alias("v"))


def _to_pivots(entries: DataFrame, salt: int) -> DataFrame:
    """u, v: classes and the pivot that each shares most keys with, of those in another component."""
    first = entries.groupBy("key").agg(F.min(F.struct("at", F.col("c").bitwiseXOR(F.lit(salt)).alias("x"), "n", "root")).alias("p"))
    pivot = first.select("key", F.col("p.x").bitwiseXOR(F.lit(salt)).alias("c2"), F.col("p.n").alias("n2"), F.col("p.at").alias("at2"), F.col("p.root").alias("root2"))
    met = entries.join(pivot, "key").where((F.col("root") != F.col("root2")) & _within("n", "at", "n2", "at2"))
    votes = met.groupBy("c", "c2").agg(F.count("*").alias("votes"))
    return votes.groupBy("c").agg(F.max(F.struct("votes", "c2")).alias("p")).select(F.col("c").alias("u"), F.col("p.c2").alias("v"))


def join(docs: DataFrame, small: int = 100, rounds: int = 2, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row, and n_links (how many other documents it is linked to) if they are counted.

    small: sets of up to so many shingles index combinations of frequent ones
    rounds: how often sets are verified against pivots before pairs are
    count_links: verify all pairs of different sets that can be linked, those inside a component included; their
        number grows with the square of a group's size
    """
    measured = kit.stage(_measure(docs))
    rows = measured.where("block is null").select("doc_id", "n", "d1", "d2")
    levels = _levels(measured)
    classes = rows.where("doc_id is not null and n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    classes = kit.stage(classes.withColumn("c", F.monotonically_increasing_id()))
    entries = kit.stage(_entries(docs, levels, small))
    shared = kit.stage(entries.groupBy("key").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("key"))
    wide = kit.stage(entries.join(shared, "key").groupBy("key", "d1").agg(F.min("at").alias("at")))
    kit.drop(entries, shared)
    found = kit.stage(_banded(wide.join(classes.select("d1", "c", "n"), "d1").select("key", "c", "n", "at")))
    kit.drop(wide)
    sets = kit.stage(_sets(docs, classes.join(found.select("c").distinct(), "c", "left_semi")))
    todo, checked, links, roots = found.withColumn("root", F.col("c")), [], [], None
    rounds = 0 if count_links else rounds
    for r in range(rounds + 1):
        pairs = _ordered(_to_pivots(todo, _SALTS[r]) if r < rounds else _pairs(todo, count_links))
        pairs = kit.stage(pairs.join(reduce(DataFrame.unionByName, checked), ["u", "v"], "left_anti") if checked else pairs)
        links.append(_verify(pairs, sets))
        checked.append(pairs)
        roots = components(reduce(DataFrame.unionByName, links)).select(F.col("node").alias("c"), "root")
        if r < rounds:
            todo = kit.stage(_open(found.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))))
            if todo.isEmpty():
                break
    kit.drop(sets)
    named = classes.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root")
    if count_links:
        copies = kit.stage(rows.where("doc_id is not null and n > 0").distinct().groupBy("d1", "d2").agg(F.count("*").alias("copies")).join(classes.select("d1", "d2", "c"), ["d1", "d2"]).select("c", "copies"))
        linked = reduce(DataFrame.unionByName, links)
        ends = linked.select(F.col("u").alias("c"), F.col("v").alias("other")).unionByName(linked.select(F.col("v").alias("c"), F.col("u").alias("other"))).distinct()
        near = ends.join(copies.withColumnRenamed("c", "other"), "other").groupBy("c").agg(F.sum("copies").alias("near"))
        of_class = of_class.join(copies, "c").join(near, "c", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("near", F.lit(0)))
    more = ["n_links"] if count_links else []
    of_class = kit.stage(of_class.select("d1", "d2", "component_id", *more))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.join(of_class, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), *(F.when(F.col("doc_id").isNotNull(), F.coalesce(c, F.lit(0).cast("long"))).otherwise(0).alias(c) for c in more))
