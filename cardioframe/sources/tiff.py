"""Kymograph image files: a data source that reads strips in parallel, and a writer.

Files are listed once, with their sizes and without being opened. Small files share a partition; a large one is dealt out by
its strips, each part reading the file's directory and its own strips only. Rows are pieces of tiles (see operators.images), so no task
holds an image. Grey images of 8 to 64 bits are read, plain or packed (run lengths); images of several samples or pages are
skipped, as only (row, frame) images are kymographs. Files are opened through Arrow's file systems, by their URI.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import urllib.parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

NAME = "grey_tiff"
SCHEMA = "file string, path string, ty int, tx int, y int, height int, width int, rows int, pixels array<double>, problem string"
#: Tags of the format that are read, and the sizes of its types. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 339
PLAIN, PACKED = 1, 32773
TYPES = {1: "B", 3: "H", 4: "I"}


class Broken(ValueError):
    """A file that is no image of this kind; says which and why."""


def directory(f, size: int) -> dict | None:
    """Tags of a file's only image, or None for what is to be skipped (several samples or pages)."""
    head = f.read(8)
    if len(head) < 8 or head[:4] not in (b"II*\0", b"MM\0*"):
        raise Broken("it does not begin as a TIFF")
    order = "<" if head[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", head[4:])
    if not 8 <= at <= size - 2:
        raise Broken("its directory lies outside the file")
    f.seek(at)
    (n,) = struct.unpack(order + "H", f.read(2))
    raw = f.read(12 * n + 4)
    if len(raw) < 12 * n + 4:
        raise Broken("its directory is cut off")
    tags: dict = {"order": order}
    for k in range(n):
        tag, kind, count, value = struct.unpack(order + "HHI4s", raw[12 * k : 12 * k + 12])
        if kind not in TYPES:
            continue
        length = struct.calcsize(TYPES[kind]) * count
        if length > 4:
            (where,) = struct.unpack(order + "I", value)
            f.seek(where)
            value = f.read(length)
        if len(value) < length:
            raise Broken("a tag is cut off")
        tags[tag] = struct.unpack(f"{order}{count}{TYPES[kind]}", value[:length])
    if struct.unpack(order + "I", raw[-4:])[0] or tags.get(SAMPLES, (1,))[0] != 1:
        return None
    if not {WIDTH, HEIGHT, OFFSETS} <= tags.keys() or 0 in (tags[WIDTH][0], tags[HEIGHT][0]):
        raise Broken("it has no size or no strips")
    return tags


def unpack(data: bytes, size: int) -> bytes:
    """Run lengths undone: a length under 128 is followed by one more bytes than it says, over 128 by one byte that repeats."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def strips(f, tags: dict, part: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and pixels of the strips of one of ``parts`` parts of a file."""
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    step = min(tags.get(ROWS, (height,))[0], height) or height
    bits, kind = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    code = {1: "u", 2: "i", 3: "f"}.get(kind)
    if bits not in (8, 16, 32, 64) or code is None or code == "f" and bits < 32:
        raise Broken(f"pixels of {bits} bits of kind {kind} are not read")
    packing = tags.get(COMPRESSION, (PLAIN,))[0]
    if packing not in (PLAIN, PACKED):
        raise Broken(f"compression {packing} is not read")
    n = -(-height // step)
    if len(tags[OFFSETS]) != n:
        raise Broken(f"it has {len(tags[OFFSETS])} strips for {n} times {step} rows")
    for k in range(n):
        if k * parts // n != part:
            continue
        rows = min(step, height - k * step)
        size = rows * width * bits // 8
        f.seek(tags[OFFSETS][k])
        data = f.read(tags[COUNTS][k] if COUNTS in tags else size)
        data = unpack(data, size) if packing == PACKED else data
        if len(data) < size:
            raise Broken(f"strip {k} is cut off")
        yield k * step, np.frombuffer(data[:size], np.dtype(f"{tags['order']}{code}{bits // 8}")).reshape(rows, width).astype(float)


class Part(InputPartition):
    """Files (path, part, parts, size) of one task."""

    def __init__(self, files: list[tuple[str, int, int, int]]):
        self.files = files


def _open(path: str):
    """The file system of a path or URI, and the path in it. Names of kymographs hold blanks, which a URI may not."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return fs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:@?=&"))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif*")
        self.side, self.split = int(options.get("side", 256)), int(options.get("split", 16 << 20))
        self.report = options.get("broken", "raise") == "report"
        self.names: set[str] | None = None

    def partitions(self) -> list[Part]:
        where, base = _open(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        found = [i for i in where.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)]
        out, held, bytes_ = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            if self.names is not None and i.base_name not in self.names:
                continue
            path, parts = scheme + i.path, max(1, -(-i.size // self.split))
            if parts > 1:
                out += [Part([(path, k, parts, i.size)]) for k in range(parts)]
                continue
            if held and bytes_ + i.size > self.split:
                out.append(Part(held))
                held, bytes_ = [], 0
            held.append((path, 0, 1, i.size))
            bytes_ += i.size
        return out + [Part(held)] * bool(held) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.list_(pa.float64()), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for path, part, parts, size in partition.files:
            where, base = _open(path)
            try:
                with where.open_input_file(base) as f:
                    tags = directory(f, size)
                    for first, pixels in strips(f, tags, part, parts) if tags else ():
                        yield batch(self._pieces(path, tags, first, pixels))
            except (Broken, struct.error) as e:
                if not self.report:
                    raise Broken(f"{path}: {e}") from None
                # each part finds the same fault, or its own
                yield batch([(os.path.basename(path), path, *[None] * 7, f"{e}")])

    def _pieces(self, path: str, tags: dict, first: int, pixels: np.ndarray) -> list[tuple]:
        height, width = tags[HEIGHT][0], tags[WIDTH][0]
        out = []
        for y in range(first // self.side * self.side, first + len(pixels), self.side):
            a, b = max(y, first), min(y + self.side, first + len(pixels))
            for x in range(0, width, self.side):
                cut = pixels[a - first : b - first, x : x + self.side]
                out.append((os.path.basename(path), path, y // self.side, x // self.side, a, height, width, b - a, cut.T.ravel(), None))
        return out


class NamedReader(Reader):
    """A reader for sessions that hand filters down."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Names of files that are asked for choose files before any is opened; other filters are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (NamedReader if self.options.get("pushed") == "true" else Reader)(self.options)


def pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pieces of the tiles of all images below a folder. Options: pattern, side, split (bytes of a partition), broken (raise, or report: a row with ``problem``)."""
    spark.dataSource.register(Source)
    # Spark refuses readers that take filters in a session that does not hand them down
    reader = spark.read.format(NAME).option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def image_tiles(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, ty, tx, height, width, pixels: tiles as operators.images takes them. Images that are skipped or, with broken=report, at fault are left out; see pieces()."""
    found = pieces(spark, path, **options).where("problem is null")
    each = found.groupBy("path", "file", "ty", "tx", "height", "width").agg(F.sort_array(F.collect_list(F.struct("y", "rows", "pixels"))).alias("p"))
    # pieces lie above one another, and a tile runs column by column
    cols = (F.size(F.element_at("p", 1)["pixels"]) / F.element_at("p", 1)["rows"]).cast("int")
    pixels = F.flatten(F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.flatten(F.transform("p", lambda e: F.slice(e["pixels"], c * e["rows"] + 1, e["rows"])))))
    return each.select("path", "file", "ty", "tx", "height", "width", F.when(F.size("p") == 1, F.element_at("p", 1)["pixels"]).otherwise(pixels).alias("pixels"))


def encode(pixels: np.ndarray, rows: int = 64) -> bytes:
    """A grey image of 32-bit floats in plain strips of ``rows`` rows."""
    height, width = pixels.shape
    data = [pixels[k : k + rows].astype("<f4").tobytes() for k in range(0, height, rows)]
    at = np.cumsum([8, *map(len, data)])
    tags = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [32]), (COMPRESSION, [PLAIN]), (262, [1]), (OFFSETS, at[:-1]), (SAMPLES, [1]), (ROWS, [rows]), (COUNTS, list(map(len, data))), (FORMAT, [3])]
    extra_at, head, extra = int(at[-1]) + 2 + 12 * len(tags) + 4, b"", b""
    for tag, values in tags:
        raw = struct.pack(f"<{len(values)}I", *map(int, values))
        head += struct.pack("<HHI", tag, 4, len(values)) + (raw if len(raw) <= 4 else struct.pack("<I", extra_at + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, int(at[-1])) + b"".join(data) + struct.pack("<H", len(tags)) + head + struct.pack("<I", 0) + extra


def write_images(kymographs: DataFrame, folder: str, rows: int = 64) -> DataFrame:
    """Files of kymographs (recording, peak_no, xpos, t, col), named as published, below a folder that all executors share; gives recording, peak_no, xpos, file and bytes.

    An image is one file, so it is put together in one task. A task that runs again writes the same files; each gets its name when it is whole.
    """
    each = kymographs.groupBy("recording", "peak_no", "xpos").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "col"))), lambda c: c["col"].cast("array<double>")).alias("cols"))
    named = each.withColumn("file", F.concat("recording", F.lit("_peak_"), F.col("peak_no").cast("string"), F.lit("_at Xpos_"), F.col("xpos").cast("string"), F.lit(".tiff")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for k in range(batch.num_rows):
                name = batch.column(batch.schema.get_field_index("file"))[k].as_py()
                cols = batch.column(batch.schema.get_field_index("cols"))[k]
                data = encode(np.stack([c.values.to_numpy() for c in cols], 1), rows)
                part = f"{base}/.{os.getpid()}-{name}"
                with where.open_output_stream(part) as out:
                    out.write(data)
                where.move(part, f"{base}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("recording", "peak_no", "xpos", "file")), pa.array(sizes, pa.int64())], ["recording", "peak_no", "xpos", "file", "bytes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.select("recording", "peak_no", "xpos", "file").schema)
    return named.select("recording", "peak_no", "xpos", "file", "cols").mapInArrow(run, f"{kinds}, bytes long")
