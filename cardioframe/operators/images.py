"""Images in tiles: stencils with a halo, background by a rolling ball, and the traces of edges.

An image is a set of tiles: keys, ty, tx, height and width (of the whole image), pixels (an array, column by column).
A stencil sends each tile's rims to the tiles around it, by one shuffle on (keys, ty, tx), so a task holds a tile
and its halo and never an image. In kymographs rows lie across the heart and columns are frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import writers
from .signal import half_sine, outliers

SIDE = 256


def to_tiles(columns: DataFrame, keys: list[str], t: str = "t", side: int = SIDE) -> DataFrame:
    """Tiles of images that are given by columns: keys, t (from 0), col (an array from its first row)."""
    sizes = columns.groupBy(*keys).agg(F.max(F.size("col")).cast("int").alias("height"), (F.max(t) + 1).cast("int").alias("width"))
    cuts = F.sequence(F.lit(0), F.floor((F.size("col") - 1) / side).cast("int"))
    parts = F.transform(cuts, lambda k: F.struct(k.alias("ty"), F.slice("col", k * side + 1, F.lit(side)).alias("part")))
    each = columns.where(F.size("col") > 0).select(*keys, F.floor(F.col(t) / side).cast("int").alias("tx"), F.col(t).alias("__t"), F.explode(parts).alias("p")).select(*keys, "p.ty", "tx", F.struct("__t", "p.part").alias("c"))
    tiles = each.groupBy(*keys, "ty", "tx").agg(F.flatten(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["part"].cast("array<double>"))).alias("pixels"))
    return tiles.join(sizes, keys).select(*keys, "ty", "tx", "height", "width", "pixels")


def to_columns(tiles: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """keys, t (from 0) and col of the images of tiles."""
    rows = F.least(F.lit(side), F.col("height") - F.col("ty") * side)
    parts = F.transform(F.sequence(F.lit(0), (F.size("pixels") / rows).cast("int") - 1), lambda c: F.struct((F.col("tx") * side + c).alias("t"), F.slice("pixels", c * rows + 1, rows).alias("part")))
    each = tiles.select(*keys, "ty", F.explode(parts).alias("p")).select(*keys, "p.t", F.struct("ty", "p.part").alias("c"))
    return each.groupBy(*keys, "t").agg(F.flatten(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["part"])).alias("col"))


@dataclass(frozen=True)
class Place:
    """Where a tile lies: its first row and column, its size, and the size of its image."""

    y: int
    x: int
    rows: int
    cols: int
    height: int
    width: int


def stencil(tiles: DataFrame, keys: list[str], halo: tuple[int, int], work: Callable[[np.ndarray, Place], np.ndarray], outside: float | None = None, side: int = SIDE) -> DataFrame:
    """Tiles of ``work(padded, place)``, where padded is a tile with ``halo`` (rows, columns) more on each side.

    outside: what stands beyond the image; None repeats its rim. work returns an array as large as the tile. A halo is at
    most as wide as a tile, as only the tiles around it are asked.
    """
    hy, hx = halo
    if max(halo) > side:
        raise ValueError(f"a halo of {halo} needs tiles of more than {side}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keys).schema)
    piece = "dy int, dx int, part array<double>"

    def place(ty: int, tx: int, height: int, width: int) -> Place:
        return Place(ty * side, tx * side, min(side, height - ty * side), min(side, width - tx * side), height, width)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in ("ty", "tx", "height", "width", "pixels")}
            row, out = [], {c: [] for c in ("ty", "tx", "dy", "dx", "part")}
            for k in range(batch.num_rows):
                p = place(*(of[c][k].as_py() for c in ("ty", "tx", "height", "width")))
                pixels = of["pixels"][k].values.to_numpy().reshape(p.cols, p.rows).T
                # dy: on which side of the tile that gets it a piece lies
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ty, tx = p.y // side - dy, p.x // side - dx
                        if not (0 <= ty * side < p.height and 0 <= tx * side < p.width) or dy and not hy or dx and not hx:
                            continue
                        cut = pixels[{0: slice(None), -1: slice(max(0, p.rows - hy), None), 1: slice(0, hy)}[dy], {0: slice(None), -1: slice(max(0, p.cols - hx), None), 1: slice(0, hx)}[dx]]
                        row.append(k)
                        for c, v in (("ty", ty), ("tx", tx), ("dy", dy), ("dx", dx), ("part", cut.T.ravel())):
                            out[c].append(v)
            named = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int32())) for c in (*keys, "height", "width")]
            yield pa.RecordBatch.from_arrays([*named, *(pa.array(out[c], pa.int32()) for c in ("ty", "tx", "dy", "dx")), pa.array(out["part"], pa.list_(pa.float64()))], [*keys, "height", "width", "ty", "tx", "dy", "dx", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in ("ty", "tx", "height", "width", "pieces")}
            done = []
            for k in range(batch.num_rows):
                p = place(*(of[c][k].as_py() for c in ("ty", "tx", "height", "width")))
                padded = np.full((p.rows + 2 * hy, p.cols + 2 * hx), np.nan)
                top, left, bottom, right = hy, hx, hy + p.rows, hx + p.cols
                for item in of["pieces"][k]:
                    dy, dx, part = item["dy"].as_py(), item["dx"].as_py(), item["part"].values.to_numpy()
                    n = {0: p.rows, -1: hy, 1: min(hy, max(0, p.height - p.y - p.rows))}[dy]
                    part = part.reshape(-1, n).T
                    y = {0: hy, -1: 0, 1: hy + p.rows}[dy]
                    x = {0: hx, -1: hx - part.shape[1], 1: hx + p.cols}[dx]
                    padded[y : y + n, x : x + part.shape[1]] = part
                    top, bottom, left, right = min(top, y), max(bottom, y + n), min(left, x), max(right, x + part.shape[1])
                if outside is None:
                    inner = padded[top:bottom, left:right]
                    padded = np.pad(inner, ((top, padded.shape[0] - bottom), (left, padded.shape[1] - right)), mode="edge")
                else:
                    padded = np.where(np.isnan(padded), outside, padded)
                done.append(np.asarray(work(padded, p), float).T.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in (*keys, "ty", "tx", "height", "width")), pa.array(done, pa.list_(pa.float64()))], [*keys, "ty", "tx", "height", "width", "pixels"])

    size = "height int, width int"
    if max(halo) == 0:
        whole = tiles.select(*keys, "ty", "tx", "height", "width", F.array(F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.col("pixels").alias("part"))).alias("pieces"))
    else:
        sent = tiles.select(*keys, "ty", "tx", "height", "width", "pixels").mapInArrow(send, f"{kinds}, {size}, ty int, tx int, {piece}")
        whole = sent.groupBy(*keys, "ty", "tx", "height", "width").agg(F.collect_list(F.struct("dy", "dx", "part")).alias("pieces"))
    return whole.mapInArrow(join, f"{kinds}, ty int, tx int, {size}, pixels array<double>")


def gaussian(sigma: float) -> np.ndarray:
    """Weights of a blur, cut off at four sigma, with sum 1."""
    reach = int(np.ceil(4 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return weight / weight.sum()


def _along(m: np.ndarray, weight: np.ndarray, axis: int) -> np.ndarray:
    """Sums of neighbours with weights; what has not all neighbours is left out."""
    n = m.shape[axis] - len(weight) + 1
    return sum(w * np.take(m, np.arange(k, k + n), axis) for k, w in enumerate(weight))


def blur(tiles: DataFrame, keys: list[str], sigma: float = 1.5, side: int = SIDE) -> DataFrame:
    """Gaussian blur; rims repeat."""
    weight = gaussian(sigma)
    reach = len(weight) // 2
    return stencil(tiles, keys, (reach, reach), lambda m, p: _along(_along(m, weight, 0), weight, 1), side=side)


def rolling_mean(tiles: DataFrame, keys: list[str], width: int = 4, side: int = SIDE) -> DataFrame:
    """The mean of a frame and the width - 1 after it. Near the end the last frame stands in; these frames have no mean of their own."""
    return stencil(tiles, keys, (0, width - 1), lambda m, p: _along(m[:, width - 1 :], np.full(width, 1 / width), 1), side=side)


def weighted(tiles: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """Rows weighted by half a sine wave: nothing at the rims, all in the middle. No shuffle."""
    rows = F.least(F.lit(side), F.col("height") - F.col("ty") * side)
    at = lambda k: F.col("ty") * side + F.pmod(k, rows)
    return tiles.withColumn("pixels", F.transform("pixels", lambda v, k: v * half_sine(at(k), F.col("height"))))


#: By the radius of a ball up to which they hold: how far the image is shrunk, and the percentage of the ball's rim that is left out. Fixed values.
BALLS = ((10, 1, 24), (30, 2, 24), (100, 4, 32), (np.inf, 8, 40))


def ball(radius: float) -> tuple[int, np.ndarray]:
    """How far an image is shrunk for a ball of a radius, and the heights of the ball on that grid (-inf where it is not)."""
    shrink, trim = next((s, c) for most, s, c in BALLS if radius <= most)
    small = max(1.0, radius / shrink)
    half = int(np.floor(small - int(trim * small) // 100 + 0.5))
    d = np.arange(-half, half + 1) ** 2
    left = small**2 - d[:, None] - d[None, :]
    return shrink, np.where(left >= 0, np.sqrt(np.maximum(left, 0)), -np.inf)


def opening(m: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Where a ball that is rolled under a surface touches it at most; the result lacks twice the ball's reach on each side."""
    n, size = len(heights), [s - len(heights) + 1 for s in m.shape]
    steps = [(i, j) for i in range(n) for j in range(n) if heights[i, j] > -np.inf]
    low = np.full(size, np.inf)
    for i, j in steps:
        np.minimum(low, m[i : i + size[0], j : j + size[1]] - heights[i, j], out=low)
    size = [s - n + 1 for s in size]
    high = np.full(size, -np.inf)
    for i, j in steps:
        np.maximum(high, low[i : i + size[0], j : j + size[1]] + heights[i, j], out=high)
    return high


def _between(first: int, n: int, small: int, shrink: int) -> tuple[np.ndarray, np.ndarray]:
    """For n places of a large image, from the first: the place on the shrunk one before each, and its weight beside the next (outside 0..1 at the rims, where the line is drawn on)."""
    at = np.arange(first, first + n)
    low = np.clip((at - shrink // 2) // shrink, 0, max(0, small - 2))
    return low, 1 - ((at + 0.5) / shrink - (low + 0.5)) if small > 1 else np.ones(n)


def subtract_background(tiles: DataFrame, keys: list[str], radius: float = 50, side: int = SIDE) -> DataFrame:
    """Images less the surface that a ball rolled under them touches; nothing is under 0.

    As published for images, the ball rolls on the least values of blocks, and the surface is drawn between their
    centres. Without smoothing beforehand. All steps run on a tile with its halo, so they cost one shuffle.
    """
    shrink, heights = ball(radius)
    reach = shrink * (len(heights) + 1)
    if side % shrink:
        raise ValueError(f"tiles of {side} rows do not fall into blocks of {shrink}")

    def work(m: np.ndarray, p: Place) -> np.ndarray:
        own = m[reach : reach + p.rows, reach : reach + p.cols]
        full = np.pad(m, [(0, -s % shrink) for s in m.shape], constant_values=np.inf)
        small = full.reshape(full.shape[0] // shrink, shrink, -1, shrink).min(axis=(1, 3))
        under = opening(small, heights)  # from the second block before the tile on
        for axis, first, n, total in ((0, p.y, p.rows, p.height), (1, p.x, p.cols, p.width)):
            blocks = -(-total // shrink)
            low, weight = _between(first, n, blocks, shrink)
            at = low - first // shrink + 2
            weight = weight[:, None] if axis == 0 else weight
            with np.errstate(invalid="ignore"):  # beyond the image the surface is infinite; it is cut off with the other axis
                near = np.take(under, at, axis) * weight
                under = near + np.take(under, at + 1, axis) * (1 - weight) if blocks > 1 else near
        return np.maximum(own - under, 0)

    return stencil(tiles, keys, (reach, reach), work, outside=np.inf, side=side)


def smoothed(tiles: DataFrame, keys: list[str], sigma: float = 1.5, mean: int = 4, side: int = SIDE) -> DataFrame:
    """keys, t, col: blurred images, their rows weighted by half a sine wave, and the mean of ``mean`` frames from each on. All in one shuffle.

    The last mean - 1 frames have no mean and no column.
    """
    weight = gaussian(sigma)
    reach = len(weight) // 2

    def work(m: np.ndarray, p: Place) -> np.ndarray:
        soft = _along(_along(m, weight, 0), weight, 1)[:, mean - 1 :]
        lit = soft * np.sin(np.pi * np.arange(p.y, p.y + p.rows) / max(1, p.height - 1))[:, None]
        return _along(lit, np.full(mean, 1 / mean), 1)

    done = stencil(tiles, keys, (reach, reach + mean - 1), work, side=side)
    last = F.col("width") - (mean - 1)
    # columns that have no mean go before they are put together
    rows = F.least(F.lit(side), F.col("height") - F.col("ty") * side)
    kept = done.where(F.col("tx") * side < last).withColumn("pixels", F.slice("pixels", F.lit(1), F.least(F.size("pixels"), (last - F.col("tx") * side) * rows)))
    return to_columns(kept, keys, side)


def scaled(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Columns as shares of their largest value, less the smallest share of their image; a column without a value over 0 is 0 before that."""
    top = F.array_max("col")
    shares = columns.select(*keys, "t", F.when(top > 0, F.transform("col", lambda v: v / top)).otherwise(F.transform("col", lambda v: F.lit(0.0))).alias("col"))
    low = shares.groupBy(*keys).agg(F.min(F.array_min("col")).alias("__low"))
    return shares.join(low, keys).select(*keys, "t", F.transform("col", lambda v: v - F.col("__low")).alias("col"))


def _trapezoid(x: Column) -> Column:
    return F.when(F.size(x) > 1, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) - (F.element_at(x, 1) + F.element_at(x, -1)) / 2).otherwise(0.0)


def trace(columns: DataFrame, movies: DataFrame, keys: list[str], literal: bool = False) -> DataFrame:
    """The trace of each image's edges: a row for each frame with time, distance, up, down, up_bright, down_bright, down_norm, up_norm, distance_norm.

    columns: keys, t (from 0), col, as scaled() gives them. movies: keys, resolution, time_interval. up is the first row (from 1) over its column's mean, down
    the last one less one, as published; rows off the trace are passed over (see signal.repaired_edge(), also for ``literal``). up_bright is
    the integral of a column's rows up to the image's largest ``up`` less its standard deviation (whole part), down_bright that from the
    last row to the same of ``down``. A row of a frame is found where its column is read; only rows' numbers are compared between frames.
    """
    mean = F.aggregate("col", F.lit(0.0), lambda a, v: a + v) / F.size("col")
    over = F.filter(F.transform(F.arrays_zip("col", F.sequence(F.lit(1), F.size("col")).alias("i")), lambda e: F.when(e["col"] > mean, e["i"])), lambda i: i.isNotNull())
    found = columns.where(F.size("col") > 0).select(*keys, "t", "col", over.alias("__over")).where(F.size("__over") > 0)
    found = writers.staged(found.select(*keys, "t", "col", "__over", F.element_at("__over", 1).alias("__up"), (F.element_at("__over", -1) - 1).alias("__down")))
    fixed = found
    for edge, lower in (("__up", False), ("__down", True)):
        fixed = outliers(fixed, found, keys, edge, "__over", lower, literal)
    edges = fixed.select(*keys, "t", "col", F.col("__up").alias("up"), F.col("__down").alias("down"))
    side = lambda c: (F.max(c) - F.coalesce(F.stddev_samp(c), F.lit(0.0))).cast("int")
    of = edges.groupBy(*keys).agg(side("up").alias("__um"), side("down").alias("__dm"), *(f(c).alias(f"__{n}_{c}") for c in ("up", "down") for n, f in (("min", F.min), ("max", F.max))))
    norm = lambda c: F.try_divide(F.col(c) - F.col(f"__min_{c}"), F.col(f"__max_{c}") - F.col(f"__min_{c}"))
    out = edges.join(of, keys).join(movies.select(*keys, "resolution", "time_interval"), keys)
    return out.select(
        *keys, "t", (F.col("t") * F.col("time_interval")).alias("time"), ((F.col("down") - F.col("up")) * F.col("resolution")).alias("distance"), "up", "down",
        _trapezoid(F.slice("col", F.lit(1), F.greatest(F.lit(1), F.col("__um")))).alias("up_bright"),
        _trapezoid(F.slice("col", F.greatest(F.lit(1), F.col("__dm")), F.size("col"))).alias("down_bright"),
        norm("down").alias("down_norm"), norm("up").alias("up_norm"), (norm("down") - norm("up")).alias("distance_norm"),
    )


def trace_images(tiles: DataFrame, movies: DataFrame, keys: list[str], sigma: float = 1.5, mean: int = 4, radius: float | None = None, side: int = SIDE, literal: bool = False) -> DataFrame:
    """From kymographs to traces: background (if a ball's radius is given), blur, weights, rolling mean, scale, edges."""
    ground = tiles if radius is None else subtract_background(tiles, keys, radius, side)
    return trace(scaled(writers.staged(smoothed(ground, keys, sigma, mean, side)), keys), movies, keys, literal)
