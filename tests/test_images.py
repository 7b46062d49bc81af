"""Tiles against whole images in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardioframe.operators import images

KEYS = ["movie"]
SIDE = 16


def columns(spark, **named):
    rows = [(k, t, [float(v) for v in m[:, t]]) for k, m in named.items() for t in range(m.shape[1])]
    return spark.createDataFrame(rows, "movie string, t int, col array<double>").repartition(3)


def tiled(spark, side=SIDE, **named):
    return images.to_tiles(columns(spark, **named), KEYS, side=side)


def whole(tiles, side=SIDE):
    out = {}
    for r in images.to_columns(tiles, KEYS, side).orderBy("t").collect():
        out.setdefault(r["movie"], []).append(r["col"])
    return {k: np.array(v).T for k, v in out.items()}


def example(height, width, seed=0):
    return np.random.default_rng(seed).normal(size=(height, width))


def soft(m, sigma=1.5):
    weight = images.gaussian(sigma)
    reach = len(weight) // 2
    for axis in (0, 1):
        padded = np.pad(m, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        m = np.apply_along_axis(np.convolve, axis, padded, weight, "valid")
    return m


SHAPES = {"a": (40, 50), "b": (16, 33), "c": (7, 5), "d": (1, 1), "e": (49, 16), "f": (17, 18)}
IMAGES = {k: example(*shape, seed=i) for i, (k, shape) in enumerate(SHAPES.items())}


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k].shape == want[k].shape and np.allclose(got[k], want[k]), k


def test_tiles_hold_the_image(spark):
    tiles = tiled(spark, **IMAGES)
    assert {(r["movie"], r["ty"], r["tx"]) for r in tiles.where("movie = 'a'").collect()} == {("a", y, x) for y in range(3) for x in range(4)}
    assert tiles.agg(F.max(F.size("pixels"))).first()[0] == SIDE * SIDE
    same(whole(tiles), IMAGES)


def test_blur_of_tiles_equals_that_of_the_image(spark):
    same(whole(images.blur(tiled(spark, **IMAGES), KEYS, side=SIDE)), {k: soft(m) for k, m in IMAGES.items()})


def test_weights_and_rolling_mean_cross_tiles(spark):
    tall = {k: m for k, m in IMAGES.items() if m.shape[0] > 1}
    weight = lambda m: np.sin(np.pi * np.arange(m.shape[0]) / (m.shape[0] - 1))[:, None]
    same(whole(images.weighted(tiled(spark, **tall), KEYS, SIDE)), {k: m * weight(m) for k, m in tall.items()})
    mean = lambda m: np.stack([np.pad(m, ((0, 0), (0, 3)), mode="edge")[:, k : k + 4].mean(1) for k in range(m.shape[1])], 1)
    same(whole(images.rolling_mean(tiled(spark, **IMAGES), KEYS, 4, SIDE)), {k: mean(m) for k, m in IMAGES.items()})


def test_a_halo_has_to_fit_into_a_tile(spark):
    with pytest.raises(ValueError):
        images.stencil(tiled(spark, c=IMAGES["c"]), KEYS, (17, 0), lambda m, p: m, side=SIDE)


def plain_background(m, radius):
    """The ball, place by place, on the whole image."""
    shrink, heights = images.ball(radius)
    h, w = m.shape
    small = np.array([[m[i : i + shrink, j : j + shrink].min() for j in range(0, w, shrink)] for i in range(0, h, shrink)])
    reach, under = len(heights) // 2, np.full(small.shape, -np.inf)
    points = [(i - reach, j - reach, z) for i, r in enumerate(heights) for j, z in enumerate(r) if z > -np.inf]
    for y in range(-reach, small.shape[0] + reach):
        for x in range(-reach, small.shape[1] + reach):
            inside = [(y + i, x + j, z) for i, j, z in points if 0 <= y + i < small.shape[0] and 0 <= x + j < small.shape[1]]
            if inside:
                top = min(small[i, j] - z for i, j, z in inside)
                for i, j, z in inside:
                    under[i, j] = max(under[i, j], top + z)
    for axis in (0, 1):
        n, blocks = m.shape[axis], under.shape[axis]
        centres = (np.arange(blocks) + 0.5) * shrink - 0.5
        low = [min(max(0, int((i - shrink // 2) / shrink)), max(0, blocks - 2)) for i in range(n)]
        line = lambda i: np.take(under, low[i], axis) if blocks < 2 else np.take(under, low[i], axis) + (i - centres[low[i]]) / shrink * (np.take(under, low[i] + 1, axis) - np.take(under, low[i], axis))  # noqa: B023, E731
        under = np.stack([line(i) for i in range(n)], axis)
    return np.maximum(m - under, 0)


@pytest.mark.parametrize("radius", [4, 25])
def test_background_of_tiles_equals_a_plain_ball(spark, radius):
    size = {4: {"a": (40, 50), "b": (9, 33), "c": (3, 2)}, 25: {"a": (70, 101), "b": (5, 66), "c": (1, 1)}}[radius]
    some = {k: example(*s, seed=9) * 20 + np.add.outer(np.arange(s[0]), np.arange(s[1])) for k, s in size.items()}
    side = {4: 16, 25: 64}[radius]
    same(whole(images.subtract_background(tiled(spark, side, **some), KEYS, radius, side), side), {k: plain_background(m, radius) for k, m in some.items()})


def test_the_published_ball():
    shrink, heights = images.ball(50)
    assert shrink == 4 and heights.shape == (19, 19) and heights.max() == 12.5


def plain_trace(m, resolution, interval):
    m = soft(m) * np.sin(np.pi * np.arange(len(m)) / (len(m) - 1))[:, None]
    m = np.stack([m[:, k : k + 4].mean(1) for k in range(m.shape[1] - 3)], 1)
    m = m / m.max(0)
    m -= m.min()
    rows = [np.flatnonzero(c > c.mean()) + 1 for c in m.T]
    up, down = np.array([r[0] for r in rows]), np.array([r[-1] - 1 for r in rows])
    low, high = up.mean() - up.std(ddof=1), down.mean() + down.std(ddof=1)
    up = np.array([next((v for v in r if v > low), u) if u <= low else u for r, u in zip(rows, up, strict=True)])
    down = np.array([next((v - 1 for v in r[::-1] if v - 1 < high), d) if d >= high else d for r, d in zip(rows, down, strict=True)])
    a, b = max(1, int(up.max() - up.std(ddof=1))), max(1, int(down.max() - down.std(ddof=1)))
    norm = lambda v: (v - v.min()) / (v.max() - v.min())
    return np.column_stack([np.arange(len(up)) * interval, (down - up) * resolution, up, down, np.trapezoid(m[:a], axis=0), np.trapezoid(m[b - 1 :], axis=0), norm(down), norm(up), norm(down) - norm(up)])


def test_trace_of_a_beating_band(spark):
    t, y = np.arange(90)[None, :], np.arange(60)[:, None]
    half = 14 + 5 * np.cos(t / 7)
    image = 1 / (1 + np.exp((np.abs(y - 30) - half) * 2)) + 0.02 * example(60, 90)
    image[3:6, 40] = 3.0  # a stray speck over the upper edge
    movies = spark.createDataFrame([("m", 0.65, 0.005)], "movie string, resolution double, time_interval double")
    got = images.trace_images(tiled(spark, 32, m=image), movies, KEYS, side=32).orderBy("t").toPandas()
    assert np.allclose(got[["time", "distance", "up", "down", "up_bright", "down_bright", "down_norm", "up_norm", "distance_norm"]].to_numpy(), plain_trace(image, 0.65, 0.005))
    assert len(got) == 87 and got["up"].min() > 5
