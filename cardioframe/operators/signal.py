"""Signal and image operators. Those that plain expressions cannot say run as Arrow-batched pandas functions, a recording or beat each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .series import Series


def rolling_ball(s: Series, x: str, wm: int = 20, ws: int = 20) -> list[tuple[str, Column]]:
    """Steps of a baseline: least value within wm places, the largest of those within wm, their mean within ws. Windows are cut off at the ends."""
    return [("__low", F.min(x).over(s.rows(-wm, wm))), ("__high", F.max("__low").over(s.rows(-wm, wm))), ("baseline", F.avg("__high").over(s.rows(-ws, ws)))]


def with_baseline(df: DataFrame, s: Series, x: str, wm: int = 20, ws: int = 20) -> DataFrame:
    """Adds ``baseline`` and ``corrected``."""
    for name, c in rolling_ball(s, x, wm, ws):
        df = df.withColumn(name, c)
    return df.withColumn("corrected", F.col(x) - F.col("baseline")).drop("__low", "__high")


#: Penalties that are tried, as multiples of trace R / trace Q'Q of a beat.
_PENALTIES = 10.0 ** np.arange(-5, 6, 0.25)


def smoothing_splines(t: np.ndarray, y: np.ndarray, penalties: np.ndarray = _PENALTIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of series of equally many points (a row each): smoothed values, second derivatives, and the penalty with the least generalised cross-validation score.

    The natural cubic spline that minimises squared error plus penalty times integrated squared curvature, in
    its Reinsch form: (R + p Q'Q) c = Q'y with five diagonals, factored for all series and penalties at once,
    a point at a time. The trace that the score needs comes from the five middle diagonals of the inverse.
    """
    n, h = t.shape[1], np.diff(t)
    m = n - 2
    a, b, c = 1 / h[:, :-1], -1 / h[:, :-1] - 1 / h[:, 1:], 1 / h[:, 1:]  # the columns of Q
    q0, q1, q2 = a**2 + b**2 + c**2, b[:, :-1] * a[:, 1:] + c[:, :-1] * b[:, 1:], c[:, :-2] * a[:, 2:]
    r0, r1 = (h[:, :-1] + h[:, 1:]) / 3, h[:, 1:-1] / 6
    p = penalties * (r0.sum(1) / q0.sum(1))[:, None]
    right = a * y[:, :-2] + b * y[:, 1:-1] + c * y[:, 2:]
    at = lambda x, i: x[:, i, None] if 0 <= i < x.shape[1] else 0.0
    zero = np.zeros_like(p)
    d, l1, l2, z = ([zero] * m for _ in range(4))
    for i in range(m):
        d1, d2, k1, k2, j2 = (x[j] if j >= 0 else zero for x, j in ((d, i - 1), (d, i - 2), (l1, i - 1), (l2, i - 2), (l2, i - 1)))
        d[i] = at(r0, i) + p * at(q0, i) - d1 * k1**2 - d2 * k2**2
        l1[i] = (at(r1, i) + p * at(q1, i) - d1 * k1 * j2) / d[i] if i < m - 1 else zero
        l2[i] = p * at(q2, i) / d[i] if i < m - 2 else zero
        z[i] = at(right, i) - (k1 * z[i - 1] if i else 0) - (k2 * z[i - 2] if i > 1 else 0)
    curve = np.zeros((*p.shape, n))
    s0 = s1 = t0 = zero  # of the inverse: the diagonal and the next one of the row below, the diagonal of the row after that
    trace = zero.copy()
    for i in reversed(range(m)):
        below = curve[:, :, i + 3] if i + 3 < n else zero
        curve[:, :, i + 1] = z[i] / d[i] - l1[i] * curve[:, :, i + 2] - l2[i] * below
        u1, u2 = -l1[i] * s0 - l2[i] * s1, -l1[i] * s1 - l2[i] * t0
        u0 = 1 / d[i] - l1[i] * u1 - l2[i] * u2
        trace += u0 * at(q0, i) + 2 * u1 * at(q1, i) + 2 * u2 * at(q2, i)
        s0, s1, t0 = u0, u1, s0
    inner = curve[:, :, 1:-1]
    off = np.zeros_like(curve)
    off[:, :, :-2] += a[:, None] * inner
    off[:, :, 1:-1] += b[:, None] * inner
    off[:, :, 2:] += c[:, None] * inner
    off *= p[:, :, None]
    score = n * (off**2).sum(2) / np.maximum(p * trace, 1e-9) ** 2
    best, rows = score.argmin(1), np.arange(len(t))
    return y - off[rows, best], curve[rows, best], p[rows, best]


def spline_at(t: np.ndarray, fit: np.ndarray, curve: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline's values between its knots."""
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 2)
    h = t[k + 1] - t[k]
    a, b = (t[k + 1] - at) / h, (at - t[k]) / h
    return a * fit[k] + b * fit[k + 1] + ((a**3 - a) * curve[k] + (b**3 - b) * curve[k + 1]) * h**2 / 6


_LANDMARKS = ("peaked", "tt10p", "tt25p", "tt50p", "tt75p", "tt90p", "tt90r", "tt75r", "tt50r", "tt25r", "tt10r")


def _spline_marks(t: np.ndarray, fit: np.ndarray, curve: np.ndarray, step: float, block: int = 100_000) -> list[float]:
    """Landmarks of one spline sampled every ``step``, a block of samples at a time: first over each level up to the peak, first under it after the peak."""
    total = max(1, int(np.ceil((t[-1] - t[0]) / step)))
    sampled = lambda: ((x := t[0] + step * np.arange(k, min(k + block, total)), spline_at(t, fit, curve, x)) for k in range(0, total, block))
    top, peaked = max(((z.max(), -x[z.argmax()]) for x, z in sampled()))
    peaked, scale = -peaked, top if top > 0 else 1.0
    found = dict.fromkeys(_LANDMARKS, np.nan) | {"peaked": peaked}
    for x, z in sampled():
        for level in (10, 25, 50, 75, 90):
            for name, hit in ((f"tt{level}p", (x <= peaked) & (z / scale > level / 100)), (f"tt{level}r", (x > peaked) & (z / scale < level / 100))):
                if np.isnan(found[name]) and hit.any():
                    found[name] = x[hit.argmax()]
    return [found[c] for c in _LANDMARKS]


def spline_landmarks(rows: DataFrame, keys: list[str], t: str = "time", y: str = "relative", step: float = 0.0002) -> DataFrame:
    """Landmarks of each beat from a smoothing spline sampled every ``step``. Beats of under 5 different times have nulls; values at equal times are averaged.

    A beat's points become one row; splines of a batch of beats are fitted together, by their number of points.
    """
    names = rows.select(*keys).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names) + "".join(f", {c} double" for c in _LANDMARKS)
    points = F.sort_array(F.collect_list(F.when(F.col(t).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")))))
    each = rows.groupBy(*keys).agg(points.alias("p")).select(*keys, F.col("p.t").alias("t"), F.col("p.y").alias("y"))

    def run(parts):
        for part in parts:
            out = np.full((len(part), len(_LANDMARKS)), np.nan)
            by_size: dict[int, list] = {}
            for i, (x, v) in enumerate(zip(part["t"], part["y"], strict=True)):
                at, place, times = np.unique(np.asarray(x, float), return_inverse=True, return_counts=True)
                if len(at) >= 5:
                    by_size.setdefault(len(at), []).append((i, at, np.bincount(place, np.asarray(v, float)) / times))
            for n, some in by_size.items():
                many = max(1, 400_000 // (n * len(_PENALTIES)))
                for k in range(0, len(some), many):
                    index, at, v = zip(*some[k : k + many], strict=True)
                    fit, curve, _ = smoothing_splines(np.array(at), np.array(v))
                    out[list(index)] = [_spline_marks(*x, step) for x in zip(at, fit, curve, strict=True)]
            done = part[keys].copy()
            done[list(_LANDMARKS)] = out
            yield done

    found = each.mapInPandas(run, schema)
    return found.select(*keys, *(stats.finite(F.col(c)).alias(c) for c in _LANDMARKS))


def gaussian_blur(images: DataFrame, keys: list[str], sigma: float = 1.5) -> DataFrame:
    """Images as rows (keys, pixels: array of rows of doubles), blurred along both sides; edges repeat."""
    size = int(np.ceil(4 * sigma))
    weight = np.exp(-0.5 * (np.arange(-size, size + 1) / sigma) ** 2)
    weight /= weight.sum()

    def blur(m: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            padded = np.pad(m, [(size, size) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            m = np.apply_along_axis(np.convolve, axis, padded, weight, "valid")
        return m

    def run(parts):
        for part in parts:
            part["pixels"] = [blur(np.stack(p).astype(float)).tolist() for p in part["pixels"]]
            yield part

    return images.select(*keys, "pixels").mapInPandas(run, images.select(*keys, "pixels").schema)


def pixel_sd(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """How much each pixel varies over time; pixels: keys, x, y, t, value in long form. Partial aggregates run before the shuffle."""
    return pixels.groupBy(*keys, "x", "y").agg(F.stddev_samp(value).alias("sd"))


def half_sine(row: Column, height: Column) -> Column:
    """The weight of a row (from 0) of an image: nothing at its rims, all in its middle."""
    return F.sin(F.lit(np.pi) * row / (height - 1))


def outer_edges(columns: DataFrame, keys: list[str], value: str) -> DataFrame:
    """First and last row over the mean of its image column. ``down`` is one less than that row, as published; ``distance`` is what lies between."""
    w = Window.partitionBy(*keys, "t")
    over = columns.withColumn("__over", F.col(value) > F.avg(value).over(w))
    found = over.groupBy(*keys, "t").agg(F.min(F.when(F.col("__over"), F.col("y"))).alias("up"), (F.max(F.when(F.col("__over"), F.col("y"))) - 1).alias("down"))
    return found.withColumn("distance", F.col("down") - F.col("up"))


def repaired_edge(columns: DataFrame, keys: list[str], value: str, lower: bool = False, literal: bool = False) -> DataFrame:
    """The first row over its column's mean (the last one less one, for the lower edge) that is not off the trace: not beyond mean minus (plus) one standard deviation of all frames.

    The rows over the mean are looked through until one fits, in one pass; where none does, the first stays.
    literal: as first published, a trace with one such frame only is left as it is
    """
    w = Window.partitionBy(*keys, "t")
    sign = -1 if lower else 1
    # mirrored rows make the lower edge an upper one
    at = (F.col("y") - 1) * sign if lower else F.col("y")
    over = columns.withColumn("__m", F.avg(value).over(w)).where(F.col(value) > F.col("__m")).select(*keys, "t", at.alias("__y"))
    first = over.groupBy(*keys, "t").agg(F.min("__y").alias("__first"))
    limit = first.groupBy(*keys).agg((F.avg("__first") - F.coalesce(F.stddev_samp("__first"), F.lit(0.0))).alias("__limit"))
    off = first.join(limit, keys).groupBy(*keys).agg(F.first("__limit").alias("__limit"), F.count_if(F.col("__first") <= F.col("__limit")).alias("__off"))
    use = F.col("__y") > F.col("__limit")
    found = over.join(off, keys).groupBy(*keys, "t").agg(F.min("__y").alias("__first"), F.min(F.when(use & (F.col("__off") > (1 if literal else 0)), F.col("__y"))).alias("__next"), F.first("__off").alias("__off"))
    best = F.when(F.col("__off") > (1 if literal else 0), F.coalesce("__next", "__first")).otherwise(F.col("__first"))
    return found.select(*keys, "t", (best * sign).alias("edge"))


def outliers(df: DataFrame, firsts: DataFrame, keys: list[str], edge: str, candidates: str, lower: bool, literal: bool = False) -> DataFrame:
    """``df`` with ``edge`` repaired as repaired_edge() does, where each frame holds its rows over the mean as an array.

    firsts: keys, edge of all frames, from which the limit is taken (``df`` itself, or a table of it)
    """
    spread = F.coalesce(F.stddev_samp(edge), F.lit(0.0))
    limit = firsts.groupBy(*keys).agg((F.avg(edge) + spread if lower else F.avg(edge) - spread).alias("__limit"))
    off = (lambda c: c >= F.col("__limit")) if lower else (lambda c: c <= F.col("__limit"))
    many = firsts.join(limit, keys).groupBy(*keys).agg(F.first("__limit").alias("__limit"), F.count_if(off(F.col(edge))).alias("__off"))
    rows = F.transform(F.reverse(candidates), lambda i: i - 1) if lower else F.col(candidates)
    fit = F.element_at(F.filter(rows, lambda i: ~off(i)), 1)
    best = F.when((F.col("__off") > (1 if literal else 0)) & off(F.col(edge)), F.coalesce(fit, F.col(edge))).otherwise(F.col(edge))
    return df.join(many, keys).withColumn(edge, best).drop("__limit", "__off")


def bright_stripes(profile: DataFrame, keys: tuple[str, ...], x: str, value: str, least_width: int = 60) -> DataFrame:
    """Runs of columns at least as bright as the mean, of at least ``least_width`` columns."""
    from .series import islands

    s = Series(keys, (x,))
    marked = profile.withColumn("__bright", F.col(value) >= F.avg(value).over(s.whole))
    return islands(marked, s, F.col("__bright")).where(F.col("n") >= least_width)


def stripe_peaks(profile: DataFrame, stripes: DataFrame, keys: tuple[str, ...], x: str, value: str, n: int = 3) -> DataFrame:
    """The n largest local maxima of each stripe."""
    from .series import local_extrema

    s = Series(keys, (x,))
    peaks = profile.withColumns({"place": s.number(), "__p": local_extrema(s, value)}).where("__p")
    places = stripes.select(*keys, F.col("first").alias("__a"), F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("place"))
    inside = peaks.join(places, [*keys, "place"])
    w = Window.partitionBy(*keys, "__a").orderBy(F.desc(value), "place")
    return inside.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "place", x, value, "rank")


def quantile_floor(s: Series, x: str, q: float = 0.75) -> Column:
    """0 under the quantile of the series."""
    return F.when(F.col(x) < F.percentile(x, F.lit(q)).over(s.whole), 0.0).otherwise(F.col(x))


def quantile_clamp(s: Series, x: str, q: float = 0.75) -> Column:
    return F.greatest(F.col(x), F.percentile(x, F.lit(q)).over(s.whole))
