import numpy as np
import pytest
from pyspark.sql import functions as F

from cardioframe.operators import signal
from cardioframe.operators.series import Series


def test_spline_follows_a_smooth_curve():
    t = np.linspace(0, 1, 60)
    y = np.sin(3 * t) + 0.01 * np.random.default_rng(1).normal(size=60)
    (fit,), (curve,), _ = signal.smoothing_splines(t[None], y[None])
    at = np.linspace(0.05, 0.95, 200)
    assert np.abs(signal.spline_at(t, fit, curve, at) - np.sin(3 * at)).max() < 0.02


def dense_spline(t, y, penalties):
    """The same spline from full matrices."""
    n, h, i = len(t), np.diff(t), np.arange(len(t) - 2)
    q = np.zeros((n, n - 2))
    q[i, i], q[i + 1, i], q[i + 2, i] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    r = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
    best = (np.inf,)
    for p in penalties * np.trace(r) / np.trace(q.T @ q):
        hat = np.linalg.inv(np.eye(n) + p * q @ np.linalg.solve(r, q.T))
        fit = hat @ y
        score = n * ((y - fit) ** 2).sum() / np.trace(np.eye(n) - hat) ** 2
        if score < best[0]:
            best = (score, fit, np.concatenate([[0], np.linalg.solve(r, q.T @ fit), [0]]), p)
    return best[1:]


@pytest.mark.parametrize("n", [5, 6, 13, 40])
def test_banded_splines_equal_dense_ones(n):
    rng = np.random.default_rng(n)
    t = np.cumsum(rng.uniform(0.5, 1.5, (7, n)), axis=1)
    y = np.sin(t / n * 6) + 0.2 * rng.normal(size=t.shape)
    grid = 10.0 ** np.arange(-3, 4, 0.5)
    for a, b, (fit, curve, p) in zip(t, y, zip(*signal.smoothing_splines(t, y, grid), strict=True), strict=True):
        want = dense_spline(a, b, grid)
        assert p == pytest.approx(want[2]) and np.allclose(fit, want[0], atol=1e-6) and np.allclose(curve, want[1], atol=1e-5)


def test_spline_landmarks_after_a_rebound_and_of_long_beats(spark):
    t = np.linspace(0, 1, 3001)
    y = np.interp(t, [0, 0.2, 0.5, 0.7, 1], [0, 1, 0.2, 0.8, 0])
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y, strict=True)] + [("b", 300_000 * float(a), float(b)) for a, b in zip(t[::100], y[::100], strict=True)], "beat string, time double, relative double")
    got = {r["beat"]: r for r in signal.spline_landmarks(df, ["beat"], step=0.001).collect()}
    assert got["a"]["tt50r"] == pytest.approx(0.2 + 0.3 * 0.5 / 0.8, abs=0.01) and got["a"]["tt10r"] > 0.9
    assert got["b"]["tt50p"] / 300_000 == pytest.approx(got["a"]["tt50p"], abs=0.02)


def test_spline_landmarks_of_a_raised_cosine(spark):
    t = np.linspace(0, 0.4, 80)
    rows = [(1, float(a), float((1 - np.cos(2 * np.pi * a / 0.4)) / 2)) for a in t]
    df = spark.createDataFrame(rows + [(2, 0.0, 1.0)], "beat int, time double, relative double")
    got = {r["beat"]: r for r in signal.spline_landmarks(df, ["beat"]).collect()}
    assert got[1]["peaked"] == pytest.approx(0.2, abs=0.002)
    assert got[1]["tt50p"] == pytest.approx(0.1, abs=0.002) and got[1]["tt50r"] == pytest.approx(0.3, abs=0.002)
    assert got[2]["peaked"] is None or np.isnan(got[2]["peaked"])


def test_baseline_follows_a_drift(spark):
    x = [0.1 * i + (5 if i % 25 == 12 else 0) for i in range(200)]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, t int, x double")
    got = signal.with_baseline(df, Series(("k",), ("t",)), "x").orderBy("t").toPandas()
    middle = got["corrected"].to_numpy()[40:160]
    assert middle[np.arange(40, 160) % 25 == 12].min() > 4 and np.abs(middle[np.arange(40, 160) % 25 != 12]).max() < 2.5


def test_blur_keeps_the_sum_of_an_inner_dot(spark):
    image = np.zeros((31, 31))
    image[15, 15] = 1
    df = spark.createDataFrame([("a", image.tolist())], "id string, pixels array<array<double>>")
    out = np.array(signal.gaussian_blur(df, ["id"]).first()["pixels"])
    assert out.sum() == pytest.approx(1) and out[15, 15] == out.max() and out[15, 14] == pytest.approx(out[14, 15])


def test_edges_of_a_band(spark):
    rows = [("r", t, y, 1.0 if 3 <= y <= 7 else 0.0) for t in range(3) for y in range(12)]
    df = spark.createDataFrame(rows, "rec string, t int, y int, v double")
    assert {tuple(r) for r in signal.outer_edges(df, ["rec"], "v").select("up", "down", "distance").collect()} == {(3, 6, 3)}


def test_a_stray_edge_is_repaired(spark):
    rows = [("r", t, y, 1.0 if 8 <= y <= 12 or (t == 4 and y == 0) else 0.0) for t in range(9) for y in range(20)]
    df = spark.createDataFrame(rows, "rec string, t int, y int, v double")
    assert {r["edge"] for r in signal.repaired_edge(df, ["rec"], "v").collect()} == {8}
    assert {r["edge"] for r in signal.repaired_edge(df, ["rec"], "v", literal=True).collect()} == {0, 8}


def test_edges_behind_many_stray_rows(spark):
    rows = [("r", t, y, 1.0 if 10 <= y <= 14 or (t == 4 and (y < 6 or y > 22)) else 0.0) for t in range(9) for y in range(30)]
    df = spark.createDataFrame(rows, "rec string, t int, y int, v double")
    assert {r["edge"] for r in signal.repaired_edge(df, ["rec"], "v").collect()} == {10}
    assert {r["edge"] for r in signal.repaired_edge(df, ["rec"], "v", lower=True).collect()} == {13}


def test_stripes_and_quantiles(spark):
    df = spark.createDataFrame([("r", x, 1.0 if 100 <= x < 180 or x < 20 else 0.0) for x in range(300)], "rec string, x int, v double")
    got = signal.bright_stripes(df, ("rec",), "x", "v").collect()
    assert [(r["first"], r["last"]) for r in got] == [(101, 180)]
    s = Series(("rec",), ("x",))
    few = df.where("x < 4").withColumn("v", F.col("x") * 1.0)
    assert [r[0] for r in few.select(signal.quantile_floor(s, "v").alias("f")).collect()] == [0, 0, 0, 3]
