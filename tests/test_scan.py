"""Recurrences composed over blocks against one pass over the run."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.operators import scan


def one_sample_at_a_time(x, sections):
    """The cascade's difference equations, a sample and a section at a time, from the steady state of the first sample."""
    level = x[0]
    for num, den in sections:
        gain = num.sum() / den.sum()
        z1, z2 = level * (gain - num[0]), level * (num[2] - den[2] * gain)
        out = np.empty_like(x)
        for i, v in enumerate(x):
            out[i] = num[0] * v + z1
            z1, z2 = num[1] * v - den[1] * out[i] + z2, num[2] * v - den[2] * out[i]
        x, level = out, level * gain
    return x


def plain(x, sections, edge):
    u = np.concatenate([2 * x[0] - x[edge:0:-1], x, 2 * x[-1] - x[-2:-edge - 2:-1]])
    y = one_sample_at_a_time(one_sample_at_a_time(u, sections)[::-1], sections)[::-1]
    return y[edge:-edge]


@pytest.mark.parametrize("block", [22, 64, 100, 333, 5000])
def test_equal_to_one_pass_at_any_block(spark, block):
    rng = np.random.default_rng(block)
    sections = kn.bandpass_sections(.7, 4.0, 30.0, 3)
    runs = {1: rng.normal(size=1200).cumsum(), 2: np.sin(np.arange(700) / 5) + 40, 3: rng.normal(size=21), 4: rng.normal(size=22), 5: rng.normal(size=2 * block + 1)}
    rows = [(r, j, len(x), 10 * j, float(v)) for r, x in runs.items() for j, v in enumerate(x)]
    df = spark.createDataFrame(rows, "run int, j long, run_size long, k long, x double").repartition(5)
    got = scan.filter_runs(df, ["run"], "x", "y", sections, 21, block).toPandas().sort_values(["run", "j"])
    assert (got["k"] == 10 * got["j"]).all()
    for r, x in runs.items():
        y = got[got["run"] == r]["y"].to_numpy(float)
        assert len(y) == len(x)
        if len(x) <= 21:
            assert np.isnan(y).all()
        else:
            np.testing.assert_allclose(y, plain(x, sections, 21), atol=1e-12 * max(1, np.abs(x).max()) * 10, rtol=0)


def test_a_missing_value_leaves_its_run_empty(spark):
    df = spark.createDataFrame([(r, j, 200, j, None if r == 1 and j == 150 else float(j % 7)) for r in (1, 2) for j in range(200)], "run int, j long, run_size long, k long, x double")
    got = scan.filter_runs(df, ["run"], "x", "y", kn.bandpass_sections(.7, 4.0, 30.0, 3), 21, 50)
    assert {r["run"]: r["n"] for r in got.groupBy("run").agg(F.count("y").alias("n")).collect()} == {1: 0, 2: 200}


def spline_in_blocks(t, x, cuts, at):
    """Blocks between ``cuts`` eliminated on their own and joined by their borders, evaluated block by block."""
    spans = list(zip([0, *cuts], [*cuts, len(t)]))
    parts = [(t[max(a - 1, 0):b + 1], x[max(a - 1, 0):b + 1], a > 0, b < len(t)) for a, b in spans]
    ends = np.stack([scan._moments(*p)[[0, -1]].ravel() for p in parts])
    before, behind = scan._borders(ends[:, :3], ends[:, 3:])
    out = np.full(len(at), np.nan)
    for (a, b), p, l, r in zip(spans, parts, before, behind):
        here = (at >= t[a]) & (at < t[b] if b < len(t) else at <= t[-1])
        out[here] = scan.spline_at(*p, l, r, at[here])
    return out


@pytest.mark.parametrize("n, cuts", [(3, []), (3, [1, 2]), (10, [1, 2, 3]), (50, [7, 8, 30]), (200, list(range(1, 200))), (200, [100]), (500, list(range(37, 500, 41)))])
def test_spline_joined_at_borders(n, cuts):
    rng = np.random.default_rng(n)
    t = np.cumsum(rng.random(n) + .01)
    x = rng.normal(size=n)
    at = np.sort(rng.uniform(t[0], t[-1], 400))
    np.testing.assert_allclose(spline_in_blocks(t, x, cuts, at), kn.natural_cubic(t, x, at), atol=1e-11)
    h = np.diff(t)                                      # and both equal the dense solution of the whole system
    full = np.eye(n)
    for i in range(1, n - 1):
        full[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
    rhs = np.concatenate([[0], 6 * (np.diff(x)[1:] / h[1:] - np.diff(x)[:-1] / h[:-1]), [0]])
    np.testing.assert_allclose(scan._moments(t, x, False, False)[:, 0], np.linalg.solve(full, rhs), atol=1e-9)
