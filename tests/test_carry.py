"""Bucketed ordered operators against one-task pandas results, with one key holding most rows."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import carry, greedy
from pulsegrid.operators.fallback import _walk, sequential_clock
from pulsegrid.operators.metrics import average_rank


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 4000
    key = np.where(rng.random(n) < .6, 0, rng.integers(1, 9, n))
    pdf = pd.DataFrame({"key": key, "t": rng.random(n) * 1000, "x": np.round(rng.normal(size=n), 2), "id": np.arange(n)})
    df = spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("t") / 7))
    return pdf.sort_values(["key", "t"]).reset_index(drop=True), df


def test_previous_and_next(data):
    pdf, df = data
    out = carry.with_prev(df, ["key"], "b", ["t"], F.struct("x"), "p")
    out = carry.with_prev(out, ["key"], "b", ["t"], F.struct("x"), "q", next_row=True).select("id", "p.x", F.col("q.x").alias("nx")).toPandas().set_index("id")
    np.testing.assert_array_equal(out.loc[pdf.id, "x"], pdf.groupby("key").x.shift(1))
    np.testing.assert_array_equal(out.loc[pdf.id, "nx"], pdf.groupby("key").x.shift(-1))


def test_running_sum_max_and_index(data):
    pdf, df = data
    out = carry.with_running(df, ["key"], "b", ["t"], s=(F.col("x"), "sum"), m=(F.col("x"), "max"))
    out = carry.with_index(out, ["key"], "b", ["t"], "i").toPandas().set_index("id").loc[pdf.id]
    np.testing.assert_allclose(out.s, pdf.groupby("key").x.cumsum(), atol=1e-9)
    np.testing.assert_array_equal(out.m, pdf.groupby("key").x.cummax())
    np.testing.assert_array_equal(out.i, pdf.groupby("key").cumcount())
    before = carry.with_running(df, ["key"], "b", ["t"], inclusive=False, m=(F.col("x"), "max")).toPandas().set_index("id").loc[pdf.id]
    np.testing.assert_array_equal(before.m, pdf.groupby("key").x.cummax().groupby(pdf.key).shift(1))


def test_islands_across_chunks(spark):
    flags = [1, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "key int, k long, f boolean")
    out = carry.islands(df, ["key"], "k", F.col("f"), 4).collect()
    assert sorted((r.start, r.end, r.flag) for r in out) == [(0, 3, True), (3, 5, False), (5, 13, True), (13, 14, False), (14, 15, True)]


@pytest.mark.parametrize("small", [100_000, 50])
def test_quantiles_by_bracket_and_by_whole_range(data, small):
    pdf, df = data
    probs = {"a": 0.0, "b": .1, "c": .5, "d": .9, "e": 1.0}
    out = carry.exact_quantiles(df, ["key"], "x", probs, accuracy=200, small=small).toPandas().set_index("key")
    for k, g in pdf.groupby("key"):
        np.testing.assert_allclose(out.loc[k, list(probs)].to_numpy(float), np.quantile(g.x, list(probs.values())), atol=1e-12)


def test_rank_with_ties_and_missing(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"key": 1, "v": np.where(rng.random(600) < .5, 3.0, rng.integers(0, 5, 600)), "tie": rng.permutation(600)})
    pdf.loc[:20, "v"] = None
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = carry.with_rank(df, ["key"], "v", "tie", bins=16).toPandas()
    live = out[out.v.notna()].sort_values(["v", "tie"], ascending=[False, True])
    assert live["rank"].tolist() == list(range(1, len(live) + 1))
    assert out[out.v.isna()]["rank"].isna().all()


def test_average_rank(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, 5.0)], "key int, v double")
    assert sorted(r.k for r in average_rank(df, ["key"], "v", "k").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_greedy_windows_match_a_plain_scan(spark):
    rng = np.random.default_rng(3)
    starts = np.sort(rng.choice(5000, 900, replace=False)) / 10.0
    df = spark.createDataFrame(pd.DataFrame({"key": 1, "start_sec": starts}))
    chosen = sorted(r.start_sec for r in greedy.nonoverlapping(df, "key", 7.3, 20.0).where("chosen").collect())
    want, end = [], -np.inf
    for s in starts:
        if s >= end - 1e-9:
            want.append(s)
            end = s + 7.3
    assert chosen == want


@pytest.mark.parametrize("seed", range(3))
def test_fallback_clock_matches_a_plain_loop(spark, seed):
    rng = np.random.default_rng(seed)
    raw = np.cumsum(rng.normal(1.0, 1.5, 400))
    raw[rng.random(400) < .3] = np.nan
    i = np.arange(400)
    df = spark.createDataFrame(pd.DataFrame({"key": 1, "i": i, "raw": raw})).withColumn("raw", F.when(~F.isnan("raw"), F.col("raw")))
    out = sequential_clock(df, "key", "i", "raw", 1.0, 16).toPandas().sort_values("i")
    t, used = _walk(i, raw, 1.0, None)
    np.testing.assert_allclose(out.t, t, atol=1e-9)
    assert (out.source.eq("container").to_numpy() == used).all()


def test_average_rank_reads_its_rows_once(spark):
    """A mean that comes out in another order of addition the second time kept its row from its own rank; so did a missing key."""
    df = spark.createDataFrame([("a", .1), ("a", .2), ("a", .3), ("a", None), (None, .5), (None, .4)], "key string, v double")
    means = df.groupBy("key", "v").agg(F.avg("v").alias("m"))
    out = average_rank(means, ["key"], "m", "k")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(r.key), r.v, r.k) for r in out.collect() if r.v is not None) == [("None", .4, 1.0), ("None", .5, 2.0), ("a", .1, 1.0), ("a", .2, 2.0), ("a", .3, 3.0)]
    assert [r.k for r in out.collect() if r.v is None] == [None]
