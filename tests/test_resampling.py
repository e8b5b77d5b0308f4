"""Bootstrap vectors against one draw at a time."""
import hashlib
import random

import numpy as np
import pytest

from pulsegrid.operators import resampling as rs


def plain_count(subject, draw):
    h = int(hashlib.sha256(f"{rs.SEED}:{draw // 10}:{subject}".encode()).hexdigest()[6 * (draw % 10):6 * (draw % 10) + 6], 16)
    return sum(h >= c for c in rs.SHARES)


def test_counts_are_poisson_and_plain():
    got = rs.counts(["a", "17"], 100)
    assert [[plain_count(s, d) for d in range(100)] for s in ("a", "17")] == got.tolist()
    many = rs.counts([str(k) for k in range(200)])
    assert many.mean() == pytest.approx(1, abs=.01) and many.var() == pytest.approx(1, abs=.02)


def test_weighted_sums(spark, monkeypatch):
    r = random.Random(1)
    cells = [(f"s{r.randint(0, 30)}", r.choice("ab"), r.randint(0, 3), r.choice([None, r.random()])) for _ in range(300)]
    df = spark.createDataFrame(cells, "subject string, key string, k long, v double").repartition(3)
    got = {(x["key"], x["k"]): x["sums"] for x in rs.weighted_sums(df, 50).collect()}
    for (key, k), sums in got.items():
        want = [sum(v * plain_count(s, d) for s, a, b, v in cells if (a, b) == (key, k) and v is not None) for d in range(50)]
        assert sums == pytest.approx(want)
    assert set(got) == {(a, b) for _, a, b, v in cells if v is not None}


@pytest.mark.parametrize("bins, region", [(64, 50_000), (4, 10), (2, 1)])
def test_pooled_quantiles(spark, bins, region):
    """Many refinements and none: ties, one value only, subjects with many values, a key that few draws take."""
    r = random.Random(bins)
    rows = [(f"s{r.randint(0, 12)}", "many", round(r.gauss(0, 3), 1)) for _ in range(150)]
    rows += [("s1", "one", 2.5)] + [(f"s{k}", "tied", 1.0) for k in range(9)] + [("s2", "few", 1.0), ("s3", "few", 4.0), ("s3", "few", None)]
    df = spark.createDataFrame(rows, "subject string, key string, x double").repartition(3)
    got = {(x["key"], x["name"]): x["per_draw"] for x in rs.pooled_quantiles(df, {"median": .5, "p90": .9}, 40, bins, region).collect()}
    assert len(got) == 8
    for (key, name), per_draw in got.items():
        for d, v in enumerate(per_draw):
            pool = [x for s, k, x in rows if k == key and x is not None for _ in range(plain_count(s, d))]
            assert v == pytest.approx(np.percentile(pool, {"median": 50, "p90": 90}[name])) if pool else v is None, (key, name, d)
