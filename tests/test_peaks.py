"""Peaks across block borders against one pass over the run."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.operators import ecg


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(4)
    ramp = np.zeros(400)
    ramp[5:395:3] = np.arange(130) + 1.0                                # a chain in which every peak outranks the one before
    plateaus = np.repeat(rng.integers(0, 4, 120), rng.integers(1, 6, 120)).astype(float)
    calm = np.concatenate([[0], np.full(150, 2.0), [5.0], np.full(150, 2.0), [0], np.full(99, 2.0)])       # decided far from the peak
    return {1: rng.random(500), 2: ramp, 3: plateaus, 4: np.round(rng.random(300), 1), 5: calm, 6: np.array([0.0, 1, 0]), 7: np.ones(30), 8: np.sin(np.arange(300) / 9) * np.arange(300)}


@pytest.mark.parametrize("block, distance", [(5000, 7), (100, 7), (16, 9), (33, 20), (64, 1)])
def test_equal_to_one_pass(spark, runs, block, distance):
    rows = [(r, j, float(v)) for r, x in runs.items() for j, v in enumerate(x)]
    df = spark.createDataFrame(rows, "run int, j long, a double").repartition(4)
    tops = ecg.local_maxima(df, ["run"], "j", "a", block).where("a >= 0.2")
    thin = ecg.thinned(tops, ["run"], "j", "a", distance, block) if distance > 1 else tops
    tall = ecg.prominent(df, thin.withColumn("least", F.lit(0.3)), ["run"], "j", "a", block)
    for name, got, prominence in (("thinned", thin, None), ("prominent", tall, 0.3)):
        have = {}
        for r in got.collect():
            have.setdefault(r["run"], []).append(r["j"])
        for r, x in runs.items():
            assert sorted(have.get(r, [])) == sorted(kn.find_peaks(x, distance, prominence, 0.2).tolist()), (name, r)
