"""Gap, run, interval and window semantics on hand-made traces."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import assoc as ac, clock as ck, signals as sg


def trace(spark, t, valid=None, x=None, rec=1):
    t = np.asarray(t, float)
    pdf = pd.DataFrame({"recording": rec, "event_id": range(len(t)), "t": t, "x": t if x is None else x, "valid": np.ones(len(t), bool) if valid is None else valid})
    return spark.createDataFrame(pdf)


def resampled(spark, samples, points, max_gap, bucket=1.0):
    grid = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate(points)], "recording long, k long, t double")
    out = ck.bounded_resample(samples, grid, ["recording"], ["x"], max_gap, bucket).toPandas().sort_values("k")
    return out


def test_long_gap_stays_open_and_ends_are_not_extrapolated(spark):
    valid = np.ones(100, bool)
    valid[30:60] = False
    s = trace(spark, np.arange(100) / 30, valid)
    out = resampled(spark, s, np.arange(-1, 101) / 30, .15)
    x = out.x.to_numpy()
    assert np.isnan(x[0]) and np.isnan(x[-1]) and np.isnan(x[31:61]).all() and not out.imputed.any()
    np.testing.assert_allclose(x[1:31], np.arange(30) / 30, atol=1e-12)


def test_short_gap_is_filled_and_flagged(spark):
    valid = np.ones(20, bool)
    valid[[5, 6]] = False
    out = resampled(spark, trace(spark, np.arange(20) / 30, valid), np.arange(20) / 30, .15)
    assert out.x.notna().all() and out.index[out.imputed].size == 2 and out.k[out.imputed].tolist() == [5, 6]
    np.testing.assert_allclose(out.x, np.arange(20) / 30, atol=1e-12)


def test_reference_line_is_reproduced(spark):
    s = trace(spark, .01 + np.arange(300) / 100)
    points = spark.createDataFrame([(1, i, i / 30) for i in range(1, 85)], "recording long, k long, t double")
    out = ck.resample_unbounded(s, points, ["recording"], "x", .5).toPandas()
    np.testing.assert_allclose(out.value, out.t, atol=1e-9)


@pytest.mark.parametrize("bucket", [5.0, 1000.0])
def test_guards_are_half_open(spark, bucket):
    ev = spark.createDataFrame([(1, a, b, True) for a, b in ((60., 110.), (145., 195.), (220., 270.))], "recording long, start_sec double, end_sec double, timing_verified boolean")
    t = [54.9, 55, 59.9, 60, 109.9, 110, 114.9, 115, 140]
    m = ck.sample_phase(trace(spark, t).select("recording", "event_id", "t"), ev, ["recording"], 5.0, bucket).orderBy("t").toPandas()
    assert m.cuff_active.tolist() == [False, False, False, True, True, False, False, False, False]
    assert m.candidate_cuff_free.tolist() == [True, False, False, False, False, False, False, True, False]


@pytest.mark.parametrize("size", [None, (400, 400), (400, ck.DENSE + 1)])
def test_one_sweep_serves_several_guards(spark, size):
    rng = np.random.default_rng(4)
    start = rng.uniform(0, 900, 40)
    ev = pd.DataFrame({"recording": rng.integers(1, 4, 40), "start_sec": start, "end_sec": start + rng.uniform(0, 60, 40), "timing_verified": rng.random(40) < .9})
    ev.loc[[3, 7], "end_sec"] = np.nan
    ev.loc[[5], "start_sec"] = np.nan
    ev = spark.createDataFrame(ev).replace(float("nan"), None)
    samples = trace(spark, rng.integers(0, 1000, 300)).withColumn("recording", F.col("event_id") % 5).select("recording", "event_id", "t")
    masks = ["cuff_active", "cuff_boundary_guard", "candidate_cuff_free", "verified_cuff_free", "timing_uncertain"]
    got = {r["event_id"]: r for r in ck.sample_phase(samples, ev, ["recording"], {"A": 0.0, "B": 12.5}, 100.0, size).collect()}
    for name, guard in (("A", 0.0), ("B", 12.5)):
        one = ck.sample_phase(samples, ev, ["recording"], guard, 100.0).collect()
        assert len(one) == len(got) == 300 and all(got[r["event_id"]][m][name] == r[m] for r in one for m in masks)


def test_samples_of_small_recordings_are_swept_where_they_are(spark):
    ev = spark.createDataFrame([(1, 60., 70., True)], "recording long, start_sec double, end_sec double, timing_verified boolean")
    size = (600_000, 1000)
    m = ck.sample_phase(ck.dealt(trace(spark, range(100)), size[0], "recording"), ev, ["recording"], {"A": 0.0}, 10.0, size)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange") == 2                       # samples and borders, once each


def test_missing_end_blocks_everything_after(spark):
    ev = spark.createDataFrame([(1, 60., None, False), (1, 145., 195., True)], "recording long, start_sec double, end_sec double, timing_verified boolean")
    m = ck.sample_phase(trace(spark, [10, 54, 56, 130, 500]).select("recording", "event_id", "t"), ev, ["recording"], 5.0, 20.0).orderBy("t").toPandas()
    assert m.candidate_cuff_free.tolist() == [True, True, False, False, False] and m.timing_uncertain.all()
    ext = spark.createDataFrame([(1, 0., 300.)], "recording long, t0 double, t1 double")
    blocked = ev.select("recording", (F.col("start_sec") - 5).alias("start_sec"), (F.col("end_sec") + 5).alias("end_sec"))
    assert [(r.start_sec, r.end_sec) for r in ck.interval_complement(blocked, ext, ["recording"], 50.0).collect()] == [(0.0, 55.0)]


def test_union_counts_overlap_once(spark):
    iv = spark.createDataFrame([(1, 0., 10.), (1, 5., 15.), (1, 40., 41.)], "recording long, start_sec double, end_sec double")
    assert ck.interval_union(iv, ["recording"], 3.0).first().union_sec == 16.0


def test_window_needs_one_whole_association(spark):
    w = spark.createDataFrame([(1, 0., 10.), (1, 5., 15.)], "recording long, start_sec double, end_sec double")
    iv = spark.createDataFrame([(1, 5., 15., 120.)], "recording long, start_sec double, end_sec double, sbp double")
    out = ac.contained(w, iv, ["recording"], ["sbp"], 100.0).orderBy("start_sec").collect()
    assert [r.inside for r in out] == [False, True] and out[1].interval.sbp == 120.0


def test_preceding_interval_respects_the_distance(spark):
    ev = spark.createDataFrame([(1, 7, 60.)], "recording long, event_id long, start_sec double")
    iv = spark.createDataFrame([(1, 0., 55.), (1, 70., 80.)], "recording long, start_sec double, end_sec double")
    hit = lambda d: ac.preceding(ev, iv, ["recording"], [], d, 10.0).first().interval
    assert hit(30.0).end_sec == 55.0 and hit(3.0) is None


def test_windows_do_not_depend_on_later_samples(spark):
    n = spark.createDataFrame([(1, 600)], "recording long, n long")
    a = ck.sliding_windows(n, ["recording"], 300, 150).collect()
    b = ck.sliding_windows(n.withColumn("n", F.lit(900).cast("long")), ["recording"], 300, 150).collect()
    assert [(r.start, r.end) for r in a] == [(0, 300), (150, 450), (300, 600)] and set(map(tuple, a)) <= set(map(tuple, b))


def test_dense_keys_get_narrow_buckets(spark):
    s = trace(spark, np.arange(1000) / 100)
    assert ck.bucket_width(s, ["recording"], 10.0, 10_000, 100) == 10.0
    assert .3 <= ck.bucket_width(s, ["recording"], 10.0, 50, 100) <= .5


def segment(spark, x, chunk, block, halo):
    pdf = pd.DataFrame({"recording": 1, "k": range(len(x)), "g": x})
    s = spark.createDataFrame(pdf).withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    y, runs = sg.segment_signal(s, ["recording"], 30.0, .7, 4.0, 60, 30, F.col("g").isNotNull(), chunk=chunk, block=block, halo=halo)
    return y.toPandas().sort_values("k").signal.to_numpy(float), runs.toPandas()


def test_filter_does_not_cross_gaps(spark):
    x = np.sin(2 * np.pi * 1.2 * np.arange(600) / 30)
    x[250:350] = np.nan
    y, runs = segment(spark, x, 64, 8192, 1024)
    assert np.isnan(y[220:380]).all() and len(runs) == 2 and np.isfinite(y[30:220]).all()


def test_blocked_filter_equals_one_pass(spark):
    x = np.random.default_rng(0).normal(size=3000)
    whole, _ = segment(spark, x, 100000, 100000, 10)
    parts, _ = segment(spark, x, 128, 512, 400)
    np.testing.assert_allclose(parts, whole, atol=1e-9, equal_nan=True)


def test_blocked_spline_equals_one_pass(spark):
    rng = np.random.default_rng(0)
    t = np.cumsum(rng.random(400) * .1 + .01)
    s = trace(spark, t, x=rng.normal(size=400)).withColumn("i", F.col("event_id")).select("recording", "t", "x", "i")
    at = np.linspace(t[0], t[-1], 500)[:-1]
    lo = np.searchsorted(t, at, side="right") - 1
    p = spark.createDataFrame(pd.DataFrame({"recording": 1, "k": range(len(at)), "t": at, "linear": 0.0, "lo_i": lo}))
    run = lambda block: sg.bounded_cubic(s, p, ["recording"], "x", 1.0, 5.0, block, 40).toPandas().sort_values("k").value.to_numpy()
    np.testing.assert_allclose(run(32), run(100000), atol=1e-10)


def test_unfolded_rows_are_spread_by_their_number(spark):
    from pulsegrid.operators.clock import explode_ids
    g = explode_ids(spark.range(40), ["id"], F.lit(50_000), "k")
    sizes = [r["n"] for r in g.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2_000_000 and max(sizes) <= 1_000_000            # one task had them all: the blocks were coalesced by their bytes
    assert explode_ids(spark.range(3), ["id"], F.lit(0), "k").count() == 0


def test_reference_grid_is_joined_before_it_is_unfolded(spark):
    samples = spark.createDataFrame([(1, 0.0), (1, 10.0), (2, 0.0), (2, 4.0), (3, 0.0), (3, 2.0)], "key int, t double")
    within = spark.createDataFrame([(1, 2.5, 6.0), (2, 9.0, 9.5)], "key int, a double, b double")
    g = ck.shared_grid(samples, ["key"], 1.0, within)
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")                # the join lies below the unfolding
    assert sorted((r["key"], r["k"], r["t"]) for r in g.collect()) == [(1, k, float(k)) for k in (3, 4, 5, 6)]


def test_neighbours_are_dealt_by_their_number(spark, monkeypatch):
    """The tasks were as many as the session's partitions, however many the points; small keys stay whole, dense ones are cut, with the same rows."""
    samples = spark.range(40).select((F.col("id") % 4).alias("recording"), (F.col("id") * 7919 % 100000).cast("double").alias("t"), F.col("id").cast("double").alias("x"))
    size = ck.grid_size(samples, ["recording"], 1.0)
    grid = ck.shared_grid(samples, ["recording"], 1.0)
    assert size[0] == grid.count() + 40 and size[1] < size[0]
    near = lambda: ck.neighbours(samples, grid, ["recording"], ["x"], 5000.0, size)
    whole = near()
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    rows = lambda df: df.agg(F.count("*"), F.sum(F.hash("recording", "k", "lo", "hi"))).first()
    expected = rows(ck.neighbours(samples, grid, ["recording"], ["x"], 5000.0))
    assert rows(whole) == expected
    monkeypatch.setattr(ck, "DENSE", 10)
    cut = near()
    assert f", {-(-size[0] // 250_000)}" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert rows(cut) == expected


def test_spline_travels_with_its_samples(spark, monkeypatch):
    """Every point passed through Python and three joins by bucket; now second derivatives are a column of the samples. Dense keys, cut in buckets, agree."""
    from pulsegrid.plans import QUERIES
    sf = "/root/testdata/sf0.001"
    q = QUERIES["bounded_cubic"](spark, sf)
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "Join" not in plan
    whole = {n: sorted(map(str, QUERIES[n](spark, sf).collect())) for n in ("bounded_cubic", "rate_adapter")}
    for module in (ck, sg):
        monkeypatch.setattr(module, "DENSE", 10)
    for n, rows in whole.items():
        assert sorted(map(str, QUERIES[n](spark, sf).collect())) == rows and rows


def test_spline_of_samples_is_the_one_of_points(spark):
    rng = np.random.default_rng(11)
    t = np.cumsum(rng.choice([.2, .5, 3.0], 300, p=[.6, .3, .1]))
    pdf = pd.DataFrame({"recording": 1, "t": t, "x": rng.normal(size=300), "i": np.arange(300)})
    s = spark.createDataFrame(pdf)
    at = np.sort(np.r_[rng.uniform(t[0] - 1, t[-1] + 1, 900), t])
    grid = spark.createDataFrame(pd.DataFrame({"recording": 1, "k": np.arange(len(at)), "t": at}))
    hi = np.searchsorted(t, at)
    exact = (hi < 300) & (t[np.minimum(hi, 299)] - at <= 1e-8)
    lo = np.clip(hi - 1, 0, 299)
    near = (hi > 0) & (hi < 300) & (t[np.minimum(hi, 299)] - t[lo] <= 1.0 + 1e-8)
    linear = np.where(exact, pdf.x[np.minimum(hi, 299)], np.where(near, np.interp(at, t, pdf.x), np.nan))
    p = grid.toPandas().assign(linear=linear, lo_i=np.where(exact, np.minimum(hi, 299), lo))
    p = spark.createDataFrame(p).withColumn("linear", F.when(~F.isnan("linear"), F.col("linear")))
    want = sg.bounded_cubic(s, p, ["recording"], "x", 1.0, 5.0, 4).toPandas().sort_values("k").value.to_numpy(float)
    for size in (None, (300, 300)):
        m = sg.with_moments(s, ["recording"], "x", 1.0, 5.0, 4, size)
        u = ck.neighbours(m, grid, ["recording"], ["x", "run", "run_size", "m"], 5.0)
        got = u.select("k", sg.spline_between(F.col("t"), F.col("lo"), F.col("hi"), "x", 1.0).alias("value")).toPandas().sort_values("k").value.to_numpy(float)
        np.testing.assert_allclose(got, want, atol=1e-9)
        assert np.isnan(got).any() and np.isfinite(got).sum() > 300


def test_runs_of_small_keys_stay_in_place(spark, monkeypatch):
    """Labels were joined by (recording, bucket): from some size on in as many tasks as the session has partitions. Dense keys, cut in buckets, agree."""
    from pulsegrid.plans import QUERIES
    sf, written = "/root/testdata/sf0.001", []
    keep = sg.checkpointed
    monkeypatch.setattr(sg, "checkpointed", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    whole = sorted(map(str, QUERIES["rgb_trace_process"](spark, sf).collect()))
    assert len(written) == 1 and "Window" in written[0] and "Join" not in written[0]
    for module in (ck, sg):
        monkeypatch.setattr(module, "DENSE", 10)
    assert sorted(map(str, QUERIES["rgb_trace_process"](spark, sf).collect())) == whole and whole
    assert "Join" in written[1]


def test_samples_of_windows_are_dealt_by_their_number(spark):
    from pulsegrid.plans.clock import window_quality
    plan = window_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert any("window_index" in line for line in dealt)                 # as many tasks as the session has partitions, however many samples
