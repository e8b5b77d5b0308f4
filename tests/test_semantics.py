"""Balanced statistics, splits, sources, beats and streaming rules on small fixtures."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.batch import apply_kernel
from pulsegrid.operators import beats as bt, ecg, metrics as mt, models as md, splits as sl
from pulsegrid.operators import spectral as sp
from pulsegrid.plans.ranking import assert_no_label_leak
from pulsegrid.sources import files as fl


def errors(spark, rows):
    return mt.with_error(spark.createDataFrame(rows, "subject string, pred double, ref double"))


def test_balanced_and_pooled_means(spark):
    e = errors(spark, [("S1", 71., 70.)] * 3 + [("S2", 79., 70.)]).withColumn("g", F.lit(1))
    assert e.agg(F.avg("abs_err")).first()[0] == 3.0
    assert mt.balanced_means(e, ["g"], "subject", ["abs_err"]).first().balanced_abs_err == 5.0


def test_balanced_rmse_takes_the_root_last(spark):
    e = errors(spark, [("a", 70., 70.), ("a", 74., 70.), ("b", 80., 70.)]).withColumns({"g": F.lit(1), "sq": F.col("err") * F.col("err")})
    b = mt.balanced_means(e, ["g"], "subject", ["abs_err", "sq"]).first()
    assert b.balanced_abs_err == 6.0 and b.balanced_sq == 54.0


def test_coverage_denominators(spark):
    e = errors(spark, [("S1", 71., 70.), ("S1", 71., 70.), ("S1", None, 70.), ("S1", 71., None), ("S2", 79., 70.), ("S2", 72., 70.)])
    c = mt.coverage_metrics(e.withColumns({"g": F.lit(1), "extraction_ok": F.lit(True)}), ["g"]).first()
    assert (c.windows, c.valid_pairs, c.prediction_failures, c.missing_labels) == (6, 4, 1, 1)
    assert c.finite_prediction_coverage == pytest.approx(5 / 6) and c.within_5 == .75


def test_centred_correlation_needs_repeats(spark):
    rows = [("a", 1., 2.), ("a", 2., 3.), ("b", 1., 1.), ("c", 1., 2.), ("d", 2., 2.), ("e", 3., 1.)]
    d = spark.createDataFrame(rows, "subject string, x double, y double").withColumn("g", F.lit(1))
    r = mt.centered_corr(d, ["g"], "subject", "x", "y").first()
    assert r.centered_corr is None and r.within_df == 1 and r.repeated_subjects == 1


def test_single_row_has_zero_spread_and_no_correlation(spark):
    r = errors(spark, [("a", 71., 70.)]).agg(*mt.named(mt.regression_aggs())).first()
    assert r.sd == 0.0 and r.pearson is None and r.n == 1


@pytest.mark.parametrize("n", [3, 5, 11, 40])
def test_split_is_a_partition(spark, n):
    s = sl.subject_split(spark.range(n).withColumnRenamed("id", "subject"), "subject").toPandas()
    assert len(s) == n and s.subject.is_unique and set(s.partition) == {"train", "validation", "test"}
    again = sl.subject_split(spark.range(n - 1, -1, -1).withColumnRenamed("id", "subject"), "subject").toPandas()
    assert dict(zip(s.subject, s.partition)) == dict(zip(again.subject, again.partition))


def test_two_subjects_make_a_smoke_split(spark):
    m = sl.split_manifest(spark.range(2).withColumnRenamed("id", "subject"), "subject").toPandas()
    assert m.smoke_only.all() and sorted(m.partition) == ["train", "validation"]


def test_scaling_uses_train_rows_only(spark):
    rows = spark.createDataFrame([(1., None, "train"), (3., 5., "train"), (1000., 9., "test")], "a double, b double, partition string")
    out = sl.impute_scale(rows, ["a", "b"]).orderBy("a").collect()
    assert [r.a_scaled for r in out] == [-1.0, 1.0, 998.0] and [r.b_scaled for r in out] == [0.0, 0.0, 4.0]


def test_target_columns_are_refused():
    assert assert_no_label_leak(["a"], ["a"]) == ["a"]
    for bad in (["sbp_mean"], ["other"]):
        with pytest.raises(ValueError):
            assert_no_label_leak(bad, ["a", "sbp_mean"])


def test_ridge_from_sums_equals_the_direct_fit():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    sums = {"n": 50.0, "t0": y.sum(), **{f"s{i}": x[:, i].sum() for i in range(2)}, **{f"c{i}_0": x[:, i] @ y for i in range(2)},
            **{f"p{i}_{j}": x[:, i] @ x[:, j] for i in range(2) for j in range(i, 2)}}
    w, b = md.solve(sums, 2, 1, 10.0)
    z = (x - x.mean(0)) / x.std(0)
    direct = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (y - y.mean()))
    np.testing.assert_allclose(x @ w[:, 0] + b[0], z @ direct + y.mean(), atol=1e-9)


@pytest.mark.parametrize("text,error", [("1 2 3 4\n60 61 62 63\n0 1 2 3", None), ("1 60 0\n2 61 1\n3 62 2\n4 63 3", None), ("1 2 3 4 60 61 62 63 0 1 2 3", None), ("1 2\n3 4", "unexpected_shape")])
def test_contact_reference_layouts(spark, text, error):
    r = fl.parse_contact_reference(spark.createDataFrame([("p", text)], "path string, content string")).first()
    assert r.error == error
    if error is None:
        assert list(r.t) == [0, 1, 2, 3] and list(r.ppg) == [1, 2, 3, 4] and list(r.hr) == [60, 61, 62, 63]


def test_files_round_trip_and_are_not_overwritten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 2 3\n60 61 62\n0 1 2")
    assert fl.parse_contact_reference(fl.whole_files(spark, str(tmp_path / "in"))).first().error is None
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id int, v double")
    fl.write_json(df, str(tmp_path / "json"))
    assert sorted(r.v is None for r in spark.read.schema("id int, v double").json(str(tmp_path / "json")).collect()) == [False, True]
    assert fl.write_once(df, str(tmp_path / "p")) and not fl.write_once(df, str(tmp_path / "p"))


def test_failed_kernel_rows_keep_their_place(spark):
    df = spark.createDataFrame([(1, [1., 2., 3.]), (2, None), (3, [1., None, 2.]), (4, [5., 6., 7.]), (5, [1.])], "id int, x array<double>")
    out = {r.id: r.s for r in apply_kernel(df, ["x"], lambda m: [m.sum(1)], "s double").collect()}
    assert out == {1: 6.0, 2: None, 3: None, 4: 18.0, 5: 1.0}


def pulse(spark, hz=1.2, fs=30.0, seconds=10):
    t = np.arange(int(fs * seconds)) / fs
    x = np.sin(2 * np.pi * hz * t) + .25 * np.sin(4 * np.pi * hz * t)
    return spark.createDataFrame([(1, x.tolist()), (2, [1.0] * len(t))], "id int, x array<double>")


def test_heart_rate_and_beats_of_a_pulse(spark):
    d = sp.with_hr(pulse(spark), "x", 30.0, 300)
    d = bt.with_beats(d, "x", 30.0).withColumns(bt.reliability("", "hr_bpm", 30.0)).withColumns(bt.pulse_features("", 30.0))
    good = d.where("id = 1").first()
    assert good.hr_bpm == pytest.approx(72, abs=.3) and good.reliable and good.ibi_mean_sec == pytest.approx(1 / 1.2, abs=.02)
    assert not d.where("id = 2").first().reliable


@pytest.mark.parametrize("delay", [-.12, .12])
def test_delay_sign_and_phase(spark, delay):
    fs, t = 60.0, np.arange(1200) / 60
    f = lambda t: np.sin(2 * np.pi * 1.2 * t) + .2 * np.sin(2 * np.pi * 2.4 * t)
    d = spark.createDataFrame([(f(t).tolist(), f(t - delay).tolist(), 1.2)], "x array<double>, y array<double>, hz double")
    d = sp.with_xcorr(d, "x", "y", 18).withColumn("rad", sp.window_radius(F.col("hz"), fs, .3, F.size("x")))
    d = sp.xcorr_delay(d, "xc", 18, "rad", fs).withColumn("phase", sp.phase_delay(F.col("x"), F.col("y"), F.col("hz"), fs)).first()
    assert d.delay == pytest.approx(delay, abs=1 / 60) and d.phase == pytest.approx(delay, abs=.015) and d.score > .9


def test_perfect_and_shifted_waveforms(spark):
    t = np.arange(304) / 30
    x = np.sin(2 * np.pi * 1.2 * t) + .25 * np.sin(2 * np.pi * 2.4 * t)
    rows = [("same", (3 * x[4:] + 10).tolist(), x[4:].tolist()), ("late", x[:300].tolist(), x[4:].tolist()), ("flat", [1.0] * 300, x[4:].tolist())]
    d = sp.with_lag_metrics(spark.createDataFrame(rows, "id string, p array<double>, t array<double>"), "p", "t", 300, 15)
    r = {x.id: x for x in d.collect()}
    assert r["same"].wave_corr == pytest.approx(1) and r["same"].aligned_nrmse == pytest.approx(0, abs=1e-6) and r["same"].selected_lag == 0
    assert r["late"].selected_lag == 4 and r["late"].d1_corr_same_lag == pytest.approx(1)
    assert r["flat"].wave_corr is None and r["flat"].selected_lag is None


def test_ecg_peaks_and_windows(spark):
    fs, n = 200.0, 200 * 40
    t = np.arange(n) / fs
    beats = np.arange(.5, 39.5, 60 / 72)
    x = sum(np.exp(-.5 * ((t - b) / .018) ** 2) for b in beats) + .002 * np.random.default_rng(0).normal(size=n) + .1 * np.sin(2 * np.pi * .3 * t)
    s = spark.createDataFrame(pd.DataFrame({"recording": 1, "k": range(n), "x": x}))
    p = ecg.r_peaks(s, "recording", fs, block=1000).select("recording", (F.col("k") / fs).alias("t"), F.col("ratio").alias("strength"))
    found = np.sort(p.toPandas().t)
    assert all(np.abs(found - b).min() < .03 for b in beats[1:-1])
    w = ecg.rr_window_hr(p, "recording", 10.0, 5.0).toPandas()
    assert (w.reason == "valid").all() and np.allclose(w.hr_bpm, 72, atol=.5)
    irregular = spark.createDataFrame([(1, float(v), 1.0) for v in np.cumsum([.4, 1.3] * 15)], "recording int, t double, strength double")
    assert (ecg.rr_window_hr(irregular, "recording", 10.0, 5.0).toPandas().reason == "irregular_or_missed_beats").all()


def test_consensus_prefers_the_supported_rate(spark):
    rows = [(1, "GREEN", "f", 1, 72.0, 1.0), (1, "CHROM", "f", 1, 73.0, .9), (1, "POS", "c", 1, 71.5, .8), (1, "GREEN", "c", 1, 140.0, 1.0)]
    c = spark.createDataFrame(rows, "recording int, method string, roi string, rank int, hr_bpm double, score double")
    r = bt.consensus(c, "recording").first()
    assert abs(r.hr_bpm - 72) < 1.5 and r.sources == 3 and r.clusters == 2


def test_sql_table_function(spark):
    from pulsegrid.functions.sql import register
    register(spark)
    spark.createDataFrame([(1, 600), (2, 100)], "recording int, n int").createOrReplaceTempView("sizes")
    got = spark.sql("select recording, start, end from sizes, lateral sliding_windows(n, 300, 150)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 300), (1, 150, 450), (1, 300, 600)]


def test_registered_kernel_joins_the_method_registry(spark):
    from pulsegrid.operators import colour as cl
    cl.register_method("RED", lambda r, g, b, fs: r - r.mean(1, keepdims=True))
    try:
        w = spark.createDataFrame([([1., 2., 3.], [0.] * 3, [0.] * 3)], "r array<double>, g array<double>, b array<double>")
        assert cl.window_methods(w, ["RED"], 30.0).first().RED == [-1.0, 0.0, 1.0]
        with pytest.raises(ValueError):
            cl.register_method("RED", None)
    finally:
        del cl.KERNEL_METHODS["RED"]


def test_optical_weights_abstain_and_never_renormalize(spark):
    from pulsegrid.operators import optical as op
    rows = [("f", 0, f, p, 160., 120., 100., 0.9, 0.0 if (p, f) != (1, 3) else .9, True) for f in range(10) for p in range(3)]
    patches = spark.createDataFrame(rows, "roi string, block long, frame long, patch int, r double, g double, b double, chroma_compatible_fraction double, clipped_fraction double, valid boolean")
    w = op.patch_weights(patches, patches, None, ["roi"])
    assert {r.reason for r in w.collect()} == {"ABSTAIN_SKIN_UNVERIFIED"} and sum(r.weight for r in w.collect()) == pytest.approx(1)
    mixed = {r.frame: r for r in op.patch_mix(patches, w, ["roi"]).collect()}
    assert not mixed[3].available and mixed[3].r is None and mixed[4].r == pytest.approx(160)
    low = op.patch_weights(patches, patches.withColumn("chroma_compatible_fraction", F.lit(.1)), None, ["roi"])
    assert {r.reason for r in low.collect()} == {"ABSTAIN_WHOLE_ROI_LOW_SKIN_PROXY"}


def test_digest_tree_is_order_sensitive_and_split_invariant(spark):
    from pulsegrid.operators.assoc import digest_sequence
    a = spark.createDataFrame([(1, i, f"x{i}") for i in range(600)], "k int, i long, x string")
    d = lambda df: digest_sequence(df, ["k"], "i", F.col("x")).first()
    assert d(a).items == 600 and d(a).digest == d(a.repartition(7)).digest
    assert d(a.withColumn("i", 599 - F.col("i"))).digest != d(a).digest


STREAMS = ["stream_window_quality", "stream_run_sessions", "stream_dedupe_windows", "stream_motion", "stream_identity_lock", "stream_fallback_clock", "stream_late_policy"]


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The event table as a folder of shuffled part files."""
    folder = tmp_path_factory.mktemp("parts")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4, F.rand(3)).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("key", STREAMS)
def test_streams_read_one_file_and_many_alike(spark, in_parts, key):
    from pulsegrid.plans import QUERIES
    one, many = (sorted(map(str, QUERIES[key](spark, d).collect())) for d in ("/root/testdata/sf0.001", in_parts))
    assert one and one == many


def test_unset_folder_is_refused_off_one_machine():
    from types import SimpleNamespace
    from pulsegrid.session import shared_folder
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("local[4]"), "x")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master), "x")


def test_failing_kernel_loses_only_its_rows(spark):
    from pulsegrid.functions.batch import apply_kernel

    def fragile(m):
        if (m[:, 0] == 2).any():
            raise np.linalg.LinAlgError("no convergence")
        return m.sum(1), m * 2

    w = spark.createDataFrame([(k, [float(k), 1.0] + [3.0] * (k % 2)) for k in range(6)] + [(9, None)], "k int, x array<double>")
    got = {r.k: (r.s, r.y) for r in apply_kernel(w, ["x"], fragile, "s double, y array<double>").collect()}
    assert got[2] == (None, None) and got[9] == (None, None)
    assert got[4] == (5.0, [8.0, 2.0]) and got[3] == (7.0, [6.0, 2.0, 6.0])


def test_digest_tree_grows_with_the_sequence(spark):
    from pulsegrid.operators.assoc import digest_sequence
    a = spark.createDataFrame([(k, i, f"x{i}") for k, n in ((1, 70), (2, 3)) for i in range(n)], "k int, i long, x string")
    d = {r.k: r for r in digest_sequence(a, ["k"], "i", F.col("x"), block=4).collect()}
    alone = digest_sequence(a.where("k = 2"), ["k"], "i", F.col("x"), block=4).first()
    assert {k: r["items"] for k, r in d.items()} == {1: 70, 2: 3} and d[2].digest == alone.digest


def test_overlap_sees_every_partition_value(spark):
    from pulsegrid.operators.assoc import running_overlap
    iv = spark.createDataFrame([(1, 0.0, 50.0, 1, "fold-a"), (1, 10.0, 20.0, 2, "fold-b"), (1, 60.0, 70.0, 3, "fold-a")], "k int, start_sec double, end_sec double, event_id int, part string")
    assert {r.event_id: r.overlaps for r in running_overlap(iv, ["k"], "part", 30.0).collect()} == {1: False, 2: True, 3: False}


def test_ranks_with_an_outlier_and_ties(spark):
    from pulsegrid.operators.carry import with_rank
    rows = [(1, float(v % 50), i) for i, v in enumerate(range(3000))] + [(1, 1e12, 5000), (1, 7.0, 5001)]
    got = {r.i: r["rank"] for r in with_rank(spark.createDataFrame(rows, "k int, v double, i long"), ["k"], "v", "i").collect()}
    want = {i: n + 1 for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert got == want


@pytest.mark.parametrize("bucket", [3.0, 25.0, 400.0])
def test_greedy_choice_with_one_dense_key(spark, bucket):
    from pulsegrid.operators.greedy import nonoverlapping
    rng = np.random.default_rng(2)
    rows = [(1, float(t)) for t in np.unique(rng.integers(0, 4000, 900) / 10)] + [(2, float(t)) for t in range(0, 90, 7)]
    got = nonoverlapping(spark.createDataFrame(rows, "k int, start_sec double"), "k", 5.0, bucket)
    for key in (1, 2):
        end, want = -1e9, []
        for t in sorted(t for k, t in rows if k == key):
            if t >= end - 1e-9:
                want.append(t)
                end = t + 5.0
        assert sorted(r.start_sec for r in got.where(f"k = {key} and chosen").collect()) == want


def test_reference_sums_do_not_depend_on_the_order_of_lines(spark):
    from pulsegrid.sources.tables import steady_sum
    lines = [("a", v) for v in (.1, .2, .3)] + [("b", v) for v in (.3, .2, .1)] + [("c", float("inf")), ("c", 1.0), ("d", None)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(lines, "k string, v double").coalesce(1).groupBy("k").agg(steady_sum(F.col("v")).alias("s")).collect()}
    assert got["a"] == got["b"] and got["a"] == pytest.approx(.6)            # the plain sums differ in the last bit, and ranks with them
    assert got["c"] == float("inf") and got["d"] is None


def test_a_delay_window_is_gathered_once_for_all_policies(spark, monkeypatch):
    """Grid rows, their windows and delays were made, shuffled and written once a policy."""
    from pulsegrid.plans import jobs
    sf = "/root/testdata/sf0.001"
    whole = {str(r) for r in jobs.job_delay_feasibility(spark, sf).collect()}
    written, keep = [], jobs.checkpointed
    monkeypatch.setattr(jobs, "checkpointed", lambda df: written.append(df) or keep(df))
    assert {str(r) for r in jobs.job_delay_feasibility(spark, sf).collect()} == whole and len(whole) == 18
    assert not any({"x", "y"} & set(df.columns) for df in written)                                  # no samples
    windows = [df for df in written if "lag" in df.columns]
    assert len(windows) == 1 and windows[0].count() == max(r["windows"] for r in jobs.job_delay_feasibility(spark, sf).collect())
    monkeypatch.setattr(jobs.ck, "DENSE", 10)                                                      # recordings that are cut into buckets
    assert {str(r) for r in jobs.job_delay_feasibility(spark, sf).collect()} == whole


def test_the_split_of_a_window_reaches_the_timing_diagnostics(spark):
    """Delays of the halves were computed and dropped, and were missing in every window, as half of one is under three seconds."""
    from pulsegrid.plans import spectral

    def delay(x, y, hz):
        x, y = x - x.mean(), y - y.mean()
        r = min(8, int(.49 * 16 / hz), len(x) - 3)
        c = np.correlate(y, x, "full")[len(x) - 1 - r:len(x) + r] / np.sqrt((x * x).sum() * (y * y).sum())
        k = int(c.argmax())
        if not 0 < k < 2 * r:
            return None
        den = c[k - 1] - 2 * c[k] + c[k + 1]
        return (k - r + (np.clip(.5 * (c[k - 1] - c[k + 1]) / den, -.5, .5) if abs(den) > 1e-12 else 0)) / 16

    sf = "/root/testdata/sf0.001"
    got = {r["vec_id"]: r for r in spectral.timing_diagnostics(spark, sf).collect()}
    rows = spectral.delays(spark, sf).select("vec_id", "x", "y", "hr_hz").collect()
    for r in rows:
        x, y = np.array(r["x"]), np.array(r["y"])
        first, last = delay(x[:48], y[:48], r["hr_hz"]), delay(x[-48:], y[-48:], r["hr_hz"])
        assert got[r["vec_id"]]["first_half_delay_sec"] == (None if first is None else pytest.approx(first, abs=1e-6))
        assert got[r["vec_id"]]["second_half_delay_sec"] == (None if last is None else pytest.approx(last, abs=1e-6))
        both = None if first is None or last is None else abs(last - first)
        assert got[r["vec_id"]]["split_difference_sec"] == (None if both is None else pytest.approx(both, abs=1e-6))
    assert len(rows) == len(got) and len({r["split_difference_sec"] for r in got.values()}) > 10
    assert all(0 <= r["delay_phase_coherence"] <= 1 for r in got.values())
