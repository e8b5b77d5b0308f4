"""The classical study against plain loops over its cells."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import jobs

SF = "/root/testdata/sf0.001"


def test_equal_region_is_the_mean_of_what_is_there(spark):
    s = jobs.roi_samples(spark, SF)
    got = jobs.with_equal_region(s).toPandas()
    own, equal = got[got["roi"] != "equal_roi_average"], got[got["roi"] == "equal_roi_average"]
    want = own.groupby(["recording", "i"])[["r", "g", "b"]].mean().reset_index().sort_values(["recording", "i"], ignore_index=True)
    equal = equal.sort_values(["recording", "i"], ignore_index=True)
    assert len(own) == s.count() and len(equal) == len(want)
    assert own.groupby(["recording", "i"]).size().nunique() > 1                              # some places miss a region
    np.testing.assert_allclose(equal[["r", "g", "b"]], want[["r", "g", "b"]], rtol=1e-12)


def test_study_is_what_its_cells_say(spark):
    cells = jobs.study_cells(spark, SF)
    e = cells.toPandas()
    got = {(r["roi"], r["method"]): r for r in jobs.job_classical_study(spark, SF).collect()}
    assert {k[0] for k in got} == {"A", "N", "R", "equal_roi_average"} and len(got) == 24
    for key, part in e.groupby(["roi", "method"]):
        r = got[key]
        assert r["intended_cells"] == len(part) and r["eligible_cells"] == part["pred"].notna().sum()
        means = part.groupby("recording")[["abs_err", "sq", *jobs.INDICATORS]].mean()
        assert r["pooled_mae"] == pytest.approx(part["abs_err"].mean(), abs=1e-6) and r["balanced_mae"] == pytest.approx(means["abs_err"].mean(), abs=1e-6)
        assert r["balanced_rmse"] == pytest.approx(np.sqrt(means["sq"].mean()), abs=1e-6)
        for c in jobs.INDICATORS:
            both = means[["abs_err", c]].dropna()
            ranks = both.rank()
            defined = len(both) >= 3 and (ranks.std() > 0).all()
            want = ranks["abs_err"].corr(ranks[c]) if defined else None
            assert r[f"{c}_rho"] == (None if want is None else pytest.approx(want, abs=1e-6)), (key, c)


def test_every_cell_a_recording_owes_is_there(spark):
    """Short windows, and those a region lacks, were left out; so were what other windows and regions say of a cell, and the waveform's scores."""
    e = jobs.study_cells(spark, SF).toPandas()
    n = jobs.roi_samples(spark, SF).groupBy("recording", "roi").count().toPandas().groupby("recording")["count"].max()
    assert (e.groupby("recording").size() == 4 * 6 * np.ceil(n / jobs.BLOCK)).all() and not e.duplicated([*jobs.ROI, "method"]).any()
    none = e["failure"] == "NO_COMPUTABLE_PRIOR"
    assert none.any() and (~none).any() and e.loc[none, ["pred", "zero_lag_r", "periodicity"]].isna().all(axis=None)
    own = jobs.roi_samples(spark, SF).selectExpr("recording", "roi", f"i div {jobs.BLOCK} as window_index", "cast(discount > 0 as int) as ok").groupBy(*jobs.ROI).sum("ok").toPandas()
    support = e[e["roi"] != jobs.EQUAL].merge(own, "left", jobs.ROI)
    np.testing.assert_allclose(support["quality"], support["sum(ok)"].fillna(0) / jobs.BLOCK)
    assert (support["quality"] == 0).any()
    by = e.set_index([*jobs.ROI, "method"])["pred"].to_dict()
    last = e.groupby("recording")["window_index"].max().to_dict()
    for r in e.itertuples():
        other = by.get((r.recording, r.roi, r.window_index + (1 if r.window_index < last[r.recording] else -1), r.method), np.nan)
        rates = [by[r.recording, roi, r.window_index, r.method] for roi in "ANR"]
        for got, want in ((r.adjacent_window_hr_difference_bpm, abs(r.pred - other)), (r.inter_roi_hr_range_bpm, max(rates) - min(rates) if np.isfinite(rates).all() else np.nan)):
            assert got == pytest.approx(want, nan_ok=True)
    live = e[e["zero_lag_r"].notna()]
    assert len(live) and (live["lag_aligned_r"] >= live["zero_lag_r"]).all() and (live["lag_boundary"] == (live["selected_lag_ms"].abs() == 500)).all()
    got = {(r["roi"], r["method"]): r for r in jobs.job_classical_study(spark, SF).collect()}
    for key, part in e.groupby(["roi", "method"]):
        r = got[key]
        assert r["no_prior"] == (part["failure"] == "NO_COMPUTABLE_PRIOR").sum() and r["lag_boundary_cells"] == part["lag_boundary"].sum()
        for c in jobs.SCORES:
            want = part.groupby("recording")[c].mean().mean()
            assert r[f"balanced_{c}"] == (None if np.isnan(want) else pytest.approx(want, abs=1e-6))


def test_scores_of_known_waveforms(spark):
    t = np.arange(jobs.BLOCK) / jobs.RATE
    rng = np.random.default_rng(8)
    b = np.sin(2 * np.pi * 1.2 * t) + .3 * rng.normal(size=len(t))
    late = np.r_[rng.normal(size=3), b[:-3]]
    cells = [(1, "A", k, x.tolist(), f) for k, (x, f) in enumerate([(late, ""), (-b, ""), (b, "FLAT_SOURCE_RGB"), (b, "")])]
    cells = spark.createDataFrame(cells, "recording long, roi string, window_index long, x array<double>, failure string").selectExpr("*", "70.0D as pred")
    ref = spark.createDataFrame([(1, "A", k, b.tolist(), k < 3, 72.0) for k in range(4)], "recording long, roi string, window_index long, b array<double>, reference_usable boolean, ref double")
    got = {r["window_index"]: r for r in jobs.scored(cells, ref).collect()}
    assert got[0]["selected_lag_ms"] == 3000 / jobs.RATE and got[0]["lag_aligned_r"] == pytest.approx(1) and got[0]["zero_lag_r"] == pytest.approx(np.corrcoef(late, b)[0, 1])
    assert got[1]["zero_lag_r"] == pytest.approx(-1) and got[1]["err"] == -2                        # no polarity is turned
    assert got[2]["zero_lag_r"] is None and got[3]["zero_lag_r"] is None and got[0]["matched_band_r"] < 1


def test_window_tables_compute_only_what_they_return(spark, monkeypatch):
    """Support and targets passed through six methods, a filter and Python, three times over; and one way to index serves dense and sparse suppliers."""
    from pulsegrid.plans import QUERIES, jobs
    from pulsegrid.sources import tables
    plan = QUERIES["fixed_window_inputs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window " not in plan
    crop = QUERIES["cropped_roi_window_table"](spark, SF)
    assert crop._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 2             # the two places, no method
    whole = {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in ("fixed_window_inputs", "cropped_roi_window_table")}
    for module in (tables, jobs):
        monkeypatch.setattr(module, "DENSE", 10)
    for n, rows in whole.items():
        assert sorted(map(str, QUERIES[n](spark, SF).collect())) == rows and rows


def test_samples_are_dealt_by_their_number(spark, monkeypatch):
    from pulsegrid.sources import tables
    monkeypatch.setattr(tables, "PER_TASK", 500)
    s = tables.colour_samples(spark, SF)
    assert s.rdd.getNumPartitions() >= s.count() // 500                    # the session's number of shuffle partitions, however large the table


def test_a_window_passes_through_one_python_worker(spark, monkeypatch):
    """Methods, filters and spectra each had a worker of their own in a task, and windows were made in as many tasks as the session has partitions."""
    monkeypatch.setattr(jobs, "PER_TASK", 500)
    w = jobs.roi_windows(spark, SF)
    assert w._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert w.rdd.getNumPartitions() >= jobs.roi_samples(spark, SF).count() // 500
    written = []
    monkeypatch.setattr(jobs, "checkpointed", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    jobs.study_cells(spark, SF)
    assert len(written) == 3 and "MapInArrow" not in written[0] and written[1].count("MapInArrow") == 1


def test_kernels_read_what_kernels_before_them_made(spark):
    from pulsegrid.functions.batch import apply_kernels, job
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [4.0, 5.0, 6.0])], "id int, x array<double>")
    half = job(["x"], lambda m: [np.where(m == 5, np.nan, m / 2)], "h array<double>")               # a value that is missing: no total of that row
    out = apply_kernels(df, [half, job(["h"], lambda m: [m.sum(1)], "total double")])
    assert {r["id"]: r["total"] for r in out.collect()} == {1: 3.0, 2: None, 3: None}


def test_dealt_ranks_are_the_average_ranks(spark):
    from pulsegrid.operators import metrics as mt
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"key": rng.choice(["a", "b"], 4000), "recording": np.arange(4000), "v": np.r_[rng.normal(size=2000), rng.integers(0, 5, 2000)]})
    out = mt.average_rank_dealt(spark.createDataFrame(pdf), ["key"], "v", "recording", "rank", 1_000_000)
    assert out.rdd.getNumPartitions() >= 4
    got = out.toPandas().sort_values("recording")["rank"].to_numpy()
    np.testing.assert_array_equal(got, pdf.groupby("key")["v"].rank().to_numpy())
