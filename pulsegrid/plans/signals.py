"""Run filtering, splines, rate change, beats, morphology and ECG queries."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.functions.batch import apply_kernel, apply_kernels, job
from pulsegrid.functions.cols import finite, joined, reasons, rnd
from pulsegrid.operators import beats as bt, clock as ck, ecg, signals as sg, spectral as sp
from pulsegrid.operators.carry import dealt, with_index, with_place, with_prev
from pulsegrid.plans.clock import FS as HOURLY, KEY, MAX_GAP, span, uniform
from pulsegrid.plans.recursion import runs_sql
from pulsegrid.plans.registry import COLOUR, GRID, R, RESAMPLED, TRACE, query
from pulsegrid.plans.spectral import RADIUS, coherence_job, delays, quality_columns, quality_jobs, spectral_peaks, with_coherence, with_rate_array
from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import FS, colour_samples, trace, wave_pairs, waves

L = 64


def colour_grid(spark, d):
    return colour_samples(spark, d).select("recording", F.col("i").alias("k"), "r", "g", "b", "discount", "flag")


@query("segment_signal", f"""with recursive {COLOUR}, smp as (select recording, i as k, flag <> 'A' or discount > 0 as ok, g as v from colour), {runs_sql('sg', 'smp', FS, .7, 4.0, 32, 4)},
 sig as (select recording, case when good and j >= 4 and j < n - 4 then y[j + 1] end as signal from sg),
 kept as (select recording, count(signal) as retained, sqrt(avg(signal * signal)) as rms from sig group by 1), al as (select recording, count(*) as samples from smp group by 1),
 rn as (select recording, cast(count_if(good) as bigint) as segments, cast(count_if(not good) as bigint) as failed_runs from (select distinct recording, run, good from sg) group by 1)
select al.recording, samples, coalesce(retained, 0) as retained, {R('rms')} as rms, segments, failed_runs from al left join kept using (recording) left join rn using (recording)""")
def segment_signal(spark, d):
    ok = (F.col("flag") != "A") | (F.col("discount") > 0)
    # the run chain reads the indexed samples many times
    y, runs = sg.segment_signal(checkpointed(colour_grid(spark, d)), ["recording"], FS, .7, 4.0, max(4, int(2.0 * FS)), 4, ok, chunk=512)
    kept = y.groupBy("recording").agg(F.count("*").alias("samples"), F.count("signal").alias("retained"), rnd(F.sqrt(F.avg(F.col("signal") * F.col("signal")))).alias("rms"))
    r = runs.groupBy("recording").agg(F.count_if(F.col("reason") == "").alias("segments"), F.count_if(F.col("reason") != "").alias("failed_runs"))
    return kept.join(r, "recording", "left")


def process(spark, d):
    """Bounded resampling, run filtering and edge blanking of every trace on its shared grid."""
    u = uniform(spark, d)
    size = ck.grid_size(trace(spark, d), KEY, HOURLY)
    return u, *sg.segment_signal(u, KEY, HOURLY, .05 * HOURLY, .25 * HOURLY, 48, 3, F.col("x").isNotNull(), channel="x", chunk=256, size=size)


@query("rgb_trace_process", f"""with recursive {TRACE}, {GRID}, {RESAMPLED}, smp as (select recording, k, x is not null as ok, x as v from uniform), {runs_sql('sg', 'smp', HOURLY, .05 * HOURLY, .25 * HOURLY, 48, 3)},
 sig as (select recording, case when good and j >= 3 and j < n - 3 then y[j + 1] end as signal from sg),
 al as (select recording, count(*) as points, avg((x is not null)::int) as support, avg(imputed::int) as imputed from uniform group by 1),
 st as (select recording, count(signal) as valid, stddev_pop(signal) as amplitude from sig group by 1),
 rn as (select recording, cast(count_if(good) as bigint) as segments, cast(count_if(not good) as bigint) as failures from (select distinct recording, run, good from sg) group by 1)
select al.recording, points, segments, failures, {R('support')} as support, {R('imputed')} as imputed, {R('coalesce(valid, 0) / points')} as signal_valid, {R('amplitude')} as amplitude
 from al left join st using (recording) left join rn using (recording)""")
def rgb_trace_process(spark, d):
    u, y, runs = process(spark, d)
    a = u.groupBy(*KEY).agg(F.count("*").alias("points"), F.avg(F.col("x").isNotNull().cast("double")).alias("support"), F.avg(F.col("imputed").cast("double")).alias("imputed"))
    s = y.groupBy(*KEY).agg(F.avg(F.col("signal").isNotNull().cast("double")).alias("signal_valid"), F.stddev_pop("signal").alias("amplitude"))
    r = runs.groupBy(*KEY).agg(F.count_if(F.col("reason") == "").alias("segments"), F.count_if(F.col("reason") != "").alias("failures"))
    return a.join(s, KEY).join(r, KEY, "left").select(*KEY, "points", "segments", "failures", *[rnd(c).alias(c) for c in ("support", "imputed", "signal_valid", "amplitude")])


def trace_size(spark, d):
    """Samples of all recordings, and of the largest."""
    n = trace(spark, d).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return tuple(v or 0 for v in n.agg(F.sum("n"), F.max("n")).first())


def knots(spark, d, size):
    s = trace(spark, d).where("valid")
    if size[1] <= ck.DENSE:
        return with_place(dealt(s, size[0], *KEY), KEY, ["t", "event_id"], "i").select(*KEY, "t", "x", "i")
    return checkpointed(with_index(s.withColumn("day", F.floor(F.col("t") / 86400.0)), KEY, "day", ["t", "event_id"], "i").select(*KEY, "t", "x", "i"))


def cubic(spark, d, fs):
    """Points of the grid with the bounded cubic value: the second derivatives are a column of the samples, so a point needs its two neighbours alone."""
    s, size = trace(spark, d), trace_size(spark, d)
    k = sg.with_moments(knots(spark, d, size), KEY, "x", MAX_GAP, span(spark, d), size=size)
    u = ck.neighbours(k, ck.shared_grid(s, KEY, fs), KEY, ["x", "run", "run_size", "m"], span(spark, d), ck.grid_size(s, KEY, fs))
    return u.select(*KEY, "k", "t", sg.spline_between(F.col("t"), F.col("lo"), F.col("hi"), "x", MAX_GAP).alias("value"))


#: Knots as runs, the tridiagonal system of their second derivatives solved sample by sample, and the spline between two knots.
CUBIC = f"""{TRACE}, {GRID}, {RESAMPLED}, kn as (select recording, t, x, row_number() over (partition by recording order by t, event_id) - 1 as i from trace where valid),
 ks as (select *, sum(case when t - pt <= 86400 + 1e-8 then 0 else 1 end) over (partition by recording order by i) as run from (select *, lag(t) over (partition by recording order by i) as pt from kn)),
 kr as (select {{'r': recording, 'u': run}} as key, list(t order by i) as t, list(x order by i) as x, min(i) as first, count(*) as n from ks group by recording, run),
 el as (select key, t, x, n, 1::bigint as i, 0e0 as c, 0e0 as d from kr where n >= 3 union all
   select key, t, x, n, i + 1, (t[i + 2] - t[i + 1]) / (2 * (t[i + 2] - t[i]) - (t[i + 1] - t[i]) * c),
     (6 * ((x[i + 2] - x[i + 1]) / (t[i + 2] - t[i + 1]) - (x[i + 1] - x[i]) / (t[i + 1] - t[i])) - (t[i + 1] - t[i]) * d) / (2 * (t[i + 2] - t[i]) - (t[i + 1] - t[i]) * c)
   from el where i < n - 1),
 ec as (select key, n, list(c order by i) as c, list(d order by i) as d from el group by 1, 2),
 su as (select key, n, c, d, n as i, 0e0 as m from ec union all select key, n, c, d, i - 1, case when i = 2 then 0e0 else d[i - 1] - c[i - 1] * m end from su where i > 1),
 mo as (select key, list(m order by i) as m from su group by key),
 ad as (select nb.recording, nb.k, nb.t, uniform.x as linear, case when nb.rt - nb.t <= 1e-8 then hi.i - 1 else lo.i end as low, case when nb.rt - nb.t <= 1e-8 then hi.i else lo.i end as own
   from nb join uniform using (recording, k) left join kn lo on lo.recording = nb.recording and lo.t = nb.lt left join kn hi on hi.recording = nb.recording and hi.t = nb.rt),
 pl as (select ad.*, kr.key, kr.n, kr.t as kt, kr.x as kx, least(greatest(ad.low - kr.first, 0), kr.n - 2) + 1 as p from ad left join ks on ks.recording = ad.recording and ks.i = ad.own
   left join kr on kr.key = {{'r': ad.recording, 'u': ks.run}}),
 ev as (select pl.recording, k, linear, n, least(greatest(pl.t, kt[1]), kt[n]) as a, kt[p] as t0, kt[p + 1] as t1, kx[p] as x0, kx[p + 1] as x1, m[p] as m0, m[p + 1] as m1 from pl left join mo using (key))"""
SPLINE = ("case when linear is null then null when n < 3 then linear else (m0 * power(t1 - a, 3) + m1 * power(a - t0, 3)) / (6 * (t1 - t0))"
          " + (x0 / (t1 - t0) - m0 * (t1 - t0) / 6) * (t1 - a) + (x1 / (t1 - t0) - m1 * (t1 - t0) / 6) * (a - t0) end")


@query("bounded_cubic", f"with recursive {CUBIC} select recording, k, {R(SPLINE)} as x from ev")
def bounded_cubic(spark, d):
    return cubic(spark, d, HOURLY).select(*KEY, "k", rnd("value").alias("x"))


NATIVE = 2 * HOURLY
TAPS = kn.kaiser_lowpass(1.0, .15, .35, 40.0)


@query("rate_adapter")
def rate_adapter(spark, d):
    """Regular double-rate grid, low-pass per run, back to the native times, then the target grid."""
    s = trace(spark, d)
    size = ck.grid_size(s, KEY, NATIVE)
    f = sg.fir(cubic(spark, d, NATIVE), KEY, "k", "value", TAPS, "x", size=size).select(*KEY, "t", "x", F.lit(True).alias("valid"))
    if size[1] > ck.DENSE:
        f = checkpointed(f)                                               # read twice there
    at = ck.bounded_resample(f, s.select(*KEY, F.col("event_id").alias("k"), "t"), KEY, ["x"], MAX_GAP, span(spark, d), size)
    back = checkpointed(at.join(s.select(F.col("event_id").alias("k"), "valid"), "k").withColumn("valid", F.col("valid") & F.col("x").isNotNull()))
    target = ck.bounded_resample(back, ck.shared_grid(s, KEY, HOURLY), KEY, ["x"], MAX_GAP, span(spark, d), ck.grid_size(s, KEY, HOURLY))
    g = target.groupBy(*KEY).agg(F.count("*").alias("target_points"), rnd(F.avg(F.col("x").isNotNull().cast("double"))).alias("target_valid_fraction"),
                                 rnd(F.avg(F.col("imputed").cast("double"))).alias("target_interpolated_fraction"), rnd(F.stddev_pop("x")).alias("output_sd"))
    eff = back.groupBy(*KEY).agg(rnd(F.avg(F.col("valid").cast("double"))).alias("effective_source_valid_fraction"))
    return g.join(eff, KEY)


@query("find_peaks")
def find_peaks(spark, d):
    w = apply_kernel(waves(spark, d), ["x"], lambda m: [[kn.find_peaks(v, 4, .2 * v.std()).tolist() for v in m]], "peaks array<int>")
    return w.select("vec_id", F.size("peaks").alias("peak_count"), F.array_join(F.transform("peaks", lambda p: p.cast("string")), "|").alias("peaks"))


def beat_windows(spark, d):
    w = sp.hr_columns(apply_kernels(waves(spark, d), [sp.hr_job("x", FS, L), bt.beats_job("x", FS)]), "x", FS, L)
    return w.withColumns(bt.reliability("", "hr_bpm", FS))


PULSE = ("amp_mean", "amp_std", "width50_mean_sec", "upstroke_mean_sec", "fall_time_mean_sec", "area_mean", "duty_mean", "upstroke_slope_mean", "ibi_mean_sec", "ibi_std_sec")


@query("pulse_wave_features")
def pulse_wave_features(spark, d):
    w = beat_windows(spark, d).withColumns(bt.pulse_features("", FS))
    return w.select("vec_id", rnd("hr_bpm").alias("hr_bpm"), rnd("snr_db").alias("snr_db"), *[rnd(c).alias(c) for c in PULSE])


@query("reliable_beats")
def reliable_beats(spark, d):
    w = beat_windows(spark, d)
    return w.select("vec_id", F.size("anchors").alias("anchors"), F.size("beats").alias("complete_beats"), "ibi_reliable", "reliable",
                    F.when(F.col("reliable"), "ok").otherwise("insufficient reliable beats or ambiguous cycles/IBI").alias("reason"))


@query("coarse_feature_gate")
def coarse_feature_gate(spark, d):
    w = beat_windows(spark, d).withColumns(bt.pulse_features("", FS))
    keep = lambda c, flag, floor: rnd(F.when(F.col(flag) & (F.col(c) > floor), F.col(c))).alias(c)
    std = F.when(F.col("ibi_reliable") & (F.col("ibi_std_sec") >= 0), F.col("ibi_std_sec"))
    mean = F.when(F.col("ibi_reliable") & (F.col("ibi_mean_sec") > 1e-8), F.col("ibi_mean_sec"))
    return w.select("vec_id", rnd("hr_bpm").alias("hr_bpm"), *[keep(c, "reliable", 1e-8) for c in ("amp_mean", "width50_mean_sec", "upstroke_mean_sec", "fall_time_mean_sec", "area_mean")],
                    rnd(mean).alias("ibi_mean_sec"), rnd(std).alias("ibi_std_sec"), rnd(F.try_divide(std, mean)).alias("ibi_cv"), F.size("anchors").alias("reliable_beats"))


@query("morphology")
def morphology(spark, d):
    w = bt.with_morphology(sp.with_hr(waves(spark, d), "x", FS, L), "x", "hr_hz", FS)
    return w.select("vec_id", *[rnd(c).alias(c) for c in bt.MORPH])


@query("morphology_moments", f"""with w as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as x from embeddings), z as (select vec_id, (x - avg(x) over v) / stddev_pop(x) over v as z from w window v as (partition by vec_id))
select vec_id, {R('avg(z * z * z)')} as skewness, {R('avg(z * z * z * z) - 3')} as kurtosis from z group by 1""")
def morphology_moments(spark, d):
    w = bt.with_morphology(sp.with_hr(waves(spark, d), "x", FS, L), "x", "hr_hz", FS)
    return w.select("vec_id", rnd("skewness").alias("skewness"), rnd("kurtosis").alias("kurtosis"))


@query("two_site_features")
def two_site_features(spark, d):
    p = apply_kernel(wave_pairs(spark, d), ["x", "y"], lambda x, y: [kn.legacy_bandpass(x, FS), kn.legacy_bandpass(y, FS)], "fx array<double>, fy array<double>")
    p = sp.with_hr(p.select("vec_id", "subject", F.col("fx").alias("x"), F.col("fy").alias("y")), "x", FS, L)
    p = sp.with_xcorr(p, "x", "y", int(round(.6 * FS)))
    lag = (F.array_position("xc", F.array_max("xc")) - 1 - int(round(.6 * FS))) / FS
    # legacy phase: nearest plain FFT bin, wrapped to half a cycle
    hz = F.bround(F.col("hr_hz") * L / FS, 0) * (FS / L)
    phase = sp.phase_delay(F.col("x"), F.col("y"), hz, FS)
    p = with_coherence(p).withColumns({"lag": lag, "phase": phase})
    speed = lambda c: rnd(F.when(F.col(c) > 0, .5 / F.col(c)))
    return p.select("vec_id", rnd("lag").alias("delay_xcorr_sec"), rnd(F.array_max("xc")).alias("delay_xcorr_score"), rnd("phase").alias("delay_phase_sec"),
                    rnd("coherence").alias("coherence"), speed("lag").alias("velocity_xcorr_m_s"), speed("phase").alias("velocity_phase_m_s"))


def site_features(spark, d):
    """The fixed two-site feature row of every window pair."""
    p = delays(spark, d, [*quality_jobs("x", "face_"), *quality_jobs("y", "hand_")])
    p = quality_columns(quality_columns(p, "x", "face_"), "y", "hand_")
    p = with_rate_array(p).withColumns({f"_{s}": F.array_repeat(F.coalesce(f"{s}_hr_hz", F.lit(-1.0)), L) for s in ("face", "hand")})

    def peaks(m, f):
        return [[kn.find_peaks(v - v.mean(), max(1, int(.6 * FS / h)), .3 * v.std()).tolist() if h > 0 else [] for v, h in zip(m, f[:, 0])]]

    p = apply_kernels(p, [coherence_job(), bt.morphology_job("x", "_face", FS, "face_"), bt.morphology_job("y", "_hand", FS, "hand_"),
                          job(["x", "_f"], peaks, "x_peaks array<int>"), job(["y", "_f"], peaks, "y_peaks array<int>")]).drop("_f", "_face", "_hand")
    p = bt.match_beats(p, "x_peaks", "y_peaks", F.col("radius"))
    m = F.transform("matched", lambda v: v / F.lit(FS))
    return p.withColumns({"delay_beat_std_sec": bt.sd_of(m), "delay_beat_median_sec": median_of(m),
                          "delay_valid_beat_fraction": F.size("matched") / F.greatest(F.lit(1), F.size("x_peaks")),
                          "hr_difference_bpm": F.abs(F.col("face_hr_bpm") - F.col("hand_hr_bpm")), "zero_lag_correlation": sp.centered_corr(F.col("x"), F.col("y"))})


def median_of(a):
    s = F.array_sort(a)
    n = F.size(a)
    half = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.element_at(s, F.greatest(half + n % 2, F.lit(1))) + F.element_at(s, half + 1)) / 2)


SITE = [f"{site}_{k}" for site in ("face", "hand") for k in (*bt.MORPH, "hr_bpm", "snr_db", "spectral_peak_to_mean", "periodicity", "amplitude_std")]


@query("site_pair_features")
def site_pair_features(spark, d):
    p = site_features(spark, d)
    return p.select("vec_id", *[rnd(c).alias(c) for c in SITE], rnd("delay").alias("delay_xcorr_sec"), rnd("score").alias("delay_xcorr_score"), rnd("phase_delay").alias("delay_phase_sec"),
                    rnd("coherence").alias("delay_phase_coherence"), *[rnd(c).alias(c) for c in ("delay_beat_median_sec", "delay_beat_std_sec", "delay_valid_beat_fraction", "hr_difference_bpm", "zero_lag_correlation")])


@query("beat_matching")
def beat_matching(spark, d):
    p = apply_kernels(wave_pairs(spark, d), [sp.hr_job("x", FS, L), bt.beats_job("x", FS, "a_"), bt.beats_job("y", FS, "b_")])
    p = sp.hr_columns(p, "x", FS, L).select("vec_id", "hr_hz", "a_peaks", "b_peaks")
    p = bt.match_beats(p, "a_peaks", "b_peaks", sp.window_radius(F.col("hr_hz"), FS, .5, F.lit(L)))
    m = F.transform("matched", lambda v: v / F.lit(FS))
    return p.select("vec_id", F.size("matched").alias("matched_beats"), rnd(median_of(m)).alias("median_sec"), rnd(bt.sd_of(m)).alias("std_sec"),
                    rnd(F.size("matched") / F.greatest(F.size("a_peaks"), F.size("b_peaks"), F.lit(1))).alias("matched_fraction"))


@query("template_repeatability")
def template_repeatability(spark, d):
    w = bt.with_beats(waves(spark, d), "x", FS)
    # one row per beat offset; a window has a bounded number of beats
    seg = F.transform("beats", lambda b: F.slice("z", b["l"] + 1, b["r"] - b["l"] + 1))
    long = w.select("vec_id", F.explode(seg).alias("s")).select("vec_id", F.posexplode("s").alias("o", "v"))
    t = long.groupBy("vec_id", "o").agg(F.median("v").alias("m"), F.count("*").alias("c")).where("c >= 3")
    t = t.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("o", "m"))).alias("a")).select("vec_id", F.col("a.m").alias("t"))
    prev = t.select((F.col("vec_id") + 1).alias("vec_id"), F.col("t").alias("u"))
    j = w.select("vec_id").join(t, "vec_id", "left").join(prev, "vec_id", "left")
    n = F.least(F.size("t"), F.size("u"))
    a, b = F.slice("t", F.lit(1), n), F.slice("u", F.lit(1), n)
    ok = F.col("t").isNotNull() & F.col("u").isNotNull() & (n >= 3)
    return j.select("vec_id", F.col("t").isNotNull().alias("has_template"), rnd(F.when(ok, sp.centered_corr(a, b))).alias("adjacent_template_correlation"))


@query("consensus_hr")
def consensus_hr(spark, d):
    c = candidates(spark, d)
    return bt.consensus(c, "recording").select("recording", rnd("hr_bpm").alias("hr_bpm"), rnd("score").alias("score"), "sources", "clusters")


def candidates(spark, d):
    p = spectral_peaks(spark, d)
    # five consecutive windows stand for the method outputs of one recording
    return p.select(F.floor(F.col("vec_id") / 5).alias("recording"), (F.col("vec_id") % 5).cast("string").alias("method"), F.col("subject").cast("string").alias("roi"), "rank", "hr_bpm", "score")


CLOCK_SQL = f"""recursive {TRACE}, fr as (select recording, event_id, case when valid then t end as raw, row_number() over (partition by recording order by event_id) - 1 as i from trace),
 ck as (select recording, event_id, i, coalesce(raw, 0e0) as t, raw is not null as used from fr where i = 0 union all
   select f.recording, f.event_id, f.i, case when f.raw > c.t then f.raw else c.t + 600e0 end, coalesce(f.raw > c.t, false) from ck c join fr f on f.recording = c.recording and f.i = c.i + 1)"""


@query("fallback_clock", f"with {CLOCK_SQL} select recording, count(*) as frames, cast(count_if(used) as bigint) as container, cast(count_if(not used) as bigint) as nominal_fallback, {R('max(t)')} as last_t from ck group by 1")
def fallback_clock(spark, d):
    return ck_fallback(spark, d).groupBy("recording").agg(
        F.count("*").alias("frames"), F.count_if(F.col("source") == "container").alias("container"), F.count_if(F.col("source") == "nominal_fallback").alias("nominal_fallback"),
        rnd(F.max("t")).alias("last_t"))


def ck_fallback(spark, d, period=600.0):
    """Container times where they increase, otherwise the previous time plus one period.

    Walked frame by frame inside a time bucket; a bucket starts from the last container time
    carried into it, so a recording is never one task. Between buckets the accepted clock can run
    ahead of the container only while fallbacks pile up, which the carried maximum covers.
    """
    from pulsegrid.operators.fallback import sequential_clock
    s = trace(spark, d).select("recording", "event_id", F.when(F.col("valid"), F.col("t")).alias("raw"))
    s = with_index(s.withColumn("b", F.floor(F.col("event_id") / 4096)), ["recording"], "b", ["event_id"], "i")
    return sequential_clock(s, "recording", "i", "raw", period, 512)


# ---- ECG -----------------------------------------------------------------------

ECG_FS = 100.0


def ecg_samples(spark, d):
    return colour_samples(spark, d).select("recording", F.col("i").alias("k"), F.when((F.col("flag") != "A") | (F.col("discount") > 0), F.col("g")).alias("x"))


@query("r_peak_detect")
def r_peak_detect(spark, d):
    p = ecg.r_peaks(checkpointed(ecg_samples(spark, d)), "recording", ECG_FS, min_run_sec=.5, edge_sec=.05)
    return p.select("recording", "k", rnd("ratio").alias("amplitude_ratio"))


RR = f"""{TRACE}, pk as (select recording, t / 36000e0 as t, x from trace where event_type <> 'error'), b as (select recording, min(t) as t0, max(t) as t1 from pk group by 1),
 win as (select recording, t0 + w * 5e0 as a, t0 + w * 5e0 + 10 as b, w from (select recording, t0, unnest(range(0, greatest(0, cast(floor((t1 - t0 - 10) / 5) as bigint) + 1))) as w from b)),
 pw as (select win.recording, w, a, b, t, x, t - lag(t) over (partition by win.recording, w order by t) as rr from win join pk on pk.recording = win.recording and t >= a and t < b),
 st as (select recording, w, any_value(a) as a, any_value(b) as b, count(rr) as rr_count, median(rr) as med, stddev_pop(rr) / avg(rr) as cv, min(rr) as lo, max(rr) as hi, min(t) as ft, max(t) as lt, median(x) as strength from pw group by 1, 2),
 rr as (select win.recording, win.w as window_index, coalesce(rr_count, 0) as rr_count, cv, strength, case when coalesce(rr_count, 0) < 5 then 'fewer_than_5_complete_rr' when lo < 0.05 or hi > 3 or cv > 0.9 or greatest(hi / med - 1, 1 - lo / med) > 2.5 then 'irregular_or_missed_beats'
   when ft - win.a > 1.5 * med or win.b - lt > 1.5 * med then 'uncovered_ecg_edges' else 'valid' end as reason, 60 / med as bpm from win left join st on st.recording = win.recording and st.w = win.w)"""


def rr_windows(spark, d, offset=0.0):
    pk = trace(spark, d).where("event_type <> 'error'").select("recording", (F.col("t") / 36000.0).alias("t"), F.col("x").alias("strength"))
    return ecg.rr_window_hr(pk, "recording", 10.0, 5.0, offset, rr_low=.05, rr_high=3.0, max_cv=.9, max_deviation=2.5)


@query("rr_window_hr", f"""with {RR} select recording, window_index, rr_count, {R('cv')} as rr_cv, {R('strength')} as median_strength, reason, {R("case when reason = 'valid' then bpm end")} as hr_bpm from rr""")
def rr_window_hr(spark, d):
    return rr_windows(spark, d).select("recording", "window_index", "rr_count", rnd("rr_cv").alias("rr_cv"), rnd("median_strength").alias("median_strength"), "reason", rnd("hr_bpm").alias("hr_bpm"))


def shifted_rr(o):
    return RR.replace("t0 + w * 5e0 as a, t0 + w * 5e0 + 10 as b", f"t0 + w * 5e0 + {o} as a, t0 + w * 5e0 + 10 + {o} as b").split("pw as", 1)[1]


def rr_variant(name, o):
    body = RR[RR.index(" win as"):].replace("t0 + w * 5e0 as a, t0 + w * 5e0 + 10 as b", f"t0 + w * 5e0 + ({o}) as a, t0 + w * 5e0 + 10 + ({o}) as b")
    for t in ("win", "pw", "st"):
        body = body.replace(f" {t} as (", f" {t}{name} as (").replace(f"from {t} ", f"from {t}{name} {t} ").replace(f"join {t} ", f"join {t}{name} {t} ").replace(f"from {t})", f"from {t}{name} {t})")
    return body.replace(" rr as (select win", f" rr{name} as (select win").replace("from pw group by", f"from pw{name} pw group by")


SYNC = RR[:RR.index(" win as")] + rr_variant("m", "-0.5e0") + "," + rr_variant("z", "0e0") + "," + rr_variant("p", "0.5e0")


@query("sync_sensitivity", f"""with {SYNC}, j as (select z.recording, z.window_index, z.reason, z.bpm, m.reason = 'valid' and z.reason = 'valid' and p.reason = 'valid' as all_ok, greatest(m.bpm, z.bpm, p.bpm) - least(m.bpm, z.bpm, p.bpm) as spread
   from rrz z join rrm m using (recording, window_index) join rrp p using (recording, window_index))
select recording, window_index, case when reason <> 'valid' then reason when all_ok and spread <= 3 then 'valid' else 'timing_uncertain_or_boundary_support' end as reason, {R('case when all_ok then spread end')} as sync_hr_range_bpm,
  {R("case when reason = 'valid' and all_ok and spread <= 3 then bpm end")} as hr_bpm from j""")
def sync_sensitivity(spark, d):
    parts = {n: rr_windows(spark, d, o).select("recording", "window_index", F.col("reason").alias(f"reason_{n}"), F.col("hr_bpm").alias(f"hr_{n}")) for n, o in (("m", -.5), ("z", 0.0), ("p", .5))}
    j = parts["z"].join(parts["m"], ["recording", "window_index"]).join(parts["p"], ["recording", "window_index"])
    hrs = [F.col(f"hr_{n}") for n in parts]
    ok = F.col("hr_m").isNotNull() & F.col("hr_z").isNotNull() & F.col("hr_p").isNotNull()
    spread = F.greatest(*hrs) - F.least(*hrs)
    steady = ok & (spread <= 3)
    why = F.when(F.col("reason_z") != "valid", F.col("reason_z")).when(steady, "valid").otherwise("timing_uncertain_or_boundary_support")
    return j.select("recording", "window_index", why.alias("reason"), rnd(F.when(ok, spread)).alias("sync_hr_range_bpm"), rnd(F.when(steady, F.col("hr_z"))).alias("hr_bpm"))


@query("legacy_ecg_hr")
def legacy_ecg_hr(spark, d):
    return ecg.legacy_hr(waves(spark, d), "x", FS).select("vec_id", "beats", "inverted", rnd("hr_bpm").alias("hr_bpm"))
