"""Spectral, lag and delay queries over the 64-sample vector windows."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.functions.batch import apply_kernel, apply_kernels, job
from pulsegrid.functions.cols import joined, ratio, reasons, rnd
from pulsegrid.operators import spectral as sp
from pulsegrid.plans.registry import PAIRS, R, WAVES, query, unrounded
from pulsegrid.sources.tables import FS, wave_pairs, waves

L = 64
SIZE, NFFT = sp.hr_segment(L, FS)
STEP = FS / NFFT
K0, K1 = sp.band_bins(FS, NFFT, sp.LOW, sp.HIGH)


def dft(name, source, value, k0, k1, nfft, taper=True, keys="vec_id"):
    """SQL density of mean-removed 64-sample windows at bins k0..k1."""
    hann = "(0.5e0 - 0.5e0 * cos(2 * pi() * i / 64e0))" if taper else "1e0"
    norm = float((kn.hann(L) ** 2).sum()) if taper else float(L)
    return f"""{name}_c as (select {keys}, i, ({value} - avg({value}) over (partition by {keys})) * {hann} as v from {source}),
 {name} as (select {keys}, k, 2e0 / ({FS!r}e0 * {norm!r}e0) * (pow(sum(v * cos(2 * pi() * k * i / {nfft}e0)), 2) + pow(sum(v * sin(2 * pi() * k * i / {nfft}e0)), 2)) as p
   from {name}_c, (select unnest(range({k0}, {k1} + 1)) as k) group by {keys}, k)"""


def hr_sql(name, psd, keys="vec_id"):
    """SQL heart rate, confidence and SNR from a density at the estimator's bins."""
    return f"""{name}_t as (select {keys}, arg_min(k, (-p, k)) as km, max(p) as pm, avg(p) as pmean, sum(p) as ptot from {psd} group by {keys}),
 {name}_n as (select t.*, ln(pm + 1e-8) as y1, ln(a.p + 1e-8) as y0, ln(b.p + 1e-8) as y2 from {name}_t t
   left join {psd} a on a.{keys} = t.{keys} and a.k = km - 1 left join {psd} b on b.{keys} = t.{keys} and b.k = km + 1),
 {name}_f as (select *, km * {STEP!r}e0 + case when y0 is not null and y2 is not null and abs(y0 - 2 * y1 + y2) > 1e-8
   then greatest(-1, least(1, 0.5e0 * (y0 - y2) / (y0 - 2 * y1 + y2))) * {STEP!r}e0 else 0 end as hz from {name}_n),
 {name}_s as (select f.{keys}, sum(case when k * {STEP!r}e0 between hz - 0.12 and hz + 0.12 then p else 0 end)
   + case when 2 * any_value(hz) <= 3.5 then sum(case when k * {STEP!r}e0 between 2 * hz - 0.12 and 2 * hz + 0.12 then p else 0 end) else 0 end as sig
   from {name}_f f join {psd} s on s.{keys} = f.{keys} group by f.{keys}),
 {name} as (select f.{keys}, hz, hz * 60 as bpm, least(1, pm / (3 * (pmean + 1e-8))) as confidence,
   10 * log10(greatest(1e-8, sig) / greatest(1e-8, ptot + 1e-8 - sig)) as snr from {name}_f f join {name}_s s on s.{keys} = f.{keys})"""


HR = f"{WAVES}, {dft('psd', 'w', 'x', K0, K1, NFFT)}, {hr_sql('hr', 'psd')}"


@query("welch_psd", f"with {WAVES}, {dft('psd', 'w', 'x', K0, K1, NFFT)} select vec_id, k, {R(f'k * {STEP!r}e0')} as hz, {R('p', 9)} as density from psd")
def welch_psd(spark, d):
    w = sp.welch_band(waves(spark, d), "x", FS, SIZE, NFFT, sp.LOW, sp.HIGH, "psd")
    k = F.col("j").cast("long") + K0
    return w.select("vec_id", F.posexplode("psd").alias("j", "p")).select("vec_id", k.alias("k"), rnd(k * STEP).alias("hz"), rnd("p", 9).alias("density"))


@query("hr_welch", f"with {HR} select vec_id, {R('bpm')} as hr_bpm, {R('confidence')} as confidence from hr")
def hr_welch(spark, d):
    return sp.with_hr(waves(spark, d), "x", FS, L).select("vec_id", rnd("hr_bpm").alias("hr_bpm"), rnd("confidence").alias("confidence"))


@query("snr_db", f"with {HR} select vec_id, {R('snr')} as snr_db from hr")
def snr_db(spark, d):
    return sp.with_hr(waves(spark, d), "x", FS, L).select("vec_id", rnd("snr_db").alias("snr_db"))


LAGGED = """lagged as (select w.vec_id, corr(w.x, b.x) as periodicity from w join hr using (vec_id)
   join w b on b.vec_id = w.vec_id and b.i = w.i + cast(round_even(16e0 / hz, 0) as bigint) group by 1)"""


@query("spectral_quality", f"""with {HR}, {dft('q', 'w', 'x', 3, 14, 64)}, {LAGGED},
 pk as (select vec_id, max(p) / avg(p) as ptm from q group by 1), sd as (select vec_id, stddev_pop(x) as sd from w group by 1)
select vec_id, {R('bpm')} as hr_bpm, {R('snr')} as snr_db, {R('ptm')} as spectral_peak_to_mean, {R('periodicity')} as periodicity, {R('sd')} as amplitude_std
from hr join pk using (vec_id) join lagged using (vec_id) join sd using (vec_id)""")
def spectral_quality(spark, d):
    return signal_quality(waves(spark, d), "x").select(
        "vec_id", *[rnd(c).alias(c) for c in ("hr_bpm", "snr_db", "spectral_peak_to_mean", "periodicity", "amplitude_std")])


def quality_jobs(x, prefix=""):
    size = min(L, int(8 * FS))
    return [sp.hr_job(x, FS, L, prefix), sp.welch_job(x, FS, size, size, sp.LOW, sp.HIGH, f"{prefix}q")]


def quality_columns(df, x, prefix=""):
    w = sp.hr_columns(df, x, FS, L, prefix)
    lag = F.bround(FS / F.col(f"{prefix}hr_hz"), 0).cast("int")
    peak = ratio(F.array_max(f"{prefix}q") * F.size(f"{prefix}q"), F.aggregate(f"{prefix}q", F.lit(0.0), lambda a, p: a + p))
    return w.withColumns({f"{prefix}spectral_peak_to_mean": peak, f"{prefix}periodicity": sp.shifted_corr(F.col(x), lag),
                          f"{prefix}amplitude_std": sp.population_sd(x)})


def signal_quality(df, x, prefix=""):
    """Heart rate, SNR, peak-to-mean, one-period autocorrelation and spread of a window."""
    return quality_columns(apply_kernels(df, quality_jobs(x, prefix)), x, prefix)


@query("spectral_diagnostics", f"""with {HR}, c as (select vec_id, i, x - avg(x) over (partition by vec_id) as v from w),
 bins as (select vec_id, hz, cast(round_even(hz * 128, 0) as bigint) as k1, cast(round_even(hz * 256, 0) as bigint) as k2, cast(round_even(hz * 64, 0) as bigint) as kh from hr),
 t as (select vec_id, i, v * (0.5e0 - 0.5e0 * cos(2 * pi() * i / 64e0)) as v from c),
 p as (select vec_id, {', '.join(f"pow(sum(v * cos(2 * pi() * {k} * i / 2048e0)), 2) + pow(sum(v * sin(2 * pi() * {k} * i / 2048e0)), 2) as {n}" for k, n in (('k1', 'p1'), ('k2', 'p2'), ('kh', 'ph')))} from t join bins using (vec_id) group by 1),
 per as (select a.vec_id, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) as periodicity from c a join hr using (vec_id) join c b on b.vec_id = a.vec_id and b.i = a.i + cast(round_even(16e0 / hz, 0) as bigint) group by 1)
select vec_id, {R('bpm')} as pred_hr_bpm, {R('snr')} as snr_db, {R('confidence')} as concentration, {R('periodicity')} as periodicity,
  {R('p2 / p1')} as harmonic_power_ratio, {R('ph / p1')} as subharmonic_power_ratio from hr join p using (vec_id) join per using (vec_id)""")
def spectral_diagnostics(spark, d):
    w = sp.with_hr(waves(spark, d), "x", FS, L)
    step = FS / 2048
    x, hz = F.col("x"), F.col("hr_hz")
    p1, p2, ph = [sp.power_at(x, F.bround(hz * k / step, 0) * step, FS, L) for k in (1.0, 2.0, .5)]
    lag = F.bround(FS / hz, 0).cast("int")
    return w.select("vec_id", rnd("hr_bpm").alias("pred_hr_bpm"), rnd("snr_db").alias("snr_db"), rnd("confidence").alias("concentration"),
                    rnd(sp.shifted_corr(x, lag, plain=False)).alias("periodicity"), rnd(ratio(p2, p1)).alias("harmonic_power_ratio"),
                    rnd(ratio(ph, p1)).alias("subharmonic_power_ratio"))


@query("band_power_concentration", f"""with {HR}, {dft('q', 'w', 'x', 3, 16, 64)},
 tz as (select *, lead(p) over (partition by vec_id order by k) as nx from q)
select vec_id, {R('sum((p + nx) / 2 * 0.25e0)', 9)} as band_power, {R('sum(case when abs(k * 0.25e0 - hz) <= 0.15 then p else 0 end) / sum(p)')} as spectral_concentration
from tz join hr using (vec_id) group by 1""")
def band_power_concentration(spark, d):
    w = sp.hr_columns(apply_kernels(waves(spark, d), [sp.hr_job("x", FS, L), sp.welch_job("x", FS, L, L, .7, 4.0, "q")]), "x", FS, L)
    k0, _ = sp.band_bins(FS, L, .7, 4.0)
    step = FS / L
    total = F.aggregate("q", F.lit(0.0), lambda a, p: a + p)
    area = (total - (F.element_at("q", 1) + F.element_at("q", -1)) / 2) * step
    own = F.aggregate(F.transform("q", lambda p, i: F.when(F.abs((i + k0) * step - F.col("hr_hz")) <= .15, p).otherwise(0.0)), F.lit(0.0), lambda a, p: a + p)
    return w.select("vec_id", rnd(area, 9).alias("band_power"), rnd(ratio(own, total)).alias("spectral_concentration"))


def js_psd(name, col):
    return f"""{name}_c as (select vec_id, i, ({col} - avg({col}) over (partition by vec_id)) * (0.5e0 - 0.5e0 * cos(2 * pi() * i / 64e0)) as v from p),
 {name} as (select vec_id, k, pow(sum(v * cos(2 * pi() * k * i / 64e0)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64e0)), 2) + 1e-8 as p
   from {name}_c, (select unnest(range(3, 29)) as k) group by 1, 2)"""


@query("js_spectral_distance", f"""with {PAIRS}, {js_psd('px', 'x')}, {js_psd('py', 'y')},
 n as (select vec_id, k, a.p / sum(a.p) over (partition by vec_id) as p, b.p / sum(b.p) over (partition by vec_id) as q from px a join py b using (vec_id, k))
select vec_id, {R('greatest(0, least(1, 0.5e0 * sum(p * (ln(greatest(p, 1e-8)) - ln(greatest((p + q) / 2, 1e-8))) + q * (ln(greatest(q, 1e-8)) - ln(greatest((p + q) / 2, 1e-8)))) / ln(2e0)))')} as spectral_distance from n group by 1""")
def js_spectral_distance(spark, d):
    k0, k1 = sp.band_bins(FS, L, .7, min(8.0, .45 * FS))
    scale = FS * float((kn.hann(L) ** 2).sum()) / 2
    p = wave_pairs(spark, d)
    p = apply_kernels(p, [sp.welch_job(c, FS, L, L, .7, min(8.0, .45 * FS), f"p{c}") for c in ("x", "y")])
    p = p.withColumns({f"p{c}": F.transform(f"p{c}", lambda v: v * scale + 1e-8) for c in ("x", "y")})
    return p.select("vec_id", rnd(sp.js_distance(F.col("px"), F.col("py"))).alias("spectral_distance"))


@query("signed_corr", f"with {PAIRS} select vec_id, {R('corr(x, y)')} as signed_corr from p group by 1 having count(x) = 64 and count(y) = 64")
def signed_corr(spark, d):
    return wave_pairs(spark, d).select("vec_id", rnd(sp.centered_corr(F.col("x"), F.col("y"))).alias("signed_corr"))


LAGS = """lg as (select unnest(range(-{r}, {r} + 1)) as lag),
 ov as (select a.vec_id, lag, a.i, a.x, b.y, a.x - lag(a.x) over w as dx, b.y - lag(b.y) over w as dy from p a join lg on true join p b on b.vec_id = a.vec_id and a.i = b.i + lag
   window w as (partition by a.vec_id, lag order by a.i)),
 ll as (select vec_id, lag, corr(x, y) as c, corr(dx, dy) as d from ov group by 1, 2)"""


@query("legacy_corr", f"""with {PAIRS}, {LAGS.format(r=15)} select vec_id, {R('max(case when lag = 0 then c end)')} as corr_zero, {R('max(c)')} as corr_aligned from ll group by 1""")
def legacy_corr(spark, d):
    w = sp.with_lag_metrics(wave_pairs(spark, d), "x", "y", L, 15)
    return w.select("vec_id", rnd("wave_corr").alias("corr_zero"), rnd("wave_corr_aligned").alias("corr_aligned"))


@query("lag_aligned_metrics", f"""with {PAIRS}, {LAGS.format(r=8)},
 best as (select *, row_number() over (partition by vec_id order by c desc, abs(lag), lag) as rn from ll)
select vec_id, cast(lag as integer) as selected_lag_samples, {R('1000 * lag / 16e0')} as selected_lag_ms, {R('c')} as wave_corr_aligned, {R('d')} as d1_corr_same_lag, {R('sqrt(greatest(0, 2 - 2 * c))')} as aligned_nrmse
from best where rn = 1""")
def lag_aligned_metrics(spark, d):
    w = sp.with_lag_metrics(wave_pairs(spark, d), "x", "y", L, int(round(.5 * FS)))
    return w.select("vec_id", F.col("selected_lag").alias("selected_lag_samples"), rnd(1000 * F.col("selected_lag") / FS).alias("selected_lag_ms"),
                    rnd("wave_corr_aligned").alias("wave_corr_aligned"), rnd("d1_corr_same_lag").alias("d1_corr_same_lag"), rnd("aligned_nrmse").alias("aligned_nrmse"))


@query("joint_lag", f"""with {PAIRS}, {LAGS.format(r=15)},
 best as (select *, row_number() over (partition by vec_id order by (1 - c) + 0.25e0 * (1 - d), abs(lag), lag) as rn from ll)
select vec_id, cast(lag as integer) as selected_lag, {R('1 - c')} as waveform_loss, {R('1 - d')} as derivative_loss from best where rn = 1""")
def joint_lag(spark, d):
    lags = sp.lag_order(L, 15)
    w = sp.with_lag_metrics(wave_pairs(spark, d), "x", "y", L, 15)
    loss = F.zip_with("lag_corr", "lag_d1", lambda c, e: (1 - c) + 0.25 * (1 - e))
    w = w.withColumn("loss", loss)
    at = F.array_position("loss", F.array_min("loss")).cast("int")
    return w.select("vec_id", F.when(at.isNotNull(), F.element_at(F.array(*[F.lit(k) for k in lags]), F.coalesce(at, F.lit(1)))).alias("selected_lag"),
                    rnd(1 - F.element_at("lag_corr", at)).alias("waveform_loss"), rnd(1 - F.element_at("lag_d1", at)).alias("derivative_loss"))


XC = """xg as (select unnest(range(-{r}, {r} + 1)) as lag),
 ce as (select vec_id, i, x - avg(x) over (partition by vec_id) as x, y - avg(y) over (partition by vec_id) as y from p),
 en as (select vec_id, sqrt(sum(x * x) * sum(y * y)) as e from ce group by 1),
 xc as (select a.vec_id, lag, sum(a.x * b.y) / any_value(e) as c from ce a join xg on true join ce b on b.vec_id = a.vec_id and b.i = a.i + lag join en on en.vec_id = a.vec_id group by 1, 2)"""


@query("xcorr_delay_legacy", f"""with {PAIRS}, {XC.format(r=8)}, best as (select *, row_number() over (partition by vec_id order by c desc, lag) as rn from xc)
select vec_id, {R('lag / 16e0')} as lag_sec, {R('c')} as score from best where rn = 1""")
def xcorr_delay_legacy(spark, d):
    w = sp.with_xcorr(wave_pairs(spark, d), "x", "y", 8)
    at = F.array_position("xc", F.array_max("xc"))
    return w.select("vec_id", rnd((at - 9) / FS).alias("lag_sec"), rnd(F.array_max("xc")).alias("score"))


RADIUS = 8
XDELAY = f"""{HR}, p as (select a.vec_id, a.subject, a.i, a.x, b.x as y from w a join w b on b.vec_id = a.vec_id + 1 and b.i = a.i), {XC.format(r=RADIUS)},
 rad as (select vec_id, hz, least(8, cast(floor(0.49e0 * 16 / hz) as bigint), 61) as rad from hr),
 xr as (select xc.*, hz, rad, lag(c) over w as cl, lead(c) over w as cr from xc join rad using (vec_id) where abs(lag) <= rad window w as (partition by vec_id order by lag)),
 xb as (select *, row_number() over (partition by vec_id order by c desc, lag) as rn, min(c) over (partition by vec_id) as lowest from xr),
 xd as (select vec_id, hz, rad, c as score, lowest, abs(lag) = rad as boundary, lag as best_lag, case when abs(lag) < rad then
   (lag + case when abs(cl - 2 * c + cr) > 1e-12 then greatest(-0.5e0, least(0.5e0, 0.5e0 * (cl - cr) / (cl - 2 * c + cr))) else 0 end) / 16e0 end as delay from xb where rn = 1),
 ph as (select ce.vec_id, any_value(hz) as hz, sum(x * cos(2 * pi() * hz * i / 16e0)) as xr, -sum(x * sin(2 * pi() * hz * i / 16e0)) as xi, sum(y * cos(2 * pi() * hz * i / 16e0)) as yr, -sum(y * sin(2 * pi() * hz * i / 16e0)) as yi
   from ce join hr using (vec_id) group by 1),
 phd as (select vec_id, -atan2(yi * xr - yr * xi, yr * xr + yi * xi) / (2 * pi() * hz) as phase_delay from ph)"""


def delays(spark, d, extra=()):
    """Pairs with heart rate of the first site and the bounded, refined delay between the two."""
    p = apply_kernels(wave_pairs(spark, d), [sp.hr_job("x", FS, L), sp.xcorr_job("x", "y", RADIUS), *extra])
    p = sp.hr_columns(p, "x", FS, L)
    p = p.withColumn("radius", sp.window_radius(F.col("hr_hz"), FS, .5, F.size("x")))
    p = sp.xcorr_delay(p, "xc", RADIUS, "radius", FS)
    return p.withColumn("phase_delay", sp.phase_delay(F.col("x"), F.col("y"), F.col("hr_hz"), FS))


@query("xcorr_delay", f"with {XDELAY} select vec_id, cast(rad as integer) as radius, {R('delay')} as delay_xcorr_sec, {R('score')} as delay_xcorr_score, boundary from xd")
def xcorr_delay(spark, d):
    return delays(spark, d).select("vec_id", "radius", rnd("delay").alias("delay_xcorr_sec"), rnd("score").alias("delay_xcorr_score"), "boundary")


@query("phase_delay", f"with {XDELAY} select vec_id, {R('phase_delay')} as delay_phase_sec from phd join xd using (vec_id)")
def phase_delay(spark, d):
    return delays(spark, d).select("vec_id", rnd("phase_delay").alias("delay_phase_sec"))


@query("msc_coherence", f"""with {HR}, seg as (select unnest([0, 16, 32]) as st),
 sg as (select a.vec_id, st, a.i - st as j, a.x, b.x as y from w a join w b on b.vec_id = a.vec_id + 1 and b.i = a.i join seg on a.i >= st and a.i < st + 32),
 ct as (select vec_id, st, j, (x - avg(x) over v) * (0.5e0 - 0.5e0 * cos(2 * pi() * j / 32e0)) as x, (y - avg(y) over v) * (0.5e0 - 0.5e0 * cos(2 * pi() * j / 32e0)) as y from sg window v as (partition by vec_id, st)),
 bn as (select vec_id, arg_min(k, (abs(k * 0.5e0 - hz), k)) as k from hr, (select unnest(range(0, 17)) as k) group by 1),
 ft as (select vec_id, st, sum(x * cos(2 * pi() * k * j / 32e0)) as xr, -sum(x * sin(2 * pi() * k * j / 32e0)) as xi, sum(y * cos(2 * pi() * k * j / 32e0)) as yr, -sum(y * sin(2 * pi() * k * j / 32e0)) as yi
   from ct join bn using (vec_id) group by 1, 2)
select vec_id, {R('(pow(avg(xr * yr + xi * yi), 2) + pow(avg(xr * yi - xi * yr), 2)) / (avg(xr * xr + xi * xi) * avg(yr * yr + yi * yi))')} as coherence from ft group by 1""")
def msc_coherence(spark, d):
    p = with_coherence(sp.with_hr(wave_pairs(spark, d), "x", FS, L))
    return p.select("vec_id", rnd("coherence").alias("coherence"))


def coherence_job(name="coherence"):
    """Needs ``_f``, the rate repeated to the window length (a kernel takes equal-length arrays)."""
    size = min(int(4 * FS), L // 2)
    return job(["x", "y", "_f"], lambda x, y, f: [kn.coherence_at(x, y, FS, size, f[:, 0]) if size >= int(2 * FS) else [None] * len(x)], f"{name} double")


def with_rate_array(df):
    return df.withColumn("_f", F.array_repeat(F.coalesce("hr_hz", F.lit(-1.0)), L))


def with_coherence(df):
    return apply_kernels(with_rate_array(df), [coherence_job()]).drop("_f")


PART = max(L // 2, math.ceil(3 * FS))     # samples of the first and the last part


def half_delays(p):
    """Delay of the first and of the last part of each window at the whole window's heart rate.

    The parts are the halves; where half a window is under the three seconds a delay needs, they are three seconds long and overlap.
    """
    for name, start in (("h1", 1), ("h2", L - PART + 1)):
        p = p.withColumns({f"{name}x": F.slice("x", start, PART), f"{name}y": F.slice("y", start, PART)})
    p = apply_kernels(p, [sp.xcorr_job(f"{h}x", f"{h}y", RADIUS, f"{h}xc") for h in ("h1", "h2")])
    r = sp.window_radius(F.col("hr_hz"), FS, .5, F.lit(PART))
    for h in ("h1", "h2"):
        p = sp.xcorr_delay(p, f"{h}xc", RADIUS, r, FS, f"{h}_")
    return p


def timing(spark, d):
    """Delay with its ambiguity and robustness diagnostics (no beat landmarks)."""
    wide = delays(spark, d, [sp.xcorr_job("x", "y", L - 2, "full")])
    part, lag0 = F.col("part"), F.col("radius")
    period = 1 / F.col("hr_hz")
    lag = lambda i: (i - (L - 2)) / F.lit(FS)
    best = (F.col("at") - 1 - lag0) / FS
    rival = F.transform(F.col("full"), lambda c, i: F.when(
        (i > 0) & (i < 2 * (L - 2)) & (c > F.element_at("full", F.greatest(i, F.lit(1)))) & (c > F.element_at("full", F.least(i + 2, F.lit(2 * L - 3))))
        & (F.abs(lag(i) - best) > .7 * period) & (F.abs(lag(i) - best) < 1.3 * period), c))
    near = F.filter(F.transform(part, lambda c, i: F.when(c >= F.col("score") - .1, i)), lambda i: i.isNotNull())
    w = wide.withColumns({"competing_cycle_peak_score": F.array_max(rival),
                          "correlation_peak_width_sec": (F.array_max(near) - F.array_min(near)) / FS,
                          "polarity_ambiguity": -F.col("low") > F.col("score") + .1,
                          "phase_xcorr_difference_sec": F.abs(F.col("delay") - F.col("phase_delay"))})
    w = half_delays(w)
    w = w.withColumns({"cycle_ambiguity": F.coalesce(F.col("competing_cycle_peak_score") >= F.col("score") - .05, F.lit(False)),
                       "split_difference_sec": F.abs(F.col("h2_delay") - F.col("h1_delay"))})
    return with_coherence(w)


@query("timing_diagnostics", f"""with {XDELAY}, fg as (select unnest(range(-62, 63)) as lag),
 fx as (select a.vec_id, fg.lag, sum(a.x * b.y) / any_value(e) as c from ce a join fg on true join ce b on b.vec_id = a.vec_id and b.i = a.i + fg.lag join en on en.vec_id = a.vec_id group by 1, 2),
 fp as (select *, lag(c) over v as cl, lead(c) over v as cr from fx window v as (partition by vec_id order by lag)),
 rv as (select vec_id, max(fp.c) as comp from fp join xd using (vec_id) where fp.c > cl and fp.c > cr and abs(fp.lag - best_lag) / 16e0 > 0.7 / hz and abs(fp.lag - best_lag) / 16e0 < 1.3 / hz group by 1),
 wd as (select vec_id, (max(xr.lag) - min(xr.lag)) / 16e0 as width from xr join xd using (vec_id) where xr.c >= score - 0.1 group by 1),
 hp as (select vec_id, h, i - h * 16 as i, x - avg(x) over v as x, y - avg(y) over v as y from p join (select unnest([0, 1]) as h) on i >= h * 16 and i < h * 16 + 48 window v as (partition by vec_id, h)),
 he as (select vec_id, h, sqrt(sum(x * x) * sum(y * y)) as e from hp group by 1, 2),
 hx as (select a.vec_id, a.h, xg.lag, sum(a.x * b.y) / any_value(e) as c from hp a join xg on true join hp b on b.vec_id = a.vec_id and b.h = a.h and b.i = a.i + xg.lag join he on he.vec_id = a.vec_id and he.h = a.h group by 1, 2, 3),
 hn as (select hx.*, rad.rad, lag(c) over v as cl, lead(c) over v as cr from hx join rad using (vec_id) where abs(lag) <= rad.rad window v as (partition by vec_id, h order by lag)),
 hb as (select *, row_number() over (partition by vec_id, h order by c desc, lag) as rn from hn),
 hd as (select vec_id, max(case when h = 0 then delay end) as first_half, max(case when h = 1 then delay end) as second_half from (select vec_id, h, case when abs(lag) < rad then
   (lag + case when abs(cl - 2 * c + cr) > 1e-12 then greatest(-0.5e0, least(0.5e0, 0.5e0 * (cl - cr) / (cl - 2 * c + cr))) else 0 end) / 16e0 end as delay from hb where rn = 1) group by 1)
select vec_id, {R('delay')} as delay_xcorr_sec, {R('comp')} as competing_cycle_peak_score, coalesce(comp >= score - 0.05, false) as cycle_ambiguity, -lowest > score + 0.1 as polarity_ambiguity,
  boundary as search_boundary, {R('width')} as correlation_peak_width_sec, {R('abs(delay - phase_delay)')} as phase_xcorr_difference_sec,
  {R('first_half')} as first_half_delay_sec, {R('second_half')} as second_half_delay_sec, {R('abs(second_half - first_half)')} as split_difference_sec, {R('coherence')} as delay_phase_coherence
from xd left join rv using (vec_id) left join wd using (vec_id) join phd using (vec_id) left join hd using (vec_id) left join ({unrounded('msc_coherence')}) co using (vec_id)""")
def timing_diagnostics(spark, d):
    t = timing(spark, d)
    return t.select("vec_id", rnd("delay").alias("delay_xcorr_sec"), rnd("competing_cycle_peak_score").alias("competing_cycle_peak_score"),
                    "cycle_ambiguity", "polarity_ambiguity", F.col("boundary").alias("search_boundary"),
                    rnd("correlation_peak_width_sec").alias("correlation_peak_width_sec"),
                    rnd("phase_xcorr_difference_sec").alias("phase_xcorr_difference_sec"),
                    rnd("h1_delay").alias("first_half_delay_sec"), rnd("h2_delay").alias("second_half_delay_sec"),
                    rnd("split_difference_sec").alias("split_difference_sec"), rnd("coherence").alias("delay_phase_coherence"))


GRIDLAG = 3   # samples searched by the conservative estimator (180 ms at 16 Hz)


def grid_lag(c):
    """Best overlap-correlation lag with border, polarity and sub-sample offset, from a lag curve."""
    top = F.array_max(c)
    at = F.array_position(c, top).cast("int")
    edge = (at == 1) | (at == 2 * GRIDLAG + 1)
    left, right = F.element_at(c, at - 1), F.element_at(c, at + 1)
    den = left - 2 * top + right
    frac = F.when(~edge & (den < -1e-10), F.greatest(F.lit(-.5), F.least(F.lit(.5), .5 * (left - right) / den))).otherwise(0.0)
    return {"peak": top, "edge": edge, "flip": -F.array_min(c) > top + .08, "lag": (at - 1 - GRIDLAG + frac) * (1000 / FS)}


def signed_lag(p, min_peak, max_frames=1.5):
    """Lag in ms or an abstention with its reason, over whole windows and both halves."""
    half = L // 2

    def run(x, y):
        lags = range(-GRIDLAG, GRIDLAG + 1)
        return [kn.lag_pearson(x, y, lags), kn.lag_pearson(x[:, :half], y[:, :half], lags), kn.lag_pearson(x[:, half:], y[:, half:], lags)]

    p = apply_kernel(p, ["x", "y"], run, "wc array<double>, ac array<double>, bc array<double>")
    for name in "wab":
        p = p.withColumns({f"{name}{k}": v for k, v in grid_lag(F.col(f"{name}c")).items()})
    unstable = F.col("aedge") | F.col("aflip") | F.col("bedge") | F.col("bflip")
    difference = F.abs(F.col("alag") - F.col("blag"))
    reason = F.when(F.least(sp.population_sd("x"), sp.population_sd("y")) < 1e-10, "flat_signal") \
        .when(F.col("wflip"), "polarity_ambiguous").when(F.col("wedge"), "search_boundary") \
        .when(F.col("wpeak") < min_peak, "low_correlation").when(unstable, "half_window_unstable") \
        .when(F.least("apeak", "bpeak") < min_peak, "half_window_low_correlation") \
        .when(difference > max_frames * 1000 / FS, "half_window_inconsistent_delay").otherwise("resolved")
    p = p.withColumns({"reason": reason, "half_difference_ms": difference})
    return p.withColumn("lag_ms", F.when(F.col("reason") == "resolved", F.col("wlag")))


def grid_sql(name, where, shift):
    return f"""{name}o as (select a.vec_id, l.lag, corr(a.x, b.y) as c from p a join (select unnest(range(-3, 4)) as lag) l on true join p b on b.vec_id = a.vec_id and b.i = a.i + l.lag
   where a.i >= {where[0]} and a.i < {where[1]} and b.i >= {where[0]} and b.i < {where[1]} group by 1, 2),
 {name}n as (select *, lag(c) over v as cl, lead(c) over v as cr, min(c) over (partition by vec_id) as lo, row_number() over (partition by vec_id order by c desc, lag) as rn from {name}o window v as (partition by vec_id order by lag)),
 {name} as (select vec_id, c as peak, abs(lag) = 3 as edge, -lo > c + 0.08 as flip, (lag + case when abs(lag) < 3 and cl - 2 * c + cr < -1e-10 then greatest(-0.5e0, least(0.5e0, 0.5e0 * (cl - cr) / (cl - 2 * c + cr))) else 0 end) * 62.5e0 as lag from {name}n where rn = 1)"""


SIGNED = f"""{PAIRS}, {grid_sql('gw', (0, 64), 0)}, {grid_sql('ga', (0, 32), 0)}, {grid_sql('gb', (32, 64), 32)},
 sl as (select vec_id, gw.peak, gw.lag, abs(ga.lag - gb.lag) as diff, case when gw.flip then 'polarity_ambiguous' when gw.edge then 'search_boundary' when gw.peak < 0.1 then 'low_correlation'
   when ga.edge or ga.flip or gb.edge or gb.flip then 'half_window_unstable' when least(ga.peak, gb.peak) < 0.1 then 'half_window_low_correlation'
   when abs(ga.lag - gb.lag) > 93.75 then 'half_window_inconsistent_delay' else 'resolved' end as reason from gw join ga using (vec_id) join gb using (vec_id))"""


@query("signed_lag_abstain", f"with {SIGNED} select vec_id, reason, {R('peak')} as peak_corr, {R('case when reason = \'resolved\' then lag end')} as lag_ms, 62.5e0 as uncertainty_floor_ms from sl")
def signed_lag_abstain(spark, d):
    p = signed_lag(wave_pairs(spark, d), .1)
    return p.select("vec_id", "reason", rnd("wpeak").alias("peak_corr"), rnd("lag_ms").alias("lag_ms"), F.lit(1000 / FS).alias("uncertainty_floor_ms"))


@query("timing_transfer_audit", f"""with {SIGNED}, r as (select vec_id, reason, case when reason = 'resolved' then lag end as lag from sl),
 j as (select r.vec_id, r.lag as a, n.lag as b from r join r n on n.vec_id = r.vec_id + 1)
select vec_id, case when a is null or b is null then 'ABSTAIN' when abs(a - b) <= 62.5 then 'PASS' else 'FAIL' end as outcome, {R('b - a')} as differential_shift_ms from j""")
def timing_transfer_audit(spark, d):
    p = signed_lag(wave_pairs(spark, d), .1).select("vec_id", F.col("lag_ms").alias("a"))
    n = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    outcome = F.when(a.isNull() | b.isNull(), "ABSTAIN").when(F.abs(a - b) <= 1000 / FS, "PASS").otherwise("FAIL")
    return p.join(n, "vec_id").select("vec_id", outcome.alias("outcome"), rnd(b - a).alias("differential_shift_ms"))


@query("delay_uncertainty_floor", f"""with {XDELAY} select vec_id, {R('greatest(0.0625e0, coalesce(abs(delay - phase_delay), 0.0625e0))')} as uncertainty_floor_sec,
  coalesce(abs(delay) <= greatest(0.0625e0, abs(delay - phase_delay)), false) as below_floor from xd join phd using (vec_id)""")
def delay_uncertainty_floor(spark, d):
    p = delays(spark, d)
    gap = F.abs(F.col("delay") - F.col("phase_delay"))
    floor = F.greatest(F.lit(1 / FS), F.coalesce(gap, F.lit(1 / FS)))
    return p.select("vec_id", rnd(floor).alias("uncertainty_floor_sec"), F.coalesce(F.abs("delay") <= floor, F.lit(False)).alias("below_floor"))


GATE = """concat_ws('|', case when delay is null then 'delay_noncomputable_or_boundary' end, case when abs(fb - hb) > 10 then 'face_hand_hr_disagreement' end,
  case when score < 0.2 then 'low_signed_correlation' end, case when -lowest > score + 0.1 then 'polarity_ambiguity' end, case when boundary then 'search_boundary' end,
  case when coalesce(abs(delay - phase_delay), 9) > 0.1 then 'phase_xcorr_difference_sec_too_large' end)"""
GATED = f"""{XDELAY}, g as (select xd.*, phase_delay, f.bpm as fb, h.bpm as hb, f.snr as fs, h.snr as hs from xd join phd using (vec_id) join hr f using (vec_id) join hr h on h.vec_id = xd.vec_id + 1),
 gr as (select g.*, w.subject, {GATE} as why from g join (select distinct vec_id, subject from w) w using (vec_id)),
 gs as (select *, case when delay is null then 'invalid' when why = '' then 'strict' when fs >= -6 and hs >= -6 then 'intermediate' else 'uncertain' end as status from gr)"""


def gated(spark, d):
    """Delay rows with status from signal, agreement and ambiguity conditions."""
    p = sp.hr_columns(delays(spark, d, [sp.hr_job("y", FS, L, "y_")]), "y", FS, L, "y_")
    far = F.coalesce(F.abs(F.col("delay") - F.col("phase_delay")), F.lit(9.0)) > .1
    why = reasons(("delay_noncomputable_or_boundary", F.col("delay").isNull()),
                  ("face_hand_hr_disagreement", F.abs(F.col("hr_bpm") - F.col("y_hr_bpm")) > 10),
                  ("low_signed_correlation", F.col("score") < .2), ("polarity_ambiguity", -F.col("low") > F.col("score") + .1),
                  ("search_boundary", F.col("boundary")), ("phase_xcorr_difference_sec_too_large", far))
    p = p.withColumn("why", why)
    status = F.when(F.col("delay").isNull(), "invalid").when(F.size("why") == 0, "strict") \
        .when((F.col("snr_db") >= -6) & (F.col("y_snr_db") >= -6), "intermediate").otherwise("uncertain")
    return p.withColumn("status", status)


@query("delay_gate", f"with {GATED} select vec_id, status, why as reasons, {R('delay')} as delay_xcorr_sec from gs")
def delay_gate(spark, d):
    return gated(spark, d).select("vec_id", "status", joined("why").alias("reasons"), rnd("delay").alias("delay_xcorr_sec"))


@query("delay_candidate_gate", f"""with {GATED} select vec_id, case when why = '' and abs(delay) > greatest(0.0625e0, abs(delay - phase_delay)) then 'candidate' when delay is not null then 'uncertain' else 'invalid' end as status,
  {R('greatest(0.0625e0, coalesce(abs(delay - phase_delay), 0.0625e0))')} as floor_sec from gs""")
def delay_candidate_gate(spark, d):
    p = gated(spark, d)
    floor = F.greatest(F.lit(1 / FS), F.coalesce(F.abs(F.col("delay") - F.col("phase_delay")), F.lit(1 / FS)))
    status = F.when((F.size("why") == 0) & (F.abs("delay") > floor), "candidate").when(F.col("delay").isNotNull(), "uncertain").otherwise("invalid")
    return p.select("vec_id", status.alias("status"), rnd(floor).alias("floor_sec"))


@query("cross_method_spread", f"""with {GATED}, s as (select subject, vec_id // 5 as grp, count(delay) as computable, max(delay) - min(delay) as spread from gs group by 1, 2)
select subject, grp, computable, {R('case when computable >= 2 then spread end')} as delay_range_sec, coalesce(computable >= 2 and spread <= 0.0625, false) as confirmed from s""")
def cross_method_spread(spark, d):
    s = gated(spark, d).groupBy("subject", F.floor(F.col("vec_id") / 5).alias("grp")).agg(
        F.count("delay").alias("computable"), (F.max("delay") - F.min("delay")).alias("spread"))
    two = F.col("computable") >= 2
    return s.select("subject", "grp", "computable", rnd(F.when(two, F.col("spread"))).alias("delay_range_sec"),
                    F.coalesce(two & (F.col("spread") <= 1 / FS), F.lit(False)).alias("confirmed"))


@query("engineering_good_flag", f"""with {HR}, {LAGGED} select vec_id, snr >= -6 and periodicity >= 0.1 as good from hr join lagged using (vec_id)""")
def engineering_good_flag(spark, d):
    q = signal_quality(waves(spark, d), "x")
    return q.select("vec_id", ((F.col("snr_db") >= -6) & (F.col("periodicity") >= .1)).alias("good"))


@query("topk_spectral_peaks", f"""with {HR}, nb as (select *, lag(p) over v as pl, lead(p) over v as pr from psd window v as (partition by vec_id order by k)),
 pk as (select * from nb where p > pl and p > pr),
 one as (select vec_id, arg_min(k, (-p, k)) as k from psd group by 1 having vec_id not in (select vec_id from pk)),
 al as (select vec_id, k, p, pl, pr from pk union all select nb.vec_id, nb.k, p, pl, pr from nb join one using (vec_id, k)),
 rk as (select *, row_number() over (partition by vec_id order by p desc, k) as rank, max(p) over (partition by vec_id) as top from al),
 rf as (select *, ln(pl + 1e-8) as y0, ln(p + 1e-8) as y1, ln(pr + 1e-8) as y2 from rk where rank <= 5)
select vec_id, cast(rank as integer) as rank, {R(f'60 * (k * {STEP!r}e0 + case when y0 is not null and y2 is not null and abs(y0 - 2 * y1 + y2) > 1e-8 then greatest(-1, least(1, 0.5e0 * (y0 - y2) / (y0 - 2 * y1 + y2))) * {STEP!r}e0 else 0 end)')} as hr_bpm,
  {R('0.65e0 / rank + 0.35e0 * p / (top + 1e-8)')} as score, {R('p / (top + 1e-8)')} as rel_power from rf""")
def topk_spectral_peaks(spark, d):
    return spectral_peaks(spark, d).select("vec_id", "rank", rnd("hr_bpm").alias("hr_bpm"), rnd("score").alias("score"), rnd("rel_power").alias("rel_power"))


def spectral_peaks(spark, d, top=5):
    """Up to five strongest local maxima per window with refined rate and local score."""
    w = sp.welch_band(waves(spark, d), "x", FS, SIZE, NFFT, sp.LOW, sp.HIGH, "psd")
    size = K1 - K0 + 1
    entries = F.transform("psd", lambda p, i: F.struct((-p).alias("np"), (i + 1).alias("at")))
    peak = lambda s: (s["at"] > 1) & (s["at"] < size) & (-s["np"] > F.element_at("psd", F.greatest(s["at"] - 1, F.lit(1)))) \
        & (-s["np"] > F.element_at("psd", F.least(s["at"] + 1, F.lit(size))))
    w = w.withColumn("peaks", F.filter(entries, peak)).withColumn("all", entries)
    chosen = F.when(F.size("peaks") > 0, F.slice(F.array_sort("peaks"), 1, top)).otherwise(F.slice(F.array_sort("all"), 1, 1))
    w = w.withColumn("chosen", chosen).select("vec_id", "subject", "psd", (-F.element_at("chosen", 1)["np"]).alias("best"), F.posexplode("chosen").alias("j", "s"))
    rank = F.col("j") + 1
    p = -F.col("s.np")
    rel = p / (F.col("best") + 1e-8)
    return w.select("vec_id", "subject", rank.alias("rank"), (60 * sp.refine(F.col("psd"), F.col("s.at"), K0, STEP)).alias("hr_bpm"),
                    (0.65 / rank + 0.35 * rel).alias("score"), rel.alias("rel_power"))


@query("window_hr_label", f"""with {HR} select vec_id, {R('coalesce(case when confidence >= 0.9 then bpm end, 60 + subject)')} as label_bpm, case when confidence >= 0.9 then 'waveform' else 'device' end as source
from hr join (select distinct vec_id, subject from w) using (vec_id)""")
def window_hr_label(spark, d):
    w = sp.with_hr(waves(spark, d), "x", FS, L)
    own = F.when(F.col("confidence") >= .9, F.col("hr_bpm"))
    return w.select("vec_id", rnd(F.coalesce(own, (60 + F.col("subject")).cast("double"))).alias("label_bpm"),
                    F.when(own.isNotNull(), "waveform").otherwise("device").alias("source"))


@query("candidate_targets", f"""with {HR}, c as (select h.vec_id, o.vec_id - h.vec_id as slot, o.bpm as cand, abs(o.bpm - h.bpm) as err from hr h join hr o on o.vec_id between h.vec_id + 1 and h.vec_id + 3),
 e as (select *, exp(-0.5e0 * pow(err / 3, 2)) as g, exp(-pow(err / 5, 2)) as quality, row_number() over (partition by vec_id order by err, slot) as rn, count(*) over (partition by vec_id) as n from c)
select vec_id, slot, {R('cand')} as candidate_bpm, {R('err')} as abs_error, rn = 1 as is_best, {R('g / (sum(g) over (partition by vec_id) + 1e-8)')} as soft_target, {R('quality')} as quality from e""")
def candidate_targets(spark, d):
    h = sp.with_hr(waves(spark, d), "x", FS, L).select("vec_id", "hr_bpm")
    slots = h.select("vec_id", F.col("hr_bpm").alias("cand"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("slot"))
    slots = slots.select((F.col("vec_id") - F.col("slot")).alias("vec_id"), F.col("slot").cast("long").alias("slot"), "cand")
    c = h.join(slots, "vec_id").withColumn("err", F.abs(F.col("cand") - F.col("hr_bpm")))
    # at most three candidates per window: a bounded array, no window function
    g = c.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("err", "slot", "cand"))).alias("a"))
    soft = lambda s: F.exp(-0.5 * F.pow(s["err"] / 3, 2))
    g = g.withColumn("tot", F.aggregate("a", F.lit(0.0), lambda t, s: t + soft(s)) + 1e-8)
    g = g.select("vec_id", "tot", F.posexplode("a").alias("j", "s"))
    return g.select("vec_id", "s.slot", rnd("s.cand").alias("candidate_bpm"), rnd("s.err").alias("abs_error"), (F.col("j") == 0).alias("is_best"),
                    rnd(soft(F.col("s")) / F.col("tot")).alias("soft_target"), rnd(F.exp(-F.pow(F.col("s.err") / 5, 2))).alias("quality"))


@query("soft_hr_labels", f"""with {HR}, b as (select vec_id, bin, exp(-0.5e0 * pow((bin - bpm) / 3, 2)) as g from hr, (select unnest(range(42, 211, 4)) as bin))
select vec_id, cast(bin as integer) as bin_bpm, {R('g / (sum(g) over (partition by vec_id) + 1e-8)')} as target from b""")
def soft_hr_labels(spark, d):
    w = sp.with_hr(waves(spark, d), "x", FS, L)
    bins = F.array(*[F.lit(b) for b in range(42, 211, 4)])
    g = F.transform(bins, lambda b: F.exp(-0.5 * F.pow((b - F.col("hr_bpm")) / 3, 2)))
    w = w.withColumn("g", g).withColumn("tot", F.aggregate("g", F.lit(0.0), lambda a, v: a + v) + 1e-8)
    return w.select("vec_id", "tot", F.posexplode("g").alias("j", "v")).select(
        "vec_id", F.element_at(bins, F.col("j") + 1).alias("bin_bpm"), rnd(F.col("v") / F.col("tot")).alias("target"))


@query("centered_derivatives", f"""with {WAVES}, g as (select vec_id, i, case when i = 0 then (lead(x) over v - x) * 16 when i = 63 then (x - lag(x) over v) * 16 else (lead(x) over v - lag(x) over v) * 8 end as d1 from w window v as (partition by vec_id order by i)),
 h as (select vec_id, i, d1, case when i = 0 then (lead(d1) over v - d1) * 16 when i = 63 then (d1 - lag(d1) over v) * 16 else (lead(d1) over v - lag(d1) over v) * 8 end as d2 from g window v as (partition by vec_id order by i))
select vec_id, {R('max(d1)')} as derivative_max, {R('stddev_pop(d2)')} as second_derivative_std from h group by 1""")
def centered_derivatives(spark, d):
    def gradient(c):
        at = lambda k: F.element_at(c, k)
        return F.transform(c, lambda v, i: F.when(i == 0, (at(2) - v) * FS).when(i == L - 1, (v - at(L - 1)) * FS)
                           .otherwise((at(F.least(i + 2, F.lit(L))) - at(F.greatest(i, F.lit(1)))) * FS / 2))
    w = waves(spark, d).withColumn("d1", gradient(F.col("x"))).withColumn("d2", gradient(F.col("d1")))
    return w.select("vec_id", rnd(F.array_max("d1")).alias("derivative_max"), rnd(sp.population_sd("d2")).alias("second_derivative_std"))


@query("adjacent_overlap_corr", f"""with {WAVES} select a.vec_id, {R('corr(a.x, b.x)')} as overlap_corr from w a join w b on b.vec_id = a.vec_id + 1 and b.i = a.i - 32 group by 1""")
def adjacent_overlap_corr(spark, d):
    p = wave_pairs(spark, d)
    return p.select("vec_id", rnd(sp.centered_corr(F.slice("x", L // 2 + 1, L // 2), F.slice("y", 1, L // 2))).alias("overlap_corr"))


@query("adjacent_change", f"""with {HR} , v as (select vec_id, case when confidence >= 0.8 then bpm end as bpm from hr)
select a.vec_id, {R('abs(a.bpm - b.bpm)')} as adjacent_hr_change_bpm from v a left join v b on b.vec_id = a.vec_id - 1""")
def adjacent_change(spark, d):
    h = sp.with_hr(waves(spark, d), "x", FS, L).select("vec_id", F.when(F.col("confidence") >= .8, F.col("hr_bpm")).alias("bpm"))
    prev = h.select((F.col("vec_id") + 1).alias("vec_id"), F.col("bpm").alias("previous"))
    return h.join(prev, "vec_id", "left").select("vec_id", rnd(F.abs(F.col("bpm") - F.col("previous"))).alias("adjacent_hr_change_bpm"))


@query("cross_window_quality", f"""with {HR}, v as (select vec_id, vec_id // 3 as grp, case when confidence >= 0.6 then bpm end as bpm from hr)
select grp, {R('case when count(bpm) = 3 then max(bpm) - min(bpm) end')} as inter_roi_hr_range_bpm, {R("abs(max(case when vec_id % 3 = 0 then bpm end) - max(case when vec_id % 3 = 1 then bpm end))")} as adjacent_window_hr_difference_bpm from v group by 1""")
def cross_window_quality(spark, d):
    h = sp.with_hr(waves(spark, d), "x", FS, L)
    v = h.select(F.floor(F.col("vec_id") / 3).alias("grp"), (F.col("vec_id") % 3).alias("slot"), F.when(F.col("confidence") >= .6, F.col("hr_bpm")).alias("bpm"))
    one = lambda k: F.max(F.when(F.col("slot") == k, F.col("bpm")))
    return v.groupBy("grp").agg(rnd(F.when(F.count("bpm") == 3, F.max("bpm") - F.min("bpm"))).alias("inter_roi_hr_range_bpm"),
                                rnd(F.abs(one(0) - one(1))).alias("adjacent_window_hr_difference_bpm"))
