"""Colour methods over bounded windows of the three-channel runs."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.functions.batch import apply_kernel
from pulsegrid.functions.cols import arr_zscore, rnd
from pulsegrid.operators import colour as cl, signals as sg
from pulsegrid.plans.recursion import zero_phase_sql
from pulsegrid.plans.registry import COLOUR, R, query
from pulsegrid.sources.tables import BLOCK, FS, colour_samples, colour_windows

WIN = cl.WINDOW
KEYS = "recording, window_index, pos"


def samples(spark, d):
    s = colour_samples(spark, d)
    s = s.withColumns({"window_index": F.floor(F.col("i") / BLOCK), "pos": (F.col("i") % BLOCK).cast("int")})
    return s.withColumn("n", F.count(F.lit(1)).over(cl._w()))


def picked(df, *names):
    return df.select(*WIN, F.col("pos").cast("int").alias("pos"), *[rnd(n).alias(n.lower()) for n in names])


MEANS = f"""{COLOUR}, m as (select *, r / (avg(r) over w + 1e-8) - 1 as rn, g / (avg(g) over w + 1e-8) - 1 as gn, b / (avg(b) over w + 1e-8) - 1 as bn
  from cw window w as (partition by recording, window_index))"""


def two_axis(x1, x2, sign, source, name):
    return f"""a as (select *, {x1} as x1, {x2} as x2 from {source}),
 y as (select *, x1 + ({sign}) * (stddev_pop(x1) over w / (stddev_pop(x2) over w + 1e-8)) * x2 as y from a window w as (partition by recording, window_index)),
 z as (select *, y - avg(y) over (partition by recording, window_index) as v from y)
select {KEYS}, {R('case when n >= 4 then v end')} as {name} from z"""


@query("standardize_channels", f"""with {COLOUR} select {KEYS}, {', '.join(R(f'({c} - avg({c}) over w) / (stddev_pop({c}) over w + 1e-8)') + f' as {c}_z' for c in 'rgb')}
from cw window w as (partition by recording, window_index)""")
def standardize_channels(spark, d):
    return picked(cl.standardized(samples(spark, d), ["r", "g", "b"]), "r_z", "g_z", "b_z")


@query("mean_normalize", f"with {MEANS} select {KEYS}, {R('rn')} as r_n, {R('gn')} as g_n, {R('bn')} as b_n from m")
def mean_normalize(spark, d):
    return picked(cl.mean_normalized(samples(spark, d), ["r", "g", "b"]), "r_n", "g_n", "b_n")


@query("signed_zscore", f"""with {COLOUR}, v as (select *, case when discount > 0 then b end as c from cw)
select {KEYS}, {R('case when stddev_pop(c) over w > 1e-8 and count(c) over w = n and n >= 2 then (c - avg(c) over w) / (stddev_pop(c) over w + 1e-8) end')} as z
from v window w as (partition by recording, window_index)""")
def signed_zscore(spark, d):
    s = samples(spark, d).withColumn("c", F.when(F.col("discount") > 0, F.col("b")))
    return picked(cl.signed_zscore(s, "c", "z"), "z")


@query("min_quality_filter", f"""with {COLOUR}, v as (select *, count_if(discount >= 0.09) over (partition by recording, window_index) as c from cw)
select {KEYS}, discount from v where c < 4 or discount >= 0.09""")
def min_quality_filter(spark, d):
    s = samples(spark, d).withColumn("c", F.count_if(F.col("discount") >= .09).over(cl._w()))
    return s.where("c < 4 or discount >= 0.09").select(*WIN, "pos", "discount")


@query("method_green", f"with {COLOUR} select {KEYS}, {R('case when n >= 4 then g - avg(g) over (partition by recording, window_index) end')} as green from cw")
def method_green(spark, d):
    return picked(cl.green(samples(spark, d)), "GREEN")


@query("method_chrom", f"with {MEANS}, {two_axis('3 * rn - 2 * gn', '1.5e0 * rn + gn - 1.5e0 * bn', '-1', 'm', 'chrom')}")
def method_chrom(spark, d):
    return picked(cl.chrom(samples(spark, d)), "CHROM")


@query("method_pos", f"with {MEANS}, {two_axis('rn - gn', 'rn + gn - 2 * bn', '1', 'm', 'pos_wave')}")
def method_pos(spark, d):
    # Spark column names ignore case, so the position is renamed before the POS column appears
    s = cl.pos(samples(spark, d).withColumnRenamed("pos", "k"))
    return s.select(*WIN, F.col("k").alias("pos"), rnd("POS").alias("pos_wave"))


@query("method_lgi", f"""with {COLOUR}, {two_axis('ln(greatest(g, 1e-6)) - ln(greatest(b, 1e-6))', 'ln(greatest(g, 1e-6)) - ln(greatest(r, 1e-6))', '-1', 'cw', 'lgi')}""")
def method_lgi(spark, d):
    return picked(cl.lgi(samples(spark, d)), "LGI")


@query("method_pbv", f"""with {COLOUR}, s as (select *, {', '.join(f'({c} - avg({c}) over w) / (stddev_pop({c}) over w + 1e-8) as {c}z' for c in 'rgb')}
   from cw window w as (partition by recording, window_index)),
 c as (select recording, window_index, var_samp(rz) + 1e-6 as a, covar_samp(rz, gz) as b, covar_samp(rz, bz) as c, var_samp(gz) + 1e-6 as e,
   covar_samp(gz, bz) as f, var_samp(bz) + 1e-6 as i from s group by 1, 2),
 k as (select *, a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c) as det from c),
 wt as (select recording, window_index, ((c * f - b * i) - (b * f - c * e)) / det as wr, ((a * i - c * c) - (b * c - a * f)) / det as wg,
   ((b * c - a * f) - (a * e - b * b)) / det as wb from k),
 y as (select s.*, wr * rz + wg * gz + wb * bz as y from s join wt using (recording, window_index)),
 z as (select *, y - avg(y) over (partition by recording, window_index) as v from y)
select {KEYS}, {R('case when n >= 4 then v end')} as pbv from z""")
def method_pbv(spark, d):
    return picked(cl.pbv(samples(spark, d)), "PBV")


@query("method_omit", f"""with {COLOUR}, c as (select *, r - avg(r) over w as rc, g - avg(g) over w as gc, b - avg(b) over w as bc from cw window w as (partition by recording, window_index)),
 x as (select *, rc - (rc + gc + bc) / 3 as xr, gc - (rc + gc + bc) / 3 as xg, bc - (rc + gc + bc) / 3 as xb from c),
 u as (select *, (xr - xg) / sqrt(2e0) as u, (xr + xg - 2 * xb) / sqrt(6e0) as v from x),
 m as (select recording, window_index, avg(u * u) as uu, avg(v * v) as vv, avg(u * v) as uv from u group by 1, 2),
 e as (select *, (uu + vv) / 2 + sqrt(pow((uu - vv) / 2, 2) + uv * uv) as lam from m),
 dir as (select recording, window_index, uu + vv as spread, case when abs(uv) > 1e-12 then (lam - vv) when uu >= vv then 1 else 0 end as du,
   case when abs(uv) > 1e-12 then uv when uu >= vv then 0 else 1 end as dv from e),
 nd as (select recording, window_index, spread, du / sqrt(du * du + dv * dv) as du, dv / sqrt(du * du + dv * dv) as dv from dir),
 ld as (select *, du / sqrt(2e0) + dv / sqrt(6e0) as lr, -du / sqrt(2e0) + dv / sqrt(6e0) as lg, -2 * dv / sqrt(6e0) as lb from nd),
 sg as (select *, sign(case when abs(lr) >= abs(lg) and abs(lr) >= abs(lb) then lr when abs(lg) >= abs(lb) then lg else lb end) as s from ld)
select {KEYS}, {R('case when n >= 4 then case when spread < 1e-14 then gc else s * (du * u + dv * v) end end')} as omit from u join sg using (recording, window_index)""")
def method_omit(spark, d):
    return picked(cl.omit(samples(spark, d)), "OMIT")


def sliding(x1, x2, sign, name):
    return f"""{COLOUR}, sub as (select recording, window_index, n, pos, r, g, b, unnest(range(greatest(0, pos - 25), least(pos, greatest(n - 26, 0)) + 1)) as st from cw where n > 26
   union all select recording, window_index, n, pos, r, g, b, 0 from cw where n <= 26 and n >= 4),
 m as (select *, r / (avg(r) over w + 1e-8) - 1 as rn, g / (avg(g) over w + 1e-8) - 1 as gn, b / (avg(b) over w + 1e-8) - 1 as bn from sub window w as (partition by recording, window_index, st)),
 a as (select *, {x1} as x1, {x2} as x2 from m),
 y as (select *, x1 + ({sign}) * (stddev_pop(x1) over w / (stddev_pop(x2) over w + 1e-8)) * x2 as y from a window w as (partition by recording, window_index, st)),
 z as (select *, y - avg(y) over (partition by recording, window_index, st) as v from y),
 o as (select recording, window_index, pos, avg(v) as v from z group by 1, 2, 3)
select cw.recording, cw.window_index, cw.pos, {R('v - avg(v) over (partition by cw.recording, cw.window_index)')} as {name} from cw left join o using (recording, window_index, pos)"""


def kernel_method(spark, d, name, column):
    return exploded(cl.window_methods(colour_windows(spark, d), [name], FS), name, column)


def exploded(windows, column, name):
    """One row per sample; a failed window keeps its rows with NULL values."""
    filled = F.coalesce(F.col(column), F.array_repeat(F.lit(None).cast("double"), F.col("n").cast("int")))
    return windows.select(*WIN, F.posexplode(filled).alias("pos", "v")).select(*WIN, "pos", rnd("v").alias(name))


@query("method_chrom_win", "with " + sliding("3 * rn - 2 * gn", "1.5e0 * rn + gn - 1.5e0 * bn", "-1", "chrom_win"))
def method_chrom_win(spark, d):
    return kernel_method(spark, d, "CHROM_WIN", "chrom_win")


@query("method_pos_win", "with " + sliding("rn - gn", "rn + gn - 2 * bn", "1", "pos_win"))
def method_pos_win(spark, d):
    return kernel_method(spark, d, "POS_WIN", "pos_win")


@query("method_pca")
def method_pca(spark, d):
    return kernel_method(spark, d, "PCA", "pca")


@query("method_ica")
def method_ica(spark, d):
    return kernel_method(spark, d, "ICA", "ica")


def kernel_filter(df, column, kernel, name, **params):
    return apply_kernel(df, [column], lambda x, **p: [kernel(x, **p)], f"{name} array<double>", **params)


@query("linear_detrend", f"""with {COLOUR}, f as (select *, g - avg(g) over w as y from cw window w as (partition by recording, window_index)),
 l as (select recording, window_index, regr_slope(y, pos) as sl, regr_intercept(y, pos) as ic from f group by 1, 2)
select {KEYS}, {R('y - (sl * pos + ic)')} as detrended from f join l using (recording, window_index)""")
def linear_detrend(spark, d):
    s = samples(spark, d).withColumn("y", F.col("g") - F.avg("g").over(cl._w()))
    return picked(cl.detrend(s, "y", "pos", "detrended"), "detrended")


@query("detrended_variant")
def detrended_variant(spark, d):
    # method with its own band-pass, straight line removed, band-pass again
    w = cl.pivot_windows(cl.chrom(samples(spark, d)), ["CHROM"])
    w = kernel_filter(w, "CHROM", kn.legacy_bandpass, "first", fs=FS)
    s = exploded(w, "first", "y")
    s = cl.detrend(s, "y", "pos", "res").withColumn("n", F.count(F.lit(1)).over(cl._w()))
    w = kernel_filter(cl.pivot_windows(s, ["res"], "pos"), "res", kn.legacy_bandpass, "wave", fs=FS)
    return exploded(w, "wave", "detrended")


@query("zero_phase_bandpass", f"""with recursive {COLOUR}, win as (select {{'r': recording, 'w': window_index}} as key, recording, window_index, list(g order by pos) as v from cw group by recording, window_index),
 src as (select key, list_transform(v, lambda a: a - list_avg(v)) as x from win), {zero_phase_sql('zp', 'src', FS, .7, 4.0)}
select recording, window_index, len(v) as n, y is not null as ok, {R('y[1]')} as first, {R('list_sum(list_transform(y, lambda a: a * a))')} as energy from win left join zp using (key)""")
def zero_phase_bandpass(spark, d):
    w = kernel_filter(colour_windows(spark, d).select(*WIN, "n", "g"), "g", kn.bandpass, "wave", fs=FS)
    return w.select(*WIN, "n", F.col("wave").isNotNull().alias("ok"), rnd(F.element_at("wave", 1)).alias("first"),
                    rnd(F.aggregate("wave", F.lit(0.0), lambda a, x: a + x * x)).alias("energy"))


@query("legacy_bandpass")
def legacy_bandpass(spark, d):
    w = kernel_filter(colour_windows(spark, d).select(*WIN, "n", "g"), "g", kn.legacy_bandpass, "wave", fs=FS)
    return exploded(w, "wave", "value")


PRIORS = ("GREEN", "CHROM", "CHROM_WIN", "PBV", "POS_WIN", "OMIT")


def prior_arrays(spark, d):
    """All default methods as arrays per window; a method that failed is a NULL array."""
    s = samples(spark, d).withColumnRenamed("pos", "k")
    for name in ("GREEN", "CHROM", "PBV", "OMIT"):
        s = cl.SAMPLE_METHODS[name](s)
    w = cl.pivot_windows(s, ["r", "g", "b", "GREEN", "CHROM", "PBV", "OMIT"])
    return cl.window_methods(w, ["CHROM_WIN", "POS_WIN"], FS)


@query("window_priors")
def window_priors(spark, d):
    w = prior_arrays(spark, d)
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("x")) for m in PRIORS])
    long = w.select(*WIN, "n", F.explode(methods).alias("m")).select(*WIN, "n", "m.method", "m.x")
    long = kernel_filter(long, "x", kn.legacy_bandpass, "y", fs=FS)
    zero = F.array_repeat(F.lit(0.0), F.col("n").cast("int"))
    prior = F.coalesce(arr_zscore("y", cl.EPS), zero)
    long = long.select(*WIN, "n", "method", F.col("y").isNotNull().alias("valid"), prior.alias("prior"))
    return long.select(*WIN, "method", "valid", F.size("prior").alias("samples"), rnd(F.element_at("prior", 1)).alias("first_value"),
                       rnd(F.aggregate("prior", F.lit(0.0), lambda a, v: a + v * v)).alias("energy"))


@query("multi_roi_average", f"""with {COLOUR}, roi as (select window_index, pos, flag as roi, avg(g) as v from cw group by 1, 2, 3),
 ok as (select *, v >= 40 as valid from roi)
select window_index, pos, cast(count_if(valid) as bigint) as valid_rois, {R('avg(case when valid then v end)')} as value from ok group by 1, 2""")
def multi_roi_average(spark, d):
    s = samples(spark, d).groupBy("window_index", "pos", F.col("flag").alias("roi")).agg(F.avg("g").alias("v"))
    ok = F.col("v") >= 40
    return s.groupBy("window_index", "pos").agg(F.count_if(ok).alias("valid_rois"), rnd(F.avg(F.when(ok, F.col("v")))).alias("value"))


TAPS = kn.kaiser_lowpass(FS, 2.0, 6.0, 40.0)


@query("fir_antialias", f"""with {COLOUR}, taps as (select unnest([{', '.join(repr(float(h)) for h in TAPS)}]) as h, unnest(range({len(TAPS)})) as j),
 f as (select a.recording, a.i, sum(b.g * h) as y, count(*) as c from colour a join taps on true join colour b on b.recording = a.recording and b.i = a.i + j - {len(TAPS) // 2} group by 1, 2)
select recording, i, {R(f'case when c = {len(TAPS)} then y end')} as filtered from f""")
def fir_antialias(spark, d):
    out = sg.fir(colour_samples(spark, d).select("recording", "i", "g"), ["recording"], "i", "g", TAPS, "y")
    return out.select("recording", "i", rnd("y").alias("filtered"))


@query("sinusoid_fit_gain", f"""with {COLOUR}, b as (select *, sin(2 * pi() * 1.2e0 * pos / 16e0) as s, cos(2 * pi() * 1.2e0 * pos / 16e0) as c from cw),
 m as (select recording, window_index, count(*) as n, avg(s) as ms, avg(c) as mc, avg(g) as mg, var_pop(s) as ss, var_pop(c) as cc, covar_pop(s, c) as sc, covar_pop(s, g) as sg, covar_pop(c, g) as cg from b group by 1, 2),
 k as (select *, ss * cc - sc * sc as det from m),
 w as (select *, (sg * cc - cg * sc) / det as p, (cg * ss - sg * sc) / det as q from k)
select recording, window_index, {R('case when n >= 16 then sqrt(p * p + q * q) end')} as gain, {R('case when n >= 16 then -1000 * atan2(q, p) / (2 * pi() * 1.2e0) end')} as delay_ms from w""")
def sinusoid_fit_gain(spark, d):
    angle = F.col("pos") * (2 * 3.141592653589793 * 1.2 / FS)
    s = samples(spark, d).withColumns({"s": F.sin(angle), "c": F.cos(angle)})
    m = s.groupBy(*WIN).agg(F.count("*").alias("n"), F.var_pop("s").alias("ss"), F.var_pop("c").alias("cc"),
                            F.covar_pop("s", "c").alias("sc"), F.covar_pop("s", "g").alias("sg"), F.covar_pop("c", "g").alias("cg"))
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    p = (F.col("sg") * F.col("cc") - F.col("cg") * F.col("sc")) / det
    q = (F.col("cg") * F.col("ss") - F.col("sg") * F.col("sc")) / det
    ok = F.col("n") >= 16
    return m.select(*WIN, rnd(F.when(ok, F.sqrt(p * p + q * q))).alias("gain"),
                    rnd(F.when(ok, -1000 * F.atan2(q, p) / (2 * 3.141592653589793 * 1.2))).alias("delay_ms"))
