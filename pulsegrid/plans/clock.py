"""Clock, resampling, runs, windows and interval queries over the event traces."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.cols import finite, joined, reasons, rnd, safe_corr
from pulsegrid.operators import clock as ck
from pulsegrid.operators.carry import dealt, exact_quantiles, halo, with_prev
from pulsegrid.plans.registry import CUFF, GRID, R, RESAMPLED, TRACE, query
from pulsegrid.sources.tables import DAY, cuff_events, read, trace

KEY = ["recording"]
FS = 1 / 3600.0          # one grid point per hour
MAX_GAP = DAY
WIDEST = 7 * DAY         # widest time bucket of the ordered operators
LENGTH, STRIDE = 48, 24  # window and hop in grid points


_WIDTHS: dict[tuple, float] = {}


def span(spark, d):
    """Bucket width for the event traces, measured once per session and table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _WIDTHS:
        _WIDTHS[key] = ck.bucket_width(trace(spark, d).select(*KEY, "t"), KEY, WIDEST)
    return _WIDTHS[key]


def uniform(spark, d):
    s = trace(spark, d)
    grid = ck.shared_grid(s, KEY, FS)
    return ck.bounded_resample(s, grid, KEY, ["x"], MAX_GAP, span(spark, d), ck.grid_size(s, KEY, FS))


def events_with_flags(spark, d):
    return cuff_events(spark, d).withColumn("timing_verified", F.col("end_sec").isNotNull())


@query("validate_clock", f"""
with {TRACE}, s as (select *, lag(t) over (partition by recording order by event_id) as p from trace)
select recording, count(*) as samples, cast(count_if(not isfinite(t)) as bigint) as nonfinite,
  cast(count_if(t <= p) as bigint) as not_increasing, count_if(t <= p or not isfinite(t)) = 0 as ok
from s group by 1""")
def validate_clock(spark, d):
    s = trace(spark, d).withColumn("block", F.floor(F.col("event_id") / 4096))
    s = with_prev(s, KEY, "block", ["event_id"], F.struct("t"), "prev")
    back = F.col("t") <= F.col("prev.t")
    return s.groupBy(*KEY).agg(F.count("*").alias("samples"), F.count_if(~finite("t")).alias("nonfinite"),
                               F.count_if(back).alias("not_increasing"),
                               (F.count_if(back | ~finite("t")) == 0).alias("ok"))


@query("validate_trace", f"""
with {TRACE} select recording, count(*) as samples, cast(count_if(valid) as bigint) as valid_samples,
  cast(count_if(valid and (x is null or not isfinite(x))) as bigint) as contradictions from trace group by 1""")
def validate_trace(spark, d):
    s = trace(spark, d)
    return s.groupBy(*KEY).agg(F.count("*").alias("samples"), F.count_if("valid").alias("valid_samples"),
                               F.count_if(F.col("valid") & ~finite("x")).alias("contradictions"))


@query("validate_uniform_grid", f"""
with {TRACE}, {GRID}, s as (select *, lag(t) over (partition by recording order by k) as p from grid)
select recording, count(*) as points, cast(count_if(abs(t - p - 3600) > 1e-7 + 1e-5 * 3600) as bigint) as bad_steps
from s group by 1""")
def validate_uniform_grid(spark, d):
    g = ck.shared_grid(trace(spark, d), KEY, FS).withColumn("block", F.floor(F.col("k") / 4096))
    g = with_prev(g, KEY, "block", ["k"], F.struct("t"), "prev")
    bad = F.abs(F.col("t") - F.col("prev.t") - 1 / FS) > 1e-7 + 1e-5 / FS
    return g.groupBy(*KEY).agg(F.count("*").alias("points"), F.count_if(bad).alias("bad_steps"))


@query("clock_audit", f"""
with {TRACE}, s as (select *, t - lag(t) over (partition by recording order by t, event_id) as dt,
    x = lag(x) over (partition by recording order by t, event_id) as same from trace),
  q as (select recording, quantile_cont(dt, 0) as q00, quantile_cont(dt, .01) as q01, quantile_cont(dt, .5) as q50,
    quantile_cont(dt, .99) as q99, quantile_cont(dt, 1) as q100, count(*) as samples, cast(count_if(same) as bigint) as repeated
    from s group by 1)
select recording, samples, repeated, {R('q00')} as q00, {R('q01')} as q01, {R('q50')} as q50, {R('q99')} as q99,
  {R('q100')} as q100, (select cast(count_if(dt > 1.5 * q50) as bigint) from s where s.recording = q.recording) as long_intervals
from q""")
def clock_audit(spark, d):
    s = trace(spark, d).withColumn("block", F.floor(F.col("t") / span(spark, d)))
    s = with_prev(s, KEY, "block", ["t", "event_id"], F.struct("t", "x"), "prev")
    s = s.withColumn("dt", F.col("t") - F.col("prev.t"))
    q = exact_quantiles(s, KEY, "dt", {"q00": 0, "q01": .01, "q50": .5, "q99": .99, "q100": 1})
    counts = s.groupBy(*KEY).agg(F.count("*").alias("samples"), F.count_if(F.col("x") == F.col("prev.x")).alias("repeated"))
    over = s.join(q.select(*KEY, "q50"), KEY).groupBy(*KEY).agg(
        F.count_if(F.col("dt") > 1.5 * F.col("q50")).alias("long_intervals"))
    return counts.join(q, KEY, "left").join(over, KEY, "left").select(
        *KEY, "samples", "repeated", *[rnd(c).alias(c) for c in ("q00", "q01", "q50", "q99", "q100")],
        F.coalesce("long_intervals", F.lit(0)).alias("long_intervals"))


@query("shared_grid", f"with {TRACE}, {GRID} select recording, k, {R('t')} as t from grid")
def shared_grid(spark, d):
    return ck.shared_grid(trace(spark, d), KEY, FS).select(*KEY, "k", rnd("t").alias("t"))


@query("bounded_resample", f"with {TRACE}, {GRID}, {RESAMPLED} select recording, k, {R('x')} as x, imputed from uniform")
def bounded_resample(spark, d):
    return uniform(spark, d).select(*KEY, "k", rnd("x").alias("x"), "imputed")


@query("resample_unbounded", f"""
with {TRACE}, {GRID}, s as (select *, row_number() over (partition by recording order by t) as rn,
    count(*) over (partition by recording) as n from trace),
  seg as (select a.recording, a.t as ta, a.x as xa, b.t as tb, b.x as xb, a.rn, a.n from s a
    join s b on a.recording = b.recording and b.rn = a.rn + 1),
  pts as (select recording, k, t from grid union all select recording, -1 as k, t0 - 1800 as t from bounds
    union all select recording, -2 as k, t1 + 1800 as t from bounds),
  hit as (select p.recording, p.k, p.t, coalesce(s1.ta, s0.ta) as ta, coalesce(s1.xa, s0.xa) as xa,
    coalesce(s1.tb, s0.tb) as tb, coalesce(s1.xb, s0.xb) as xb from pts p
    asof left join seg s1 on p.recording = s1.recording and p.t >= s1.ta
    left join seg s0 on p.recording = s0.recording and s0.rn = 1)
select recording, k, {R('xa + (xb - xa) / (tb - ta) * (t - ta)')} as x from hit""")
def resample_unbounded(spark, d):
    s = trace(spark, d).select(*KEY, "t", "event_id", "x")
    b = ck.bounds(s, KEY, FS)
    outer = b.select(*KEY, F.lit(-1).cast("long").alias("k"), (F.col("t0") - 1800).alias("t")).unionByName(
        b.select(*KEY, F.lit(-2).cast("long").alias("k"), (F.col("t1") + 1800).alias("t")))
    points = ck.shared_grid(s, KEY, FS).select(*KEY, "k", "t").unionByName(outer)
    return ck.resample_unbounded(s, points, KEY, "x", span(spark, d)).select(*KEY, "k", rnd("value").alias("x"))


@query("reference_interp_on_grid", f"""
with {TRACE}, {GRID}, ref as (select recording, t, avg(x) as x from trace where event_type = 'view' group by 1, 2),
  sup as (select recording, min(t) as a, max(t) as b from ref group by 1),
  hit as (select g.recording, g.k, g.t, l.t as lt, l.x as lx, r.t as rt, r.x as rx from grid g
    join sup s on s.recording = g.recording and g.t between s.a and s.b
    asof join ref l on g.recording = l.recording and g.t >= l.t
    asof join ref r on g.recording = r.recording and g.t <= r.t)
select recording, k, {R('case when rt = lt then lx else lx + (rx - lx) / (rt - lt) * (t - lt) end')} as value from hit""")
def reference_interp_on_grid(spark, d):
    s = trace(spark, d)
    ref = s.where("event_type = 'view'").select(*KEY, "t", "event_id", "x")
    support = ref.groupBy(*KEY).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = ck.shared_grid(s, KEY, FS, support)
    out = ck.resample_unbounded(ref, grid, KEY, "x", span(spark, d))
    one = ref.groupBy(*KEY).agg(F.count("*").alias("c"), F.first("x").alias("only"))
    out = out.join(one, KEY).withColumn("value", F.when(F.col("c") == 1, F.col("only")).otherwise(F.col("value")))
    return out.select(*KEY, "k", rnd("value").alias("value"))


@query("support_projection", f"""
with {TRACE}, {GRID}, hit as (select g.recording, g.k, g.t, l.valid as lv, r.valid as rv, r.t as rt, l.t as lt from grid g
    asof left join trace l on g.recording = l.recording and g.t > l.t
    asof left join trace r on g.recording = r.recording and g.t <= r.t)
select recording, k, coalesce(case when rt - t <= 1e-8 then rv else lv and rv end, false) as supported from hit""")
def support_projection(spark, d):
    s = trace(spark, d)
    u = ck.neighbours(s, ck.shared_grid(s, KEY, FS), KEY, ["valid"], span(spark, d), ck.grid_size(s, KEY, FS))
    flag = F.when(F.col("hi.t") - F.col("t") <= ck.EXACT, F.col("hi.valid")).otherwise(F.col("lo.valid") & F.col("hi.valid"))
    return u.select(*KEY, "k", F.coalesce(flag, F.lit(False)).alias("supported"))


@query("common_support", f"""
with {TRACE}, e as (select recording, event_type, max(t) as last, count(*) as n from trace group by 1, 2),
  c as (select recording, min(last) as common_end, count(*) as streams, max(n) as most, min(n) as least from e group by 1)
select c.recording, streams, {R('common_end')} as common_end, cast(count_if(t <= common_end) as bigint) as kept,
  cast(count_if(t > common_end) as bigint) as discarded, any_value(most - least > 5) as rates_differ
from c join trace using (recording) group by 1, 2, common_end""")
def common_support(spark, d):
    s = trace(spark, d)
    ends = s.groupBy(*KEY, "event_type").agg(F.max("t").alias("last"), F.count("*").alias("n"))
    c = ends.groupBy(*KEY).agg(F.min("last").alias("common_end"), F.count("*").alias("streams"),
                               (F.max("n") - F.min("n") > 5).alias("rates_differ"))
    return s.join(c, KEY).groupBy(*KEY, "streams", "rates_differ", "common_end").agg(
        F.count_if(F.col("t") <= F.col("common_end")).alias("kept"),
        F.count_if(F.col("t") > F.col("common_end")).alias("discarded")).select(
        *KEY, "streams", rnd("common_end").alias("common_end"), "kept", "discarded", "rates_differ")


@query("window_interval_join", f"""
with {TRACE}, {GRID}, s as (select tr.*, t - t0 as rel, t1 - t0 as dur from trace tr join bounds using (recording)),
 j as (select s.recording, w.w as window_index, x, valid from s, lateral (select unnest(range(0, cast(floor(rel / 86400) as bigint) + 1)) as w) w
   where rel < w.w * 86400e0 + 172800)
select recording, window_index, count(*) as samples, cast(count_if(valid) as bigint) as valid_samples, {R('avg(x)')} as mean_x
from j group by 1, 2""")
def window_interval_join(spark, d):
    s = trace(spark, d)
    s = s.join(ck.bounds(s, KEY, FS), KEY)
    s = ck.assign_windows(s, F.col("t") - F.col("t0"), F.lit(2 * DAY), F.lit(DAY))
    return s.groupBy(*KEY, "window_index").agg(F.count("*").alias("samples"), F.count_if("valid").alias("valid_samples"),
                                         rnd(F.avg("x")).alias("mean_x"))


MASKS = f"""{TRACE}, {CUFF}, s as (select * from trace where event_type <> 'purchase'),
 ver as (select recording, bool_and(end_sec is not null) as ok from cuff group by 1),
 m as (select s.recording, s.event_id, s.t, coalesce(bool_or(t >= start_sec and t < end_sec), false) as act,
   coalesce(bool_or(t >= start_sec - 300 and t < end_sec + 300), false) as grd,
   coalesce(bool_or(end_sec is null and t >= start_sec - 300), false) as unk
   from s left join cuff c on s.recording = c.recording group by 1, 2, 3),
 mk as (select m.recording, event_id, t, act as cuff_active, grd and not act as cuff_boundary_guard,
   not (grd or unk) as candidate_cuff_free, not (grd or unk) and coalesce(ok, true) as verified_cuff_free,
   unk or not coalesce(ok, true) as timing_uncertain from m left join ver using (recording)),
 ph as (select *, case when cuff_active then 1 when cuff_boundary_guard then 2 when candidate_cuff_free then 0 else 3 end as phase from mk)"""


def masks(spark, d):
    s = trace(spark, d).where("event_type <> 'purchase'").select(*KEY, "event_id", "t")
    return ck.sample_phase(s, events_with_flags(spark, d), KEY, 300.0, span(spark, d)).withColumn("phase", ck.phase_label())


@query("event_mask_join", f"""with {MASKS} select recording, event_id, cuff_active, cuff_boundary_guard,
  candidate_cuff_free, verified_cuff_free, timing_uncertain from ph""")
def event_mask_join(spark, d):
    return masks(spark, d).select(*KEY, "event_id", "cuff_active", "cuff_boundary_guard", "candidate_cuff_free",
                                  "verified_cuff_free", "timing_uncertain")


@query("cuff_phase_label", f"with {MASKS} select phase, count(*) as samples, count(distinct recording) as recordings from ph group by 1")
def cuff_phase_label(spark, d):
    p = masks(spark, d).groupBy("phase", "recording").agg(F.count("*").alias("n"))
    return p.groupBy("phase").agg(F.sum("n").alias("samples"), F.count("*").alias("recordings"))


@query("phase_seconds", f"""with {MASKS}, dt as (select *, lead(t) over (partition by recording order by t, event_id) - t as dt from ph)
select recording, {R('sum(case when cuff_active then dt else 0 end)')} as active_sec,
  {R('sum(case when cuff_boundary_guard then dt else 0 end)')} as guard_sec,
  {R('sum(case when candidate_cuff_free then dt else 0 end)')} as free_sec,
  {R('sum(case when timing_uncertain then dt else 0 end)')} as uncertain_sec from dt group by 1""")
def phase_seconds(spark, d):
    m = masks(spark, d).withColumn("block", F.floor(F.col("t") / span(spark, d)))
    m = with_prev(m, KEY, "block", ["t", "event_id"], F.struct("t"), "next", next_row=True)
    dt = F.col("next.t") - F.col("t")
    part = {"active_sec": "cuff_active", "guard_sec": "cuff_boundary_guard", "free_sec": "candidate_cuff_free",
            "uncertain_sec": "timing_uncertain"}
    return m.groupBy(*KEY).agg(*[rnd(F.sum(F.when(F.col(c), dt).when(dt.isNotNull(), 0.0))).alias(n) for n, c in part.items()])


RUNS = f"""{TRACE}, {GRID}, {RESAMPLED},
 isl as (select recording, k, x is not null as flag, k - row_number() over (partition by recording, x is not null order by k) as g from uniform),
 allruns as (select recording, flag, g, min(k) as start, max(k) + 1 as "end" from isl group by 1, 2, 3),
 runs as (select recording, start, "end" from allruns where flag)"""


@query("valid_runs", f"with {RUNS} select recording, start, \"end\" from runs")
def valid_runs(spark, d):
    return ck.valid_runs(uniform(spark, d), KEY, F.col("x").isNotNull(), chunk=128)


@query("longest_run", f"""with {RUNS}, r as (select *, row_number() over (partition by recording order by "end" - start desc, start) as rn from runs)
select recording, start, "end", {R('t0 + start * 3600')} as start_sec, {R('t0 + ("end" - 1) * 3600')} as end_sec
from r join bounds using (recording) where rn = 1""")
def longest_run(spark, d):
    r = ck.valid_runs(uniform(spark, d), KEY, F.col("x").isNotNull(), chunk=128)
    best = r.groupBy(*KEY).agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("b"))
    b = ck.bounds(trace(spark, d), KEY, FS).select(*KEY, "t0")
    return best.join(b, KEY).select(*KEY, "b.start", "b.end", rnd(F.col("t0") + F.col("b.start") / FS).alias("start_sec"),
                                    rnd(F.col("t0") + (F.col("b.end") - 1) / FS).alias("end_sec"))


@query("missing_intervals", f"""with {RUNS} select recording, start, "end", {R('t0 + start * 3600')} as start_sec,
  {R('t0 + ("end" - 1) * 3600')} as end_sec from allruns join bounds using (recording) where not flag""")
def missing_intervals(spark, d):
    r = ck.valid_runs(uniform(spark, d), KEY, F.col("x").isNull(), chunk=128)
    b = ck.bounds(trace(spark, d), KEY, FS).select(*KEY, "t0")
    return r.join(b, KEY).select(*KEY, "start", "end", rnd(F.col("t0") + F.col("start") / FS).alias("start_sec"),
                                 rnd(F.col("t0") + (F.col("end") - 1) / FS).alias("end_sec"))


WINDOWS = """sz as (select recording, count(*) as n from grid group by 1),
 win as (select recording, w as window_index, w * 24 as start, w * 24 + 48 as "end" from
   (select recording, unnest(range(0, case when n >= 48 then (n - 48) // 24 + 1 else 0 end)) as w from sz))"""


@query("sliding_windows", f"with {TRACE}, {GRID}, {WINDOWS} select recording, window_index, start, \"end\" from win")
def sliding_windows(spark, d):
    return ck.sliding_windows(ck.bounds(trace(spark, d), KEY, FS), KEY, LENGTH, STRIDE)


@query("time_windows", f"""with {TRACE}, {GRID} select recording, w as window_index, {R('t0 + w * 86400')} as start_sec,
  {R('t0 + w * 86400 + 172800')} as end_sec from (select recording, t0, unnest(range(0,
  cast(floor((t1 - t0 - 172800 + 1e-6) / 86400) as bigint) + 1)) as w from bounds where t1 - t0 + 1e-6 >= 172800)""")
def time_windows(spark, d):
    b = ck.bounds(trace(spark, d), KEY, FS)
    room = F.col("t1") - F.col("t0") - 2 * DAY + 1e-6
    w = ck.explode_ids(b, KEY, F.when(room >= 0, F.floor(room / DAY) + 1).otherwise(0), "window_index")
    start = F.col("t0") + F.col("window_index") * DAY
    return w.select(*KEY, "window_index", rnd(start).alias("start_sec"), rnd(start + 2 * DAY).alias("end_sec"))


@query("scheduled_windows_fixed", f"""with {TRACE}, {GRID}, sch as (select recording, t1 - t0 as dur,
   unnest(range(0, cast(floor((greatest(30 * 86400e0, t1 - t0) - 172800) / 86400 + 1e-9) as bigint) + 1)) as w from bounds)
select recording, w as window_index, w * 86400e0 as start_sec, w * 86400e0 + 172800 as end_sec, w * 86400e0 + 172800 <= dur as supported from sch""")
def scheduled_windows_fixed(spark, d):
    b = ck.bounds(trace(spark, d), KEY, FS).withColumn("dur", F.col("t1") - F.col("t0"))
    total = F.greatest(F.lit(30 * DAY), F.col("dur"))
    w = ck.explode_ids(b, KEY, F.floor((total - 2 * DAY) / DAY + 1e-9) + 1, "window_index")
    start = F.col("window_index") * DAY
    return w.select(*KEY, "window_index", start.alias("start_sec"), (start + 2 * DAY).alias("end_sec"),
                    (start + 2 * DAY <= F.col("dur")).alias("supported"))


FLAGSHIP = f"""{RUNS}, {WINDOWS},
 src as (select w.recording, w.window_index, avg(case when valid then 1.0 else 0 end) as valid_fraction,
   case when avg(x) > 0 then stddev_pop(x) / avg(x) end as illumination_cv
   from win w join bounds b using (recording) join trace t on t.recording = w.recording
   and t.t >= t0 + start * 3600e0 and t.t < t0 + start * 3600e0 + 172800 group by 1, 2),
 gr as (select w.recording, w.window_index, count(x) as finite_points, avg(imputed::int) as imputed_fraction, stddev_pop(x) as sd
   from win w join uniform u on u.recording = w.recording and u.k >= w.start and u.k < w."end" group by 1, 2),
 per as (select w.recording, w.window_index, corr(a.x, b.x) as periodicity from win w
   join uniform a on a.recording = w.recording and a.k >= w.start and a.k < w.start + 24
   join uniform b on b.recording = a.recording and b.k = a.k + 24 group by 1, 2),
 q as (select w.recording, w.window_index, w.start, t0 + w.start * 3600e0 as start_sec, coalesce(valid_fraction, 0) as valid_fraction, imputed_fraction,
   illumination_cv, case when finite_points = 48 then periodicity end as periodicity,
   coalesce(valid_fraction, 0) < .75 as r1, finite_points < 48 as r2, finite_points = 48 and sd < 1e-10 as r3,
   coalesce(case when finite_points = 48 and isfinite(periodicity) then periodicity end, -9) < .5 as r4, coalesce(illumination_cv > 1, false) as r5
   from win w join bounds using (recording) left join src using (recording, window_index) join gr using (recording, window_index) join per using (recording, window_index))"""
REASON_SQL = """concat_ws('|', case when r1 then 'insufficient_original_valid_frames' end, case when r2 then 'missing_signal_or_filter_edge' end,
 case when r3 then 'flat_signal' end, case when r4 then 'weak_periodicity' end, case when r5 then 'illumination_variation' end)"""


@query("quality_status_window", f"""with {FLAGSHIP} select recording, window_index, {R('start_sec')} as start_sec,
  {R('valid_fraction')} as valid_fraction, {R('imputed_fraction')} as imputed_fraction, {R('periodicity')} as periodicity,
  {R('illumination_cv')} as illumination_cv,
  case when r1 or r2 or r3 then 'invalid' when r4 or r5 then 'uncertain' else 'good' end as status, {REASON_SQL} as reasons from q""")
def quality_status_window(spark, d):
    return window_quality(spark, d).select(
        *KEY, "window_index", rnd("start_sec").alias("start_sec"), rnd("valid_fraction").alias("valid_fraction"),
        rnd("imputed_fraction").alias("imputed_fraction"), rnd("periodicity").alias("periodicity"),
        rnd("illumination_cv").alias("illumination_cv"), "status", joined("reasons").alias("reasons"))


def window_quality(spark, d, min_valid: float = 0.75, max_cv: float = 1.0):
    """Support, missing share, flatness and one-day periodicity per window, with status and reasons."""
    s = trace(spark, d)
    b = ck.bounds(s, KEY, FS).select(*KEY, "t0", "n")
    windows = ck.sliding_windows(b, KEY, LENGTH, STRIDE)
    source = ck.assign_windows(s.join(b, KEY), F.col("t") - F.col("t0"), F.lit(LENGTH / FS), F.lit(STRIDE / FS))
    # a sample lies in two windows, and a window has few samples: they are dealt as they are
    source = dealt(source, s.count() * LENGTH // STRIDE, *KEY, "window_index").groupBy(*KEY, "window_index").agg(
        F.avg(F.col("valid").cast("double")).alias("valid_fraction"),
        F.when(F.avg("x") > 0, F.stddev_pop("x") / F.avg("x")).alias("illumination_cv"))
    # one-day lag by a short frame over the dense grid; a pair counts when both ends lie in the window
    day = int(DAY * FS)
    u, frame = halo(uniform(spark, d), KEY, "k", 0, day)
    u = u.withColumn("later", F.lead("x", day).over(frame)).where("_own").select(*KEY, "k", "x", "imputed", "later")
    g = ck.assign_windows(u, F.col("k"), F.lit(LENGTH), F.lit(STRIDE))
    pair = F.col("k") - F.col("window_index") * STRIDE < LENGTH - day
    g = g.groupBy(*KEY, "window_index").agg(
        F.count("x").alias("finite_points"), F.avg(F.col("imputed").cast("double")).alias("imputed_fraction"),
        F.stddev_pop("x").alias("sd"), safe_corr(F.when(pair, F.col("x")), F.when(pair, F.col("later"))).alias("r"))
    g = g.withColumn("periodicity", F.when(F.col("finite_points") == LENGTH, F.col("r"))).drop("r")
    q = windows.join(g, [*KEY, "window_index"]).join(source, [*KEY, "window_index"], "left").join(b.drop("n"), KEY)
    q = q.withColumns({"start_sec": F.col("t0") + F.col("start") / FS,
                       "valid_fraction": F.coalesce("valid_fraction", F.lit(0.0))})
    hard = [("insufficient_original_valid_frames", F.col("valid_fraction") < min_valid),
            ("missing_signal_or_filter_edge", F.col("finite_points") < LENGTH),
            ("flat_signal", (F.col("finite_points") == LENGTH) & (F.col("sd") < 1e-10))]
    soft = [("weak_periodicity", F.coalesce("periodicity", F.lit(-9.0)) < .5),
            ("illumination_variation", F.coalesce(F.col("illumination_cv") > max_cv, F.lit(False)))]
    q = q.withColumns({"invalid": reasons(*hard), "uncertain": reasons(*soft)})
    return q.withColumns({
        "status": F.when(F.size("invalid") > 0, "invalid").when(F.size("uncertain") > 0, "uncertain").otherwise("good"),
        "reasons": F.concat("invalid", "uncertain")})


@query("interval_union_seconds", f"""with {CUFF}, c as (select * from cuff where end_sec is not null),
 s as (select *, max(end_sec) over (partition by recording order by start_sec, end_sec rows between unbounded preceding and 1 preceding) as seen from c)
select recording, count(*) as intervals, {R('sum(greatest(0, end_sec - greatest(start_sec, coalesce(seen, start_sec))))')} as union_sec from s group by 1""")
def interval_union_seconds(spark, d):
    e = cuff_events(spark, d).where("end_sec is not null")
    return ck.interval_union(e, KEY, span(spark, d)).select(*KEY, "intervals", rnd("union_sec").alias("union_sec"))


@query("interval_complement", f"""with {TRACE}, {GRID}, {CUFF},
 bl as (select recording, greatest(t0, start_sec - 300) as a, least(t1, coalesce(end_sec + 300, t1)) as b, t0, t1 from cuff join bounds using (recording)),
 s as (select *, greatest(t0, coalesce(max(b) over (partition by recording order by a, b rows between unbounded preceding and 1 preceding), t0)) as cur from bl),
 gaps as (select recording, cur as a, a as b from s where a > cur union all
   select recording, greatest(t0, coalesce(m, t0)), t1 from bounds left join (select recording, max(b) as m from bl group by 1) using (recording)
   where t1 > greatest(t0, coalesce(m, t0)))
select recording, {R('a')} as start_sec, {R('b')} as end_sec, b - a >= 3600 as signal_window_possible,
  case when b - a >= 3600 then 'candidate_cuff_free' else 'too_short_for_window_and_edges' end as reason from gaps""")
def interval_complement(spark, d):
    return free_intervals(spark, d).select(
        *KEY, rnd("start_sec").alias("start_sec"), rnd("end_sec").alias("end_sec"), "signal_window_possible",
        F.when(F.col("signal_window_possible"), "candidate_cuff_free").otherwise("too_short_for_window_and_edges").alias("reason"))


def free_intervals(spark, d, guard: float = 300.0, need: float = 3600.0):
    blocked = cuff_events(spark, d).select(*KEY, (F.col("start_sec") - guard).alias("start_sec"),
                                           (F.col("end_sec") + guard).alias("end_sec"))
    extent = ck.bounds(trace(spark, d), KEY, FS).select(*KEY, "t0", "t1")
    gaps = ck.interval_complement(blocked, extent, KEY, span(spark, d))
    return gaps.withColumn("signal_window_possible", F.col("end_sec") - F.col("start_sec") >= need)


@query("duplicate_time_mean", """
with s as (select user_id as recording, cast(epoch_us(ts) // 3600000000 as bigint) as hour, "value" as x, event_type from events),
 g as (select recording, hour, count(*) as copies, bool_and(event_type <> 'error') as ok, avg(x) as m from s group by 1, 2)
select recording, hour, copies, (case when ok then round(m, 6) + 0.0 end) as mean_x from g""")
def duplicate_time_mean(spark, d):
    e = read(spark, d, "events")
    hour = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 3600000000)
    # one poisoned copy makes the whole instant missing
    g = e.groupBy(F.col("user_id").alias("recording"), hour.alias("hour")).agg(
        F.count("*").alias("copies"), F.bool_and(F.col("event_type") != "error").alias("ok"), F.avg("value").alias("m"))
    return g.select("recording", "hour", "copies", F.when(F.col("ok"), rnd("m")).alias("mean_x"))
