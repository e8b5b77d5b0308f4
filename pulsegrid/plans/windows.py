"""Window-level summaries, schedules, frame checks and status rules."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from pulsegrid.functions.cols import joined, reasons, rnd, safe_corr
from pulsegrid.operators import clock as ck, colour as cl, greedy, spectral as sp
from pulsegrid.operators.carry import exact_quantiles, islands, with_prev
from pulsegrid.plans.clock import CUFF, FLAGSHIP, FS, KEY, LENGTH, RUNS, span, STRIDE, events_with_flags, uniform, window_quality
from pulsegrid.plans.colour import samples as colour_long
from pulsegrid.plans.registry import COLOUR, GRID, R, TRACE, query
from pulsegrid.plans.spectral import GATED, HR, dft, gated, hr_sql, K0, K1, NFFT
from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import DAY, FS as RATE, read, trace

STATUS = f"""{FLAGSHIP}, qs as (select *, case when r1 or r2 or r3 then 'invalid' when r4 or r5 then 'uncertain' else 'good' end as status from q)"""


@query("quality_summary", f"""with {STATUS}, lv as (select *, unnest(['all', 'usable', 'good']) as level from qs), sel as (select * from lv where level = 'all' or (level = 'usable' and status <> 'invalid') or (level = 'good' and status = 'good')),
 rk as (select *, max(start_sec + 172800) over (partition by recording, level order by start_sec rows between unbounded preceding and 1 preceding) as seen from sel)
select recording, level, count(*) as windows, {R('sum(greatest(0, start_sec + 172800 - greatest(start_sec, coalesce(seen, start_sec))))')} as coverage_sec, {R('median(periodicity)')} as median_periodicity, {R('median(illumination_cv)')} as median_cv from rk group by 1, 2""")
def quality_summary(spark, d):
    q = checkpointed(window_quality(spark, d))     # window rows, read by the union and two medians
    levels = F.array_compact(F.array(F.lit("all"), F.when(F.col("status") != "invalid", "usable"), F.when(F.col("status") == "good", "good")))
    s = q.select(*KEY, "start_sec", (F.col("start_sec") + LENGTH / FS).alias("end_sec"), "periodicity", "illumination_cv", F.explode(levels).alias("level"))
    key = [*KEY, "level"]
    cover = ck.interval_union(s, key, span(spark, d))
    med = [exact_quantiles(s, key, c, {n: .5}) for c, n in (("periodicity", "median_periodicity"), ("illumination_cv", "median_cv"))]
    out = cover.join(med[0], key, "left").join(med[1], key, "left")
    return out.select(*key, F.col("intervals").alias("windows"), rnd("union_sec").alias("coverage_sec"), rnd("median_periodicity").alias("median_periodicity"), rnd("median_cv").alias("median_cv"))


@query("signal_summary", f"""with {STATUS}, m as (select recording, median(periodicity) as med from qs group by 1)
select recording, cast(count_if(status = 'good') as bigint) as good, cast(count_if(status = 'uncertain') as bigint) as uncertain, cast(count_if(status = 'invalid') as bigint) as invalid, {R('any_value(med)')} as median_periodicity,
  {R('median(abs(periodicity - med))')} as mad_periodicity from qs join m using (recording) group by 1""")
def signal_summary(spark, d):
    q = checkpointed(window_quality(spark, d).select(*KEY, "status", "periodicity"))
    counts = q.groupBy(*KEY).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("good", "uncertain", "invalid")])
    med = exact_quantiles(q, KEY, "periodicity", {"med": .5})
    dev = q.join(med, KEY).withColumn("dev", F.abs(F.col("periodicity") - F.col("med")))
    out = counts.join(med, KEY, "left").join(exact_quantiles(dev, KEY, "dev", {"mad": .5}), KEY, "left")
    return out.select(*KEY, "good", "uncertain", "invalid", rnd("med").alias("median_periodicity"), rnd("mad").alias("mad_periodicity"))


@query("delay_summary", f"""with {GATED} select subject, {', '.join(f"cast(count_if(status = '{s}') as bigint) as {s}" for s in ('strict', 'intermediate', 'uncertain', 'invalid'))}, {R('median(delay)')} as median_delay, {R('stddev_pop(delay)')} as sd_delay from gs group by 1""")
def delay_summary(spark, d):
    g = gated(spark, d)
    out = g.groupBy("subject").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("strict", "intermediate", "uncertain", "invalid")], F.stddev_pop("delay").alias("sd"))
    out = out.join(exact_quantiles(g, ["subject"], "delay", {"med": .5}), "subject", "left")
    return out.select("subject", "strict", "intermediate", "uncertain", "invalid", rnd("med").alias("median_delay"), rnd("sd").alias("sd_delay"))


@query("stability_summary", f"""with {GATED}, sel as (select *, unnest(['all_computable', status]) as selection from gs where delay is not null), atm as (select subject, count(*) as attempted from gs group by 1),
 adj as (select a.subject, a.selection, abs(b.delay - a.delay) as diff from sel a join sel b on b.vec_id = a.vec_id + 1 and b.subject = a.subject and b.selection = a.selection),
 am as (select subject, selection, count(*) as pairs, median(diff) as md from adj group by 1, 2)
select sel.subject, selection, any_value(attempted) as attempted_windows, count(*) as computable_windows, {R('median(delay) * 1000')} as median_delay_ms, {R('case when count(*) >= 2 then stddev_pop(delay) * 1000 end')} as delay_std_ms,
  {R('case when count(*) >= 2 then (quantile_cont(delay, .75) - quantile_cont(delay, .25)) * 1000 end')} as delay_iqr_ms, coalesce(any_value(pairs), 0) as adjacent_pairs, {R('any_value(md) * 1000')} as median_adjacent_difference_ms
from sel join atm using (subject) left join am using (subject, selection) group by 1, 2""")
def stability_summary(spark, d):
    g = checkpointed(gated(spark, d).select("vec_id", "subject", "status", "delay"))     # read by five branches
    key = ["subject", "selection"]
    s = g.where("delay is not null").select("vec_id", "subject", "delay", F.explode(F.array(F.lit("all_computable"), "status")).alias("selection"))
    nxt = s.select((F.col("vec_id") - 1).alias("vec_id"), *key, F.col("delay").alias("after"))
    adj = s.join(nxt, ["vec_id", *key]).withColumn("diff", F.abs(F.col("after") - F.col("delay")))
    pairs = adj.groupBy(*key).agg(F.count("*").alias("pairs")).join(exact_quantiles(adj, key, "diff", {"md": .5}), key)
    out = s.groupBy(*key).agg(F.count("*").alias("n"), F.stddev_pop("delay").alias("sd")).join(exact_quantiles(s, key, "delay", {"q1": .25, "q2": .5, "q3": .75}), key)
    out = out.join(g.groupBy("subject").agg(F.count("*").alias("attempted")), "subject").join(pairs, key, "left")
    two = F.col("n") >= 2
    return out.select(*key, F.col("attempted").alias("attempted_windows"), F.col("n").alias("computable_windows"), rnd(F.col("q2") * 1000).alias("median_delay_ms"),
                      rnd(F.when(two, F.col("sd") * 1000)).alias("delay_std_ms"), rnd(F.when(two, (F.col("q3") - F.col("q1")) * 1000)).alias("delay_iqr_ms"),
                      F.coalesce("pairs", F.lit(0)).alias("adjacent_pairs"), rnd(F.col("md") * 1000).alias("median_adjacent_difference_ms"))


@query("acquisition_summary", f"""with {TRACE}, s as (select *, lead(t) over (partition by recording order by t, event_id) - t as dt from trace)
select recording, count(*) as samples, {R('avg(valid::int)')} as valid_fraction, {R('sum(case when valid then dt end)')} as valid_seconds, {R('median(x)')} as median_value,
  cast(count_if(event_type = 'error') as bigint) as reason_error, cast(count_if(x > 200) as bigint) as reason_clipped from s group by 1""")
def acquisition_summary(spark, d):
    s = trace(spark, d).withColumn("block", F.floor(F.col("t") / span(spark, d)))
    s = with_prev(s, KEY, "block", ["t", "event_id"], F.struct("t"), "next", next_row=True)
    dt = F.col("next.t") - F.col("t")
    a = s.groupBy(*KEY).agg(F.count("*").alias("samples"), rnd(F.avg(F.col("valid").cast("double"))).alias("valid_fraction"), rnd(F.sum(F.when(F.col("valid"), dt))).alias("valid_seconds"),
                            F.count_if(F.col("event_type") == "error").alias("reason_error"), F.count_if(F.col("x") > 200).alias("reason_clipped"))
    q = exact_quantiles(trace(spark, d), KEY, "x", {"q": .5})
    return a.join(q, KEY, "left").select("recording", "samples", "valid_fraction", "valid_seconds", rnd("q").alias("median_value"), "reason_error", "reason_clipped")


@query("region_quality", f"""with {RUNS}, r as (select *, row_number() over (partition by recording order by "end" - start desc, start) as rn from runs),
 u as (select recording, avg(case when x is not null then 1e0 else 0 end) as sv, avg(imputed::int) as im from uniform group by 1),
 s as (select recording, avg(valid::int) as vf, stddev_pop(x) as ill, avg(x) as mean_x from trace group by 1)
select recording, {R('vf')} as valid_frame_fraction, {R('1 - vf')} as missing_frame_fraction, {R('sv')} as signal_valid_fraction, {R('im')} as interpolated_grid_fraction, coalesce("end" - start, 0) as longest_run, {R('ill')} as illumination_std, {R('mean_x')} as value_mean,
  concat_ws('|', case when vf = 0 then 'not_detected' end, case when vf < 0.8 then 'insufficient_valid_frames' end, case when coalesce("end" - start, 0) < 72 then 'insufficient_duration_or_flat_signal' end) as reasons
from s join u using (recording) left join r on r.recording = s.recording and rn = 1""")
def region_quality(spark, d):
    return region(spark, d).select(*KEY, *[rnd(c).alias(c) for c in ("valid_frame_fraction", "missing_frame_fraction", "signal_valid_fraction", "interpolated_grid_fraction")],
                                   "longest_run", rnd("illumination_std").alias("illumination_std"), rnd("value_mean").alias("value_mean"), joined("why").alias("reasons"))


def region(spark, d):
    """Support, longest run and spread per recording with the reasons that make it unusable."""
    u = uniform(spark, d)
    runs = ck.valid_runs(u, KEY, F.col("x").isNotNull(), chunk=128)
    longest = runs.groupBy(*KEY).agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    g = u.groupBy(*KEY).agg(F.avg(F.col("x").isNotNull().cast("double")).alias("signal_valid_fraction"), F.avg(F.col("imputed").cast("double")).alias("interpolated_grid_fraction"))
    s = trace(spark, d).groupBy(*KEY).agg(F.avg(F.col("valid").cast("double")).alias("valid_frame_fraction"), F.stddev_pop("x").alias("illumination_std"), F.avg("x").alias("value_mean"))
    out = s.join(g, KEY).join(longest, KEY, "left").withColumns({"missing_frame_fraction": 1 - F.col("valid_frame_fraction"), "longest_run": F.coalesce("longest", F.lit(0))})
    why = reasons(("not_detected", F.col("valid_frame_fraction") == 0), ("insufficient_valid_frames", F.col("valid_frame_fraction") < .8),
                  ("insufficient_duration_or_flat_signal", F.col("longest_run") < 72))
    return out.withColumn("why", why)


@query("quality_status_region", f"""with {RUNS}, lr as (select recording, max("end" - start) as n from runs group by 1), s as (select recording, avg(valid::int) as vf from trace group by 1),
 w as (select concat_ws('|', case when vf = 0 then 'not_detected' end, case when vf < 0.8 then 'insufficient_valid_frames' end, case when coalesce(n, 0) < 72 then 'insufficient_duration_or_flat_signal' end) as reasons from s left join lr using (recording))
select reasons, reasons = '' as usable, count(*) as recordings from w group by 1, 2""")
def quality_status_region(spark, d):
    r = region(spark, d).select(joined("why").alias("reasons"), (F.size("why") == 0).alias("usable"))
    return r.groupBy("reasons", "usable").agg(F.count("*").alias("recordings"))


@query("cohort_gate", f"""with {STATUS}, g as (select * from qs where status <> 'invalid'), rk as (select *, max(start_sec + 172800) over (partition by recording order by start_sec rows between unbounded preceding and 1 preceding) as seen from g),
 u as (select recording, count(*) as n, sum(greatest(0, start_sec + 172800 - greatest(start_sec, coalesce(seen, start_sec)))) as cover from rk group by 1)
select b.recording, coalesce(n, 0) as valid_windows, {R('coalesce(cover, 0)')} as union_sec, coalesce(cover >= 259200 and n >= 3, false) as run_remaining from bounds b left join u using (recording)""")
def cohort_gate(spark, d):
    q = window_quality(spark, d).where("status <> 'invalid'").select(*KEY, "start_sec", (F.col("start_sec") + LENGTH / FS).alias("end_sec"))
    u = ck.interval_union(q, KEY, span(spark, d))
    b = ck.bounds(trace(spark, d), KEY, FS).select(*KEY).join(u, KEY, "left")
    n, cover = F.coalesce("intervals", F.lit(0)), F.coalesce("union_sec", F.lit(0.0))
    return b.select(*KEY, n.alias("valid_windows"), rnd(cover).alias("union_sec"), ((cover >= 3 * DAY) & (n >= 3)).alias("run_remaining"))


@query("window_gate", f"""with {GATED}, v as (select *, concat_ws('|', case when fs < -8 then 'face_low_signal_quality' end, case when hs < -8 then 'hand_low_signal_quality' end, case when delay is null then 'unresolved_delay' end,
   case when score < 0.2 then 'low_delay_correlation' end, case when abs(fb - hb) > 40 then 'face_hand_hr_inconsistent' end) as reasons from gs)
select vec_id, case when reasons = '' then 'accepted' else 'excluded' end as status, reasons from v""")
def window_gate(spark, d):
    g = gated(spark, d)
    why = reasons(("face_low_signal_quality", F.col("snr_db") < -8), ("hand_low_signal_quality", F.col("y_snr_db") < -8), ("unresolved_delay", F.col("delay").isNull()),
                  ("low_delay_correlation", F.col("score") < .2), ("face_hand_hr_inconsistent", F.abs(F.col("hr_bpm") - F.col("y_hr_bpm")) > 40))
    g = g.withColumn("gate", why)
    return g.select("vec_id", F.when(F.size("gate") == 0, "accepted").otherwise("excluded").alias("status"), joined("gate").alias("reasons"))


METHOD_WIN = f"""{COLOUR}, m as (select *, r / (avg(r) over w + 1e-8) - 1 as rn, g / (avg(g) over w + 1e-8) - 1 as gn, b / (avg(b) over w + 1e-8) - 1 as bn from cw window w as (partition by recording, window_index)),
 ax as (select *, 3 * rn - 2 * gn as c1, 1.5e0 * rn + gn - 1.5e0 * bn as c2, rn - gn as p1, rn + gn - 2 * bn as p2 from m),
 wv as (select recording * 1000000 + window_index as vec_id, pos as i, g as green, c1 - stddev_pop(c1) over w / (stddev_pop(c2) over w + 1e-8) * c2 as chrom, p1 + stddev_pop(p1) over w / (stddev_pop(p2) over w + 1e-8) * p2 as pos_wave
   from ax where n = 64 window w as (partition by recording, window_index))"""


@query("method_agreement", f"""with {METHOD_WIN}, {', '.join(f"{dft('d_' + m, 'wv', m, K0, K1, NFFT)}, {hr_sql('h_' + m, 'd_' + m)}" for m in ('green', 'chrom', 'pos_wave'))},
 c as (select vec_id, corr(green, chrom) as gc, corr(green, pos_wave) as gp, corr(chrom, pos_wave) as cp from wv group by 1)
select vec_id // 1000000 as recording, vec_id % 1000000 as window_index, {R('greatest(h_green.bpm, h_chrom.bpm, h_pos_wave.bpm) - least(h_green.bpm, h_chrom.bpm, h_pos_wave.bpm)')} as hr_range_bpm, {R('gc')} as green_chrom_r, {R('gp')} as green_pos_r, {R('cp')} as chrom_pos_r
from c join h_green using (vec_id) join h_chrom using (vec_id) join h_pos_wave using (vec_id)""")
def method_agreement(spark, d):
    s = colour_long(spark, d).withColumnRenamed("pos", "k")
    w = cl.pivot_windows(cl.pos(cl.chrom(cl.green(s))), ["GREEN", "CHROM", "POS"]).where("n = 64")
    w = sp.with_hr(w, {m: f"{m.lower()}_" for m in ("GREEN", "CHROM", "POS")}, RATE, 64)
    hr = [F.col(f"{m}_hr_bpm") for m in ("green", "chrom", "pos")]
    r = lambda a, b: rnd(sp.centered_corr(F.col(a), F.col(b)))
    return w.select("recording", "window_index", rnd(F.greatest(*hr) - F.least(*hr)).alias("hr_range_bpm"), r("GREEN", "CHROM").alias("green_chrom_r"),
                    r("GREEN", "POS").alias("green_pos_r"), r("CHROM", "POS").alias("chrom_pos_r"))


@query("motion_speed", f"""with {TRACE}, c as (select event_id, cast(json_extract_string(props, '$.k') as integer) as y from events), s as (select t.*, y, lag(t) over w as pt, lag(x) over w as px, lag(y) over w as py from trace t join c using (event_id) where valid window w as (partition by recording order by t, event_id))
select event_id, {R('case when t - pt <= 86400 then sqrt(pow(x - px, 2) + pow(y - py, 2)) / (t - pt) * 3600 end')} as motion_per_hour from s union all select event_id, null from trace where not valid""")
def motion_speed(spark, d):
    e = read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].cast("double").alias("y"))
    s = trace(spark, d).select(*KEY, "event_id", "t", "x", "valid").join(e, "event_id")
    live = s.where("valid").withColumn("block", F.floor(F.col("t") / span(spark, d)))
    live = with_prev(live, KEY, "block", ["t", "event_id"], F.struct("t", "x", "y"), "p")
    dt = F.col("t") - F.col("p.t")
    move = F.sqrt(F.pow(F.col("x") - F.col("p.x"), 2) + F.pow(F.col("y") - F.col("p.y"), 2))
    out = live.select("event_id", rnd(F.when((dt <= DAY) & (dt > 0), F.try_divide(move, dt) * 3600)).alias("motion_per_hour"))
    return out.unionByName(s.where("not valid").select("event_id", F.lit(None).cast("double").alias("motion_per_hour")))


@query("repeated_frame_flag", f"""with {TRACE}, s as (select *, floor(x) as q, lag(floor(x)) over (partition by recording order by t, event_id) as p from trace) select event_id, coalesce(q = p, false) as repeated from s""")
def repeated_frame_flag(spark, d):
    s = trace(spark, d).withColumns({"block": F.floor(F.col("t") / span(spark, d)), "q": F.floor("x")})
    s = with_prev(s, KEY, "block", ["t", "event_id"], F.struct("q"), "p")
    return s.select("event_id", F.coalesce(F.col("q") == F.col("p.q"), F.lit(False)).alias("repeated"))


@query("downsample_guard", f"""with {TRACE}, s as (select recording, t - lag(t) over (partition by recording order by t, event_id) as dt from trace), m as (select recording, median(dt) as dt from s group by 1)
select recording, {R('1 / dt * 3600')} as acquired_per_hour, 1 / 3600e0 < 0.95e0 / dt as refused from m""")
def downsample_guard(spark, d):
    s = trace(spark, d).withColumn("block", F.floor(F.col("t") / span(spark, d)))
    s = with_prev(s, KEY, "block", ["t", "event_id"], F.struct("t"), "p").withColumn("dt", F.col("t") - F.col("p.t"))
    m = exact_quantiles(s, KEY, "dt", {"dt": .5})
    return m.select(*KEY, rnd(F.try_divide(F.lit(3600.0), "dt")).alias("acquired_per_hour"), (F.lit(FS) < F.try_divide(F.lit(.95), "dt")).alias("refused"))


ANCHOR = f"""{RUNS}, {CUFF}, ph0 as (select u.recording, u.k, x is not null as ok, coalesce(bool_or(u.t >= start_sec and u.t < end_sec), false) as act, coalesce(bool_or(u.t >= start_sec - 3600 and u.t < end_sec + 3600), false) as grd
   from uniform u left join (select * from cuff where end_sec is not null) c on c.recording = u.recording group by 1, 2, 3),
 lb as (select recording, k, case when not ok then -1 when act then 1 when grd then 2 else 0 end as label from ph0),
 ig as (select *, k - row_number() over (partition by recording, label order by k) as g from lb),
 pr as (select recording, label, min(k) as a, max(k) + 1 as b from ig where label >= 0 group by recording, label, g),
 st as (select recording, unnest(range(a + 2, b - 2 - 24 + 1, 12)) as start from pr where b - a >= 28 union select recording, unnest(range(0, n - 24 + 1, 12)) from (select recording, count(*) as n from grid group by 1) where n >= 24),
 pm as (select distinct recording, unnest(range(a + 2, b - 2 - 24 + 1, 24)) as start from pr where b - a >= 28)"""


@query("phase_anchored_schedule", f"with {ANCHOR} select distinct st.recording, st.start, pm.start is not null as is_primary from st left join pm on pm.recording = st.recording and pm.start = st.start")
def phase_anchored_schedule(spark, d):
    return anchored(spark, d, length=24, stride=12, edge=2, guard=3600.0)


def anchored(spark, d, length, stride, edge, guard):
    """Global starts and starts anchored inside every (phase, support) run; primary starts step by the window."""
    events = events_with_flags(spark, d).where("end_sec is not null")
    u = uniform(spark, d)
    m = ck.sample_phase(u.select(*KEY, "k", "t", "x"), events, KEY, guard, span(spark, d))
    label = F.when(F.col("x").isNull(), -1).otherwise(ck.phase_label())
    runs = checkpointed(islands(m, KEY, "k", label, 128).where("flag >= 0").where(F.col("end") - F.col("start") >= length + 2 * edge))
    last = F.col("end") - edge - length
    starts = lambda step: runs.select(*KEY, F.explode(F.sequence(F.col("start") + edge, last, F.lit(step).cast("long"))).alias("start"))
    primary = starts(length).withColumn("is_primary", F.lit(True))
    sizes = ck.bounds(trace(spark, d), KEY, FS).select(*KEY, "n")
    every = starts(stride).unionByName(ck.sliding_windows(sizes, KEY, length, stride).select(*KEY, "start")).distinct()
    return every.join(primary, [*KEY, "start"], "left").select(*KEY, "start", F.coalesce("is_primary", F.lit(False)).alias("is_primary"))


@query("nonoverlapping_greedy", f"""with recursive {TRACE}, v as (select recording, t, lead(t) over (partition by recording order by t) as nx, row_number() over (partition by recording order by t) as rn from trace),
 ch as (select recording, t from v where rn = 1 union all select c.recording, (select min(v.t) from v where v.recording = c.recording and v.t >= c.t + 172800 - 1e-9) as t from ch c where c.t is not null)
select trace.event_id, ch.t is not null as chosen from trace left join ch on ch.recording = trace.recording and ch.t = trace.t""")
def nonoverlapping_greedy(spark, d):
    w = trace(spark, d).select("recording", "event_id", F.col("t").alias("start_sec"))
    return greedy.nonoverlapping(w, "recording", 2 * DAY, span(spark, d)).select("event_id", "chosen")
