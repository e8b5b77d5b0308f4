"""Streaming queries replayed over the event table, with batch SQL for the deterministic ones."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.cols import rnd
from pulsegrid.plans.registry import R, query
from pulsegrid.plans.signals import CLOCK_SQL
from pulsegrid.session import shared_folder
from pulsegrid.sources.tables import read, seconds
from pulsegrid.streaming import operators as so
from pulsegrid.streaming.replay import CLOSING, EVENTS, drained, event_stream, run_to_end

EPOCH = "epoch_us({0}) / 1e6"


def unix(c):
    return F.unix_micros(c) / F.lit(1e6)


@query("stream_window_quality", f"""with e as (select user_id, ts, "value" as x, event_type <> 'error' as valid from events), mx as (select date_trunc('millisecond', max(ts)) - interval 1 hour as wm from events),
 w as (select e.*, s.s as ws from e, lateral (select unnest([time_bucket(interval 1 day, ts, timestamp '1970-01-01'), time_bucket(interval 1 day, ts, timestamp '1970-01-01') - interval 1 day]) as s) s),
 g as (select user_id, ws, count(*) as samples, avg(valid::int) as vf, avg(x) as m, stddev_pop(x) as sd from w group by 1, 2)
select user_id, epoch_us(ws) / 1e6 as start_unix, samples, {R('vf')} as valid_fraction, {R('m')} as mean_value, case when vf < 0.75 or sd < 1e-10 then 'invalid' when sd / m > 1 then 'uncertain' else 'good' end as status,
  concat_ws('|', case when vf < 0.75 then 'insufficient_original_valid_frames' end, case when sd < 1e-10 then 'flat_signal' end, case when sd / m > 1 then 'illumination_variation' end) as reasons from g, mx where ws + interval 2 day <= wm""")
def stream_window_quality(spark, d):
    q = so.window_quality(event_stream(spark, f"{d}/events.parquet"), "2 days", "1 day", "1 hour")
    out = run_to_end(q, "window-quality")
    return out.select("user_id", unix("start").alias("start_unix"), "samples", rnd("valid_fraction").alias("valid_fraction"), rnd("mean_value").alias("mean_value"), "status", "reasons")


@query("stream_run_sessions", """with e as (select user_id, ts from events where event_type <> 'error'), mx as (select date_trunc('millisecond', max(ts)) - interval 1 hour as wm from e),
 l as (select *, case when ts >= lag(ts) over w + interval 24 hour or lag(ts) over w is null then 1 else 0 end as n from e window w as (partition by user_id order by ts)), s as (select *, sum(n) over (partition by user_id order by ts) as sid from l)
select user_id, epoch_us(min(ts)) / 1e6 as start_unix, epoch_us(max(ts)) / 1e6 + 86400 as end_unix, count(*) as samples from s, mx group by user_id, sid, wm having max(ts) + interval 24 hour <= wm""")
def stream_run_sessions(spark, d):
    out = run_to_end(so.run_sessions(event_stream(spark, f"{d}/events.parquet"), "24 hours", "1 hour"), "sessions")
    return out.select("user_id", unix("start").alias("start_unix"), unix("end").alias("end_unix"), "samples")


@query("stream_dedupe_windows", "select distinct user_id, cast(epoch_us(ts) // 86400000000 as bigint) as day, event_type from events")
def stream_dedupe_windows(spark, d):
    s = event_stream(spark, f"{d}/events.parquet").withColumn("day", F.floor(F.unix_micros("ts") / 86400000000))
    return run_to_end(so.dedupe_windows(s, ["user_id", "day", "event_type"], "2 days").select("user_id", "day", "event_type"), "dedupe")


def state_rows(s):
    return s.select("ts", "user_id", "event_id", "event_type", "valid", ((F.unix_micros("ts") - 1704067200000000) / F.lit(1e6)).alias("t"), F.col("value").alias("x"),
                    F.from_json("props", "k int")["k"].cast("double").alias("y"))


def folded(spark, d, processor, output, name, delay="1 hour", files_per_trigger=None):
    """Keyed fold of the whole event table in event-time order; the delay has to cover how far files are out of order."""
    return drained(event_stream(spark, f"{d}/events.parquet", files_per_trigger), lambda s: so.keyed(state_rows(s), processor, output, delay, CLOSING), name)


@query("stream_motion", f"""with c as (select *, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t, cast(json_extract_string(props, '$.k') as integer) as y from events), s as (select *, lag(t) over w as pt, lag("value") over w as px, lag(y) over w as py from c where event_type <> 'error' window w as (partition by user_id order by t, event_id))
select user_id, event_id, {R('case when t - pt <= 86400 then sqrt(pow("value" - px, 2) + pow(y - py, 2)) / (t - pt) * 3600 end')} as motion_per_hour from s union all select user_id, event_id, null from c where event_type = 'error'""")
def stream_motion(spark, d):
    out = folded(spark, d, so.Motion(86400.0), "user_id long, event_id long, motion_per_hour double", "motion")
    return out.select("user_id", "event_id", rnd("motion_per_hour").alias("motion_per_hour"))


LOCK_SQL = """recursive fr as (select user_id, event_id, event_type as label, "value" as x, row_number() over (partition by user_id order by ts, event_id) as i from events),
 lk as (select user_id, event_id, i, label, x, 'accepted' as outcome from fr where i = 1 union all
   select f.user_id, f.event_id, f.i, k.label, case when f.label = k.label and abs(f.x - k.x) <= 30 then f.x else k.x end,
     case when f.label <> k.label then 'hand_not_detected' when abs(f.x - k.x) > 30 then 'hand_tracking_jump' else 'accepted' end from lk k join fr f on f.user_id = k.user_id and f.i = k.i + 1)"""


@query("stream_identity_lock", f"with {LOCK_SQL} select user_id, event_id, outcome from lk")
def stream_identity_lock(spark, d):
    return folded(spark, d, so.IdentityLock(30.0), "user_id long, event_id long, outcome string", "identity")


@query("stream_fallback_clock", f"with {CLOCK_SQL} select recording as user_id, event_id, {R('t')} as t, case when used then 'container' else 'nominal_fallback' end as source from ck")
def stream_fallback_clock(spark, d):
    out = folded(spark, d, so.FallbackClock(600.0), "user_id long, event_id long, t double, source string", "clock")
    return out.select("user_id", "event_id", rnd("t").alias("t"), "source")


@query("stream_late_policy", f"""with e as (select user_id, cast(epoch_us(ts) // 86400000000 as bigint) as day, "value" as x from events),
 mx as (select cast(floor((epoch_ms(max(ts)) - 86400000) / 86400000e0) as bigint) as closed from events),
 g as (select user_id, day, count(*) as samples, {R('avg(x)')} as mean_value from e group by 1, 2),
 dropped as (select count(*) as n from e, mx where day - 19723 < 21 and day < closed)
 select g.*, day - 19723 >= 21 and day < closed as live, case when day - 19723 < 21 and day < closed then samples else 0 end as late_rows, dropped.n as dropped_rows from g, mx, dropped""")
def stream_late_policy(spark, d):
    """Newest weeks first: rows of windows that have closed are dropped by the stream and counted, and a backfill rewrites those windows only.

    Every window stays in the result; ``live`` tells whether the stream itself delivered it, ``late_rows`` how many of its rows came too late,
    and ``dropped_rows`` what the stream's own metric counted in all.
    """
    base, state, table = (shared_folder(spark, n) for n in ("late", "late-live", "late-table"))
    e = read(spark, d, "events").withColumn("week", F.floor(seconds() / 604800.0))
    closed, dropped = None, 0
    for part in ("week >= 3", "week < 3"):        # each arrival is one batch, whatever its number of files
        arrival = e.where(part).drop("week")
        arrival.write.mode("append").parquet(base)
        run = so.daily_live(event_stream(spark, base), "1 day", closed)
        progress: list = []
        live = run_to_end(run, "late-live", base=state, progress=progress)
        dropped += sum(p["observedMetrics"]["arrived"]["late"] for p in progress if "arrived" in p.get("observedMetrics", {}))
        if closed is None:
            live.write.partitionBy("day").parquet(table)
        else:
            so.backfill(spark, table, spark.read.schema(EVENTS).parquet(base), so.late_rows(arrival, closed))
        closed = max(p["eventTime"]["watermark"] for p in progress if "watermark" in p.get("eventTime", {}))
    published = spark.read.parquet(table).select("user_id", F.col("day").cast("long").alias("day"), "samples", rnd("mean_value").alias("mean_value"), "live", "late_rows")
    waiting = so.daily(e).where(so.window_end("day") > F.lit(closed).cast("timestamp"))        # not yet closed: no stream row so far
    waiting = waiting.select("user_id", "day", "samples", rnd("mean_value").alias("mean_value"), F.lit(False).alias("live"), F.lit(0).cast("long").alias("late_rows"))
    return published.union(waiting).withColumn("dropped_rows", F.lit(dropped).cast("long"))
