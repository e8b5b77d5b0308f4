"""Associations, identity joins, validation and metadata queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.cols import joined, reasons, rnd, safe_corr
from pulsegrid.operators import assoc as ac, clock as ck
from pulsegrid.operators.carry import exact_quantiles, with_prev
from pulsegrid.plans.clock import FS, KEY, span, events_with_flags, free_intervals
from pulsegrid.plans.registry import COLOUR, CUFF, EVAL, GRID, R, TRACE, query
from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import DAY, colour_samples, cuff_events, eval_rows, read, trace

FREE = f"""{TRACE}, {GRID}, {CUFF},
 bl as (select recording, greatest(t0, start_sec - 300) as a, least(t1, coalesce(end_sec + 300, t1)) as b, t0, t1 from cuff join bounds using (recording)),
 sq as (select *, greatest(t0, coalesce(max(b) over (partition by recording order by a, b rows between unbounded preceding and 1 preceding), t0)) as cur from bl),
 free as (select recording, cur as start_sec, a as end_sec from sq where a > cur union all
   select recording, greatest(t0, coalesce(m, t0)), t1 from bounds left join (select recording, max(b) as m from bl group by 1) using (recording)
   where t1 > greatest(t0, coalesce(m, t0)))"""


@query("cuff_contained_window", f"""with {FREE}, win as (select recording, t0, w, t0 + w * 43200e0 as start_sec, t0 + w * 43200e0 + 86400 as end_sec from
   (select recording, t0, unnest(range(0, cast(floor((t1 - t0 - 86400 + 1e-6) / 43200) as bigint) + 1)) as w from bounds where t1 - t0 + 1e-6 >= 86400)),
 hit as (select w.recording, w.w, max(f.end_sec) as e from win w join free f on f.recording = w.recording and w.start_sec >= f.start_sec - 1e-8 and w.end_sec <= f.end_sec + 1e-8 group by 1, 2)
select win.recording, win.w as window_index, e is not null as labelled, {R('e - win.end_sec')} as margin_sec, case when e is null then 'not_inside_one_association' else '' end as reason
from win left join hit using (recording, w)""")
def cuff_contained_window(spark, d):
    b = ck.bounds(trace(spark, d), KEY, FS)
    room = F.col("t1") - F.col("t0") - DAY + 1e-6
    w = ck.explode_ids(b, KEY, F.when(room >= 0, F.floor(room / (DAY / 2)) + 1).otherwise(0), "window_index")
    start = F.col("t0") + F.col("window_index") * (DAY / 2)
    w = w.select(*KEY, "window_index", start.alias("start_sec"), (start + DAY).alias("end_sec"))
    c = ac.contained(w, free_intervals(spark, d), KEY, [], span(spark, d))
    inside = F.col("inside")
    return c.select(*KEY, "window_index", inside.alias("labelled"), rnd(F.when(inside, F.col("interval.end_sec") - F.col("end_sec"))).alias("margin_sec"),
                    F.when(inside, "").otherwise("not_inside_one_association").alias("reason"))


PRECEDING = f"""{FREE}, ev as (select recording, event_id, start_sec, end_sec is not null as verified from cuff),
 cand as (select ev.*, f.start_sec as fs, f.end_sec as fe from ev left join free f on f.recording = ev.recording and f.end_sec <= ev.start_sec and ev.start_sec - f.end_sec <= 3600),
 pick as (select *, row_number() over (partition by event_id order by fe desc) as rn from cand),
 one as (select *, count(fe) over (partition by recording, fe) as uses from pick where rn = 1),
 agg as (select one.event_id, count(t.t) as windows, median(t.x) as med, max(t.t) as lt from one join trace t on t.recording = one.recording and t.event_type <> 'purchase'
   and t.t >= fs and t.t <= fe and one.start_sec - t.t <= 86400 group by 1)"""


@query("cuff_preceding_interval", f"""with {PRECEDING} select one.event_id, coalesce(windows, 0) > 0 as available, coalesce(windows, 0) as eligible_windows, {R('med')} as median_feature,
  {R('start_sec - lt')} as feature_to_cuff_sec, coalesce(windows > 0 and uses > 1, false) as interval_reused,
  case when fe is null then 'no_eligible_preceding_interval' when coalesce(windows, 0) = 0 then 'no_eligible_signal_windows' else 'exploratory_pre_cuff_association' end as reason from one left join agg using (event_id)""")
def cuff_preceding_interval(spark, d):
    return preceding_features(spark, d).select(
        "event_id", "available", "eligible_windows", rnd("median_feature").alias("median_feature"),
        rnd("feature_to_cuff_sec").alias("feature_to_cuff_sec"), "interval_reused", "reason")


def preceding_features(spark, d, max_distance=3600.0, reach=DAY):
    """Latest free interval before each event and the samples of it that are near enough."""
    free = checkpointed(free_intervals(spark, d).select(*KEY, "start_sec", "end_sec"))     # interval rows, read by both sides
    ev = events_with_flags(spark, d).select(*KEY, "event_id", "start_sec", "timing_verified")
    one = ac.preceding(ev, free, KEY, [], max_distance, span(spark, d))
    uses = one.where("interval is not null").groupBy(*KEY, F.col("interval.end_sec").alias("fe")).agg(F.count("*").alias("uses"))
    one = one.withColumn("fe", F.col("interval.end_sec")).join(uses, [*KEY, "fe"], "left")
    # free intervals are disjoint: each sample finds its own one, then meets the few events that follow it
    s = trace(spark, d).where("event_type <> 'purchase'").select(*KEY, "t", "x")
    s = ac.latest_start(s, free, KEY, "t", ["end_sec"], span(spark, d)).where(F.col("t") <= F.col("interval.end_sec"))
    s = s.select(*KEY, F.col("interval.end_sec").alias("fe"), "t", "x")
    s = s.where(F.col("t") >= F.col("fe") - reach)          # an event starts after its interval ends: older samples reach none
    j = one.select(*KEY, "event_id", "fe", "start_sec").join(s, [*KEY, "fe"]).where(F.col("start_sec") - F.col("t") <= reach)
    agg = j.groupBy("event_id").agg(F.count("*").alias("windows"), F.max("t").alias("lt"))
    agg = agg.join(exact_quantiles(j, ["event_id"], "x", {"median_feature": .5}), "event_id")
    one = one.join(agg, "event_id", "left")
    n = F.coalesce("windows", F.lit(0))
    return one.withColumns({
        "eligible_windows": n, "available": n > 0, "feature_to_cuff_sec": F.col("start_sec") - F.col("lt"),
        "interval_reused": (n > 0) & (F.coalesce("uses", F.lit(0)) > 1),
        "reason": F.when(F.col("interval").isNull(), "no_eligible_preceding_interval").when(n == 0, "no_eligible_signal_windows")
        .otherwise("exploratory_pre_cuff_association")})


@query("cuff_reference_align", f"""with {TRACE}, {GRID}, {CUFF}, m as (select c.event_id, c.value, t0, t1, start_sec - t0 as a, end_sec - t0 as b, t1 - t0 as dur from cuff c join bounds using (recording))
select event_id, case when value < 1 then 'unavailable' when b is null then 'session_only' when not (0 <= a and a < b and b <= dur) then 'session_only' when value >= 50 then 'timed_cuff_interval' else 'session_only' end as alignment,
  {R('case when value >= 50 and 0 <= a and a < b and b <= dur then a end')} as start_sec, {R('case when value >= 50 and 0 <= a and a < b and b <= dur then b end')} as end_sec,
  case when value < 1 then 'missing_bp' when b is null then 'insufficient_timestamps_or_protocol' when not (0 <= a and a < b and b <= dur) then 'cuff_interval_outside_recording_or_invalid'
  when value >= 50 then 'cuff_measurement_interval_only' else 'legacy_event_times_need_video_confirmation' end as reason from m""")
def cuff_reference_align(spark, d):
    b = ck.bounds(trace(spark, d), KEY, FS).select(*KEY, "t0", "t1")
    m = cuff_events(spark, d).join(b, KEY).withColumns({"a": F.col("start_sec") - F.col("t0"), "b": F.col("end_sec") - F.col("t0"), "dur": F.col("t1") - F.col("t0")})
    inside = (F.col("a") >= 0) & (F.col("a") < F.col("b")) & (F.col("b") <= F.col("dur"))
    verified = F.col("value") >= 50
    timed = F.coalesce(verified & inside, F.lit(False))
    alignment = F.when(F.col("value") < 1, "unavailable").when(timed, "timed_cuff_interval").otherwise("session_only")
    reason = F.when(F.col("value") < 1, "missing_bp").when(F.col("b").isNull(), "insufficient_timestamps_or_protocol") \
        .when(~inside, "cuff_interval_outside_recording_or_invalid").when(verified, "cuff_measurement_interval_only") \
        .otherwise("legacy_event_times_need_video_confirmation")
    return m.select("event_id", alignment.alias("alignment"), rnd(F.when(timed, F.col("a"))).alias("start_sec"),
                    rnd(F.when(timed, F.col("b"))).alias("end_sec"), reason.alias("reason"))


@query("exact_identity_match", """with rec as (select s_suppkey as video, lower('VIDEO_' || s_nationkey || '_' || (s_suppkey // 25)) as name, s_nationkey as subj from supplier),
 ses as (select c_custkey as session_id, c_nationkey as subj, lower('video_' || c_nationkey || '_' || (c_custkey // 25)) as name from customer where c_acctbal > 0),
 n as (select video, count(session_id) as c, min(session_id) as session_id from rec left join ses using (name) group by 1),
 sub as (select distinct c_nationkey as subj, true as known from customer where c_acctbal < 9000)
select video, case when c > 1 then 'ambiguous' when c = 1 then 'matched_session' when known then 'subject_only' else 'unmatched' end as match_status, case when c = 1 then session_id end as session_id
from n join rec using (video) left join sub using (subj)""")
def exact_identity_match(spark, d):
    s, c = read(spark, d, "supplier"), read(spark, d, "customer")
    name = F.lower(F.concat_ws("_", F.lit("VIDEO"), F.col("s_nationkey").cast("string"), F.floor(F.col("s_suppkey") / 25).cast("string")))
    rec = s.select(F.col("s_suppkey").alias("video"), F.col("s_nationkey").alias("subj"), name.alias("name"))
    cname = F.lower(F.concat_ws("_", F.lit("video"), F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 25).cast("string")))
    # candidates are counted before the join, so an ambiguous name never multiplies rows
    ses = c.where("c_acctbal > 0").groupBy(cname.alias("name")).agg(F.count("*").alias("c"), F.min("c_custkey").alias("session_id"))
    sub = c.where("c_acctbal < 9000").select(F.col("c_nationkey").alias("subj")).distinct().withColumn("known", F.lit(True))
    m = rec.join(ses, "name", "left").join(sub, "subj", "left")
    status = F.when(F.col("c") > 1, "ambiguous").when(F.col("c") == 1, "matched_session").when(F.col("known"), "subject_only").otherwise("unmatched")
    return m.select("video", status.alias("match_status"), F.when(F.col("c") == 1, F.col("session_id")).alias("session_id"))


@query("metadata_join_exact", """with e as (select regexp_extract(c_name, '(?i)customer[#_ ](\\d+)', 1)::bigint as subject, unnest(['c_mktsegment', 'c_nationkey']) as field, unnest([c_mktsegment, c_nationkey::varchar]) as v from customer),
 w as (select subject, max(case when field = 'c_mktsegment' then v end) as segment, max(case when field = 'c_nationkey' then v end) as nation, count(*) > 2 as duplicated from e group by 1)
select o_custkey as subject, segment, nation, duplicated, count(*) as orders from orders left join w on w.subject = o_custkey group by 1, 2, 3, 4""")
def metadata_join_exact(spark, d):
    allowed = ["c_mktsegment", "c_nationkey"]
    c = read(spark, d, "customer")
    sid = F.regexp_extract("c_name", r"(?i)customer[#_ ](\d+)", 1).cast("long")
    e = c.select(sid.alias("subject"), *[F.col(f).cast("string").alias(f) for f in allowed]).unpivot("subject", allowed, "field", "v")
    w = e.groupBy("subject").agg(F.max(F.when(F.col("field") == "c_mktsegment", F.col("v"))).alias("segment"),
                                 F.max(F.when(F.col("field") == "c_nationkey", F.col("v"))).alias("nation"), (F.count("*") > 2).alias("duplicated"))
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(F.count("*").alias("orders"))
    return o.join(w, "subject", "left").select("subject", "segment", "nation", "duplicated", "orders")


def cells(spark, d, by="method"):
    r = eval_rows(spark, d).withColumn("slot", F.floor(F.col("start_day") / 90))
    return r.groupBy(by, "subject", "slot").agg(F.avg("pred").alias("pred"), F.avg("ref").alias("ref"))


@query("matched_method_pairs", f"""with {EVAL}, c as (select method, subject, start_day // 90 as slot, avg(pred) as pred, avg(ref) as ref from ev group by 1, 2, 3),
 j as (select b.method, b.subject, abs(m.pred - m.ref) as em, abs(b.pred - b.ref) as eb from c m join c b on b.subject = m.subject and b.slot = m.slot and b.method <> m.method
   where m.method = '1-URGENT' and m.pred is not null and m.ref is not null and b.pred is not null and b.ref is not null),
 s as (select method, subject, avg(em - eb) as delta from j group by 1, 2)
select method, count(*) as matched_windows, (select count(*) from s where s.method = j.method) as matched_subjects, {R('avg(em)')} as model_mae, {R('avg(eb)')} as baseline_mae,
  (select {R('avg(delta)')} from s where s.method = j.method) as balanced_difference from j group by 1""")
def matched_method_pairs(spark, d):
    c = cells(spark, d).where("pred is not null and ref is not null").withColumn("e", F.abs(F.col("pred") - F.col("ref")))
    m = c.where("method = '1-URGENT'").select("subject", "slot", F.col("e").alias("em"))
    j = c.where("method <> '1-URGENT'").join(m, ["subject", "slot"])
    s = j.groupBy("method", "subject").agg(F.count("*").alias("w"), F.sum("em").alias("sm"), F.sum("e").alias("sb"), F.avg(F.col("em") - F.col("e")).alias("delta"))
    return s.groupBy("method").agg(F.sum("w").alias("matched_windows"), F.count("*").alias("matched_subjects"),
                                   rnd(F.sum("sm") / F.sum("w")).alias("model_mae"), rnd(F.sum("sb") / F.sum("w")).alias("baseline_mae"),
                                   rnd(F.avg("delta")).alias("balanced_difference"))


@query("paired_condition_delta", f"""with {EVAL}, c as (select status, subject, start_day // 180 as slot, avg(pred) as pred, avg(ref) as ref from ev where status <> 'P' group by 1, 2, 3),
 j as (select a.subject, a.pred - a.ref as ea, b.pred - b.ref as eb from c a join c b on a.subject = b.subject and a.slot = b.slot and a.status = 'F' and b.status = 'O' where a.pred - a.ref is not null and b.pred - b.ref is not null),
 r as (select subject, count(*) as w, avg(abs(ea)) as ma, avg(abs(eb)) as mb, avg(ea * ea) as sa, avg(eb * eb) as sb from j group by 1)
select cast(sum(w) as bigint) as pairs, count(*) as recordings, {R('avg(mb - ma)')} as mae_delta, {R('sqrt(avg(sb)) - sqrt(avg(sa))')} as rmse_delta from r""")
def paired_condition_delta(spark, d):
    r = eval_rows(spark, d).where("status <> 'P'").withColumn("slot", F.floor(F.col("start_day") / 180))
    c = r.groupBy("status", "subject", "slot").agg((F.avg("pred") - F.avg("ref")).alias("e")).where("e is not null")
    # both conditions of a pair meet in one aggregate instead of a self-join
    p = c.groupBy("subject", "slot").agg(F.max(F.when(F.col("status") == "F", F.col("e"))).alias("a"),
                                         F.max(F.when(F.col("status") == "O", F.col("e"))).alias("b")).na.drop()
    s = p.groupBy("subject").agg(F.count("*").alias("w"), F.avg(F.abs("b") - F.abs("a")).alias("dm"),
                                 F.avg(F.col("a") * F.col("a")).alias("sa"), F.avg(F.col("b") * F.col("b")).alias("sb"))
    return s.agg(F.sum("w").alias("pairs"), F.count("*").alias("recordings"), rnd(F.avg("dm")).alias("mae_delta"),
                 rnd(F.sqrt(F.avg("sb")) - F.sqrt(F.avg("sa"))).alias("rmse_delta"))


METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("intent_left_join", f"""with {EVAL}, c as (select method, subject, start_day // 365 as slot, avg(pred) as pred, count(*) as n, cast(count_if(status = 'O') as bigint) as o from ev group by 1, 2, 3),
 it as (select distinct subject, slot from c where o > 0), mm as (select unnest({METHODS}) as method),
 x as (select it.subject, it.slot, mm.method, c.pred, c.n from it join mm on true left join c on c.subject = it.subject and c.slot = it.slot and c.method = mm.method)
select subject, slot, method, case when n is null then 'missing_prediction' when pred is null then 'invalid' else 'valid' end as status, {R('pred')} as hr_bpm from x
union all select c.subject, c.slot, c.method, 'orphan_prediction', {R('c.pred')} from c left join it on it.subject = c.subject and it.slot = c.slot where it.subject is null""")
def intent_left_join(spark, d):
    r = eval_rows(spark, d).withColumn("slot", F.floor(F.col("start_day") / 365))
    c = r.groupBy("method", "subject", "slot").agg(F.avg("pred").alias("pred"), F.count("*").alias("n"))
    it = r.where("status = 'O'").select("subject", "slot").distinct()
    full = it.select("subject", "slot", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))
    x = full.join(c, ["subject", "slot", "method"], "left")
    status = F.when(F.col("n").isNull(), "missing_prediction").when(F.col("pred").isNull(), "invalid").otherwise("valid")
    orphan = c.join(it, ["subject", "slot"], "left_anti").withColumn("status", F.lit("orphan_prediction"))
    cols = ["subject", "slot", "method", "status", rnd("pred").alias("hr_bpm")]
    return x.withColumn("status", status).select(*cols).unionByName(orphan.select(*cols))


@query("nearest_window_match", f"""with {TRACE}, p as (select * from trace where event_type = 'click'), r as (select recording, t, min(event_id) as ref_id from trace where event_type = 'view' group by 1, 2),
 n as (select p.event_id, p.t, b.t as bt, b.ref_id as bid, a.t as aft, a.ref_id as aid from p asof left join r b on p.recording = b.recording and p.t > b.t asof left join r a on p.recording = a.recording and p.t <= a.t),
 k as (select event_id, t, case when bt is null then aid when aft is null then bid when t - bt <= aft - t then bid else aid end as ref_id, case when bt is null then aft - t when aft is null then t - bt else least(t - bt, aft - t) end as dist from n)
select event_id, case when dist <= 21600 then ref_id end as ref_id, {R('case when dist <= 21600 then dist end')} as distance_sec from k""")
def nearest_window_match(spark, d):
    s = trace(spark, d)
    p = s.where("event_type = 'click'").select(*KEY, "event_id", "t")
    r = s.where("event_type = 'view'").groupBy(*KEY, "t").agg(F.min("event_id").alias("ref_id"))
    n = ac.nearest(p, r, KEY, ["ref_id"], 21600.0, span(spark, d))
    return n.select("event_id", F.col("match.ref_id").alias("ref_id"), rnd(F.abs(F.col("match.t") - F.col("t"))).alias("distance_sec"))


@query("site_pair_signal_join", f"""with {COLOUR}, s as (select recording, i // 16 as k, flag, avg(g) as v from colour group by 1, 2, 3),
 j as (select a.recording, a.flag as face, b.flag as hand, a.v as x, b.v as y from s a join s b on a.recording = b.recording and a.k = b.k where (a.flag, b.flag) in (('A', 'R'), ('N', 'R'), ('A', 'N')))
select recording, face, hand, count(*) as joint_samples, {R('corr(x, y)')} as corr from j group by 1, 2, 3""")
def site_pair_signal_join(spark, d):
    s = colour_samples(spark, d).groupBy("recording", F.floor(F.col("i") / 16).alias("k"))
    w = s.agg(*[F.avg(F.when(F.col("flag") == f, F.col("g"))).alias(f"roi_{f}") for f in ("A", "N", "R")])
    pairs = F.array(*[F.struct(F.lit(a).alias("face"), F.lit(b).alias("hand"), F.col(f"roi_{a}").alias("x"), F.col(f"roi_{b}").alias("y"))
                      for a, b in (("A", "R"), ("N", "R"), ("A", "N"))])
    j = w.select("recording", F.inline(pairs)).where("x is not null and y is not null")
    return j.groupBy("recording", "face", "hand").agg(F.count("*").alias("joint_samples"), rnd(safe_corr("x", "y")).alias("corr"))


def snapshots(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    new = c.where("c_acctbal >= 0").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "HOUSEHOLD", "HOME").otherwise(F.col("c_mktsegment")))
    return c.drop("c_acctbal"), new.drop("c_acctbal").withColumn("c_phone", F.when(F.col("c_nationkey") < 5, F.lit("unknown")))


@query("metadata_diff", """with o as (select c_custkey, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) as field, unnest([c_name, c_nationkey::varchar, c_mktsegment]) as v from customer),
 n as (select c_custkey, unnest(['c_name', 'c_nationkey', 'c_mktsegment', 'c_phone']) as field, unnest([c_name, c_nationkey::varchar, case when c_mktsegment = 'HOUSEHOLD' then 'HOME' else c_mktsegment end, case when c_nationkey < 5 then 'unknown' end]) as v from customer where c_acctbal >= 0)
select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(o.field, n.field) as field, o.v as old, n.v as new from o full join n on o.c_custkey = n.c_custkey and o.field = n.field where o.v is distinct from n.v""")
def metadata_diff(spark, d):
    return ac.cell_diff(*snapshots(spark, d), "c_custkey").select("c_custkey", "field", "old", "new")


@query("symmetric_header_diff", "select field, side from (values ('c_acctbal', 'old'), ('c_phone', 'new')) t(field, side) where (select count(*) from customer) > 0")
def symmetric_header_diff(spark, d):
    # header sets come from the rows' own key sets, so columns found in data (not in code) are compared
    old = read(spark, d, "customer")
    new = snapshots(spark, d)[1]

    def headers(df):
        return df.select(F.explode(F.map_keys(F.from_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), "map<string,string>"))).alias("field")).distinct()

    a, b = headers(old), headers(new)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


@query("duplicate_owner_check", """with h as (select sha256(text) as digest, source from documents)
select digest, count(*) as copies, count(distinct source) as owners from h group by 1 having count(*) > 1""")
def duplicate_owner_check(spark, d):
    h = read(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "source").groupBy("digest", "source").agg(F.count("*").alias("n"))
    return h.groupBy("digest").agg(F.sum("n").alias("copies"), F.count("*").alias("owners")).where("copies > 1")


@query("partition_overlap_check", f"""with {TRACE}, iv as (select recording, event_id, t as start_sec, t + x * 600 as end_sec, case when event_type in ('view', 'click') then 'train' when event_type = 'signup' then 'validation' else 'test' end as part from trace)
select a.recording, a.event_id from iv a where exists (select 1 from iv b where b.recording = a.recording and b.part <> a.part and b.end_sec > a.start_sec and (b.start_sec, b.end_sec, b.event_id) < (a.start_sec, a.end_sec, a.event_id))""")
def partition_overlap_check(spark, d):
    part = F.when(F.col("event_type").isin("view", "click"), "train").when(F.col("event_type") == "signup", "validation").otherwise("test")
    iv = trace(spark, d).select(*KEY, "event_id", F.col("t").alias("start_sec"), (F.col("t") + F.col("x") * 600).alias("end_sec"), part.alias("part"))
    return ac.running_overlap(iv, KEY, "part", span(spark, d)).where("overlaps").select(*KEY, "event_id")


@query("subject_leak_antijoin", """select o_custkey as subject, count(distinct o_orderstatus) as partitions, string_agg(distinct o_orderstatus, '|' order by o_orderstatus) as found_in from orders group by 1 having count(distinct o_orderstatus) > 1""")
def subject_leak_antijoin(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("subject"), "o_orderstatus").distinct()
    g = o.groupBy("subject").agg(F.count("*").alias("partitions"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("found_in"))
    return g.where("partitions > 1")


@query("cross_recording_consistency", """with x as (select distinct l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice from lineitem)
select l_orderkey, l_linenumber, count(*) as versions from x group by 1, 2 having count(*) > 1""")
def cross_recording_consistency(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").distinct()
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("versions")).where("versions > 1")


@query("unique_keys", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def unique_keys(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).where("copies > 1")


# ---- validation and metadata -------------------------------------------------

@query("cuff_validity", f"""with {CUFF}, v as (select event_id, value + 40 as sbp, case when value >= 20 then 60 else 200 end as dbp, start_sec, end_sec from cuff)
select event_id, concat_ws('|', case when not (0 < dbp and dbp < sbp) then 'invalid_bp_order' end, case when end_sec is null then 'missing_end' end, case when sbp > 250 then 'implausible_reading' end) as reasons,
  0 < dbp and dbp < sbp and end_sec is not null and sbp <= 250 as valid from v""")
def cuff_validity(spark, d):
    v = cuff_events(spark, d).withColumns({"sbp": F.col("value") + 40, "dbp": F.when(F.col("value") >= 20, 60).otherwise(200)})
    order = (F.col("dbp") > 0) & (F.col("dbp") < F.col("sbp"))
    why = reasons(("invalid_bp_order", ~order), ("missing_end", F.col("end_sec").isNull()), ("implausible_reading", F.col("sbp") > 250))
    return v.withColumn("why", why).select("event_id", joined("why").alias("reasons"), (F.size("why") == 0).alias("valid"))


@query("cuff_event_order_check", f"""with {CUFF}, o as (select *, lag(start_sec) over w as ps, lag(end_sec) over w as pe from cuff window w as (partition by recording order by event_id))
select event_id, case when start_sec is null or end_sec is null then 'missing_endpoint' when start_sec >= end_sec then 'invalid_order' when start_sec <= ps then 'nonmonotone_start' when start_sec < pe then 'overlapping'
  when value >= 50 then 'video_reviewed' else 'unverified_legacy_bounds' end as timing_flag, value >= 50 and end_sec is not null as timing_verified from o""")
def cuff_event_order_check(spark, d):
    e = cuff_events(spark, d).withColumn("block", F.floor(F.col("event_id") / 8192))
    e = with_prev(e, KEY, "block", ["event_id"], F.struct("start_sec", "end_sec"), "p")
    flag = F.when(F.col("start_sec").isNull() | F.col("end_sec").isNull(), "missing_endpoint").when(F.col("start_sec") >= F.col("end_sec"), "invalid_order") \
        .when(F.col("start_sec") <= F.col("p.start_sec"), "nonmonotone_start").when(F.col("start_sec") < F.col("p.end_sec"), "overlapping") \
        .when(F.col("value") >= 50, "video_reviewed").otherwise("unverified_legacy_bounds")
    return e.select("event_id", flag.alias("timing_flag"), ((F.col("value") >= 50) & F.col("end_sec").isNotNull()).alias("timing_verified"))


@query("strict_timestamp", r"""with t as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' when 2 then strftime(ts, '%d.%m.%Y %H:%M:%S') else strftime(ts, '%Y-%m-%d %H:%M:%S') end as raw, ts from events)
select event_id, raw, case event_id % 4 when 0 then epoch(date_trunc('second', ts))::bigint when 1 then epoch(date_trunc('second', ts))::bigint - 7200 when 2 then epoch(date_trunc('second', ts))::bigint + 3600 end as utc_seconds,
  case when event_id % 4 = 3 then 'unknown_format_or_missing_offset' else '' end as reason from t""")
def strict_timestamp(spark, d):
    e = read(spark, d, "events")
    form = lambda p: F.date_format("ts", p)
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))) \
        .when(F.col("event_id") % 4 == 1, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))) \
        .when(F.col("event_id") % 4 == 2, form("dd.MM.yyyy HH:mm:ss")).otherwise(form("yyyy-MM-dd HH:mm:ss"))
    e = e.select("event_id", raw.alias("raw"))
    return e.select("event_id", "raw", utc_seconds(F.col("raw"), offset_minutes=-60).alias("utc_seconds"),
                    F.when(utc_seconds(F.col("raw"), offset_minutes=-60).isNull(), "unknown_format_or_missing_offset").otherwise("").alias("reason"))


def utc_seconds(raw, offset_minutes):
    """UTC seconds of ISO text with an explicit offset, or of the named day-first format plus a given offset; never a guess."""
    iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$")
    named = raw.rlike(r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$")
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def wall(text, fmt):
        return F.timestamp_diff("SECOND", origin, F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))

    zone = F.regexp_extract(raw, r"([+-])(\d{2}):(\d{2})$", 2).try_cast("int") * 60 + F.regexp_extract(raw, r"([+-])(\d{2}):(\d{2})$", 3).try_cast("int")
    sign = F.when(F.regexp_extract(raw, r"([+-])\d{2}:\d{2}$", 1) == "-", -1).otherwise(1)
    shift = F.coalesce(zone * sign, F.lit(0)) * 60
    return F.when(iso, wall(F.substring(raw, 1, 19), "yyyy-MM-dd'T'HH:mm:ss") - shift) \
        .when(named, wall(raw, "dd.MM.yyyy HH:mm:ss") - offset_minutes * 60)


@query("normalize_metadata", """with m as (select p_partkey as row_id, unnest(['height_cm', 'weight_kg', 'label']) as field, unnest([case when p_size % 10 = 0 then 'NA' else p_size::varchar end, case when p_size % 9 = 0 then '-1' when p_size % 11 = 0 then 'n.k.' else p_retailprice::varchar end, '  ' || p_brand || ' ']) as raw from part),
 n as (select row_id, field, raw, case when trim(raw) in ('', 'NA', 'N/A', 'null') then null when field in ('height_cm', 'weight_kg') then try_cast(raw as double) * case when field = 'height_cm' then 2.54e0 else 1 end end as num,
   case when field = 'label' and trim(raw) not in ('', 'NA', 'N/A', 'null') then trim(raw) end as txt from m),
 k as (select row_id, max(case when field = 'height_cm' and num > 0 then num end) as height_cm, max(case when field = 'weight_kg' and num > 0 then num end) as weight_kg, max(txt) as label,
   cast(count_if(field <> 'label' and trim(raw) not in ('', 'NA', 'N/A', 'null') and (num is null or num <= 0)) as bigint) as issues from n group by 1)
select row_id, round(height_cm, 6) + 0.0 as height_cm, round(weight_kg, 6) + 0.0 as weight_kg, label, issues from k""")
def normalize_metadata(spark, d):
    wide = read(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.when(F.col("p_size") % 10 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("Height (in)"),
        F.when(F.col("p_size") % 9 == 0, "-1").when(F.col("p_size") % 11 == 0, "n.k.").otherwise(F.col("p_retailprice").cast("string")).alias("Weight"),
        F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")).alias("Label"))
    mapping = {"Height (in)": ("height_cm", True, 2.54), "Weight": ("weight_kg", True, 1.0), "Label": ("label", False, 1.0)}
    n, _ = normalized_fields(wide, "row_id", mapping)
    return n.select("row_id", rnd("height_cm").alias("height_cm"), rnd("weight_kg").alias("weight_kg"), "label", "issues")


def normalized_fields(wide, row_id, mapping):
    """Apply an explicit column mapping; returns the normalized rows and the list of issues.

    ``mapping``: source column -> (canonical field, numeric, scale). Unmapped columns are ignored, never guessed.
    """
    long = wide.unpivot(row_id, list(mapping), "source", "raw")
    field, scale = F.lit(None).cast("string"), F.lit(None).cast("double")
    for c, (f, _, k) in mapping.items():
        field = F.when(F.col("source") == c, F.lit(f)).otherwise(field)
        scale = F.when(F.col("source") == c, F.lit(float(k))).otherwise(scale)
    numeric = F.col("source").isin([c for c, (_, num, _) in mapping.items() if num])
    long = long.withColumns({"field": field, "scale": scale, "numeric": numeric})
    blank = F.col("raw").isNull() | F.trim("raw").isin("", "NA", "N/A", "null")
    number = F.col("raw").try_cast("double") * F.col("scale")
    bad = ~blank & F.col("numeric") & (number.isNull() | F.isnan(number) | (number <= 0))
    long = long.withColumns({"num": F.when(~blank & F.col("numeric") & ~bad, number), "txt": F.when(~blank & ~F.col("numeric"), F.trim("raw")), "bad": F.coalesce(bad, F.lit(False))})
    picks = [F.max(F.when(F.col("field") == f, F.col("num" if num else "txt"))).alias(f) for f, num, _ in mapping.values()]
    out = long.groupBy(row_id).agg(*picks, F.count_if("bad").alias("issues"))
    issues = long.where("bad").select(row_id, "field", "raw", F.lit("invalid_value").alias("reason"))
    return out, issues


@query("wide_measurements_to_rows", """select p_partkey as session_id, unnest([1, 2, 3]) as measurement_index, unnest([p_size::double, p_retailprice, (p_partkey % 50)::double]) as sbp_mmhg, p_brand as device from part""")
def wide_measurements_to_rows(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("session_id"), F.col("p_brand").alias("device"), F.col("p_size").cast("double").alias("SBP1"),
                                      F.col("p_retailprice").alias("SBP2"), (F.col("p_partkey") % 50).cast("double").alias("SBP3"))
    long = p.unpivot(["session_id", "device"], ["SBP1", "SBP2", "SBP3"], "name", "sbp_mmhg")
    return long.select("session_id", F.substring("name", 4, 1).cast("int").alias("measurement_index"), "sbp_mmhg", "device")


@query("illumination_bins", """with v as (select p_partkey, case when p_size % 13 = 0 then 'dim' else (p_size * 30)::varchar || ' - ' || (p_size * 30 + 100)::varchar end as raw, p_size * 30 + 50 as mid, p_size % 13 = 0 as bad from part)
select p_partkey, raw, case when not bad then mid::double end as lux, case when bad then null when mid < 800 then '<800 lux' when mid < 1100 then '800-<1100 lux' else '>=1100 lux' end as illumination_group from v""")
def illumination_bins(spark, d):
    size = F.col("p_size")
    raw = F.when(size % 13 == 0, "dim").otherwise(F.concat((size * 30).cast("string"), F.lit(" - "), (size * 30 + 100).cast("string")))
    p = read(spark, d, "part").select("p_partkey", raw.alias("raw"))
    ends = F.transform(F.split("raw", "-"), lambda s: F.trim(s).try_cast("double"))
    total = F.aggregate(ends, F.lit(0.0), lambda a, v: a + v)     # one unreadable end makes the whole reading missing
    p = p.withColumn("lux", total / F.size(ends))
    group = F.when(F.col("lux") < 800, "<800 lux").when(F.col("lux") < 1100, "800-<1100 lux").when(F.col("lux") >= 1100, ">=1100 lux")
    return p.select("p_partkey", "raw", "lux", group.alias("illumination_group"))


@query("natural_id_normalize", """with v as (select c_custkey, case c_custkey % 3 when 0 then 'Subject_' || (c_custkey % 40) when 1 then 'subject ' || (c_custkey % 40) else c_name end as raw, c_custkey % 40 as n, c_custkey % 3 as k from customer)
select c_custkey, raw, case when k < 2 and n between 1 and 27 then 'Subject_' || n end as subject_id from v""")
def natural_id_normalize(spark, d):
    k = F.col("c_custkey") % 3
    num = (F.col("c_custkey") % 40).cast("string")
    raw = F.when(k == 0, F.concat(F.lit("Subject_"), num)).when(k == 1, F.concat(F.lit("subject "), num)).otherwise(F.col("c_name"))
    c = read(spark, d, "customer").select("c_custkey", raw.alias("raw"))
    n = F.regexp_extract("raw", r"(?i)^subject[_ ](\d+)$", 1).try_cast("int")
    return c.select("c_custkey", "raw", F.when(n.between(1, 27), F.concat(F.lit("Subject_"), n.cast("string"))).alias("subject_id"))


@query("content_sha", """with d as (select doc_id, sha256(text) as digest from documents), c as (select conv_id, turn // 256 as b, sha256(string_agg(length(role) || ':' || role || ':' || sha256(text), chr(10) order by turn)) as x, count(*) as n from conversations group by 1, 2),
 c2 as (select conv_id, b // 256 as b, case when max(max(b)) over (partition by conv_id) = 0 then any_value(x) else sha256(string_agg(x, chr(10) order by b)) end as x, sum(n) as n from c group by conv_id, c.b // 256),
 c3 as (select conv_id, case when max(b) = 0 then any_value(x) else sha256(string_agg(x, chr(10) order by b)) end as x, sum(n)::bigint as n from c2 group by 1)
select 'document' as kind, doc_id as id, digest, 1 as items from d union all select 'sequence', conv_id, x, n from c3""")
def content_sha(spark, d):
    one = read(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), F.lit(1).cast("long").alias("items"))
    item = F.concat_ws(":", F.length("role").cast("string"), "role", F.sha2("text", 256))
    seq = ac.digest_sequence(read(spark, d, "conversations"), ["conv_id"], "turn", item)
    return one.unionByName(seq.select(F.lit("sequence").alias("kind"), F.col("conv_id").alias("id"), "digest", "items"))
