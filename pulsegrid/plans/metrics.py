"""Evaluation statistics over prediction/reference rows."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from pulsegrid.functions.cols import finite, joined, reasons, rnd, safe_corr
from pulsegrid.operators import metrics as mt, resampling as rs
from pulsegrid.operators.carry import exact_quantiles, halo, with_index, with_rank
from pulsegrid.plans.registry import EVAL, R, query
from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import eval_rows, read, steady_avg

EV = EVAL + """, er as (select *, case when pred is not null and ref is not null then pred - ref end as err,
  case when pred is not null and ref is not null then abs(pred - ref) end as abs_err, status <> 'P' as extraction_ok from ev)"""


def rows(spark, d):
    return mt.with_error(eval_rows(spark, d)).withColumn("extraction_ok", F.col("status") != "P")


def rounded(df, keep, cols):
    return df.select(*keep, *[rnd(c).alias(c) for c in cols])


REG = ("mae", "rmse", "me", "sd", "pearson")
REG_SQL = f"""{R('avg(abs_err)')} as mae, {R('sqrt(avg(err * err))')} as rmse, {R('avg(err)')} as me,
  {R('case when count(err) = 1 then 0 else stddev_samp(err) end')} as sd,
  {R('case when count(err) > 1 then corr(case when err is not null then ref end, case when err is not null then pred end) end')} as pearson, count(err) as n"""


@query("regression_metrics", f"with {EV} select method, {REG_SQL} from er group by 1")
def regression_metrics(spark, d):
    return rounded(rows(spark, d).groupBy("method").agg(*mt.named(mt.regression_aggs())), ["method", "n"], REG)


@query("bland_altman", f"""with {EV}, a as (select method, avg(err) as bias, case when count(err) = 1 then 0 else stddev_samp(err) end as sd from er group by 1)
select method, {R('bias')} as bias, {R('sd')} as sd, {R('bias - 1.96 * sd')} as loa_low, {R('bias + 1.96 * sd')} as loa_high from a""")
def bland_altman(spark, d):
    a = rows(spark, d).groupBy("method").agg(*mt.named(mt.regression_aggs()))
    half = 1.96 * F.col("sd")
    a = a.withColumns({"bias": F.col("me"), "loa_low": F.col("me") - half, "loa_high": F.col("me") + half})
    return rounded(a, ["method"], ["bias", "sd", "loa_low", "loa_high"])


@query("bland_altman_points", f"""with {EV} select o_orderkey, {R('(pred + ref) / 2')} as mean_value, {R('err')} as difference
from er where err is not null""")
def bland_altman_points(spark, d):
    return rows(spark, d).where("err is not null").select(
        "o_orderkey", rnd((F.col("pred") + F.col("ref")) / 2).alias("mean_value"), rnd("err").alias("difference"))


@query("aami_sanity", f"""with {EV}, a as (select method, count(err) as n, avg(err) as me, stddev_samp(err) as sd from er group by 1)
select method, n, {R('me')} as me, {R('sd')} as sd, abs(me) <= 5 and sd <= 8 as passes_5_8_sanity from a""")
def aami_sanity(spark, d):
    a = rows(spark, d).groupBy("method").agg(*mt.named(mt.regression_aggs()))
    a = a.withColumn("passes_5_8_sanity", (F.abs("me") <= 5) & (F.col("sd") <= 8))
    return rounded(a, ["method", "n", "passes_5_8_sanity"], ["me", "sd"])


@query("stratified_metrics", f"""with {EV}, st as (select 'subject' as label, cast(subject as varchar) as grp, * from er
  union all select 'method', method, * from er union all select 'status', status, * from er)
select label, grp, {REG_SQL} from st group by 1, 2""")
def stratified_metrics(spark, d):
    # grouping sets share one scan and one shuffle over all strata
    r = rows(spark, d)
    r = r.withColumn("subject_label", F.col("subject").cast("string"))
    g = r.groupingSets([["subject_label"], ["method"], ["status"]], "subject_label", "method", "status").agg(
        F.grouping_id().alias("gid"), *mt.named(mt.regression_aggs()))
    label = F.when(F.col("gid") == 3, "subject").when(F.col("gid") == 5, "method").otherwise("status")
    grp = F.when(F.col("gid") == 3, F.col("subject_label")).when(F.col("gid") == 5, F.col("method")).otherwise(F.col("status"))
    return rounded(g.withColumns({"label": label, "grp": grp}), ["label", "grp", "n"], REG)


COV = ("mae", "rmse", "bias", "within_3", "within_5", "finite_prediction_coverage", "prediction_failure_rate", "paired_coverage",
       "median_ae", "p90_ae")
COUNTS = ("windows", "valid_pairs", "valid_labels", "finite_predictions", "missing_labels", "prediction_failures",
          "extraction_failures", "invalid_signal_windows")
COV_COUNTS = """count(*) as windows, count(err) as valid_pairs, count(ref) as valid_labels, count(pred) as finite_predictions,
  count(*) - count(ref) as missing_labels, count(*) - count(pred) as prediction_failures,
  cast(count_if(not extraction_ok) as bigint) as extraction_failures,
  cast(count_if(extraction_ok and pred is null) as bigint) as invalid_signal_windows"""
COV_SQL = f"""{COV_COUNTS}, {R('avg(abs_err)')} as mae,
  {R('sqrt(avg(err * err))')} as rmse, {R('avg(err)')} as bias, {R('avg(case when abs_err <= 3 then 1.0 when abs_err > 3 then 0.0 end)')} as within_3,
  {R('avg(case when abs_err <= 5 then 1.0 when abs_err > 5 then 0.0 end)')} as within_5, {R('count(pred) / count(*)')} as finite_prediction_coverage,
  {R('1 - count(pred) / count(*)')} as prediction_failure_rate, {R('count(err) / count(*)')} as paired_coverage"""


@query("coverage_metrics", f"""with {EV} select method, {COV_SQL}, {R('median(abs_err)')} as median_ae, {R('quantile_cont(abs_err, .9)')} as p90_ae
from er group by 1""")
def coverage_metrics(spark, d):
    return rounded(mt.coverage_metrics(rows(spark, d), ["method"]), ["method", *COUNTS], COV)


@query("subject_balanced_metrics", f"""with {EV}, s as (select method, subject, avg(abs_err) as mae, avg(err) as bias, count(*) as w,
   avg(case when pred is not null then 1.0 else 0 end) as cov from er group by 1, 2)
select method, count(*) as subjects, cast(sum(w) as bigint) as windows, count(mae) as scorable_subjects, {R('avg(mae)')} as balanced_mae,
  {R('avg(bias)')} as balanced_bias, {R('avg(cov)')} as balanced_coverage from s group by 1""")
def subject_balanced_metrics(spark, d):
    r = rows(spark, d).withColumn("cov", F.col("pred").isNotNull().cast("double"))
    b = mt.balanced_means(r, ["method"], "subject", ["abs_err", "err", "cov"])
    return b.select("method", "subjects", "windows", F.col("subjects_abs_err").alias("scorable_subjects"),
                    rnd("balanced_abs_err").alias("balanced_mae"), rnd("balanced_err").alias("balanced_bias"),
                    rnd("balanced_cov").alias("balanced_coverage"))


@query("recording_balanced_rmse", f"""with {EV}, s as (select method, subject, avg(abs_err) as mae, avg(err * err) as mse from er group by 1, 2)
select method, {R('avg(mae)')} as mae, {R('sqrt(avg(mse))')} as rmse, count(mse) as recordings from s group by 1""")
def recording_balanced_rmse(spark, d):
    r = rows(spark, d).withColumn("sq", F.col("err") * F.col("err"))
    b = mt.balanced_means(r, ["method"], "subject", ["abs_err", "sq"])
    return b.select("method", rnd("balanced_abs_err").alias("mae"), rnd(F.sqrt("balanced_sq")).alias("rmse"),
                    F.col("subjects_sq").alias("recordings"))


def failure_reason():
    return F.when(~F.col("extraction_ok"), "extraction_failed").when(F.col("pred").isNull(), "nonfinite_prediction") \
        .when(F.col("ref").isNull(), "missing_reference").otherwise("ok")


FAIL_SQL = """case when not extraction_ok then 'extraction_failed' when pred is null then 'nonfinite_prediction'
  when ref is null then 'missing_reference' else 'ok' end"""


@query("group_summary_failures", f"""with {EV}, f as (select *, {FAIL_SQL} as reason from er),
 c as (select method, reason, count(*) as n from f group by 1, 2)
select method, cast(sum(n) as bigint) as intended, cast(sum(case when reason in ('ok', 'missing_reference') then n else 0 end) as bigint) as computed,
  cast(sum(case when reason = 'ok' then n else 0 end) as bigint) as eligible,
  string_agg(reason || '=' || n, '|' order by reason) filter (reason <> 'ok') as failures from c group by 1""")
def group_summary_failures(spark, d):
    c = rows(spark, d).withColumn("reason", failure_reason()).groupBy("method", "reason").agg(F.count("*").alias("n"))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("reason") != "ok", F.struct("reason", "n")))),
                       lambda s: F.concat_ws("=", s["reason"], s["n"].cast("string")))
    return c.groupBy("method").agg(
        F.sum("n").alias("intended"),
        F.sum(F.when(F.col("reason").isin("ok", "missing_reference"), F.col("n")).otherwise(0)).alias("computed"),
        F.sum(F.when(F.col("reason") == "ok", F.col("n")).otherwise(0)).alias("eligible"),
        F.array_join(text, "|").alias("failures"))


@query("coverage_by_method", f"""with {EV}, f as (select method, {FAIL_SQL} as reason from er)
select method, count(*) as intended, cast(count_if(reason = 'ok') as bigint) as ok, cast(count_if(reason = 'extraction_failed') as bigint) as extraction_failed,
  cast(count_if(reason = 'nonfinite_prediction') as bigint) as nonfinite_prediction, cast(count_if(reason = 'missing_reference') as bigint) as missing_reference
from f group by 1""")
def coverage_by_method(spark, d):
    kinds = ["ok", "extraction_failed", "nonfinite_prediction", "missing_reference"]
    c = rows(spark, d).withColumn("reason", failure_reason())
    p = c.groupBy("method").pivot("reason", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)
    return p.select("method", sum(F.col(k) for k in kinds).alias("intended"), *kinds)


SUBJECTS = f"""st as (select method, subject, count(*) as w, count(err) as n, sum(abs_err) as sae, sum(err * err) as sse, sum(err) as se,
   avg(abs_err) as mae, median(abs_err) as med, quantile_cont(abs_err, .9) as p90 from er group by 1, 2),
 dr as (select subject, draw, {rs.counts_sql('subject')} as t from (select distinct subject from er), lateral (select unnest(range(0, {rs.DRAWS})) as draw) b),
 hit as (select draw, t, st.* from dr join st using (subject) where t > 0),
 bt as (select method, draw, sum(mae * t) / sum(case when mae is not null then t end) as bal_mae, sum(med * t) / sum(case when med is not null then t end) as bal_median,
   sum(p90 * t) / sum(case when p90 is not null then t end) as bal_p90, sum(sae * t) / sum(n * t) as win_mae, sqrt(sum(sse * t) / sum(n * t)) as win_rmse, sum(se * t) / sum(n * t) as win_bias,
   sum(n * t) / sum(w * t) as win_cov from hit group by 1, 2),
 pq as (select method, draw, quantile_cont(abs_err, .5) as win_median, quantile_cont(abs_err, .9) as win_p90 from (select method, draw, abs_err, unnest(range(0, t)) from er join dr using (subject) where t > 0 and abs_err is not null) group by 1, 2)"""
BOOT = ("bal_mae", "bal_median", "bal_p90", "win_mae", "win_rmse", "win_bias", "win_cov", "win_median", "win_p90")
#: What a subject contributes, in order of its numbers in ``weighted_sums``.
PARTS = ("w", "n", "sae", "sse", "se", "mae", "med", "p90")


def subject_stats(r):
    sums = r.groupBy("method", "subject").agg(
        F.count("*").alias("w"), F.count("err").alias("n"), F.sum("abs_err").alias("sae"),
        F.sum(F.col("err") * F.col("err")).alias("sse"), F.sum("err").alias("se"), F.avg("abs_err").alias("mae"))
    return sums.join(exact_quantiles(r, ["method", "subject"], "abs_err", {"med": .5, "p90": .9}), ["method", "subject"], "left")


@query("subject_bootstrap_ci", f"""with {EV}, {SUBJECTS}
select method, count(*) as draws, {', '.join(f"{R(f'quantile_cont({c}, .025)')} as {c}_lo, {R(f'quantile_cont({c}, .975)')} as {c}_hi" for c in BOOT)} from bt left join pq using (method, draw) group by 1""")
def subject_bootstrap_ci(spark, d):
    r = checkpointed(rows(spark, d).select("method", "subject", "err", "abs_err"))
    stats = subject_stats(r)
    cells = [F.struct(F.lit(i).cast("long").alias("k"), F.col(c).cast("double").alias("v")) for i, c in enumerate(PARTS)]
    known = [F.struct(F.lit(len(PARTS) + i).cast("long").alias("k"), F.when(c, 1.0).alias("v")) for i, c in enumerate([F.lit(True), *[F.col(x).isNotNull() for x in ("mae", "med", "p90")]])]
    cells = stats.select(F.col("subject").cast("string").alias("subject"), F.col("method").alias("key"), F.inline(F.array(*cells, *known)))

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Intervals of every statistic of a method, from its sums per draw."""
        s = dict(zip(pdf["k"], map(np.asarray, pdf["sums"])))
        zero = np.zeros(rs.DRAWS)
        s = [s.get(k, zero) for k in range(len(PARTS) + 4)]
        taken = s[len(PARTS)] > 0
        with np.errstate(all="ignore"):
            w, n, sae, sse, se, mae, med, p90, _, has_mae, has_med, has_p90 = s
            per_draw = dict(zip(BOOT, (mae / has_mae, med / has_med, p90 / has_p90, sae / n, np.sqrt(sse / n), se / n, n / w)))
        cells = {f"{c}_{e}": [x] for c, v in per_draw.items() for e, x in zip(("lo", "hi"), rs.interval(np.where(taken, v, np.nan)))}
        return pd.DataFrame({"method": [key[0]], "draws": [int(taken.sum())], **cells})

    ends = [f"{c}_{e}" for c in BOOT[:-2] for e in ("lo", "hi")]
    out = rs.weighted_sums(cells).groupBy("key").applyInPandas(summary, "method string, draws long, " + ", ".join(f"{c} double" for c in ends))
    pooled = rs.pooled_quantiles(r.select("subject", F.col("method").alias("key"), F.col("abs_err").alias("x")), {"win_median": .5, "win_p90": .9})
    over = F.filter("per_draw", lambda v: v.isNotNull())
    long = pooled.select(F.col("key").alias("method"), "name", F.explode(over).alias("v"))
    wide = long.groupBy("method").agg(*[F.percentile(F.when(F.col("name") == c, F.col("v")), F.lit(q)).alias(f"{c}_{e}") for c in BOOT[-2:] for q, e in ((.025, "lo"), (.975, "hi"))])
    return rounded(out.join(wide, "method", "left"), ["method", "draws"], [f"{c}_{e}" for c in BOOT for e in ("lo", "hi")])


@query("subgroup_bootstrap", f"""with {EV}, s as (select c_mktsegment as grp, subject, avg(abs_err) as mae from er join customer on c_custkey = subject group by 1, 2),
 dr as (select grp, mae, draw, {rs.counts_sql('subject')} as t from s, lateral (select unnest(range(0, {rs.DRAWS})) as draw) b where mae is not null),
 m as (select grp, draw, sum(mae * t) / sum(t) as mm from dr group by 1, 2 having sum(t) > 0),
 ci as (select grp, quantile_cont(mm, .025) as lo, quantile_cont(mm, .975) as hi from m group by 1)
select s.grp, count(*) as subjects, count(mae) as scorable, {R('avg(mae)')} as mean_subject_mae, {R('any_value(lo)')} as lower_95, {R('any_value(hi)')} as upper_95,
  count(mae) >= 3 as ci_supported from s left join ci using (grp) group by 1""")
def subgroup_bootstrap(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"))
    per = checkpointed(rows(spark, d).groupBy("subject").agg(F.avg("abs_err").alias("mae")).join(c, "subject"))     # one row per subject
    cells = F.inline(F.array(F.struct(F.lit(0).cast("long").alias("k"), F.col("mae").alias("v")), F.struct(F.lit(1).cast("long").alias("k"), F.lit(1.0).alias("v"))))
    sums = rs.weighted_sums(per.where("mae is not null").select(F.col("subject").cast("string").alias("subject"), F.col("grp").alias("key"), cells))
    both = sums.groupBy("key").pivot("k", [0, 1]).agg(F.first("sums")).select(F.col("key").alias("grp"), F.explode(F.zip_with("0", "1", lambda a, b: F.when(b > 0, a / b))).alias("mm"))
    ci = both.groupBy("grp").agg(F.percentile("mm", F.lit(.025)).alias("lo"), F.percentile("mm", F.lit(.975)).alias("hi"))
    out = per.groupBy("grp").agg(F.count("*").alias("subjects"), F.count("mae").alias("scorable"), F.avg("mae").alias("m"))
    out = out.join(ci, "grp", "left")
    shown = F.col("scorable") >= 3
    return out.select("grp", "subjects", "scorable", rnd("m").alias("mean_subject_mae"), F.when(shown, rnd("lo")).alias("lower_95"),
                      F.when(shown, rnd("hi")).alias("upper_95"), shown.alias("ci_supported"))


@query("temporal_metrics", f"""with {EV}, m as (select *, start_day // 365 as yr from er),
 s as (select method, yr, subject, avg(abs_err) as mae from m group by 1, 2, 3),
 b as (select method, yr, avg(mae) as bal, count(mae) as scorable from s group by 1, 2),
 p as (select method, yr, {COV_SQL}, {R('median(abs_err)')} as median_ae, {R('quantile_cont(abs_err, .9)')} as p90_ae from m group by 1, 2)
select p.*, {R('bal')} as subject_balanced_mae, scorable as scorable_subjects from p join b using (method, yr)""")
def temporal_metrics(spark, d):
    r = rows(spark, d).withColumn("yr", F.floor(F.col("start_day") / 365))
    pooled = mt.coverage_metrics(r, ["method", "yr"])
    bal = mt.balanced_means(r, ["method", "yr"], "subject", ["abs_err"])
    bal = bal.select("method", "yr", F.col("balanced_abs_err").alias("subject_balanced_mae"),
                     F.col("subjects_abs_err").alias("scorable_subjects"))
    return rounded(pooled.join(bal, ["method", "yr"]), ["method", "yr", "scorable_subjects", *COUNTS], (*COV, "subject_balanced_mae"))


@query("subject_distribution", f"""with {EV}, s as (select method, subject, avg(abs_err) as mae from er group by 1, 2)
select method, count(*) as subjects, count(mae) as finite_subjects, {R('median(mae)')} as median, {R('quantile_cont(mae, .25)')} as q1,
  {R('quantile_cont(mae, .75)')} as q3, {R('quantile_cont(mae, .75) - quantile_cont(mae, .25)')} as iqr, {R('min(mae)')} as lowest, {R('max(mae)')} as highest from s group by 1""")
def subject_distribution(spark, d):
    s = rows(spark, d).groupBy("method", "subject").agg(F.avg("abs_err").alias("mae"))
    base = s.groupBy("method").agg(F.count("*").alias("subjects"), F.count("mae").alias("finite_subjects"),
                                   F.min("mae").alias("lowest"), F.max("mae").alias("highest"))
    q = exact_quantiles(s, ["method"], "mae", {"q1": .25, "median": .5, "q3": .75})
    out = base.join(q, "method", "left").withColumn("iqr", F.col("q3") - F.col("q1"))
    return rounded(out, ["method", "subjects", "finite_subjects"], ["median", "q1", "q3", "iqr", "lowest", "highest"])


@query("descriptive_stats", f"""with m as (select event_type, median("value") as med, count("value") as n, avg("value") as mu, stddev_samp("value") as sd, min("value") as lo from events group by 1)
select event_type, n, {R('any_value(med)')} as median, {R('median(abs("value" - med))')} as mad,
  {R('any_value(case when lo >= 0 and mu > greatest(1e-6, 1e-6 * sd) then sd / mu end)')} as cv from events join m using (event_type) group by 1, 2""")
def descriptive_stats(spark, d):
    e = read(spark, d, "events").select("event_type", "value")
    base = e.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mu"),
                                       F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"))
    med = exact_quantiles(e, ["event_type"], "value", {"median": .5})
    dev = e.join(med, "event_type").withColumn("dev", F.abs(F.col("value") - F.col("median")))
    mad = exact_quantiles(dev, ["event_type"], "dev", {"mad": .5})
    ok = (F.col("lo") >= 0) & (F.col("mu") > F.greatest(F.lit(1e-6), 1e-6 * F.col("sd")))
    out = base.join(med, "event_type").join(mad, "event_type").withColumn("cv", F.when(ok, F.col("sd") / F.col("mu")))
    return rounded(out, ["event_type", "n"], ["median", "mad", "cv"])


@query("within_subject_centered_corr", f"""with {EV}, v as (select *, count(*) over (partition by method, subject) as c from er where err is not null),
 z as (select method, subject, c, ref - avg(ref) over (partition by method, subject) as x, pred - avg(pred) over (partition by method, subject) as y from v),
 a as (select method, count(distinct subject) as rs, count(*) - count(distinct subject) as wdf, corr(x, y) as r from z where c >= 2 group by 1)
select method, count(*) as n_events, count(distinct subject) as n_subjects, any_value(rs) as repeated_subjects, any_value(wdf) as within_df,
  {R('corr(ref, pred)')} as pooled_corr, {R('any_value(case when rs >= 2 and wdf >= 3 then r end)')} as centered_corr from v join a using (method) group by 1""")
def within_subject_centered_corr(spark, d):
    c = mt.centered_corr(rows(spark, d), ["method"], "subject", "ref", "pred")
    return c.select("method", "n_events", "n_subjects", "repeated_subjects", "within_df", rnd("pooled_corr").alias("pooled_corr"),
                    rnd("centered_corr").alias("centered_corr"))


@query("within_subject_range", f"""with {EV} select subject, count(ref) as n_events, {R('max(ref) - min(ref)')} as value_range from er group by 1""")
def within_subject_range(spark, d):
    return rows(spark, d).groupBy("subject").agg(F.count("ref").alias("n_events"), rnd(F.max("ref") - F.min("ref")).alias("value_range"))


@query("loso_mean_baseline", f"""with {EV}, m as (select subject, avg(ref) as mu from er where ref is not null group by 1),
 t as (select subject, (sum(mu) over () - mu) / (count(*) over () - 1) as pred_mean from m)
select er.subject, count(*) as n_events, {R('any_value(pred_mean)')} as baseline, {R('avg(abs(ref - pred_mean))')} as mae from er join t using (subject) where ref is not null group by 1""")
def loso_mean_baseline(spark, d):
    r = rows(spark, d).where("ref is not null").select("subject", "ref")
    m = r.groupBy("subject").agg(F.avg("ref").alias("mu"))
    total = m.agg(F.struct(F.sum("mu").alias("s"), F.count("*").alias("n")).alias("t")).scalar()
    base = m.select("subject", ((total["s"] - F.col("mu")) / (total["n"] - 1)).alias("baseline"))
    return r.join(base, "subject").groupBy("subject").agg(F.count("*").alias("n_events"), rnd(F.first("baseline")).alias("baseline"),
                                                         rnd(F.avg(F.abs(F.col("ref") - F.col("baseline")))).alias("mae"))


@query("session_features", f"""with {EV}, l as (select subject, ref, row_number() over (partition by subject order by start_day desc, o_orderkey desc) as rn from er where ref is not null),
 t as (select subject, avg(ref) as reading, count(*) as readings from l where rn <= 2 group by 1),
 w as (select subject, count(*) as good_windows, median(err) as med, stddev_pop(err) as sc from er where err is not null and status = 'F' group by 1)
select t.subject, {R('reading')} as reading, readings, coalesce(good_windows, 0) as good_windows, {R('med')} as median_delay, {R('sc')} as scatter,
  coalesce(good_windows >= 3 and sc <= 100, false) as delay_usable from t left join w using (subject)""")
def session_features(spark, d):
    r = rows(spark, d)
    # rank <= 2 is cut on the map side (group limit), so a hot subject ships two rows per task
    w = Window.partitionBy("subject").orderBy(F.desc("start_day"), F.desc("o_orderkey"))
    last = r.where("ref is not null").select("subject", "ref", "start_day", "o_orderkey").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    last = last.groupBy("subject").agg(rnd(F.avg("ref")).alias("reading"), F.count("*").alias("readings"))
    good = r.where("err is not null and status = 'F'")
    g = good.groupBy("subject").agg(F.count("*").alias("good_windows"), F.stddev_pop("err").alias("scatter"))
    g = g.join(exact_quantiles(good, ["subject"], "err", {"median_delay": .5}), "subject")
    out = last.join(g, "subject", "left")
    usable = F.coalesce((F.col("good_windows") >= 3) & (F.col("scatter") <= 100), F.lit(False))
    return out.select("subject", "reading", "readings", F.coalesce("good_windows", F.lit(0)).alias("good_windows"),
                      rnd("median_delay").alias("median_delay"), rnd("scatter").alias("scatter"), usable.alias("delay_usable"))


@query("session_eligibility", f"""with {EV}, s as (select subject, count(*) as sessions, cast(count_if(err is not null and status = 'F') as bigint) as good_windows,
  cast(count_if(ref is not null) as bigint) as refs, cast(count_if(status = 'P') as bigint) as excluded from er group by 1)
select *, good_windows >= 3 and refs > 0 and excluded = 0 as eligible, concat_ws('|', case when good_windows < 3 then 'fewer_than_3_good_windows' end,
  case when refs = 0 then 'no_reference' end, case when excluded > 0 then 'excluded_session' end) as reasons from s""")
def session_eligibility(spark, d):
    s = rows(spark, d).groupBy("subject").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("err").isNotNull() & (F.col("status") == "F")).alias("good_windows"),
        F.count("ref").alias("refs"), F.count_if(F.col("status") == "P").alias("excluded"))
    why = reasons(("fewer_than_3_good_windows", F.col("good_windows") < 3), ("no_reference", F.col("refs") == 0),
                  ("excluded_session", F.col("excluded") > 0))
    return s.withColumn("why", why).select("*", (F.size("why") == 0).alias("eligible"), joined("why").alias("reasons")).drop("why")


@query("spearman_association", f"""with {EV}, s as (select method, start_day // 30 as rec, avg(abs_err) as error, avg(pred) as indicator from er group by 1, 2),
 f as (select * from s where error is not null and indicator is not null),
 k as (select method, rank() over (partition by method order by error) + (count(*) over (partition by method, error) - 1) / 2.0 as re,
   rank() over (partition by method order by indicator) + (count(*) over (partition by method, indicator) - 1) / 2.0 as ri from f)
select method, count(*) as recordings, {R('case when count(*) >= 3 then corr(re, ri) end')} as spearman from k group by 1""")
def spearman_association(spark, d):
    r = rows(spark, d).withColumn("rec", F.floor(F.col("start_day") / 30))
    s = r.groupBy("method", "rec").agg(steady_avg("abs_err").alias("error"), steady_avg("pred").alias("indicator")).na.drop(subset=["error", "indicator"])
    s = mt.average_rank(mt.average_rank(s, ["method"], "error", "re"), ["method"], "indicator", "ri")
    return s.groupBy("method").agg(F.count("*").alias("recordings"),
                                   rnd(F.when(F.count("*") >= 3, safe_corr("re", "ri"))).alias("spearman"))


@query("quality_coverage_curve", f"""with {EV}, v as (select method, abs_err, o_orderkey, row_number() over (partition by method order by -pred, o_orderkey) as rn,
   count(*) over (partition by method) as n from er where err is not null),
 c as (select unnest([1.0, 0.8, 0.6, 0.4, 0.2]) as cov)
select method, cast(cov as double) as coverage, count(*) as kept, {R('avg(abs_err)')} as mae, {R('median(abs_err)')} as median_ae from v join c on rn <= greatest(1, round_even(cov::double * n, 0)) group by 1, 2""")
def quality_coverage_curve(spark, d):
    v = rows(spark, d).where("err is not null").select("method", "abs_err", "o_orderkey", "pred")
    v = checkpointed(with_rank(v, ["method"], "pred", "o_orderkey", "rn"))     # read by every coverage level
    n = v.groupBy("method").agg(F.count("*").alias("n"))
    v = v.join(n, "method")
    levels = F.array(*[F.struct(F.lit(c).alias("coverage"), F.greatest(F.lit(1.0), F.bround(F.lit(c) * F.col("n"), 0)).alias("top"))
                       for c in (1.0, .8, .6, .4, .2)])
    kept = F.filter(levels, lambda s: F.col("rn") <= s["top"])
    v = v.select("method", "abs_err", F.explode(kept).alias("lv")).select("method", "abs_err", "lv.coverage")
    base = v.groupBy("method", "coverage").agg(F.count("*").alias("kept"), F.avg("abs_err").alias("mae"))
    q = exact_quantiles(v, ["method", "coverage"], "abs_err", {"median_ae": .5})
    return rounded(base.join(q, ["method", "coverage"]), ["method", "coverage", "kept"], ["mae", "median_ae"])


@query("channel_baselines", f"""with c as (select l_quantity * 2 as ref, l_linenumber, unnest(['QUANTITY', 'PRICE', 'TAX']) as channel,
   unnest([l_quantity + l_linenumber, l_extendedprice / 1000, l_tax * 1000]) as pred from lineitem)
select channel, count(*) as n, {R('avg(abs(pred - ref))')} as mae, {R('sqrt(avg((pred - ref) * (pred - ref)))')} as rmse, {R('avg(pred - ref)')} as me, {R('corr(pred, ref)')} as pearson from c group by 1
union all select 'ORACLE_BEST', count(*), {R('avg(least(abs(l_quantity + l_linenumber - l_quantity * 2), abs(l_extendedprice / 1000 - l_quantity * 2), abs(l_tax * 1000 - l_quantity * 2)))')}, null, null, null from lineitem""")
def channel_baselines(spark, d):
    li = read(spark, d, "lineitem")
    wide = li.select((F.col("l_quantity") * 2).alias("ref"), (F.col("l_quantity") + F.col("l_linenumber")).alias("QUANTITY"),
                     (F.col("l_extendedprice") / 1000).alias("PRICE"), (F.col("l_tax") * 1000).alias("TAX"))
    names = ["QUANTITY", "PRICE", "TAX"]
    long = mt.with_error(wide.unpivot("ref", names, "channel", "pred"))
    per = long.groupBy("channel").agg(*mt.named(mt.regression_aggs()))
    per = per.select("channel", "n", *[rnd(c).alias(c) for c in ("mae", "rmse", "me", "pearson")])
    best = wide.agg(F.count("*").alias("n"), rnd(F.avg(F.least(*[F.abs(F.col(c) - F.col("ref")) for c in names]))).alias("mae"))
    none = F.lit(None).cast("double")
    best = best.select(F.lit("ORACLE_BEST").alias("channel"), "n", "mae", none.alias("rmse"), none.alias("me"), none.alias("pearson"))
    return per.unionByName(best).orderBy("mae")


@query("per_dataset_metrics", f"""with {EV}, c as (select n_name as dataset, er.* from er join customer on c_custkey = subject join nation on n_nationkey = c_nationkey)
select dataset, {REG_SQL} from c group by 1 having count(err) >= 2""")
def per_dataset_metrics(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("subject"), "c_nationkey")
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dataset"))
    # 25 rows: the nation table is a fixed dimension
    j = rows(spark, d).join(c, "subject").join(F.broadcast(n), "c_nationkey")
    return rounded(j.groupBy("dataset").agg(*mt.named(mt.regression_aggs())).where("n >= 2"), ["dataset", "n"], REG)


@query("harmonic_error_flags", f"""with {EV} select o_orderkey, abs_err > 6 and abs(pred - 2 * ref) <= 6 as double_harmonic, abs_err > 6 and abs(pred - ref / 2) <= 6 as half_harmonic,
  abs(pred - 42) <= 6 or abs(pred - 210) <= 6 as band_edge from er where err is not null""")
def harmonic_error_flags(spark, d):
    p, r, off = F.col("pred"), F.col("ref"), F.col("abs_err") > 6
    return rows(spark, d).where("err is not null").select(
        "o_orderkey", (off & (F.abs(p - 2 * r) <= 6)).alias("double_harmonic"), (off & (F.abs(p - r / 2) <= 6)).alias("half_harmonic"),
        ((F.abs(p - 42) <= 6) | (F.abs(p - 210) <= 6)).alias("band_edge"))


@query("rolling_error_mean", f"""with {EV}, s as (select *, avg(abs_err) over w as m, count(abs_err) over w as c from er
  window w as (partition by subject order by start_day, o_orderkey rows between 4 preceding and current row))
select o_orderkey, {R('case when c = 5 then m end')} as rolling_mae from s""")
def rolling_error_mean(spark, d):
    r = rows(spark, d).select("subject", "o_orderkey", "start_day", "abs_err").withColumn("block", F.floor(F.col("start_day") / 512))
    r = with_index(r, ["subject"], "block", ["start_day", "o_orderkey"], "i")
    h, w = halo(r, ["subject"], "i", 4, 0)
    five = w.rowsBetween(-4, 0)
    h = h.withColumns({"m": F.avg("abs_err").over(five), "c": F.count("abs_err").over(five)}).where("_own")
    return h.select("o_orderkey", rnd(F.when(F.col("c") == 5, F.col("m"))).alias("rolling_mae"))


@query("reason_histogram", f"""with {EV}, x as (select unnest(list_filter([case when not extraction_ok then 'extraction_failed' end, case when pred is null then 'nonfinite_prediction' end,
  case when ref is null then 'missing_reference' end, case when abs_err > 100 then 'large_error' end], lambda r: r is not null)) as reason, subject from er)
select reason, count(*) as windows, count(distinct subject) as subjects from x group by 1""")
def reason_histogram(spark, d):
    why = reasons(("extraction_failed", ~F.col("extraction_ok")), ("nonfinite_prediction", F.col("pred").isNull()),
                  ("missing_reference", F.col("ref").isNull()), ("large_error", F.col("abs_err") > 100))
    x = rows(spark, d).select("subject", F.explode(why).alias("reason")).groupBy("reason", "subject").agg(F.count("*").alias("n"))
    return x.groupBy("reason").agg(F.sum("n").alias("windows"), F.count("*").alias("subjects"))


@query("describe_missing", f"""with {EV} select method, count(*) as intended, count(pred) as finite, count(*) - count(pred) as missing, {R('min(pred)')} as lowest,
  {R('median(pred)')} as median, {R('avg(pred)')} as mean, {R('max(pred)')} as highest from er group by 1""")
def describe_missing(spark, d):
    r = rows(spark, d)
    a = r.groupBy("method").agg(F.count("*").alias("intended"), F.count("pred").alias("finite"),
                                (F.count("*") - F.count("pred")).alias("missing"), F.min("pred").alias("lowest"),
                                F.avg("pred").alias("mean"), F.max("pred").alias("highest"))
    a = a.join(exact_quantiles(r, ["method"], "pred", {"median": .5}), "method", "left")
    return rounded(a, ["method", "intended", "finite", "missing"], ["lowest", "median", "mean", "highest"])


@query("numeric_scan_audit", f"""with u as (select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as variable,
   unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as x from lineitem)
select variable, count(*) as total, cast(count_if(x is not null and isfinite(x)) as bigint) as finite, cast(count_if(x <> floor(x)) as bigint) as fractional,
  cast(count_if(x = 0) as bigint) as zeros, {R('min(x)')} as lowest, {R('max(x)')} as highest from u group by 1""")
def numeric_scan_audit(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    u = read(spark, d, "lineitem").select(*names).unpivot([], names, "variable", "x")
    return u.groupBy("variable").agg(F.count("*").alias("total"), F.count_if(finite("x")).alias("finite"),
                                     F.count_if(F.col("x") != F.floor("x")).alias("fractional"), F.count_if(F.col("x") == 0).alias("zeros"),
                                     rnd(F.min("x")).alias("lowest"), rnd(F.max("x")).alias("highest"))
