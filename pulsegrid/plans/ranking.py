"""Ranking, selection, set, split and model queries."""
from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Window, functions as F

from pulsegrid.functions.cols import joined, reasons, rnd, safe_corr
from pulsegrid.operators import metrics as mt, models as md, splits as sl
from pulsegrid.operators.carry import exact_quantiles, with_rank
from pulsegrid.plans.metrics import EV, rows
from pulsegrid.plans.registry import R, WAVES, query
from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import read, waves

RANKED = f"""{EV}, rk as (select method as subject, o_orderkey as start_sec, -abs_err as score, case when abs_err is not null then row_number() over (partition by method order by abs_err nulls last, o_orderkey) end as rank from er)"""


def ranked(spark, d):
    r = rows(spark, d).select(F.col("method").alias("subject"), F.col("o_orderkey").alias("start_sec"), (-F.col("abs_err")).alias("score"))
    return checkpointed(with_rank(r, ["subject"], "score", "start_sec"))     # selections read it several times


@query("rank_windows", f"with {RANKED} select subject, start_sec, {R('score')} as score, rank from rk")
def rank_windows(spark, d):
    return ranked(spark, d).select("subject", "start_sec", rnd("score").alias("score"), "rank")


@query("select_best_median_worst", f"""with {RANKED}, n as (select subject, max(rank) as n from rk group by 1)
select subject, start_sec, rank, case when rank = 1 then 'best' when rank = n // 2 + 1 then 'median' else 'worst' end as selection from rk join n using (subject) where rank in (1, n // 2 + 1, n)""")
def select_best_median_worst(spark, d):
    r = ranked(spark, d).where("rank is not null")
    n = r.groupBy("subject").agg(F.max("rank").alias("n"))
    mid = F.floor(F.col("n") / 2) + 1
    j = r.join(n, "subject").where((F.col("rank") == 1) | (F.col("rank") == mid) | (F.col("rank") == F.col("n")))
    name = F.when(F.col("rank") == 1, "best").when(F.col("rank") == mid, "median").otherwise("worst")
    return j.select("subject", "start_sec", "rank", name.alias("selection"))


@query("seeded_random_pick", f"""with {RANKED}, n as (select subject, max(rank) as n from rk group by 1), c as (select rk.*, rank in (1, n // 2 + 1, n) as taken from rk join n using (subject) where rank is not null),
 o as (select *, row_number() over (partition by subject order by taken, md5('42:' || subject || ':' || start_sec), start_sec) as rn from c)
select subject, start_sec, taken as already_selected from o where rn = 1""")
def seeded_random_pick(spark, d):
    r = ranked(spark, d).where("rank is not null")
    n = r.groupBy("subject").agg(F.max("rank").alias("n"))
    taken = (F.col("rank") == 1) | (F.col("rank") == F.floor(F.col("n") / 2) + 1) | (F.col("rank") == F.col("n"))
    # minimum of (taken, hash): prefers windows not chosen yet, falls back to any
    hashed = F.md5(F.concat_ws(":", F.lit("42"), "subject", F.col("start_sec").cast("string")))
    order = F.struct(taken.cast("int").alias("t"), hashed.alias("h"), "start_sec")
    return r.join(n, "subject").groupBy("subject").agg(F.min(order).alias("m")).select("subject", "m.start_sec", (F.col("m.t") == 1).alias("already_selected"))


@query("best_baseline", f"""with {EV}, b as (select method, count(distinct subject) as subjects, count(*) - count(err) as unscored, avg(abs_err) as mae, avg(case when err is null then 1e0 else 0 end) as share from er group by 1)
select method, subjects, {R('mae')} as mae from b where share < 0.4 order by mae, method limit 1""")
def best_baseline(spark, d):
    b = rows(spark, d).groupBy("method", "subject").agg(F.count("*").alias("w"), F.count("err").alias("n"), F.sum("abs_err").alias("s"))
    b = b.groupBy("method").agg(F.count("*").alias("subjects"), (F.sum("s") / F.sum("n")).alias("mae"), (1 - F.sum("n") / F.sum("w")).alias("share"))
    return b.where("share < 0.4").orderBy("mae", "method").limit(1).select("method", "subjects", rnd("mae").alias("mae"))


EPOCHS = f"""{EV}, ep as (select start_day // 200 as epoch, avg(abs_err) as hr_mae, corr(pred, ref) as aligned, avg(case when abs_err <= 100 then 1e0 when abs_err > 100 then 0e0 end) as score from er group by 1),
 z as (select * from ep where epoch = (select min(epoch) from ep))"""


def epochs(spark, d):
    r = rows(spark, d).withColumn("epoch", F.floor(F.col("start_day") / 200))
    near = F.when(F.col("abs_err").isNotNull(), (F.col("abs_err") <= 100).cast("double"))
    both = F.col("err").isNotNull()
    return r.groupBy("epoch").agg(F.avg("abs_err").alias("hr_mae"), safe_corr(F.when(both, F.col("pred")), F.when(both, F.col("ref"))).alias("aligned"), F.avg(near).alias("score"))


@query("model_selection", f"""with {EPOCHS}, g as (select ep.* from ep, z where ep.hr_mae <= z.hr_mae + 1)
select 'gated' as criterion, epoch from (select epoch from g order by score desc, aligned desc, hr_mae, epoch limit 1)
union all select 'unconstrained', epoch from (select epoch from ep order by score desc, aligned desc, hr_mae, epoch limit 1)
union all select 'best_hr', epoch from (select epoch from ep order by hr_mae, epoch limit 1)""")
def model_selection(spark, d):
    # ties are exact here: the order columns decide, not a tolerance fold
    e = epochs(spark, d)
    first = e.agg(F.min_by("hr_mae", "epoch").alias("h")).scalar()
    order = F.struct((-F.col("score")).alias("a"), (-F.col("aligned")).alias("b"), "hr_mae", "epoch")
    pick = e.agg(F.min(F.when(F.col("hr_mae") <= first + 1, order)).alias("gated"), F.min(order).alias("unconstrained"), F.min(F.struct("hr_mae", "epoch")).alias("best_hr"))
    return pick.select(F.inline(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"{c}.epoch").alias("epoch")) for c in ("gated", "unconstrained", "best_hr")])))


@query("metric_delta_table", f"""with {EPOCHS}, s as (select * from ep order by hr_mae, epoch limit 1)
select unnest(['hr_mae', 'aligned', 'score']) as metric, unnest([{R('s.hr_mae - z.hr_mae')}, {R('s.aligned - z.aligned')}, {R('s.score - z.score')}]) as delta from s, z""")
def metric_delta_table(spark, d):
    m = F.struct("hr_mae", "aligned", "score")
    one = epochs(spark, d).agg(F.min_by(m, F.struct("hr_mae", "epoch")).alias("s"), F.min_by(m, "epoch").alias("z"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), rnd(F.col(f"s.{c}") - F.col(f"z.{c}")).alias("delta")) for c in ("hr_mae", "aligned", "score")])))


CHECKS = ["coverage", "failures", "hr_mae", "rmse", "bias", "correlation", "subjects", "windows", "within_100"]


@query("acceptance_gate", f"""with {EV}, a as (select method, count(err) / count(*) >= 0.5 as c1, 1 - count(pred) / count(*) <= 0.4 as c2, avg(abs_err) <= 150 as c3, sqrt(avg(err * err)) <= 200 as c4, abs(avg(err)) <= 10 as c5,
   corr(case when err is not null then pred end, case when err is not null then ref end) >= 0.5 as c6, count(distinct subject) >= 3 as c7, count(*) >= 100 as c8, avg(case when abs_err <= 100 then 1e0 when abs_err > 100 then 0e0 end) >= 0.3 as c9 from er group by 1)
select method, {' and '.join(f'coalesce(c{i + 1}, false)' for i in range(9))} as accepted, concat_ws('|', {', '.join(f"case when not coalesce(c{i + 1}, false) then '{n}' end" for i, n in enumerate(CHECKS))}) as reasons from a""")
def acceptance_gate(spark, d):
    r = rows(spark, d)
    both = F.col("err").isNotNull()
    subj = r.select("method", "subject").distinct().groupBy("method").agg(F.count("*").alias("ns"))
    near = F.when(both, (F.col("abs_err") <= 100).cast("double"))
    a = r.groupBy("method").agg(
        F.count("*").alias("w"), (F.count("err") / F.count("*")).alias("cov"), (1 - F.count("pred") / F.count("*")).alias("fail"), F.avg("abs_err").alias("mae"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.avg("err").alias("bias"),
        safe_corr(F.when(both, F.col("pred")), F.when(both, F.col("ref"))).alias("r"), F.avg(near).alias("near")).join(subj, "method")
    c = F.col
    passed = dict(zip(CHECKS, (c("cov") >= .5, c("fail") <= .4, c("mae") <= 150, c("rmse") <= 200, F.abs("bias") <= 10, c("r") >= .5, c("ns") >= 3, c("w") >= 100, c("near") >= .3)))
    why = reasons(*[(n, ~F.coalesce(p, F.lit(False))) for n, p in passed.items()])
    return a.withColumn("why", why).select("method", (F.size("why") == 0).alias("accepted"), joined("why").alias("reasons"))


@query("attention_allocation", f"""with {WAVES}, a as (select vec_id, i // 16 as roi, avg(x * x) as e from w group by 1, 2), b as (select *, e / sum(e) over (partition by vec_id) as weight from a),
 m as (select *, max(weight) over (partition by vec_id) as top from b), c as (select *, count_if(weight = top) over (partition by vec_id) as ties from m)
select cast(roi as integer) as roi, {R('avg(weight)')} as mean_weight, {R('median(weight)')} as median_weight, {R('100 * avg(case when weight = top then 1e0 / ties else 0 end)')} as highest_percent, {R('100 * avg(case when weight > 0.4 then 1e0 else 0 end)')} as concentrated_percent from c group by 1""")
def attention_allocation(spark, d):
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.aggregate(F.slice("x", r * 16 + 1, 16), F.lit(0.0), lambda a, v: a + v * v) / 16)
    w = waves(spark, d).select("vec_id", parts.alias("e")).withColumn("tot", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    w = w.withColumn("wt", F.transform("e", lambda v: v / F.col("tot")))
    top = F.array_max("wt")
    w = w.withColumns({"top": top, "ties": F.size(F.filter("wt", lambda v: v == F.array_max("wt")))})
    long = w.select("top", "ties", F.posexplode("wt").alias("roi", "weight"))
    a = long.groupBy("roi").agg(F.avg("weight").alias("m"), F.avg(F.when(F.col("weight") == F.col("top"), 1.0 / F.col("ties")).otherwise(0.0)).alias("h"),
                                F.avg((F.col("weight") > .4).cast("double")).alias("c"))
    a = a.join(exact_quantiles(long, ["roi"], "weight", {"q": .5}), "roi")
    return a.select("roi", rnd("m").alias("mean_weight"), rnd("q").alias("median_weight"), rnd(100 * F.col("h")).alias("highest_percent"), rnd(100 * F.col("c")).alias("concentrated_percent"))


# ---- set operations ------------------------------------------------------------

@query("concat_datasets", """select 'documents' as dataset, doc_id as id, md5(text) as content, lang from documents union all select 'benchmark', item_id, md5(text), null from benchmark
union all select 'conversations', conv_id, md5(text), null from conversations""")
def concat_datasets(spark, d):
    a = read(spark, d, "documents").select(F.lit("documents").alias("dataset"), F.col("doc_id").alias("id"), F.md5("text").alias("content"), "lang")
    b = read(spark, d, "benchmark").select(F.lit("benchmark").alias("dataset"), F.col("item_id").alias("id"), F.md5("text").alias("content"))
    c = read(spark, d, "conversations").select(F.lit("conversations").alias("dataset"), F.col("conv_id").alias("id"), F.md5("text").alias("content"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("expected_minus_found", "select doc_id from documents except select doc_id from labels")
def expected_minus_found(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("identity_set_equality", """with s as (select o_orderpriority as method, o_custkey as subject, o_orderdate as start from orders), b as (select * from s where method = '1-URGENT'),
 m as (select distinct method from s where method <> '1-URGENT')
select m.method, (select count(*) from s where s.method = m.method and not exists (select 1 from b where b.subject = s.subject and b.start = s.start)) as extra,
 (select count(*) from b where not exists (select 1 from s where s.method = m.method and b.subject = s.subject and b.start = s.start)) as missing from m""")
def identity_set_equality(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("start"))
    counts = o.groupBy("subject", "start", "method").agg(F.count("*").alias("c"))
    base = counts.where("method = '1-URGENT'").select("subject", "start", F.col("c").alias("b"))
    # what a method lacks are all base rows less those at its own identities, for whatever methods there are
    g = counts.where("method <> '1-URGENT'").join(base, ["subject", "start"], "left").groupBy("method").agg(
        F.sum(F.when(F.col("b").isNull(), F.col("c")).otherwise(0)).alias("extra"), F.sum(F.coalesce("b", F.lit(0))).alias("met"))
    total = base.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("total")).scalar()
    return g.select("method", "extra", (total - F.col("met")).alias("missing"))


SPLIT = """sub as (select distinct c_custkey as subject from customer), od as (select subject, row_number() over (order by md5('42:' || subject), subject) - 1 as position, count(*) over () as n from sub)"""


@query("complete_partition_check", f"""with {SPLIT}, p as (select subject, case when position < greatest(1, round_even(n * 0.2e0, 0)) then 'validation' when position < 2 * greatest(1, round_even(n * 0.2e0, 0)) then 'test' else 'train' end as part from od)
select count(*) as subjects, cast(count_if(part = 'train') as bigint) as train, cast(count_if(part = 'validation') as bigint) as validation, cast(count_if(part = 'test') as bigint) as test,
 (select count(*) from (select distinct o_custkey from orders) where o_custkey not in (select subject from p)) as unassigned, true as disjoint from p""")
def complete_partition_check(spark, d):
    p = sl.subject_split(read(spark, d, "customer").select(F.col("c_custkey").alias("subject")), "subject")
    once = p.groupBy("subject").agg(F.count("*").alias("c"), F.first("partition").alias("part"))
    seen = read(spark, d, "orders").select(F.col("o_custkey").alias("subject")).distinct()
    missing = seen.join(p, "subject", "left_anti").agg(F.count("*").alias("unassigned")).scalar()
    part = lambda k: F.count_if(F.col("part") == k).alias(k)
    return once.agg(F.count("*").alias("subjects"), part("train"), part("validation"), part("test"), (F.max("c") == 1).alias("disjoint")).withColumn("unassigned", missing)


@query("shared_trace_groups", """with w as (select vec_id, md5(array_to_string(list_transform(embedding, lambda x: floor(cast(x as double) * 1e6)::bigint), ',')) as digest, embedding from embeddings)
select digest, count(*) as recordings from w group by embedding, digest""")
def shared_trace_groups(spark, d):
    """Every whole trace that differs in any bit of any value, by a digest of its exact doubles, with how many recordings share it.

    Shown is a digest to six digits, which other systems can spell alike.
    """
    digits = F.array_join(F.transform("x", lambda v: F.floor(v * 1e6).cast("string")), ",")
    exact = F.sha2(F.array_join(F.transform("x", lambda v: v.cast("string")), ","), 256)                  # a double's shortest text is its own
    return waves(spark, d).groupBy(exact.alias("exact"), F.md5(digits).alias("digest")).agg(F.count("*").alias("recordings")).drop("exact")


# ---- splits and models -----------------------------------------------------------

@query("subject_split", f"""with {SPLIT} select subject, position, case when position < greatest(1, round_even(n * 0.2e0, 0)) then 'validation' when position < 2 * greatest(1, round_even(n * 0.2e0, 0)) then 'test' else 'train' end as partition from od""")
def subject_split(spark, d):
    return sl.subject_split(read(spark, d, "customer").select(F.col("c_custkey").alias("subject")), "subject")


@query("split_manifest", f"""with {SPLIT}, k as (select *, least(n - 2, greatest(1, round_even(n * 0.2e0, 0))) as nt from od), v as (select *, least(n - nt - 1, greatest(1, round_even((n - nt) * 0.2e0, 0))) as nv from k)
select subject, position, case when position < nt then 'test' when position < nt + nv then 'validation' else 'train' end as partition, n = 2 as smoke_only, 42 as seed, 'sorted_md5_order_v1' as algorithm_version from v""")
def split_manifest(spark, d):
    return sl.split_manifest(read(spark, d, "customer").select(F.col("c_custkey").alias("subject")), "subject")


FEATURES = ["quantity", "price", "discount"]
MODEL_SQL = """f as (select o_orderkey, o_custkey as subject, o_orderstatus, o_totalprice / 942.4777960769379e0 as target, case when o_orderstatus <> 'P' then q end as quantity, p as price, dd as discount from orders
   left join (select l_orderkey, sum(l_quantity) as q, avg(l_extendedprice) / 942.4777960769379e0 as p, max(l_discount) as dd from lineitem group by 1) on l_orderkey = o_orderkey),
 part as (select subject, case when position < greatest(1, round_even(n * 0.2e0, 0)) then 'validation' when position < 2 * greatest(1, round_even(n * 0.2e0, 0)) then 'test' else 'train' end as partition from od),
 fp as (select f.*, partition from f join part using (subject))"""


def model_rows(spark, d):
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), (F.avg("l_extendedprice") / 942.4777960769379).alias("price"), F.max("l_discount").alias("discount"))
    o = read(spark, d, "orders").join(li, "o_orderkey", "left")
    o = o.select("o_orderkey", F.col("o_custkey").alias("subject"), "o_orderstatus", (F.col("o_totalprice") / 942.4777960769379).alias("target"),
                 F.when(F.col("o_orderstatus") != "P", F.col("quantity")).alias("quantity"), "price", "discount")
    split = sl.subject_split(read(spark, d, "customer").select(F.col("c_custkey").alias("subject")), "subject").select("subject", "partition")
    return o.join(checkpointed(split), "subject")


@query("impute_scale_train_only", f"""with {SPLIT}, {MODEL_SQL}, m as (select median(quantity) as mq, median(price) as mp, median(discount) as md from fp where partition = 'train'),
 s as (select any_value(mq) as mq, any_value(mp) as mp, any_value(md) as md, avg(coalesce(quantity, mq)) as aq, stddev_pop(coalesce(quantity, mq)) as sq, avg(coalesce(price, mp)) as ap, stddev_pop(coalesce(price, mp)) as sp,
   avg(coalesce(discount, md)) as ad, stddev_pop(coalesce(discount, md)) as sd from fp, m where partition = 'train')
select o_orderkey, partition, {R('(coalesce(quantity, mq) - aq) / sq')} as quantity_scaled, {R('(coalesce(price, mp) - ap) / sp')} as price_scaled, {R('(coalesce(discount, md) - ad) / sd')} as discount_scaled from fp, s""")
def impute_scale_train_only(spark, d):
    s = sl.impute_scale(model_rows(spark, d), FEATURES)
    return s.select("o_orderkey", "partition", *[rnd(f"{f}_scaled").alias(f"{f}_scaled") for f in FEATURES])


@query("target_standardize", f"""with {SPLIT}, {MODEL_SQL}, s as (select avg(target) as m, stddev_pop(target) as sd from fp where partition = 'train')
select o_orderkey, {R('(target - m) / sd')} as z, {R('(target - m) / sd * sd + m')} as restored from fp, s""")
def target_standardize(spark, d):
    r = model_rows(spark, d)
    s = r.where("partition = 'train'").agg(F.struct(F.avg("target").alias("m"), F.stddev_pop("target").alias("sd")).alias("s")).scalar()
    r = r.withColumn("s", s).withColumn("z", (F.col("target") - F.col("s.m")) / F.col("s.sd"))
    return r.select("o_orderkey", rnd("z").alias("z"), rnd(F.col("z") * F.col("s.sd") + F.col("s.m")).alias("restored"))


@query("drop_train_empty_columns", f"""with {SPLIT}, {MODEL_SQL} select unnest(['quantity', 'price', 'discount', 'pending_only']) as feature,
 unnest([count(quantity) > 0, count(price) > 0, count(discount) > 0, count(case when partition <> 'train' then price end) > 0]) as kept from fp where partition = 'train'""")
def drop_train_empty_columns(spark, d):
    r = model_rows(spark, d).withColumn("pending_only", F.when(F.col("partition") != "train", F.col("price")))
    names = [*FEATURES, "pending_only"]
    one = r.where("partition = 'train'").agg(*[F.count(c).alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) > 0).alias("kept")) for c in names])))


ROW_COLUMNS = ("o_orderkey", "subject", "o_orderstatus", "partition", "target")          # of a model row, not features
TARGET_WORDS = ("target", "sbp", "dbp", "reference", "label")


def assert_no_label_leak(columns: list[str], allowed: list[str]) -> list[str]:
    """Reject feature columns that look like targets or are outside the fixed schema."""
    bad = [c for c in columns if c not in allowed or any(w in c.lower() for w in TARGET_WORDS)]
    if bad:
        raise ValueError(f"feature columns not allowed: {bad}")
    return columns


@query("label_leak_guard", f"""with {SPLIT}, {MODEL_SQL} select o_orderkey, {R('quantity')} as quantity, {R('price')} as price, {R('discount')} as discount from fp""")
def label_leak_guard(spark, d):
    r = model_rows(spark, d)
    used = assert_no_label_leak([c for c in r.columns if c not in ROW_COLUMNS], FEATURES)
    return r.select("o_orderkey", *[rnd(c).alias(c) for c in used])


@query("eligible_training_rows", f"""with {SPLIT}, {MODEL_SQL} select o_orderkey, case when target is null then 'missing_target' when o_orderstatus = 'P' then 'unaccepted_window' when price is null then 'missing_features' else '' end as reason,
  target is not null and o_orderstatus <> 'P' and price is not null as eligible from fp""")
def eligible_training_rows(spark, d):
    why = F.when(F.col("target").isNull(), "missing_target").when(F.col("o_orderstatus") == "P", "unaccepted_window").when(F.col("price").isNull(), "missing_features").otherwise("")
    return model_rows(spark, d).select("o_orderkey", why.alias("reason"), (why == "").alias("eligible"))


def baseline_predictions(spark, d, trees=200):
    """Mean, ordinary, ridge and forest baselines fitted on train rows; predictions for the other rows."""
    r = sl.impute_scale(model_rows(spark, d), FEATURES)
    r = checkpointed(r.select("o_orderkey", "partition", "target", *[f"{f}_scaled" for f in FEATURES]))   # fits reread it many times
    v = VectorAssembler(inputCols=[f"{f}_scaled" for f in FEATURES], outputCol="features").transform(r)
    train, rest = v.where("partition = 'train'"), v.where("partition <> 'train'")
    n = train.count()
    models = {"ols": LinearRegression(labelCol="target", standardization=False, solver="normal"),
              "ridge": LinearRegression(labelCol="target", regParam=10.0 / n, standardization=False, solver="normal"),
              "forest": RandomForestRegressor(labelCol="target", numTrees=trees, minInstancesPerNode=3, seed=42)}
    mean = train.agg(F.avg("target")).scalar()
    base = ["o_orderkey", "partition", "target"]
    out = rest.select(*base, F.lit("mean").alias("model"), mean.alias("prediction"))
    for name, m in models.items():
        out = out.unionByName(m.fit(train).transform(rest).select(*base, F.lit(name).alias("model"), "prediction"))
    return out


@query("bp_baselines")
def bp_baselines(spark, d):
    p = baseline_predictions(spark, d).withColumn("e", F.abs(F.col("prediction") - F.col("target")))
    g = p.groupBy("model").agg(F.avg(F.when(F.col("partition") == "validation", F.col("e"))).alias("validation_mae"),
                               F.avg(F.when(F.col("partition") == "test", F.col("e"))).alias("test_mae"), F.count("*").alias("rows"))
    best = Window.partitionBy(F.lit(0)).orderBy("validation_mae", "model")     # four rows, one per model
    return g.withColumn("selected", F.row_number().over(best) == 1).select("model", rnd("validation_mae").alias("validation_mae"),
                                                                           F.when(F.col("selected"), rnd("test_mae")).alias("test_mae"), "rows", "selected")


@query("train_report")
def train_report(spark, d):
    p = baseline_predictions(spark, d)
    p = p.withColumns({"pred": F.col("prediction"), "ref": F.col("target")})
    m = mt.with_error(p).groupBy("model", "partition").agg(*mt.named(mt.regression_aggs()))
    return m.select("model", "partition", "n", *[rnd(c).alias(c) for c in ("mae", "rmse", "me", "sd", "pearson")])


SETS = {"quantity_only": 1, "quantity_price": 2, "all": 3}


@query("loso_ridge")
def loso_ridge(spark, d):
    """Leave-one-subject-out ridge on subject aggregates, three nested feature sets."""
    agg = model_rows(spark, d).groupBy("subject").agg(*[F.avg(f).alias(f) for f in FEATURES], F.avg("target").alias("y")).na.drop()
    x = [F.col(f) for f in FEATURES]
    sums = md.moments(x, [F.col("y")])
    total = agg.agg(F.struct(*[c.alias(k) for k, c in sums.items()]).alias("t")).scalar()
    own = {"n": F.lit(1.0), "t0": F.col("y")}
    for i, a in enumerate(x):
        own[f"s{i}"] = a
        own[f"c{i}_0"] = a * F.col("y")
        own.update({f"p{i}_{j}": a * x[j] for j in range(i, len(x))})
    # everyone's sums minus the held-out subject's own: no fold ever rereads the data
    folds = agg.withColumn("t", total).select("subject", *x, "y", *[(F.col(f"t.{k}") - own[k]).alias(k) for k in sums])
    sets = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.lit(u).alias("used")) for n, u in SETS.items()])
    w = md.leave_one_out(folds.drop(*FEATURES, "y").select("*", F.inline(sets)), len(FEATURES), 1, 10.0)
    p = w.join(agg, "subject")
    yhat = F.col("b0") + sum(F.col(f"w{i}_0") * F.col(f) for i, f in enumerate(FEATURES))
    p = p.withColumn("e", yhat - F.col("y"))
    base = folds.select("subject", F.lit("mean").alias("feature_set"), ((F.col("t0") / F.col("n")) - F.col("y")).alias("e"))
    e = p.select("subject", "feature_set", "e").unionByName(base)
    g = e.groupBy("feature_set").agg(F.count("*").alias("subjects"), rnd(F.avg(F.abs("e"))).alias("mae"), rnd(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), rnd(F.avg("e")).alias("bias"))
    return g.withColumn("evaluated", F.col("subjects") >= 3)
