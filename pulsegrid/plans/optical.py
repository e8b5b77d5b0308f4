"""Pixel, patch and calibration queries; a part is a frame, a line is a pixel, the return flag is the region."""
from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.cols import rnd
from pulsegrid.operators import optical as op
from pulsegrid.operators.carry import exact_quantiles, halo
from pulsegrid.plans.registry import COLOUR, PAIRS, R, query
from pulsegrid.session import checkpointed
from pulsegrid.sources.tables import colour_samples, read, wave_pairs

ROI = ["roi"]
BLOCK = 300
PIX = """px as (select l_returnflag as roi, l_partkey as frame, l_partkey // 300 as block, l_linenumber as x, cast(round(l_discount * 100) as bigint) as y,
  156 + l_quantity * 2e0 as r, 100 + l_extendedprice / 942.4777960769379e0 / 2 as g, l_tax * 400e0 + 80 as b from lineitem)"""
SKIN = """ry as (select *, (cast(round_even(r, 0) as bigint) * 4899 + cast(round_even(g, 0) as bigint) * 9617 + cast(round_even(b, 0) as bigint) * 1868 + 8192) >> 14 as lum from px),
 sk as (select *, ((cast(round_even(r, 0) as bigint) - lum) * 11682 + 2097152 + 8192) >> 14 as cr, ((cast(round_even(b, 0) as bigint) - lum) * 9241 + 2097152 + 8192) >> 14 as cb from ry),
 pk as (select *, cr between 133 and 173 and cb between 77 and 127 as skin, r + g + b as tot from sk)"""


def pixels(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("roi"), F.col("l_partkey").alias("frame"), F.floor(F.col("l_partkey") / BLOCK).alias("block"),
                     F.col("l_linenumber").alias("x"), F.round(F.col("l_discount") * 100).cast("long").alias("y"), (156 + F.col("l_quantity") * 2).alias("r"),
                     (100 + F.col("l_extendedprice") / 942.4777960769379 / 2).alias("g"), (F.col("l_tax") * 400.0 + 80).alias("b"))


def patches(spark, d):
    # frame-level rows, far fewer than pixels, read by weights, mixing and change terms
    return checkpointed(op.descriptors(op.patch_id(pixels(spark, d), ["roi", "frame"]), ["roi", "frame", "block", "patch"], 1))


@query("region_color_reduce", f"""with {PIX}, g as (select roi, frame, count(*) as pixels, avg(r) as r, avg(g) as g, avg(b) as b, avg(case when least(r, g, b) <= 1 or greatest(r, g, b) >= 254 then 1e0 else 0 end) as clip, avg((r + g + b) / 3) / 255 as bright from px where greatest(r, g, b) <= 255.5 group by 1, 2)
select roi, frame, pixels, {', '.join(R(f'case when pixels >= 4 then {c} end') + f' as {n}' for c, n in (('r', 'r'), ('g', 'g'), ('b', 'b'), ('clip', 'clipping_fraction'), ('bright', 'brightness')))} from g""")
def region_color_reduce(spark, d):
    p = pixels(spark, d).where(F.greatest("r", "g", "b") <= 255.5)
    clip = (F.least("r", "g", "b") <= 1) | (F.greatest("r", "g", "b") >= 254)
    g = p.groupBy("roi", "frame").agg(F.count("*").alias("pixels"), *[F.avg(c).alias(c) for c in "rgb"], F.avg(clip.cast("double")).alias("clipping_fraction"),
                                      (F.avg((F.col("r") + F.col("g") + F.col("b")) / 3) / 255).alias("brightness"))
    enough = F.col("pixels") >= op.MIN_PIXELS
    return g.select("roi", "frame", "pixels", *[rnd(F.when(enough, F.col(c))).alias(c) for c in ("r", "g", "b", "clipping_fraction", "brightness")])


@query("skin_gate", f"with {PIX}, {SKIN} select roi, frame, count(*) as pixels, cast(count_if(skin) as bigint) as compatible from pk group by 1, 2")
def skin_gate(spark, d):
    return pixels(spark, d).withColumn("skin", op.skin_gate(F.col("r"), F.col("g"), F.col("b"))).groupBy("roi", "frame").agg(
        F.count("*").alias("pixels"), F.count_if("skin").alias("compatible"))


PATCH = """bb as (select *, min(y) over w as y0, max(y) over w + 1 as y1, min(x) over w as x0, max(x) over w + 1 as x1 from pk window w as (partition by roi, frame)),
 pa as (select *, cast(3 * (y >= floor(y0 + (y1 - y0) / 2e0))::int + (x >= floor(x0 + (x1 - x0) / 3e0))::int + (x >= floor(x0 + (x1 - x0) * 2 / 3e0))::int as integer) as patch from bb)"""


@query("bbox_patch_id", f"with {PIX}, {SKIN}, {PATCH} select roi, frame, patch, count(*) as pixels from pa group by 1, 2, 3")
def bbox_patch_id(spark, d):
    return op.patch_id(pixels(spark, d), ["roi", "frame"]).groupBy("roi", "frame", "patch").agg(F.count("*").alias("pixels"))


def described(source, keys, least):
    return f"""ok as (select *, greatest(r, g, b) <= 255 and least(r, g, b) >= 0 as ok from {source}),
 ch as (select *, case when ok then r / tot end as qr, case when ok then g / tot end as qg, case when ok then b / tot end as qb from ok),
 md as (select *, median(qr) over w as mr, median(qg) over w as mg, median(qb) over w as mb from ch window w as (partition by {keys})),
 ds as (select {keys}, cast(count_if(ok) as bigint) as pixel_count, avg(ok::int) as finite_fraction, avg(case when ok then r end) as r, avg(case when ok then g end) as g, avg(case when ok then b end) as b,
  avg(case when ok then (least(r, g, b) <= 1 or greatest(r, g, b) >= 254)::int end) as clipped_fraction, avg(case when ok then skin::int end) as chroma_compatible_fraction, avg(case when ok then tot / 3 end) / 255 as brightness,
  median((abs(qr - mr) + abs(qg - mg) + abs(qb - mb)) / 3) as spatial_chroma_mad, avg(x) as centroid_x, avg(y) as centroid_y, count_if(ok) >= {least} as valid from md group by {keys})"""


DESC = ("r", "g", "b", "clipped_fraction", "chroma_compatible_fraction", "brightness", "spatial_chroma_mad")


@query("optical_descriptors", f"""with {PIX}, {SKIN}, {described('pk', 'roi, frame', 4)} select roi, frame, pixel_count, valid, {R('finite_fraction')} as finite_fraction, {R('centroid_x')} as centroid_x, {R('centroid_y')} as centroid_y,
  {', '.join(R(f'case when valid then {c} end') + f' as {c}' for c in DESC)} from ds""")
def optical_descriptors(spark, d):
    o = op.descriptors(pixels(spark, d), ["roi", "frame"])
    return o.select("roi", "frame", "pixel_count", "valid", *[rnd(c).alias(c) for c in ("finite_fraction", "centroid_x", "centroid_y", *DESC)])


PW = f"""{PIX}, {SKIN}, {PATCH}, {described('pa', 'roi, frame, block, patch', 1)}, vd as (select *, case when valid then clipped_fraction end as cf, case when valid then chroma_compatible_fraction end as sf from ds),
 rq as (select roi, block, frame, avg(skin::int) as sf from (select *, greatest(r, g, b) <= 255 as okk from pk) where okk group by 1, 2, 3 having count(*) >= 1),
 rb as (select roi, block, median(sf) as proxy from rq group by 1, 2),
 pb as (select roi, block, patch, avg(valid::int) as support, median(sf) as skin, median(cf) as clipped from vd group by 1, 2, 3),
 el as (select pb.*, proxy, coalesce(support >= 0.9 and skin >= 0.1 and clipped <= 0.05, false) as eligible, greatest(0.5e0, least(1, skin * (1 - clipped))) as sc from pb join rb using (roi, block)),
 ew as (select *, case when eligible then sc end as score, count_if(eligible) over (partition by roi, block) as ne, sum(case when eligible then sc end) over (partition by roi, block) as total, case when block % 3 = 0 then 'verified_skin' when block % 3 = 1 then 'unknown' else 'verified_non_skin_or_occluded' end as st from el),
 rs as (select *, case when proxy is null then 'ABSTAIN_NO_ACQUISITION' when proxy < 0.1 then 'ABSTAIN_WHOLE_ROI_LOW_SKIN_PROXY' when st = 'verified_non_skin_or_occluded' then 'ABSTAIN_WHOLE_ROI_INDEPENDENT_OCCLUSION'
   when ne < 2 then 'ABSTAIN_TOO_FEW_ELIGIBLE_PATCHES' when st = 'verified_skin' then 'ENGINEERING_WITH_INDEPENDENT_SKIN_EVIDENCE' else 'ABSTAIN_SKIN_UNVERIFIED' end as reason from ew),
 wt as (select *, case when reason in ('ENGINEERING_WITH_INDEPENDENT_SKIN_EVIDENCE', 'ABSTAIN_SKIN_UNVERIFIED') and eligible then score / total else 0 end as weight from rs)"""


def weights(spark, d):
    p = patches(spark, d)
    roi = op.descriptors(pixels(spark, d), ["roi", "frame", "block"], 1)
    state = F.when(F.col("block") % 3 == 0, "verified_skin").when(F.col("block") % 3 == 1, "unknown").otherwise("verified_non_skin_or_occluded")
    evidence = pixels(spark, d).select("roi", "block").distinct().withColumn("state", state)
    return p, checkpointed(op.patch_weights(p, roi, evidence, ROI, support=.9, chroma=.1))


@query("patch_weights", f"with {PW} select roi, block, patch, {R('support')} as support, eligible, {R('weight')} as weight, reason from wt")
def patch_weights(spark, d):
    return weights(spark, d)[1].select("roi", "block", "patch", rnd("support").alias("support"), "eligible", rnd("weight").alias("weight"), "reason")


MIX = """nd as (select roi, block, count(*) as need from wt where weight > 0 group by 1, 2),
 mj as (select v.roi, v.block, v.frame, cast(count_if(v.valid and v.cf <= 0.05) as bigint) as n, sum(case when v.valid and v.cf <= 0.05 then weight * v.r end) as r, sum(case when v.valid and v.cf <= 0.05 then weight * v.g end) as g, sum(case when v.valid and v.cf <= 0.05 then weight * v.b end) as b
   from wt join vd v using (roi, block, patch) where weight > 0 group by 1, 2, 3),
 mx as (select mj.*, n = need as available from mj join nd using (roi, block))"""


@query("patch_mix", f"with {PW}, {MIX} select roi, block, frame, available, {', '.join(R(f'case when available then {c} end') + f' as {c}' for c in 'rgb')} from mx")
def patch_mix(spark, d):
    p, w = weights(spark, d)
    return op.patch_mix(p, w, ROI).select("roi", "block", "frame", "available", *[rnd(c).alias(c) for c in "rgb"])


@query("weight_change_terms", f"""with {PW}, pc as (select roi, block, patch, avg(case when valid then g end) as g from vd group by 1, 2, 3),
 j as (select a.roi, a.block, a.patch, a.weight - coalesce(p.weight, 0) as dw, pc.g from wt a left join wt p on p.roi = a.roi and p.patch = a.patch and p.block = a.block - 1 join pc on pc.roi = a.roi and pc.block = a.block and pc.patch = a.patch where a.block > 0)
select roi, block, {R('sum(abs(dw))')} as weight_l1_step, {R('case when count_if(dw <> 0 and g is null) = 0 then sum(case when dw <> 0 then dw * g else 0 end) end')} as weight_change_term from j group by 1, 2""")
def weight_change_terms(spark, d):
    p, w = weights(spark, d)
    g = p.groupBy("roi", "block", "patch").agg(F.avg("g").alias("g"))
    prev = w.select("roi", (F.col("block") + 1).alias("block"), "patch", F.col("weight").alias("before"))
    j = w.select("roi", "block", "patch", "weight").where("block > 0").join(prev, ["roi", "block", "patch"], "left").join(g, ["roi", "block", "patch"])
    dw = F.col("weight") - F.coalesce("before", F.lit(0.0))
    j = j.withColumn("dw", dw)
    active = F.col("dw") != 0
    term = F.when(F.count_if(active & F.col("g").isNull()) == 0, F.sum(F.when(active, F.col("dw") * F.col("g")).otherwise(0.0)))
    return j.groupBy("roi", "block").agg(rnd(F.sum(F.abs("dw"))).alias("weight_l1_step"), rnd(term).alias("weight_change_term"))


STEP = f"""{COLOUR}, s as (select recording, i, case when discount > 0 then r end as r, case when discount > 0 then g end as g, case when discount > 0 then b end as b from colour),
 l as (select *, (abs(r - lag(r) over w) + abs(g - lag(g) over w) + abs(b - lag(b) over w)) / 3 / 255 as step,
  (abs(r - 2 * lag(r) over w + lag(r, 2) over w) + abs(g - 2 * lag(g) over w + lag(g, 2) over w) + abs(b - 2 * lag(b) over w + lag(b, 2) over w)) / 3 / 255 as bend from s window w as (partition by recording order by i))"""


@query("temporal_descriptors", f"with {STEP} select recording, count(step) as valid_adjacent_pairs, {R('median(step)')} as median_rgb_step, {R('max(step)')} as maximum_rgb_step, {R('median(bend)')} as flicker_proxy from l group by 1")
def temporal_descriptors(spark, d):
    ok = F.col("discount") > 0
    s = colour_samples(spark, d).select("recording", "i", *[F.when(ok, F.col(c)).alias(c) for c in "rgb"])
    h, w = halo(s, ["recording"], "i", 2, 0)
    back = lambda c, k: F.lag(c, k).over(w)
    step = sum(F.abs(F.col(c) - back(c, 1)) for c in "rgb") / 3 / 255
    bend = sum(F.abs(F.col(c) - 2 * back(c, 1) + back(c, 2)) for c in "rgb") / 3 / 255
    h = h.withColumns({"step": step, "bend": bend}).where("_own").select("recording", "step", "bend")
    long = h.unpivot("recording", ["step", "bend"], "kind", "v")
    a = long.groupBy("recording", "kind").agg(F.count("v").alias("n"), F.max("v").alias("top"))
    a = a.join(exact_quantiles(long, ["recording", "kind"], "v", {"med": .5}), ["recording", "kind"], "left")
    one = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    return a.groupBy("recording").agg(one("step", "n").alias("valid_adjacent_pairs"), rnd(one("step", "med")).alias("median_rgb_step"),
                                      rnd(one("step", "top")).alias("maximum_rgb_step"), rnd(one("bend", "med")).alias("flicker_proxy"))


@query("calibration_context", f"""with {COLOUR}, s as (select recording, i, discount > 0 and greatest(r, g, b) > 0 as good, r / (r + g + b) as cr, g / (r + g + b) as cg, b / (r + g + b) as cb from colour where i >= 64 and i < 192),
 l as (select *, (abs(cr - lag(cr) over w) + abs(cg - lag(cg) over w) + abs(cb - lag(cb) over w)) / 3 as motion, lag(good) over w as pg from s window w as (partition by recording order by i))
select recording, {', '.join(R(f'avg(case when good then {c} end)') + f' as mean_{c}, ' + R(f'stddev_pop(case when good then {c} end)') + f' as sd_{c}' for c in ('cr', 'cg', 'cb'))},
  {R('count_if(good) / count(*)')} as valid_fraction, {R('avg(case when good and pg then motion end)')} as motion, count_if(good) >= 2 as usable from l group by 1""")
def calibration_context(spark, d):
    s = colour_samples(spark, d).where((F.col("i") >= 64) & (F.col("i") < 192))
    total = F.col("r") + F.col("g") + F.col("b")
    s = s.select("recording", "i", ((F.col("discount") > 0) & (F.greatest("r", "g", "b") > 0)).alias("good"), *[(F.col(c) / total).alias(f"c{c}") for c in "rgb"])
    # the predeclared interval holds 128 samples per recording: adjacent pairs meet by index
    prev = s.select("recording", (F.col("i") + 1).alias("i"), F.col("good").alias("good_before"), *[F.col(f"c{c}").alias(f"p{c}") for c in "rgb"])
    s = s.join(prev, ["recording", "i"], "left")
    motion = sum(F.abs(F.col(f"c{c}") - F.col(f"p{c}")) for c in "rgb") / 3
    g = lambda c: F.when(F.col("good"), F.col(c))
    aggs = [x for c in ("cr", "cg", "cb") for x in (rnd(F.avg(g(c))).alias(f"mean_{c}"), rnd(F.stddev_pop(g(c))).alias(f"sd_{c}"))]
    return s.groupBy("recording").agg(*aggs, rnd(F.count_if("good") / F.count("*")).alias("valid_fraction"),
                                      rnd(F.avg(F.when(F.col("good") & F.col("good_before"), motion))).alias("motion"), (F.count_if("good") >= 2).alias("usable"))


@query("reconstruction_identity", f"""with {PAIRS}, c as (select vec_id, x, 0.5e0 * x as a, 0.25e0 * y as b, x - 0.5e0 * x - 0.25e0 * y as res from p)
select vec_id, {R('max(abs(a + b + res - x))')} as max_error, {R('sqrt(avg(a * a)) / sqrt(avg(x * x))')} as first_ratio, {R('sqrt(avg(b * b)) / sqrt(avg(x * x))')} as second_ratio, {R('sqrt(avg(res * res)) / sqrt(avg(x * x))')} as residual_ratio from c group by 1""")
def reconstruction_identity(spark, d):
    p = wave_pairs(spark, d)
    p = p.withColumns({"a": F.transform("x", lambda v: .5 * v), "b": F.transform("y", lambda v: .25 * v)})
    p = p.withColumn("res", F.zip_with("x", F.zip_with("a", "b", lambda u, v: u + v), lambda u, v: u - v))
    back = F.zip_with(F.zip_with("a", "b", lambda u, v: u + v), "res", lambda u, v: u + v)
    power = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return p.select("vec_id", rnd(F.array_max(F.zip_with(back, "x", lambda u, v: F.abs(u - v)))).alias("max_error"),
                    *[rnd(F.try_divide(power(c), power("x"))).alias(n) for c, n in (("a", "first_ratio"), ("b", "second_ratio"), ("res", "residual_ratio"))])


@query("block_medians", f"""with {COLOUR} select recording, i // 64 as block, count(*) as samples, {R('median(r)')} as r, {R('median(g)')} as g, {R('median(b)')} as b, count_if(discount > 0) / count(*) >= 0.9 as eligible from colour group by 1, 2""")
def block_medians(spark, d):
    s = colour_samples(spark, d)
    return s.groupBy("recording", F.floor(F.col("i") / 64).alias("block")).agg(
        F.count("*").alias("samples"), *[rnd(F.median(c)).alias(c) for c in "rgb"], (F.count_if(F.col("discount") > 0) / F.count("*") >= .9).alias("eligible"))
