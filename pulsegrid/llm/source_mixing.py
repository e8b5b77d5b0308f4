"""Operator 10: mixing sources to target weights.

Each source gets a target of words (``targets``). A document is taken once per whole pass over its source, and once more if it lies in
the partial pass, which takes documents in a permuted order until the target is met. The permuted order of each source is cut into
blocks; a tree of multivariate hypergeometric draws splits the exact block quotas of all sources among the output shards, half of
the shards at a time; each shard then draws its blocks, disjoint from the others', from a permutation of the source's blocks, and
orders its documents by a hash.

Only one row per source passes the driver (at most ``MOST_SOURCES``, checked). Documents are never sorted or gathered by source: the cut
of the partial pass is found by two histograms of the permuting hash and an ordering of the few documents in one fine bin. All draws
hang on the seed and doc_id alone, so reruns agree.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, the last; null ids and repeated rows of
one id share a place in the permuted order and are taken or left together; an empty table gives no rows; other columns pass through.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.llm.registry import query, table
from pulsegrid.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
MOST_SOURCES = 10_000
MOST_REPEATS = 3
BLOCK_WORDS, SHARDS, SEED = 250_000, 64, 17
NARROW = "_source string, _size long, _h string"


def place(seed: int = SEED):
    """Position of a document in the permuted order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: weights 1, 2, 3, repeating by code point (null last); words shared by weight, no source above ``most`` times
    its size. A source is full if the words left by smaller ratios of capacity to weight would fill it."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    full = F.col("_size") * most
    d = sizes.withColumn("_w", (F.row_number().over(by_name) - 1) % 3 + 1)
    rising = Window.orderBy(full / F.col("_w"), F.col("_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    d = d.withColumn("_rest", F.sum("_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))).withColumn("_ws", F.sum("_w").over(after))
    d = d.withColumn("_full", F.col("_rest") * F.col("_w") >= full * F.col("_ws"))
    left = F.sum("_size").over(everything) - F.coalesce(F.sum(F.when(F.col("_full"), full)).over(everything), F.lit(0))
    share = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything), F.lit(1))
    d = d.withColumn("_left", left).withColumn("_share", share)
    return d.select("_source", "_size", F.when(F.col("_full"), full.cast("double")).otherwise((F.col("_left") * F.col("_w")).cast("double") / F.col("_share")).alias("_target"))


def cuts(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source with a partial pass, ``_cut``: the last permuted position that is taken (null: none).

    A position is taken if the words before it and half its own are within the rest of the target.
    """
    goals = goals.select(F.col("_source").alias("_s"), (F.col("_target") - F.floor(F.col("_target") / F.greatest("_size", F.lit(1))) * F.col("_size")).alias("_rest"))

    def run(rows: DataFrame, bin_at, last: bool) -> DataFrame:
        """Within what is left of each source: running words by bin; the bin that crosses the rest, or the last taken position."""
        bins = rows.groupBy("_s", "_rest", "_done", bin_at.alias("_bin")).agg(F.sum("_size").alias("_words"))
        before = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)       # at most 4096 bins a source
        bins = bins.withColumn("_before", F.col("_done") + F.coalesce(F.sum("_words").over(before), F.lit(0)))
        if last:
            return bins.where(2 * F.col("_before") + F.col("_words") <= 2 * F.col("_rest")).groupBy("_s").agg(F.max("_bin").alias("_fine"))
        return bins.where(F.col("_before") <= F.col("_rest")).groupBy("_s").agg(F.max(F.struct("_bin", "_before")).alias("m")).select(F.col("_s").alias("_t"), "m.*")

    def inside(rows: DataFrame, found: DataFrame, bin_at) -> DataFrame:
        small = F.broadcast(found)                                           # a row for each source
        got = rows.join(small, F.col("_s").eqNullSafe(F.col("_t")) & (bin_at == F.col("_bin")))
        return got.select("_s", "_rest", F.col("_before").alias("_done"), "_size", "_h")

    first, second = F.substring("_h", 1, 3), F.substring("_h", 1, 6)
    rows = narrow.join(F.broadcast(goals), F.col("_source").eqNullSafe(F.col("_s"))).select("_s", "_rest", F.lit(0).cast("long").alias("_done"), "_size", "_h")
    rows = rows.where("_rest > 0")
    coarse = checkpointed(run(rows, first, False))
    within = inside(rows, coarse, first)
    fine = checkpointed(run(within, second, False))
    last = run(inside(within, fine, second), F.col("_h"), True)
    # Where the crossing bin takes none of its documents, everything before the bin is taken.
    found = fine.join(last, F.col("_t").eqNullSafe(F.col("_s")), "left")
    return found.select(F.col("_t").alias("_cut_source"), F.coalesce("_fine", F.col("_bin")).alias("_cut"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: halves of the shards draw from the blocks of their node, down to single shards."""
    rng = np.random.default_rng(seed)
    total = int(quotas.sum())
    room = np.diff(np.arange(shards + 1) * total // shards)
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = counts
            return
        middle = (first + last) // 2
        left = rng.multivariate_hypergeometric(counts, int(room[first:middle].sum()), method="marginals")
        node(left, first, middle)
        node(counts - left, middle, last)

    node(quotas, 0, shards)
    return out


def mix_plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: size, target, whole passes, cut of the partial pass, blocks and where each shard's blocks begin."""
    spark: SparkSession = docs.sparkSession
    narrow = checkpointed(docs.select(F.col("source").cast("string").alias("_source"), word_count().alias("_size"), place(seed).alias("_h")))
    goals = checkpointed(targets(narrow.groupBy("_source").agg(F.sum("_size").alias("_size"))))
    plan = goals.join(cuts(narrow, goals), F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    rows = plan.orderBy(F.col("_source").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    passes = [int(r["_target"] // r["_size"]) if r["_size"] else 0 for r in rows]
    blocks = [max(1, math.ceil(r["_size"] / block_words)) for r in rows]
    quotas = np.array([p * n + (((int(r["_cut"].ljust(32, "0")[:8], 16) * n) >> 32) + 1 if r["_cut"] else 0) for r, p, n in zip(rows, passes, blocks)], np.int64)
    split = split_quotas(quotas, shards, seed)
    begins = np.cumsum(split, axis=0) - split
    out = []
    for k, (r, p, n, q) in enumerate(zip(rows, passes, blocks, quotas.tolist())):
        step = next(a for a in range(max(1, int(q * 0.618)), q + 2) if math.gcd(a, max(q, 1)) == 1)       # a permutation of the blocks
        out.append((r["_source"], int(r["_size"]), float(r["_target"]), p, r["_cut"], n, q, step, begins[:, k].tolist()))
    return spark.createDataFrame(out, "_source string, _source_size long, _target double, _passes int, _cut string, _blocks long, _quota long, _step long, _begins array<long>")


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def placed(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``row`` (a row of ``docs``) with ``places``, one (shard, order) for each time it is taken, and its source's figures. No shuffle."""
    d = docs.select(F.struct("*").alias("row"), word_count().alias("size"), place(seed).alias("_h"), F.col("source").cast("string").alias("_key"))
    d = d.join(F.broadcast(plan), F.col("_key").eqNullSafe(F.col("_source")), "left")                      # at most MOST_SOURCES rows
    partial = F.col("_cut").isNotNull() & (F.col("_h") <= F.col("_cut"))
    times = F.when(F.col("size") > 0, F.col("_passes") + partial.cast("int")).otherwise(0)
    block = F.shiftright(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.col("_blocks"), 32)

    def one(nth):
        at = ((nth * F.col("_blocks") + block) * F.col("_step")) % F.col("_quota")
        shard = F.size(F.filter("_begins", lambda b: b <= at)) - 1
        return F.struct(shard.alias("shard"), F.md5(F.concat_ws(":", F.col("_h"), nth)).alias("order"))

    places = F.when(times > 0, F.transform(F.sequence(F.lit(0), times - 1), one)).otherwise(F.array().cast("array<struct<shard:int,order:string>>"))
    return d.select("row", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), places.alias("places"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed documents: one row for each time a document is taken, dealt by shard (column ``_shard``) and shuffled inside each."""
    got = placed(docs, mix_plan(docs, shards, seed, block_words), seed)
    rows = got.select("row", F.explode("places").alias("place"))
    dealt = rows.repartition(shards, "place.shard").sortWithinPartitions("place.shard", "place.order")
    return dealt.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "_shard"], F.col("place.shard").alias("_shard"))


@query("op10_source_mixing", oracle="""
    with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
      md5('17:' || doc_id) as h from documents),
    s as (select source, sum(size)::bigint as size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
    r as (select *, sum(size) over () - coalesce(sum(3 * size) over (order by 3 * size / w, source rows between unbounded preceding and 1 preceding), 0) as rest,
      sum(w) over (order by 3 * size / w, source rows between current row and unbounded following) as ws from s),
    f as (select *, rest * w >= 3 * size * ws as capped from r),
    g as (select *, sum(size) over () - coalesce(sum(3 * size) filter (capped) over (), 0) as remaining, sum(w) filter (not capped) over () as share from f),
    t as (select source, size as source_size, case when capped then (3 * size)::double else (remaining * w)::double / share::double end as target from g),
    c as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1)) as passes,
      sum(d.size) over (partition by d.source order by d.h) - d.size as before from d join t on d.source is not distinct from t.source)
    select doc_id, size::bigint as size, source_size::bigint as source_size, target,
      (size * (passes + case when 2 * before + size <= 2 * (target - passes * source_size) and target > passes * source_size then 1 else 0 end))::bigint as taken from c""")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    got = placed(docs, mix_plan(docs))
    return got.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"))
