"""Ordered operators that never put one whole key into one task.

A plain ``Window.partitionBy(recording)`` sends a recording to a single task.
Here a recording is cut into *buckets* (time spans or index blocks, a column
that is monotone in the order). Each operator works inside (key, bucket) and
then carries one small value per bucket along the key. The carried table has
one row per bucket, so its window per key stays small.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def _join_buckets(df, side, keys, bucket):
    return df.join(side, [*keys, bucket], "left")


def with_prev(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str,
              next_row: bool = False) -> DataFrame:
    """``lag(value)`` (or ``lead``) along each key. ``value`` must not be NULL (use a struct)."""
    step = F.lead if next_row else F.lag
    edge = F.min_by if next_row else F.max_by
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    ends = df.groupBy(*keys, bucket).agg(edge(value, F.struct(*order)).alias("_end"))
    ends = ends.select(*keys, bucket, step("_end").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_carry"))
    out = _join_buckets(df.withColumn(name, step(value).over(w)), ends, keys, bucket)
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def with_running(df: DataFrame, keys: list[str], bucket: str, order: list[str], inclusive: bool = True,
                 **values: tuple[Column, str]) -> DataFrame:
    """Running ``sum`` or ``max`` along each key, up to or before the row.

    ``values`` maps an output name to ``(column, "sum" | "max")``.
    """
    agg = {"sum": F.sum, "max": F.max}
    end = Window.currentRow if inclusive else -1
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(*[agg[how](c).alias(f"_t_{n}") for n, (c, how) in values.items()])
    totals = totals.select(*keys, bucket, *[agg[how](f"_t_{n}").over(before).alias(f"_c_{n}")
                                            for n, (_, how) in values.items()])
    out = _join_buckets(df.withColumns({n: agg[how](c).over(w) for n, (c, how) in values.items()}), totals, keys, bucket)
    merged = {}
    for n, (_, how) in values.items():
        here, carried = F.col(n), F.col(f"_c_{n}")
        merged[n] = (F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)) if how == "sum"
                     else F.coalesce(F.greatest(here, carried), here, carried))
    return out.withColumns(merged).drop(*[f"_c_{n}" for n in values])


def with_index(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "i") -> DataFrame:
    """Zero-based position of the row inside its key."""
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    out = _join_buckets(df.withColumn(name, F.row_number().over(w) - 1), sizes, keys, bucket)
    return out.withColumn(name, F.col(name) + F.col("_carry")).drop("_carry")


def with_place(df: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """``with_index`` for keys that are known to be small: one window, nothing carried."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def dealt(df: DataFrame, rows: int, *cols: str, per_task: int = 250_000) -> DataFrame:
    """Hash-partition into as many tasks as ``rows`` ask for, so that a task's share does not grow with the table."""
    return df.repartition(-(-rows // per_task) or 1, *cols)


def with_adjacent(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, before: str, after: str) -> DataFrame:
    """``lag`` and ``lead`` of a struct along each key from one window and one carried table."""
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    at = F.struct(*order)
    ends = df.groupBy(*keys, bucket).agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    wk = Window.partitionBy(*keys).orderBy(bucket)
    ends = ends.select(*keys, bucket, F.lag("_last").over(wk).alias("_p"), F.lead("_first").over(wk).alias("_n"))
    out = _join_buckets(df.withColumns({before: F.lag(value).over(w), after: F.lead(value).over(w)}), ends, keys, bucket)
    return out.withColumns({before: F.coalesce(before, "_p"), after: F.coalesce(after, "_n")}).drop("_p", "_n")


def halo(df: DataFrame, keys: list[str], index: str, back: int, ahead: int, block: int = 4096) -> tuple[DataFrame, WindowSpec]:
    """Copy the rows near block borders so that short frames over a dense index stay inside (key, block).

    Returns the copied rows and their ordered window; keep only rows where ``_own`` holds afterwards.
    """
    i = F.col(index)
    spread = F.array_distinct(F.transform(F.array(i - ahead, i, i + back), lambda v: F.floor(v / block)))
    d = df.withColumns({"_own_block": F.floor(i / block), "_block": F.explode(spread)})
    d = d.withColumn("_own", F.col("_block") == F.col("_own_block")).drop("_own_block")
    return d, Window.partitionBy(*keys, "_block").orderBy(index)


def islands(df: DataFrame, keys: list[str], index: str, flag: Column, chunk: int) -> DataFrame:
    """Maximal runs of equal ``flag`` over a dense integer index, as half-open [start, end).

    Runs are found per block of ``chunk`` rows; only runs touching a block
    border (two per block at most) are stitched along the key.
    """
    d = df.select(*keys, F.col(index).cast("long").alias("_i"), flag.alias("flag"))
    d = d.withColumn("_b", F.floor(F.col("_i") / chunk))
    w = Window.partitionBy(*keys, "_b").orderBy("_i")
    d = d.withColumn("_new", (~F.col("flag").eqNullSafe(F.lag("flag").over(w))
                              | F.lag("_i").over(w).isNull()).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w))
    runs = d.groupBy(*keys, "_b", "_run").agg(F.first("flag").alias("flag"), F.min("_i").alias("start"),
                                              (F.max("_i") + 1).alias("end"))
    runs = runs.withColumn("_edge", (F.col("start") == F.col("_b") * chunk) | (F.col("end") == (F.col("_b") + 1) * chunk))
    inner = runs.where(~F.col("_edge")).select(*keys, "flag", "start", "end")
    wk = Window.partitionBy(*keys).orderBy("start")
    edge = runs.where("_edge")
    glued = (F.lag("end").over(wk) == F.col("start")) & F.lag("flag").over(wk).eqNullSafe(F.col("flag"))
    edge = edge.withColumn("_new", F.when(glued, 0).otherwise(1))
    edge = edge.withColumn("_g", F.sum("_new").over(wk.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "_g").agg(F.first("flag").alias("flag"), F.min("start").alias("start"),
                                         F.max("end").alias("end"))
    return inner.unionByName(edge.select(*keys, "flag", "start", "end"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 20000,
                    small: int = 100_000) -> DataFrame:
    """Exact linear-interpolated quantiles per key without sorting a large key in one task.

    A mergeable sketch brackets each wanted rank (rank error at most n / accuracy,
    bracket four times as wide). One more pass counts the rows below the bracket
    and the distinct values inside it, and the ranks are read off those counts.
    Keys of at most ``small`` rows are bracketed by their whole range.
    Keys without a non-null value are absent from the result.
    """
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    margin = 4.0 / accuracy
    cuts = [c for p in probs.values() for c in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = d.groupBy(*keys).agg(F.percentile_approx("_v", cuts, accuracy).alias("_cut"), F.count(F.lit(1)).alias("_n"))
    large = F.col("_n") > small
    none = F.lit(None).cast("double")
    wants = []
    for i, (name, p) in enumerate(probs.items()):
        lo = F.when(large, F.col("_cut")[2 * i]) if p > margin else none
        hi = F.when(large, F.col("_cut")[2 * i + 1]) if p < 1 - margin else none
        wants.append(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), lo.alias("lo"), hi.alias("hi")))
    j = d.join(sketch, keys).select(*keys, "_n", "_v", F.explode(F.array(*wants)).alias("_w"))
    j = j.where(F.col("_w.hi").isNull() | (F.col("_v") <= F.col("_w.hi")))
    inside = F.when(F.col("_w.lo").isNull() | (F.col("_v") >= F.col("_w.lo")), F.col("_v"))
    counts = j.groupBy(*keys, F.col("_w.name").alias("_name"), F.col("_w.p").alias("_p"), "_n", inside.alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "_name").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_c").over(w), F.lit(0)), "_pos": F.col("_p") * (F.col("_n") - 1)})

    def at(rank):
        return F.max(F.when((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_c")), F.col("_v")))

    pairs = counts.groupBy(*keys, "_name", "_pos").agg(at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_z"))
    q = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    return pairs.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, q)).alias(n) for n in probs])


def with_rank(df: DataFrame, keys: list[str], value: str, tie: str, name: str = "rank", descending: bool = True,
              bins: int = 64, rows: int | None = None) -> DataFrame:
    """One-based rank per key by ``value`` then ascending ``tie``; rows with NULL value get NULL.

    Bins carry the number of rows ahead of them. Their borders come from a mergeable
    sketch of each key, so outliers and heavy tails leave them even. A bin that holds
    one single value is cut again along the tie column, so equal scores do not pile up in one task.
    With ``rows``, the number of rows, the bins are dealt over as many tasks as they ask for.
    """
    live, dead = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    s = live.withColumn("_s", F.col(value).cast("double") * (-1.0 if descending else 1.0))
    cuts = [k / bins for k in range(1, bins)]
    span = s.groupBy(*keys).agg(F.percentile_approx("_s", cuts, 20 * bins).alias("_cut"), F.min(tie).alias("_tlo"), F.max(tie).alias("_thi"))

    def bin_of(c, lo, hi):
        raw = F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins)
        return F.when(F.col(hi) > F.col(lo), F.least(F.lit(bins - 1), raw)).otherwise(0).cast("int")

    # number of borders below the value by halving: a comparison a step, all in generated code
    s = s.join(span, keys).withColumns({"_bin": F.lit(0), "_sub": bin_of(tie, "_tlo", "_thi")})
    for step in (1 << k for k in reversed(range(bins.bit_length()))):
        s = s.withColumn("_bin", F.col("_bin") + F.when(F.get("_cut", F.col("_bin") + (step - 1)) < F.col("_s"), step).otherwise(0))
    s = s.drop("_cut", "_tlo", "_thi")
    cells = s.groupBy(*keys, "_bin", "_sub").agg(F.count(F.lit(1)).alias("_c"), F.min("_s").alias("_a"), F.max("_s").alias("_z"))
    wb = Window.partitionBy(*keys, "_bin")
    cells = cells.withColumn("_cell", F.when(F.min("_a").over(wb) == F.max("_z").over(wb), F.col("_sub")).otherwise(0))
    ahead = Window.partitionBy(*keys).orderBy("_bin", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
    cells = cells.withColumn("_before", F.min("_ahead").over(Window.partitionBy(*keys, "_bin", "_cell")))
    s = s.join(cells.select(*keys, "_bin", "_sub", "_cell", "_before"), [*keys, "_bin", "_sub"])
    if rows:
        s = dealt(s, rows, *keys, "_bin", "_cell")
    rn = F.row_number().over(Window.partitionBy(*keys, "_bin", "_cell").orderBy("_s", tie))
    out = s.withColumn(name, (rn + F.col("_before")).cast("long")).drop("_s", "_bin", "_sub", "_cell", "_before")
    return out.unionByName(dead.withColumn(name, F.lit(None).cast("long")))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition into the session's full number of shuffle partitions.

    Python groups cost far more than their bytes suggest, so they must not be coalesced by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
