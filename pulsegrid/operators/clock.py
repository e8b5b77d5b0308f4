"""Clocks, grids, bounded resampling, runs and windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.cols import finite
from pulsegrid.operators.carry import dealt, islands, with_adjacent, with_prev, with_running

EXACT = 1e-8
DENSE = 1_000_000        # rows of a key, samples and points, from which it is no longer left to one task


def explode_ids(df: DataFrame, keys: list[str], count: Column, name: str, chunk: int = 4096, per_task: int = 250_000) -> DataFrame:
    """Rows 0..count-1 per input row, in blocks of ``chunk`` dealt over as many tasks as there are ``per_task`` rows to come.

    The number of tasks is given: by their bytes the blocks, which are small before they are unfolded, would be coalesced into one.
    """
    d = df.withColumn("_n", count.cast("long")).where(F.col("_n") > 0)
    rows = d.agg(F.sum("_n")).first()[0] or 0
    d = d.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    d = d.repartition(-(-rows // per_task) or 1, *keys, "_c")
    last = F.least(F.col("_n"), (F.col("_c") + 1) * chunk) - 1
    return d.withColumn(name, F.explode(F.sequence(F.col("_c") * chunk, last))).drop("_n", "_c")


def bounds(samples: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Per key: first and last time, and the size of the shared grid."""
    b = samples.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return b.withColumn("n", (F.floor((F.col("t1") - F.col("t0")) * fs + EXACT) + 1).cast("long"))


def shared_grid(samples: DataFrame, keys: list[str], fs: float, within: DataFrame | None = None) -> DataFrame:
    """Uniform grid ``t0 + k / fs`` from the first to the last original time; with ``within`` (a row of times ``a`` and ``b`` per key) only
    points from ``a`` to ``b``. Those are joined before the grid is unfolded: afterwards it passes for small, and is broadcast whole."""
    b = bounds(samples, keys, fs)
    g = explode_ids(b if within is None else b.join(within, keys), keys, F.col("n"), "k").withColumn("t", F.col("t0") + F.col("k") / F.lit(fs))
    return (g if within is None else g.where("t between a and b")).select(*keys, "k", "t")


def grid_size(samples: DataFrame, keys: list[str], fs: float) -> tuple[int, int]:
    """Samples and points of the shared grid: of all keys, and of the largest."""
    b = bounds(samples, keys, fs).join(samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")), keys).select((F.col("n") + F.col("_c")).alias("n"))
    return tuple(v or 0 for v in b.agg(F.sum("n"), F.max("n")).first())


def bucket_width(samples: DataFrame, keys: list[str], widest: float, target: int = 2_000_000, cells: int = 1024) -> float:
    """Time-bucket width for the ordered operators: ``widest``, or less when some key is dense.

    Counts the densest (key, widest / cells) cell and allows about ``target`` rows per bucket.
    """
    cell = widest / cells
    n = samples.groupBy(*keys, F.floor(F.col("t") / cell)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return widest if not n else cell * max(1, min(cells, target // n))


def neighbours(samples: DataFrame, points: DataFrame, keys: list[str], payload: list[str], bucket_sec: float,
               size: tuple[int, int] | None = None) -> DataFrame:
    """Attach to each point the nearest sample before (``lo``) and at or after (``hi``) it, over any distance.

    One window per (key, time bucket) does the two-sided as-of; a bucket only needs
    the last sample before it and the first one after it, which are carried along
    the key. No sample is copied and nothing is range-joined.
    With ``size`` (rows of all keys and of the largest, as ``grid_size`` counts them) the rows are dealt over as many tasks as they ask for,
    and keys that are all small stay whole: what follows by key finds its rows in place.
    """
    pair = F.struct("t", *payload)
    s = samples.select(*keys, "t", pair.alias("_p"), F.lit(1).alias("_src"))
    u = points.withColumn("_src", F.lit(0)).unionByName(s, allowMissingColumns=True)
    if size and size[1] <= DENSE:
        over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY t, _src)"
        u = dealt(u, size[0], *keys)
        return u.withColumns({"lo": F.expr(f"lag(_p) IGNORE NULLS {over}"), "hi": F.expr(f"lead(_p) IGNORE NULLS {over}")}).where("_src = 0").drop("_src", "_p")
    u = u.withColumn("_b", F.floor(F.col("t") / bucket_sec))
    ends = u.groupBy(*keys, "_b").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    per_key = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY _b)"
    ends = ends.select(*keys, "_b", F.expr(f"lag(_last) IGNORE NULLS {per_key}").alias("_lo"), F.expr(f"lead(_first) IGNORE NULLS {per_key}").alias("_hi"))
    over = f"OVER (PARTITION BY {', '.join(keys)}, _b ORDER BY t, _src)"
    if size:
        u = dealt(u, size[0], *keys, "_b")
    u = u.withColumns({"lo": F.expr(f"lag(_p) IGNORE NULLS {over}"), "hi": F.expr(f"lead(_p) IGNORE NULLS {over}")}).where("_src = 0")
    u = u.join(ends, [*keys, "_b"], "left")
    return u.withColumns({"lo": F.coalesce("lo", "_lo"), "hi": F.coalesce("hi", "_hi")}).drop("_src", "_b", "_p", "_lo", "_hi")


def bounded_resample(samples: DataFrame, grid: DataFrame, keys: list[str], channels: list[str], max_gap: float,
                     bucket_sec: float, size: tuple[int, int] | None = None) -> DataFrame:
    """Linear interpolation inside gaps of at most ``max_gap``; no extrapolation; ``imputed`` flag."""
    good = samples.where(F.col("valid"))
    for c in channels:
        good = good.where(finite(c))
    u = neighbours(good, grid.select(*keys, "k", "t"), keys, channels, bucket_sec, size)
    t, lo, hi = F.col("t"), F.col("lo"), F.col("hi")
    at_next = hi["t"] - t <= EXACT
    at_end = hi.isNull() & (t - lo["t"] <= EXACT)
    inside = hi["t"] - lo["t"] <= max_gap + EXACT
    a = (t - lo["t"]) / (hi["t"] - lo["t"])
    values = {c: F.when(at_next, hi[c]).when(at_end, lo[c])
              .when(inside, lo[c] * (1 - a) + hi[c] * a) for c in channels}
    imputed = F.coalesce(~F.coalesce(at_next, F.lit(False)) & inside, F.lit(False))
    return u.select(*keys, "k", "t", *[v.alias(c) for c, v in values.items()], imputed.alias("imputed"))


def resample_unbounded(samples: DataFrame, points: DataFrame, keys: list[str], channel: str, bucket_sec: float,
                       extrapolate: bool = True) -> DataFrame:
    """Linear interpolation over any gap, extrapolating from the end pair; duplicate times keep the first.

    Samples carry their successor; the last sample before each point is a running
    maximum along the key, so gaps of any length need no range join.
    """
    b = F.floor(F.col("t") / bucket_sec)
    s = samples.where(finite("t") & finite(channel)).withColumn("_b", b)
    s = with_prev(s, keys, "_b", ["t", "event_id"], F.struct("t"), "_prev")
    s = s.where(F.col("_prev").isNull() | (F.col("t") - F.col("_prev.t") > 1e-9)).drop("_prev")
    pair = F.struct(F.col("t"), F.col(channel).alias("v"))
    s = with_adjacent(s, keys, "_b", ["t"], pair, "_prev", "_next")
    # the segment to use at or after a sample: to the next one, or the last pair again
    seg = F.when(F.col("_next").isNotNull(), F.struct(F.col("t").alias("at"), pair.alias("p"), F.col("_next").alias("q"))) \
        .otherwise(F.struct(F.col("t").alias("at"), F.col("_prev").alias("p"), pair.alias("q")))
    s = s.withColumn("_seg", seg)
    head = s.where(F.col("_prev").isNull()).select(*keys, F.struct(pair.alias("p"), F.col("_next").alias("q")).alias("_head"))
    u = points.withColumns({"_src": F.lit(1), "_b": b}).unionByName(
        s.select(*keys, "t", "_b", "_seg", F.lit(0).alias("_src")), allowMissingColumns=True)
    u = with_running(u, keys, "_b", ["t", "_src"], _seg_now=(F.col("_seg"), "max"))
    u = u.where("_src = 1").join(head, keys, "left")
    p = F.coalesce(F.col("_seg_now.p"), F.col("_head.p"))
    q = F.coalesce(F.col("_seg_now.q"), F.col("_head.q"))
    slope = (q["v"] - p["v"]) / (q["t"] - p["t"])
    value = p["v"] + slope * (F.col("t") - p["t"])
    return u.withColumn("value", value).drop("_src", "_b", "_seg", "_seg_now", "_head")


def valid_runs(uniform: DataFrame, keys: list[str], flag: Column, chunk: int = 65536) -> DataFrame:
    """Half-open index pairs of the runs on which ``flag`` holds."""
    return islands(uniform, keys, "k", flag, chunk).where("flag").select(*keys, "start", "end")


def sliding_windows(sizes: DataFrame, keys: list[str], length: int, stride: int) -> DataFrame:
    """Full windows [start, end) over n samples, one row each."""
    n = F.when(F.col("n") >= length, F.floor((F.col("n") - length) / stride) + 1).otherwise(0)
    w = explode_ids(sizes.select(*keys, "n"), keys, n, "window_index")
    return w.select(*keys, "window_index", (F.col("window_index") * stride).alias("start"),
                    (F.col("window_index") * stride + length).alias("end"))


def assign_windows(df: DataFrame, position: Column, length: Column | float, stride: Column | float,
                   name: str = "window_index") -> DataFrame:
    """Copy each row into every half-open window [w*stride, w*stride+length) that holds ``position``."""
    first = F.greatest(F.lit(0), F.floor((position - length) / stride) + 1).cast("long")
    last = F.floor(position / stride).cast("long")
    ids = F.when(last >= first, F.sequence(first, last))
    return df.withColumn(name, F.explode(ids))


def sample_phase(samples: DataFrame, events: DataFrame, keys: list[str], guard: float | Column | dict[str, float], bucket_sec: float,
                 size: tuple[int, int] | None = None) -> DataFrame:
    """Protocol masks per sample by a sweep over interval borders instead of a range join.

    Borders add or remove one from running counts; a missing end never closes.
    With several named guards one sweep over the samples serves them all, and each mask is a struct of its values by name.
    With ``size`` (as ``grid_size`` counts) keys that are all small stay whole: samples dealt by it are swept where they are.
    """
    a, b, no_start = F.col("start_sec"), F.col("end_sec"), F.lit(float("-inf"))
    guards = guard if isinstance(guard, dict) else {"": guard}

    def border(t, **counts):
        of = [*[f"{c}{n}" for n in guards for c in ("_g", "_u")], "_a"]
        return F.struct(t.alias("t"), *[F.lit(counts.get(c, 0)).alias(c) for c in of])

    def each(*borders):
        return [border(at(g), **{f"{c}{n}": step}) for n, g in guards.items() for c, at, step in borders]

    closed = F.array(border(a, _a=1), border(b, _a=-1), *each(("_g", lambda g: a - g, 1), ("_g", lambda g: b + g, -1)))
    marks = F.when(a.isNull() & b.isNull(), F.array(*each(("_u", lambda g: no_start, 1)))) \
        .when(a.isNull(), F.array(*each(("_u", lambda g: no_start, 1), ("_u", lambda g: b + g + 1e-9, -1)))) \
        .when(b.isNull(), F.array(*each(("_u", lambda g: a - g, 1)))).otherwise(closed)
    borders = events.select(*keys, F.col("timing_verified").alias("_v"), F.inline(marks)).withColumn("_src", F.lit(0))
    counts = ["_a", *[f"{c}{n}" for n in guards for c in ("_g", "_u")]]
    u = samples.withColumn("_src", F.lit(1))
    if size and size[1] <= DENSE:
        u = u.unionByName(dealt(borders, size[0], *keys), allowMissingColumns=True)      # both sides lie by key: no row moves
        w = Window.partitionBy(*keys).orderBy("t", "_src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        u = u.withColumns({f"_n{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts} | {"_ok": F.bool_and("_v").over(Window.partitionBy(*keys))})
        u = u.where("_src = 1").drop("_v")
    else:
        u = u.unionByName(borders.drop("_v"), allowMissingColumns=True)
        u = u.withColumn("_b", F.floor(F.greatest(F.col("t"), F.lit(-1e15)) / bucket_sec))
        u = with_running(u, keys, "_b", ["t", "_src"], **{f"_n{c}": (F.col(c), "sum") for c in counts}).where("_src = 1").drop("_b")
        u = u.join(events.groupBy(*keys).agg(F.bool_and(F.col("timing_verified")).alias("_ok")), keys, "left")
    active, ok = F.col("_n_a") > 0, F.coalesce(F.col("_ok"), F.lit(True))

    def masks(n):
        guarded, unknown = F.col(f"_n_g{n}") > 0, F.col(f"_n_u{n}") > 0
        return {"cuff_active": active, "cuff_boundary_guard": guarded & ~active,
                "candidate_cuff_free": ~(guarded | unknown),
                "verified_cuff_free": ~(guarded | unknown) & ok, "timing_uncertain": unknown | ~ok}

    named = {n: masks(n) for n in guards}
    out = masks("") if "" in guards else {c: F.struct(*[named[n][c].alias(n) for n in guards]) for c in masks(next(iter(guards)))}
    return u.withColumns(out).drop("_src", "_ok", *counts, *[f"_n{c}" for c in counts])


def phase_label() -> Column:
    """1 active, 2 boundary guard, 0 free, 3 unknown."""
    return F.when(F.col("cuff_active"), 1).when(F.col("cuff_boundary_guard"), 2) \
        .when(F.col("candidate_cuff_free"), 0).otherwise(3)


def interval_union(intervals: DataFrame, keys: list[str], bucket_sec: float) -> DataFrame:
    """Measure of the union of half-open intervals per key."""
    d = intervals.withColumn("_b", F.floor(F.col("start_sec") / bucket_sec))
    d = with_running(d, keys, "_b", ["start_sec", "end_sec"], inclusive=False, _seen=(F.col("end_sec"), "max"))
    fresh = F.greatest(F.lit(0.0), F.col("end_sec") - F.greatest(F.col("start_sec"), F.col("_seen")))
    return d.groupBy(*keys).agg(F.sum(fresh).alias("union_sec"), F.count(F.lit(1)).alias("intervals"))


def interval_complement(blocked: DataFrame, extent: DataFrame, keys: list[str], bucket_sec: float) -> DataFrame:
    """Free intervals of [t0, t1] left by blocked intervals, clipped to the extent."""
    d = blocked.join(extent, keys)
    d = d.withColumns({"a": F.greatest("t0", F.coalesce("start_sec", "t0")), "b": F.least("t1", F.coalesce("end_sec", "t1"))})
    d = d.withColumn("_b", F.floor(F.col("a") / bucket_sec))
    d = with_running(d, keys, "_b", ["a", "b"], inclusive=False, _seen=(F.col("b"), "max"))
    gaps = d.select(*keys, F.greatest("t0", F.coalesce("_seen", "t0")).alias("start_sec"), F.col("a").alias("end_sec"))
    ends = blocked.join(extent, keys).groupBy(*keys).agg(
        F.max(F.least("t1", F.coalesce("end_sec", "t1"))).alias("_m"))
    tail = extent.join(ends, keys, "left").select(
        *keys, F.greatest("t0", F.coalesce("_m", "t0")).alias("start_sec"), F.col("t1").alias("end_sec"))
    return gaps.unionByName(tail).where("end_sec > start_sec")
