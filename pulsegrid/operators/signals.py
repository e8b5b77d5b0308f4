"""Long-run filtering, splines and rate change.

A run without gaps can be as long as a recording, so it is cut into blocks. Recursive
filters and splines hand small states from block to block (``scan``) and equal one pass
at any block size; moving averages read their neighbours.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.operators import scan
from pulsegrid.operators.carry import dealt, halo as halo_rows, with_prev, with_running
from pulsegrid.operators.clock import DENSE, EXACT
from pulsegrid.session import checkpointed


def label_runs(df: DataFrame, keys: list[str], index: str, valid: Column, chunk: int, keep_invalid: bool = False,
               size: tuple[int, int] | None = None) -> DataFrame:
    """Valid rows of a dense index with their ``run`` (its first index) and ``run_size``.

    ``keep_invalid`` also returns the invalid rows, with both columns NULL. With ``size`` (rows of all keys and of the largest) small keys
    stay whole: nothing is joined by bucket, so rows that are dealt by key stay where they are.
    """
    if size and size[1] <= DENSE:
        w = Window.partitionBy(*keys).orderBy(index)
        d = df.withColumn("_ok", valid).withColumn("_p", F.lag(F.struct(F.col("_ok").alias("ok"), F.col(index).alias("i"))).over(w))
        new = F.col("_ok") & ~F.coalesce(F.col("_p.ok") & (F.col("_p.i") == F.col(index) - 1), F.lit(False))
        d = d.withColumn("run", F.max(F.when(new, F.col(index))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        d = d.withColumn("run", F.when(F.col("_ok"), F.col("run"))).drop("_ok", "_p")
        d = d.withColumn("run_size", F.when(F.col("run").isNotNull(), F.count(F.lit(1)).over(Window.partitionBy(*keys, "run"))))
        return checkpointed(d if keep_invalid else d.where("run is not null"))
    d = df.withColumns({"_ok": valid, "_b": F.floor(F.col(index) / chunk)})
    d = with_prev(d, keys, "_b", [index], F.struct(F.col("_ok").alias("ok"), F.col(index).alias("i")), "_p")
    new = F.col("_ok") & ~F.coalesce(F.col("_p.ok") & (F.col("_p.i") == F.col(index) - 1), F.lit(False))
    d = with_running(d, keys, "_b", [index], run=(F.when(new, F.col(index)), "max"))
    d = d.withColumn("run", F.when(F.col("_ok"), F.col("run"))).drop("_ok", "_p", "_b")
    d = checkpointed(d if keep_invalid else d.where("run is not null"))          # callers read the labelled rows several times
    size = d.where("run is not null").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("run_size"))
    return d.join(size, [*keys, "run"], "left" if keep_invalid else "inner")


def halo_blocks(df: DataFrame, group: list[str], position: Column, size: Column | None, block: int, halo: int,
                payload: list[str]) -> DataFrame:
    """Ordered arrays per (group, block) holding the block's samples and ``halo`` neighbours on each side.

    ``own`` marks the block's own samples. ``size`` (last position + 1) folds a short last block into its neighbour.
    """
    d = df.withColumn("_i", position.cast("long"))
    blocks = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_i") - halo) / block)), F.floor((F.col("_i") + halo) / block))
    d = d.withColumn("block", F.explode(blocks))
    if size is not None:
        d = d.where(F.col("block") <= F.greatest(F.lit(0), F.floor((size - 1) / block)))
    d = d.withColumn("own", F.floor(F.col("_i") / block) == F.col("block"))
    g = d.groupBy(*group, "block").agg(F.array_sort(F.collect_list(F.struct("_i", "own", *payload))).alias("_s"))
    return g.where(F.exists("_s", lambda s: s["own"]))


def filter_runs(df: DataFrame, group: list[str], column: str, name: str, fs: float, low: float, high: float, order: int = 3, block: int = 8192) -> DataFrame:
    """Zero-phase band-pass of every run (rows: group, ``j`` position in run, ``run_size``, column), exact at any ``block`` (``scan``).

    True run ends use the odd extension of the one-pass filter; runs too short to extend are NULL.
    """
    edge = 3 * (2 * order + 1)
    return scan.filter_runs(df, group, column, name, kn.bandpass_sections(low, high, fs, order), edge, max(block, edge + 1))


def segment_signal(samples: DataFrame, keys: list[str], fs: float, low: float, high: float, min_samples: int, edge: int, valid: Column,
                   channel: str = "g", chunk: int = 65536, block: int = 8192, halo: int | None = None,
                   size: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Centre, band-pass and edge-blank every run of a dense index ``k``; nothing crosses a gap. ``halo`` is not needed any more.
    With ``size`` (rows of all keys and of the largest) runs of small keys are dealt over tasks by their rows.

    Returns (signal rows with NULL outside the retained part, run table with the reason a run failed).
    """
    r = label_runs(samples, keys, "k", valid, chunk, keep_invalid=True, size=size)
    group = [*keys, "run"]
    long_enough = F.coalesce((F.col("run_size") >= min_samples) & (F.col("run_size") > 2 * edge), F.lit(False))
    runs = r.where("run is not null").groupBy(*group).agg(F.first("run_size").alias("run_size"), F.avg(channel).alias("_mean"))
    runs = runs.withColumn("reason", F.when(long_enough, "").otherwise("insufficient_duration"))
    if size and size[1] <= DENSE:
        live = dealt(r.where(long_enough), size[0], *group).withColumn("_mean", F.avg(channel).over(Window.partitionBy(*group)))
    else:
        live = r.where(long_enough).join(runs.select(*group, "_mean"), group)
    live = live.withColumns({"_x": F.col(channel) - F.col("_mean"), "j": F.col("k") - F.col("run")})
    y = filter_runs(live, [*group, "run_size"], "_x", "_y", fs, low, high, block=block)
    kept = (F.col("j") >= edge) & (F.col("j") < F.col("run_size") - edge)
    y = y.select(*keys, "k", "run", F.when(kept, F.col("_y")).alias("signal"))
    # rows outside every usable run stay, without a value
    rest = r.where(~long_enough).select(*keys, "k", "run", F.lit(None).cast("double").alias("signal"))
    return y.unionByName(rest), runs.drop("_mean")


def _spline_blocks(samples: DataFrame, keys: list[str], channel: str, max_gap: float, bucket_sec: float, block: int,
                   size: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples with their ``run``, its size and their place ``j`` in it; and its blocks of knots with the derivatives next to them.

    With ``size`` (samples of all keys and of the largest) keys that are all small stay whole, dealt by the number of samples.
    """
    if size and size[1] <= DENSE:
        w = Window.partitionBy(*keys).orderBy("t")
        s = dealt(samples, size[0], *keys).withColumn("_p", F.lag("t").over(w))
        new = F.col("_p").isNull() | (F.col("t") - F.col("_p") > max_gap + 1e-8)
        s = s.withColumn("run", F.max(F.when(new, F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_p")
        s = s.withColumn("run_size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
    else:
        s = samples.withColumn("_b", F.floor(F.col("t") / bucket_sec))
        s = with_prev(s, keys, "_b", ["t"], F.struct("t"), "_p")
        new = F.col("_p").isNull() | (F.col("t") - F.col("_p.t") > max_gap + 1e-8)
        s = checkpointed(with_running(s, keys, "_b", ["t"], run=(F.when(new, F.col("i")), "max")).drop("_p", "_b"))
        s = s.join(s.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("run_size")), [*keys, "run"])
    s = s.withColumn("j", F.col("i") - F.col("run"))
    knots = halo_blocks(s, [*keys, "run", "run_size"], F.col("j"), F.col("run_size"), block, 1, ["t", channel])
    knots = checkpointed(knots.select(*keys, "run", "run_size", "block", F.col("_s.t").alias("kt"), F.col(f"_s.{channel}").alias("kx"),
                                      (~F.element_at("_s", 1)["own"]).alias("left"), (~F.element_at("_s", -1)["own"]).alias("right")))
    borders = scan.spline_borders(knots.where(F.col("run_size") > block), [*keys, "run"])
    return s, knots.join(checkpointed(borders), [*keys, "run", "block"], "left").fillna(0.0, ["before", "behind"])


def with_moments(samples: DataFrame, keys: list[str], channel: str, max_gap: float, bucket_sec: float, block: int = 256,
                 size: tuple[int, int] | None = None) -> DataFrame:
    """Samples (keys, ``t``, channel) with ``run``, ``run_size`` and ``m``, the second derivative of their run's natural cubic spline; exact at any ``block``."""
    _, knots = _spline_blocks(samples, keys, channel, max_gap, bucket_sec, block, size)
    types = dict(knots.dtypes)

    def run(batches):
        for pdf in batches:
            ends = pdf[["left", "right", "before", "behind"]].itertuples(index=False)
            m = [scan.spline_moments(np.array(t, float), np.array(x, float), *e) for t, x, e in zip(pdf["kt"], pdf["kx"], ends)]
            own = [slice(int(a), len(t) - int(b)) for t, a, b in zip(pdf["kt"], pdf["left"], pdf["right"])]
            yield pdf[[*keys, "run", "run_size"]].assign(t=[t[o] for t, o in zip(pdf["kt"], own)], x=[x[o] for x, o in zip(pdf["kx"], own)], m=m)

    schema = ", ".join(f"{g} {types[g]}" for g in [*keys, "run", "run_size"]) + ", t array<double>, x array<double>, m array<double>"
    d = knots.mapInPandas(run, schema).select(*keys, "run", "run_size", F.inline(F.arrays_zip("t", "x", "m")))
    return checkpointed(d.withColumnRenamed("x", channel))


def spline_between(t: Column, lo: Column, hi: Column, channel: str, max_gap: float) -> Column:
    """Bounded cubic value at ``t`` from the samples around it (``with_moments``): NULL in a wide gap, linear in a run of fewer than three samples."""
    exact = hi["t"] - t <= EXACT
    h, a, b = hi["t"] - lo["t"], hi["t"] - t, t - lo["t"]
    share = b / h
    linear = F.when(exact, hi[channel]).when(h <= max_gap + EXACT, lo[channel] * (1 - share) + hi[channel] * share)
    curve = ((lo["m"] * a * a * a + hi["m"] * b * b * b) / (6 * h) + (lo[channel] / h - lo["m"] * h / 6) * a + (hi[channel] / h - hi["m"] * h / 6) * b)
    alone = exact & ~F.coalesce(lo["run"] == hi["run"], F.lit(False))             # at the first sample of a run
    return F.when(linear.isNull() | alone | (F.when(exact, hi["run_size"]).otherwise(lo["run_size"]) < 3), linear).otherwise(curve)


def bounded_cubic(samples: DataFrame, points: DataFrame, keys: list[str], channel: str, max_gap: float, bucket_sec: float,
                  block: int = 256, halo: int | None = None) -> DataFrame:
    """Natural cubic spline inside runs whose gaps stay within ``max_gap``, exact at any ``block``: blocks of a run are joined by the small system
    of their borders (``scan``). ``halo`` is not needed any more.

    ``points`` carry ``lo_i``, the index of the sample before them, and ``linear``,
    the bounded linear value that also decides support. A run of fewer than three
    samples keeps the linear value.
    """
    s, knots = _spline_blocks(samples, keys, channel, max_gap, bucket_sec, block)
    owner = s.select(*keys, F.col("i").alias("lo_i"), "run", F.floor(F.col("j") / block).alias("block"))
    at = points.where("linear is not null").join(owner, [*keys, "lo_i"])
    at = at.withColumn("part", F.floor(F.col("k") / 4096))
    at = at.groupBy(*keys, "run", "block", "part").agg(F.collect_list(F.struct("k", "t", "linear")).alias("p"))
    j = at.join(knots, [*keys, "run", "block"])
    j = j.select(*keys, "kt", "kx", "left", "right", "before", "behind", "run_size", F.col("p.k").alias("k"), F.col("p.t").alias("t"), F.col("p.linear").alias("linear"))
    types = dict(j.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = row._asdict()
                t, x, at = (np.array(s[c], float) for c in ("kt", "kx", "t"))
                if s["run_size"] >= 3:
                    y = scan.spline_at(t, x, s["left"], s["right"], s["before"], s["behind"], np.clip(at, t[0], t[-1]))
                else:
                    y = np.array(s["linear"], float)
                out.append(pd.DataFrame({**{g: s[g] for g in keys}, "k": s["k"], "value": y}))
            yield pd.concat(out) if out else pd.DataFrame(columns=[*keys, "k", "value"])

    fitted = j.mapInPandas(run, ", ".join(f"{g} {types[g]}" for g in keys) + ", k long, value double")
    return points.select(*keys, "k").join(fitted, [*keys, "k"], "left")


def fir(df: DataFrame, keys: list[str], index: str, column: str, taps, name: str, block: int = 4096, size: tuple[int, int] | None = None) -> DataFrame:
    """Centred symmetric FIR over a dense index; NULL unless every tap has support. With ``size`` (rows of all keys and of the largest) small keys stay whole."""
    half = len(taps) // 2
    if size and size[1] <= DENSE:
        h, w = dealt(df, size[0], *keys).withColumns({"_own": F.lit(True), "_block": F.lit(0)}), Window.partitionBy(*keys).orderBy(index)
    else:
        h, w = halo_rows(df, keys, index, half, half, block)
    terms = [F.lag(column, half - j).over(w) if j < half else F.lead(column, j - half).over(w) if j > half else F.col(column) for j in range(len(taps))]
    return h.withColumn(name, sum(t * float(c) for t, c in zip(terms, taps))).where("_own").drop("_block", "_own")
