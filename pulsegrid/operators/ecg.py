"""R peaks and reference heart rates."""
from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.functions import kernels as kn
from pulsegrid.functions.batch import apply_kernel
from pulsegrid.functions.cols import finite
from pulsegrid.operators.carry import exact_quantiles, halo as halo_rows, with_prev, with_running
from pulsegrid.operators.clock import assign_windows, explode_ids
from pulsegrid.operators.signals import filter_runs, label_runs
from pulsegrid.session import checkpointed


def r_peaks(samples: DataFrame, key: str, fs: float, min_run_sec: float = 3.0, edge_sec: float = .25, block: int = 16384) -> DataFrame:
    """Peaks of the 5-20 Hz band per finite run: 300 ms apart, five times the local 8-s floor, three times the run's median high.

    ``samples``: (key, k dense index, x). Runs are filtered and searched in blocks; every step is exact across their borders.
    """
    runs = label_runs(samples, [key], "k", finite("x"), 65536)
    spread = runs.groupBy(key, "run").agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_sd"))
    live = runs.join(spread, [key, "run"]).where((F.col("run_size") >= fs * min_run_sec) & (F.col("_sd") >= 1e-10))
    live = live.select(key, "run", "run_size", "k", (F.col("k") - F.col("run")).alias("j"), (F.col("x") - F.col("_m")).alias("x0"))
    y = filter_runs(live, [key, "run"], "x0", "y", fs, 5.0, 20.0, block=block)
    y = y.join(live.select(key, "k", "run_size"), [key, "k"]).withColumn("a", F.abs("y")).where("a is not null")
    floor = y.groupBy(key, "run", F.floor(F.col("j") / int(8 * fs)).alias("part")).agg(F.greatest(F.median("a"), F.lit(1e-10)).alias("floor"))
    whole = exact_quantiles(y, [key, "run"], "a", {"med": .5})
    y = y.withColumn("part", F.floor(F.col("j") / int(8 * fs))).join(floor, [key, "run", "part"]).join(whole, [key, "run"])
    y = checkpointed(y.select(key, "run", "j", "k", "a", "floor", "med", "run_size"))
    edge, gap = edge_sec * fs, int(.30 * fs)
    top = thinned(local_maxima(y, [key, "run"], "j", "a", block).where("a >= 5 * floor"), [key, "run"], "j", "a", gap, block)
    tall = prominent(y, top.withColumn("least", 3 * F.col("med")), [key, "run"], "j", "a", block)
    return tall.where((F.col("j") >= edge) & (F.col("j") < F.col("run_size") - edge)).select(key, "k", (F.col("a") / F.col("floor")).alias("ratio"))


def local_maxima(samples: DataFrame, keys: list[str], index: str, value: str, block: int) -> DataFrame:
    """Rows of local maxima along dense runs; a flat top is its middle row. The first and last level of a run are none.

    Rows where the level changes are few; each meets the one before and behind it across any block border (``carry``).
    """
    at = F.struct(F.col(index).alias("i"), F.col(value).alias("v"))
    d = samples.withColumn("_b", F.floor(F.col(index) / block))
    d = with_prev(d, keys, "_b", [index], at, "_p")
    steps = checkpointed(d.where(F.col("_p").isNull() | (F.col("_p.v") != F.col(value))).select(*keys, "_b", index, value, F.col("_p.v").alias("_before")))
    steps = with_prev(steps, keys, "_b", [index], at, "_n", next_row=True)
    up, down = F.col("_before") < F.col(value), F.col("_n.v") < F.col(value)
    middle = F.floor((F.col(index) + F.col("_n.i") - 1) / 2)
    return samples.join(steps.where(up & down).select(*keys, middle.alias(index)), [*keys, index])


def thinned(peaks: DataFrame, keys: list[str], index: str, value: str, distance: int, block: int) -> DataFrame:
    """Peaks left when the highest goes first and takes all nearer than ``distance`` away; of equal ones the later goes first.

    Only a chain of peaks, each nearer than that to the next, can decide about one another. Chains are found across block borders as running
    maxima of their first places, and each is thinned by itself: a row per peak, whatever the samples between. A peak that nothing near
    it outranks stays for sure; that settles its neighbours and cuts the chains before any is gathered.
    """
    rank = lambda v, i: F.struct(v.alias("v"), i.alias("i"))
    d, w = halo_rows(peaks, keys, index, distance - 1, distance - 1, block)
    near = Window.partitionBy(*[c for c in d.columns if c in keys], "_block").orderBy(index).rangeBetween(1 - distance, distance - 1)
    best = F.max(rank(F.col(value), F.col(index))).over(near)
    d = checkpointed(d.withColumn("_sure", best["i"] == F.col(index)).where("_own").drop("_own", "_block"))
    sure = d.where("_sure")
    # what a sure peak takes is gone; the rest goes on in chains
    d, _ = halo_rows(d, keys, index, distance - 1, distance - 1, block)
    near = Window.partitionBy(*keys, "_block").orderBy(index).rangeBetween(1 - distance, distance - 1)
    left = d.withColumn("_taken", F.max("_sure").over(near)).where("_own and not _taken").drop("_own", "_block", "_taken", "_sure")
    left = with_prev(left.withColumn("_b", F.floor(F.col(index) / block)), keys, "_b", [index], F.struct(F.col(index).alias("i")), "_p")
    new = F.col("_p").isNull() | (F.col(index) - F.col("_p.i") >= distance)
    left = checkpointed(with_running(left, keys, "_b", [index], _chain=(F.when(new, F.col(index)), "max")).drop("_b", "_p"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([value, index], ascending=False, ignore_index=True)
        taken: list[int] = []                                           # kept places, ascending
        stay = np.zeros(len(pdf), bool)
        for n, i in enumerate(pdf[index].tolist()):
            p = bisect.bisect(taken, i)
            if (p == 0 or i - taken[p - 1] >= distance) and (p == len(taken) or taken[p] - i >= distance):
                taken.insert(p, i)
                stay[n] = True
        return pdf[stay]

    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_chain")) == 1
    left = left.withColumn("_alone", alone)
    fields = ", ".join(f"{c} {t}" for c, t in left.dtypes)
    chained = left.where("not _alone").groupBy(*keys, "_chain").applyInPandas(keep, fields)
    rest = left.where("_alone").unionByName(chained)
    return sure.drop("_sure").unionByName(rest.drop("_chain", "_alone"))


def prominent(samples: DataFrame, peaks: DataFrame, keys: list[str], index: str, value: str, block: int) -> DataFrame:
    """Peaks that stand out by ``least``: on both sides the signal falls that far below the peak before it rises above it, or the run ends
    without having risen.

    A side is decided by its nearest sample that has fallen or risen so far. Most peaks find it in their own block or a neighbour; the others
    meet the lowest and highest value of each block of their run, a row each, which name the one block that decides.
    """
    d = samples.select(*keys, F.col(index).alias("_j"), F.col(value).alias("_v")).withColumn("_b", F.floor(F.col("_j") / block))
    low, high = F.col("_v") <= F.col(value) - F.col("least"), F.col("_v") > F.col(value)
    before, behind = F.col("_j") < F.col(index), F.col("_j") > F.col(index)
    own = F.floor(F.col(index) / block)
    columns = peaks.columns

    def judged(p: DataFrame, blocks) -> DataFrame:
        look = p.select(*keys, index, value, "least", F.explode(F.array_distinct(F.array_compact(blocks))).alias("_b"))
        got = look.join(d, [*keys, "_b"]).groupBy(*keys, index).agg(
            F.max(F.when(before & low, F.col("_j"))).alias("_l"), F.max(F.when(before & high, F.col("_j"))).alias("_lh"),
            F.min(F.when(behind & low, F.col("_j"))).alias("_r"), F.min(F.when(behind & high, F.col("_j"))).alias("_rh"))
        return p.select(*columns).join(got, [*keys, index])

    fine = F.col("_l").isNotNull() & F.coalesce(F.col("_l") > F.col("_lh"), F.lit(True)) & F.col("_r").isNotNull() & F.coalesce(F.col("_r") < F.col("_rh"), F.lit(True))
    around = F.array(own - 1, own, own + 1)
    first = checkpointed(judged(peaks, around))
    open_ = F.coalesce("_l", "_lh").isNull() | F.coalesce("_r", "_rh").isNull()
    sums = d.groupBy(*keys, "_b").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sums = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "_lo", "_hi"))).alias("_sums"))
    far = first.where(open_).select(*columns).join(sums, keys)
    decides = lambda s: (s["_lo"] <= F.col(value) - F.col("least")) | (s["_hi"] > F.col(value))
    left = F.get(F.reverse(F.filter("_sums", lambda s: (s["_b"] < own) & decides(s))), F.lit(0))["_b"]
    right = F.get(F.filter("_sums", lambda s: (s["_b"] > own) & decides(s)), F.lit(0))["_b"]
    rest = judged(far, F.concat(around, F.array(left, right)))
    return first.where(~open_ & fine).unionByName(rest.where(fine)).select(*columns).drop("least")


def rr_window_hr(peaks: DataFrame, key: str, window: float, stride: float, offset: float = 0.0, rr_low: float = .30, rr_high: float = 1.5,
                 max_cv: float = .20, max_deviation: float = .30, least: int = 5) -> DataFrame:
    """Median complete-RR rate per scheduled window; a window without support stays with its reason."""
    b = peaks.groupBy(key).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    room = F.col("t1") - F.col("t0") - window
    schedule = explode_ids(b, [key], F.when(room >= 0, F.floor(room / stride) + 1).otherwise(0), "window_index").select(key, "window_index", "t0")
    p = peaks.join(b.select(key, "t0"), key)
    p = assign_windows(p, F.col("t") - F.col("t0") - offset, F.lit(window), F.lit(stride))
    w = Window.partitionBy(key, "window_index").orderBy("t")
    p = p.withColumn("rr", F.col("t") - F.lag("t").over(w))
    s = p.groupBy(key, "window_index").agg(
        F.count("rr").alias("n"), F.median("rr").alias("med"), F.try_divide(F.stddev_pop("rr"), F.avg("rr")).alias("rr_cv"), F.min("rr").alias("lo"),
        F.max("rr").alias("hi"), F.min("t").alias("ft"), F.max("t").alias("lt"), F.median("strength").alias("median_strength"))
    j = schedule.join(s, [key, "window_index"], "left")
    start = F.col("t0") + F.col("window_index") * stride + offset
    spread = F.greatest(F.try_divide("hi", "med") - 1, 1 - F.try_divide("lo", "med"))
    n = F.coalesce("n", F.lit(0))
    irregular = (F.col("lo") < rr_low) | (F.col("hi") > rr_high) | (F.col("rr_cv") > max_cv) | (spread > max_deviation)
    uncovered = (F.col("ft") - start > 1.5 * F.col("med")) | (start + window - F.col("lt") > 1.5 * F.col("med"))
    reason = F.when(n < least, f"fewer_than_{least}_complete_rr").when(irregular, "irregular_or_missed_beats").when(uncovered, "uncovered_ecg_edges").otherwise("valid")
    j = j.withColumns({"rr_count": n, "reason": reason})
    return j.select(key, "window_index", "rr_count", "rr_cv", "median_strength", "reason",
                    F.when(F.col("reason") == "valid", F.try_divide(F.lit(60.0), "med")).alias("hr_bpm"))


def legacy_hr(df: DataFrame, x: str, fs: float) -> DataFrame:
    """Beats over duration of the polarity with more peaks above the 90th percentile; 35-220 bpm or missing."""
    def run(m):
        low, high = max(.001, 5.0 / (fs / 2)) * fs / 2, min(.99, 20.0 / (fs / 2)) * fs / 2
        if m.shape[1] < int(3 * fs) or m.shape[1] <= 21:
            return [[None] * len(m)] * 3
        y = kn.bandpass(m - np.median(m, axis=1, keepdims=True), fs, low, high)
        seconds, gap = m.shape[1] / fs, max(1, int(round(.30 * fs)))
        beats, flip, hr = [], [], []
        for v in y:
            level = np.percentile(np.abs(v), 90)
            both = [len(kn.find_peaks(s * v, gap, None, level)) for s in (1, -1)]
            rates = [(n, k) for k, n in enumerate(both) if 35 <= 60 * n / seconds <= 220]
            best = max(rates, key=lambda r: (r[0], -r[1])) if rates else None
            beats.append(best[0] if best else None), flip.append(bool(best[1]) if best else None), hr.append(60 * best[0] / seconds if best else None)
        return [beats, flip, hr]

    return apply_kernel(df, [x], run, "beats int, inverted boolean, hr_bpm double")
