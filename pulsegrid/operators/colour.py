"""Colour-to-pulse methods over windowed r, g, b samples.

Long form: one row per sample, window statistics by one shuffle on the window
key (a window is bounded, a recording is not). Methods with a closed form stay
column expressions; only sliding, component and filter methods use a kernel.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.batch import apply_kernels, job
from pulsegrid.functions.cols import EPS
from pulsegrid.functions import kernels as kn

WINDOW = ["recording", "window_index"]


def _w():
    return Window.partitionBy(*WINDOW)


def standardized(df: DataFrame, channels: list[str]) -> DataFrame:
    """(x - mean) / (population sd + 1e-8) per window and channel."""
    w = _w()
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + EPS) for c in channels})


def mean_normalized(df: DataFrame, channels: list[str]) -> DataFrame:
    w = _w()
    return df.withColumns({f"{c}_n": F.col(c) / (F.avg(c).over(w) + EPS) - 1 for c in channels})


def signed_zscore(df: DataFrame, channel: str, name: str) -> DataFrame:
    """z-score, or missing when flat, incomplete or shorter than two."""
    w = _w()
    ok = (F.stddev_pop(channel).over(w) > 1e-8) & (F.count(channel).over(w) == F.count(F.lit(1)).over(w)) & (F.count(F.lit(1)).over(w) >= 2)
    z = (F.col(channel) - F.avg(channel).over(w)) / (F.stddev_pop(channel).over(w) + EPS)
    return df.withColumn(name, F.when(ok, z))


def _two_axis(df: DataFrame, x1: Column, x2: Column, sign: int, name: str) -> DataFrame:
    """Centre of x1 + sign * alpha * x2 with alpha the ratio of their spreads."""
    w = _w()
    df = df.withColumns({"_x1": x1, "_x2": x2})
    alpha = F.stddev_pop("_x1").over(w) / (F.stddev_pop("_x2").over(w) + EPS) * sign
    centred = (F.col("_x1") - F.avg("_x1").over(w)) + alpha * (F.col("_x2") - F.avg("_x2").over(w))
    return df.withColumn(name, F.when(F.col("n") >= 4, centred)).drop("_x1", "_x2")


def green(df: DataFrame) -> DataFrame:
    return df.withColumn("GREEN", F.when(F.col("n") >= 4, F.col("g") - F.avg("g").over(_w())))


def chrom(df: DataFrame) -> DataFrame:
    d = mean_normalized(df, ["r", "g", "b"])
    r, g, b = F.col("r_n"), F.col("g_n"), F.col("b_n")
    return _two_axis(d, 3 * r - 2 * g, 1.5 * r + g - 1.5 * b, -1, "CHROM").drop("r_n", "g_n", "b_n")


def pos(df: DataFrame) -> DataFrame:
    d = mean_normalized(df, ["r", "g", "b"])
    r, g, b = F.col("r_n"), F.col("g_n"), F.col("b_n")
    return _two_axis(d, r - g, r + g - 2 * b, 1, "POS").drop("r_n", "g_n", "b_n")


def lgi(df: DataFrame) -> DataFrame:
    log = {c: F.log(F.greatest(F.col(c), F.lit(1e-6))) for c in "rgb"}
    return _two_axis(df, log["g"] - log["b"], log["g"] - log["r"], -1, "LGI")


def pbv(df: DataFrame) -> DataFrame:
    """Projection solving (covariance + 1e-6 I) w = (0, 1, -1) by Cramer's rule."""
    w = _w()
    d = standardized(df, ["r", "g", "b"])
    pairs = [("r", "r"), ("r", "g"), ("r", "b"), ("g", "g"), ("g", "b"), ("b", "b")]
    d = d.withColumns({f"_{a}{b}": F.covar_samp(f"{a}_z", f"{b}_z").over(w) + (1e-6 if a == b else 0.0) for a, b in pairs})
    rr, rg, rb, gg, gb, bb = [F.col(f"_{a}{b}") for a, b in pairs]
    det = rr * (gg * bb - gb * gb) - rg * (rg * bb - gb * rb) + rb * (rg * gb - gg * rb)
    # columns of the adjugate for the right-hand side (0, 1, -1)
    wr = ((rb * gb - rg * bb) - (rg * gb - rb * gg)) / det
    wg = ((rr * bb - rb * rb) - (rb * rg - rr * gb)) / det
    wb = ((rg * rb - rr * gb) - (rr * gg - rg * rg)) / det
    y = wr * F.col("r_z") + wg * F.col("g_z") + wb * F.col("b_z")
    d = d.withColumn("_y", y)
    d = d.withColumn("PBV", F.when(F.col("n") >= 4, F.col("_y") - F.avg("_y").over(w)))
    return d.drop("_y", "r_z", "g_z", "b_z", *[f"_{a}{b}" for a, b in pairs])


def omit(df: DataFrame) -> DataFrame:
    """Main axis of the plane orthogonal to grey; the largest loading is made positive.

    The plane has two axes, so the principal direction is a closed form of three moments.
    """
    w = _w()
    u = (F.col("r") - F.col("g")) / 2 ** 0.5
    v = (F.col("r") + F.col("g") - 2 * F.col("b")) / 6 ** 0.5
    d = df.withColumns({"_u": u, "_v": v})
    theta = 0.5 * F.atan2(2 * F.covar_pop("_u", "_v").over(w), F.var_pop("_u").over(w) - F.var_pop("_v").over(w))
    d = d.withColumns({"_t": theta, "_spread": F.var_pop("_u").over(w) + F.var_pop("_v").over(w)})
    c, s = F.cos("_t"), F.sin("_t")
    lr, lg, lb = c / 2 ** 0.5 + s / 6 ** 0.5, -c / 2 ** 0.5 + s / 6 ** 0.5, -2 * s / 6 ** 0.5
    top = F.greatest(F.abs(lr), F.abs(lg), F.abs(lb))
    lead = F.when(F.abs(lr) == top, lr).when(F.abs(lg) == top, lg).otherwise(lb)
    y = F.when(F.col("_spread") < 1e-14, F.col("g") - F.avg("g").over(w)).otherwise(
        F.signum(lead) * (c * (F.col("_u") - F.avg("_u").over(w)) + s * (F.col("_v") - F.avg("_v").over(w))))
    return d.withColumn("OMIT", F.when(F.col("n") >= 4, y)).drop("_u", "_v", "_t", "_spread")


SAMPLE_METHODS = {"GREEN": green, "CHROM": chrom, "POS": pos, "LGI": lgi, "PBV": pbv, "OMIT": omit}
KERNEL_METHODS = {"CHROM_WIN": kn.chrom_windowed, "POS_WIN": kn.pos_windowed, "PCA": kn.pca_component, "ICA": kn.ica_component}


def register_method(name: str, kernel) -> None:
    """Add a window method ``kernel(r, g, b, fs=...) -> [windows, samples]``."""
    if name in SAMPLE_METHODS or name in KERNEL_METHODS:
        raise ValueError(f"method {name} exists")
    KERNEL_METHODS[name] = kernel


def method_job(name: str, fs: float) -> tuple:
    kernel = KERNEL_METHODS[name]
    return job(["r", "g", "b"], lambda r, g, b: [kernel(r, g, b, fs)], f"{name} array<double>")


def window_methods(windows: DataFrame, names: list[str], fs: float) -> DataFrame:
    """Kernel methods on one-row-per-window arrays in one pass; failures are NULL arrays."""
    return apply_kernels(windows, [method_job(n, fs) for n in names])


def filter_jobs(names: dict[str, str], kernel, **params) -> list[tuple]:
    """One array kernel on several columns (source -> new name), each with its own missing rows."""
    return [job([c], lambda x, **p: [kernel(x, **p)], f"{n} array<double>", **params) for c, n in names.items()]


def pivot_windows(samples: DataFrame, names: list[str], order: str = "i", **more: Column) -> DataFrame:
    """Ordered arrays of the named columns per window, and ``more`` aggregates of it."""
    p = samples.groupBy(*WINDOW).agg(F.array_sort(F.collect_list(F.struct(order, *names))).alias("_p"), F.max("n").alias("n"), *[c.alias(n) for n, c in more.items()])
    return p.select(*WINDOW, "n", *[F.col(f"_p.{c}").alias(c) for c in names], *more)


def explode_windows(windows: DataFrame, column: str, keys: list[str], position: str = "pos") -> DataFrame:
    return windows.select(*keys, F.posexplode(column).alias(position, "value"))


def detrend(df: DataFrame, channel: str, position: str, name: str) -> DataFrame:
    """Residual of the straight line fitted over the window."""
    w = _w()
    slope, cut = F.regr_slope(channel, position).over(w), F.regr_intercept(channel, position).over(w)
    return df.withColumn(name, F.col(channel) - (slope * F.col(position) + cut))
