"""Evaluation statistics as mergeable aggregates: partial sums first, one small final stage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.cols import finite, safe_corr
from pulsegrid.operators.carry import dealt, exact_quantiles, with_rank


def with_error(df: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Signed and absolute error on finite pairs, NULL elsewhere."""
    ok = finite(pred) & finite(ref)
    e = F.when(ok, F.col(pred) - F.col(ref))
    return df.withColumn("err", e).withColumn("abs_err", F.abs("err"))


def regression_aggs(pred: str = "pred", ref: str = "ref") -> dict[str, Column]:
    """MAE, RMSE, ME, SD (one reading gives 0), Pearson (constant side gives NULL), n."""
    e, p, r = F.col("err"), F.col(pred), F.col(ref)
    both = F.col("err").isNotNull()
    pp, rr = F.when(both, p), F.when(both, r)
    n = F.count(e)
    sd = F.when(n == 1, F.lit(0.0)).when(n > 1, F.stddev_samp(e))
    varied = (n > 1) & (F.stddev_pop(rr) > 0) & (F.stddev_pop(pp) > 0)
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "me": F.avg(e), "sd": sd,
            "pearson": F.when(varied, safe_corr(rr, pp)), "n": n}


def coverage_aggs() -> dict[str, Column]:
    """Counts and rates with explicit denominators; accuracy over valid pairs only."""
    finite_pred, label, valid = finite("pred"), finite("ref"), F.col("err").isNotNull()
    ok = F.col("extraction_ok")
    total, ae = F.count(F.lit(1)), F.col("abs_err")
    return {"windows": total, "valid_pairs": F.count_if(valid), "valid_labels": F.count_if(label),
            "finite_predictions": F.count_if(finite_pred), "missing_labels": F.count_if(~label),
            "prediction_failures": F.count_if(~finite_pred), "extraction_failures": F.count_if(~ok),
            "invalid_signal_windows": F.count_if(ok & ~finite_pred),
            "mae": F.avg(ae), "rmse": F.sqrt(F.avg(F.col("err") * F.col("err"))), "bias": F.avg("err"),
            "within_3": F.avg((ae <= 3).cast("double")), "within_5": F.avg((ae <= 5).cast("double")),
            "finite_prediction_coverage": F.count_if(finite_pred) / total,
            "prediction_failure_rate": F.count_if(~finite_pred) / total, "paired_coverage": F.count_if(valid) / total}


def named(aggs: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in aggs.items()]


def coverage_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``coverage_aggs`` plus exact median and 90th percentile of the absolute error."""
    base = rows.groupBy(*keys).agg(*named(coverage_aggs()))
    q = exact_quantiles(rows, keys, "abs_err", {"median_ae": .5, "p90_ae": .9})
    return base.join(q, keys, "left")


def balanced_means(rows: DataFrame, keys: list[str], subject: str, metrics: list[str]) -> DataFrame:
    """Finite mean per subject, then the plain mean over subjects that have the metric."""
    per = rows.groupBy(*keys, subject).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("_w"))
    return per.groupBy(*keys).agg(*[F.avg(m).alias(f"balanced_{m}") for m in metrics],
                                  *[F.count(m).alias(f"subjects_{m}") for m in metrics],
                                  F.count(F.lit(1)).alias("subjects"), F.sum("_w").alias("windows"))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks with ties averaged; a missing value has no rank, a missing key is a key.

    Two windows over the rows as they come. A table of distinct values joined back would miss rows: a mean of doubles that is computed
    once for the table and once for the rows differs in the last bit when its terms arrive in another order. Callers keep the rows per key few.
    """
    up = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.rank().over(up) + (ties - 1) / 2))


def average_rank_dealt(df: DataFrame, keys: list[str], value: str, tie: str, name: str, rows: int) -> DataFrame:
    """``average_rank`` of keys of any size, without a missing value or key: places by value and ``tie``, which no two rows of a key share,
    averaged over equal values. ``df`` is read several times, so it has to be a written table."""
    d = with_rank(df, keys, value, tie, "_place", descending=False, rows=rows).withColumn("_h", F.xxhash64(value))
    d = dealt(d, rows, *keys, "_h")                 # a window by a double shuffles again, whatever the rows are dealt by
    return d.withColumn(name, F.avg("_place").over(Window.partitionBy(*keys, "_h", value))).drop("_place", "_h")


def centered_corr(df: DataFrame, keys: list[str], subject: str, x: str, y: str) -> DataFrame:
    """Pooled and subject-centred Pearson from per-subject sums (no per-row subject mean)."""
    ok = finite(x) & finite(y)
    s = df.where(ok).groupBy(*keys, subject).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    rep = F.col("n") >= 2
    n = F.col("n")
    out = s.groupBy(*keys).agg(
        F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_subjects"), F.count_if(rep).alias("repeated_subjects"),
        F.sum(F.when(rep, n)).alias("_nr"),
        F.sum(F.when(rep, n * F.col("vx"))).alias("_sxx"), F.sum(F.when(rep, n * F.col("vy"))).alias("_syy"),
        F.sum(F.when(rep, n * F.col("cxy"))).alias("_sxy"))
    pooled = df.where(ok).groupBy(*keys).agg(safe_corr(x, y).alias("pooled_corr"))
    df_ = F.col("_nr") - F.col("repeated_subjects")
    enough = (F.col("repeated_subjects") >= 2) & (df_ >= 3) & (F.col("_sxx") > 0) & (F.col("_syy") > 0)
    out = out.withColumns({"within_df": F.coalesce(df_, F.lit(0)),
                           "centered_corr": F.when(enough, F.col("_sxy") / F.sqrt(F.col("_sxx") * F.col("_syy")))})
    return out.drop("_nr", "_sxx", "_syy", "_sxy").join(pooled, keys, "left")
