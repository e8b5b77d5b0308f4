"""Subject partitions and train-only statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.carry import exact_quantiles, with_index

VERSION = "sorted_md5_order_v1"    # hash order; not the permutation of any numeric generator


def hash_order(subjects: DataFrame, subject: str, seed: int) -> DataFrame:
    """Distinct subjects with a position in a seeded hash order, without one global sort task."""
    s = subjects.select(subject).distinct()
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(subject).cast("string")))
    s = s.withColumns({"_h": text, "_all": F.lit(0), "_b": F.conv(F.substring(text, 1, 3), 16, 10).cast("int")})
    return with_index(s, ["_all"], "_b", ["_h", subject], "position").select(subject, "position")


def split_counts(n: Column, validation: float, test: float) -> tuple[Column, Column]:
    """Validation and test sizes: half-even rounding, at least one, test then validation shrink to keep train."""
    nv = F.greatest(F.lit(1), F.bround(n * validation, 0).cast("long"))
    nt = F.greatest(F.lit(1), F.bround(n * test, 0).cast("long")) if test else F.lit(0).cast("long")
    nt = F.when((nv + nt >= n) & (nt > 1), F.greatest(F.lit(1), n - nv - 1)).otherwise(nt)
    nv = F.when((nv + nt >= n) & (nv > 1), F.greatest(F.lit(1), n - nt - 1)).otherwise(nv)
    return nv, nt


def subject_split(subjects: DataFrame, subject: str, validation: float = .2, test: float = .2, seed: int = 42) -> DataFrame:
    """Each subject in exactly one of train, validation, test."""
    order = hash_order(subjects, subject, seed)
    order = order.withColumn("_n", F.lit(_subjects(order)))
    nv, nt = split_counts(F.col("_n"), validation, test)
    part = F.when(F.col("position") < nv, "validation").when(F.col("position") < nv + nt, "test").otherwise("train")
    return order.withColumn("partition", part).drop("_n")


def _subjects(order: DataFrame) -> int:
    """Number of subjects: one number, counted once and written into the plan."""
    return order.count()


def split_manifest(subjects: DataFrame, subject: str, validation: float = .2, test: float = .2, seed: int = 42) -> DataFrame:
    """Test reserved first, validation from the rest; two subjects give a smoke split without test."""
    order = hash_order(subjects, subject, seed)
    n = F.lit(_subjects(order))
    nt = F.when(n == 2, 0).otherwise(F.least(n - 2, F.greatest(F.lit(1), F.bround(n * test, 0).cast("long"))))
    left = n - nt
    nv = F.least(left - 1, F.greatest(F.lit(1), F.bround(left * validation, 0).cast("long")))
    part = F.when(F.col("position") < nt, "test").when(F.col("position") < nt + nv, "validation").otherwise("train")
    return order.withColumns({"partition": part, "smoke_only": n == 2, "seed": F.lit(seed), "algorithm_version": F.lit(VERSION)})


def train_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    """Median of each feature over train rows, then mean and population SD after filling with it (one row)."""
    train = rows.where("partition = 'train'")
    long = train.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "v"))
    med = exact_quantiles(long, ["f"], "v", {"median": .5})
    filled = long.join(med, "f").withColumn("v", F.coalesce("v", "median"))
    st = filled.groupBy("f").agg(F.first("median").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    st = st.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    return st.agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("median", "mean", "sd").alias("s")))).alias("m"))


def impute_scale(rows: DataFrame, features: list[str]) -> DataFrame:
    """Fill with train medians and standardize with train moments; features empty in train stay NULL."""
    m = train_statistics(rows, features).scalar()
    out = rows.withColumn("_m", m)
    for i, f in enumerate(features):
        s = F.col("_m")[i]
        out = out.withColumn(f"{f}_scaled", (F.coalesce(F.col(f).cast("double"), s["median"]) - s["mean"]) / s["sd"])
    return out.drop("_m")
