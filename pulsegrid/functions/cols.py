"""Column helpers: missing-value rules, rounding, small array algebra.

Missing is NULL everywhere; NaN and infinities become NULL at the scan.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-8


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def null_nonfinite(c) -> Column:
    return F.when(finite(c), col(c))


def rnd(c, digits: int = 6) -> Column:
    """Round for stable output; NaN and infinities become NULL."""
    c = col(c).cast("double")
    return F.when(finite(c), F.round(c, digits) + F.lit(0.0))


def reasons(*pairs) -> Column:
    """Array of the reasons whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def joined(reason_array) -> Column:
    return F.array_join(reason_array, "|")


def let(value, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``: a lambda would repeat it for every element."""
    return F.transform(F.array(value), body)[0]


def arr_sum(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def arr_mean(a) -> Column:
    return arr_sum(a) / F.size(col(a))


def arr_center(a) -> Column:
    return let(arr_mean(a), lambda m: F.transform(col(a), lambda x: x - m))


def arr_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def arr_sd(a) -> Column:
    """Population standard deviation."""
    return let(arr_center(a), lambda c: F.sqrt(arr_dot(c, c) / F.size(c)))


def arr_zscore(a, eps: float) -> Column:
    """(x - mean) / (population sd + eps)."""
    return let(arr_center(a), lambda c: let(F.sqrt(arr_dot(c, c) / F.size(c)) + eps, lambda s: F.transform(c, lambda x: x / s)))


def arr_pearson(a, b) -> Column:
    """Pearson of two equal arrays; NULL when a side is flat."""
    def corr(s):
        return F.try_divide(arr_dot(s["a"], s["b"]), F.sqrt(arr_dot(s["a"], s["a"]) * arr_dot(s["b"], s["b"])))

    return let(F.struct(arr_center(a).alias("a"), arr_center(b).alias("b")), corr)


def ratio(a, b) -> Column:
    """Division that gives NULL for a zero denominator (ANSI mode would stop the job)."""
    return F.try_divide(col(a), col(b))


def safe_corr(x, y) -> Column:
    """Pearson aggregate or window function over complete pairs; NULL when a side is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
