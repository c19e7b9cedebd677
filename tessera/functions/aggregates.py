"""Aggregate expressions over a column or a group; nulls are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.semantics import _c


def total(c) -> Column:
    """Zero where nothing is to be summed."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def mean(c) -> Column:
    return F.avg(_c(c))


def median(c) -> Column:
    """Keeps the distinct values of a group in its task; for large groups there is
    ``operators.quantiles``, as for the two below."""
    return F.median(_c(c))


def quantile(c, q: float) -> Column:
    """Exact, with linear interpolation; null where ``q`` is out of [0, 1]."""
    return F.percentile(_c(c), F.lit(q)) if 0 <= q <= 1 else F.max(F.lit(None).cast("double"))


def variance(c) -> Column:
    return F.var_samp(_c(c))


def std(c) -> Column:
    return F.stddev_samp(_c(c))


def skewness(c, variant: str = "sample") -> Column:
    """``sample``: bias-corrected; ``population``: plain; ``kernel``: plain, scaled by
    (n-1)^2 / (n (n-2)). Zero for equal values; the first two and the last need three."""
    c = _c(c)
    n, g1 = F.count(c).cast("double"), F.skewness(c.cast("double"))
    if variant == "population":
        value = g1
    elif variant == "kernel":
        value = g1 * (n - 1) * (n - 1) / F.nullif(n * (n - 2), F.lit(0.0))
    else:
        value = g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None).cast("double")).when(F.var_samp(c) == 0, F.lit(0.0)).otherwise(value)


def kurtosis(c) -> Column:
    """Excess kurtosis, bias-corrected; zero for equal values, null below four."""
    c = _c(c)
    n, g2 = F.count(c).cast("double"), F.kurtosis(c.cast("double"))
    value = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(F.var_samp(c) == 0, F.lit(0.0)).otherwise(value)


def correlation(x, y) -> Column:
    """Pearson's, over pairs without nulls; null where a side does not vary."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def mode(c) -> Column:
    """The most frequent value, the smallest of them on a tie."""
    return F.mode(_c(c), deterministic=True)


def first(c, order) -> Column:
    return F.min_by(_c(c), _c(order))


def last(c, order) -> Column:
    return F.max_by(_c(c), _c(order))


def n_unique(c) -> Column:
    return F.count_distinct(_c(c))


def count_true(c) -> Column:
    return F.count_if(_c(c))


def count_false(c) -> Column:
    return F.count_if(~_c(c))


#: By name; what is not here needs an order or a second argument.
BY_NAME: dict[str, Callable[..., Column]] = {
    "sum": total,
    "min": lambda c: F.min(_c(c)),
    "max": lambda c: F.max(_c(c)),
    "mean": mean,
    "count": lambda c: F.count(_c(c)),
    "std": std,
    "var": variance,
    "median": median,
    "skewness": skewness,
    "kurtosis": kurtosis,
    "nunique": n_unique,
    "mode": mode,
}
BY_NAME |= {"skew": skewness, "kurt": kurtosis, "avg": mean, "variance": variance, "stddev": std}


def describe(c: str, prefix: str = "") -> list[Column]:
    """Count, mean, deviation, least and largest."""
    named = {"count": F.count(c), "mean": mean(c), "std": std(c), "min": F.min(c), "max": F.max(c)}
    return [v.cast("double").alias(prefix + k) for k, v in named.items()]
