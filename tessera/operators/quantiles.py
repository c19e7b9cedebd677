"""Exact quantiles and modes by sorted counts of distinct values.

Equal values are counted before anything is sorted, and the counts are summed up in
the order of values: within a group by a window, which spills, over a whole frame
in blocks. No buffer holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.semantics import _c
from tessera.operators import windows


def _counted(df: DataFrame, column: str | Column, keys: Sequence[str | Column]) -> tuple[DataFrame, list[str]]:
    """(keys, _v, _n): each distinct value and how often it comes; nulls count 0."""
    value = _c(column).alias("_v")
    grouped = df.groupBy(*[_c(k) for k in keys], value).agg(F.count(_c(column)).alias("_n"))
    return grouped, [c for c in grouped.columns if c not in ("_v", "_n")]


def quantiles(df: DataFrame, column: str | Column, named: dict[str, float], keys: Sequence[str | Column] = ()) -> DataFrame:
    """A column for each of ``named``, a share in [0, 1], by linear interpolation;
    null out of that range and where there is no value. A row for each group."""
    counts, names = _counted(df, column, keys)
    if names:
        group = Window.partitionBy(*names)
        summed = counts.withColumn("_upto", F.sum("_n").over(group.orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_all", F.sum("_n").over(group))
    else:
        counts = counts.where("_n > 0")
        summed = windows.cumulative(counts, "_v", {"_upto": ("sum", "_n")}).withColumn("_all", counts.agg(F.sum("_n")).scalar())
    out = []
    for name, q in named.items():
        if not 0 <= q <= 1:
            out.append(F.max(F.lit(None).cast("double")).alias(name))
            continue
        at = (F.col("_all") - 1) * F.lit(float(q))
        low, high = (F.min(F.when(F.col("_upto") > f(at), F.col("_v").cast("double"))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        out.append(F.when(share == 0, low).otherwise(low + (high - low) * share).alias(name))
    return summed.groupBy(*names).agg(*out)


def mode(df: DataFrame, column: str | Column, name: str = "mode", keys: Sequence[str | Column] = ()) -> DataFrame:
    """The most frequent value, the smallest of them on a tie. A row for each group."""
    counts, names = _counted(df, column, keys)
    known = F.when(F.col("_n") > 0, F.struct(-F.col("_n"), F.col("_v")))
    return counts.groupBy(*names).agg(F.min_by("_v", known).alias(name))
