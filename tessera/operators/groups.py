"""Grouped aggregation by any number of keys of any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import aggregates as A
from tessera.functions.semantics import _c
from tessera.operators import quantiles, windows


class GroupBy:
    """``keys``: names or expressions. Null keys make a group of their own."""

    def __init__(self, df: DataFrame, *keys: str | Column, order: str | None = None):
        if not keys:
            raise ValueError("group_by needs a key")
        if missing := [k for k in keys if isinstance(k, str) and k not in df.columns]:
            raise KeyError(f"no such columns: {missing}")
        self.df, self.keys, self.order = df, keys, order

    def _named(self, columns: tuple[str, ...], name: str) -> DataFrame:
        return self.agg({c: name for c in columns})

    def agg(self, *exprs: Column | dict[str, str | list[str]]) -> DataFrame:
        """Expressions, or a map of column to one or more aggregates by name, which
        are called ``<column>_<name>``."""
        out: list[Column] = []
        for e in exprs:
            if isinstance(e, dict):
                for c, names in e.items():
                    for n in [names] if isinstance(names, str) else names:
                        out.append(self._by_name(c, n).alias(f"{c}_{n}"))
            else:
                out.append(e)
        return self.df.groupBy(*[_c(k) for k in self.keys]).agg(*out)

    def _by_name(self, c: str, name: str) -> Column:
        if name in ("first", "last"):
            if self.order is None:
                raise ValueError(f"{name} needs an order")
            return (A.first if name == "first" else A.last)(c, self.order)
        return A.BY_NAME[name](c)

    def sum(self, *c: str) -> DataFrame:
        return self._named(c, "sum")

    def mean(self, *c: str) -> DataFrame:
        return self._named(c, "mean")

    def min(self, *c: str) -> DataFrame:
        return self._named(c, "min")

    def max(self, *c: str) -> DataFrame:
        return self._named(c, "max")

    def std(self, *c: str) -> DataFrame:
        return self._named(c, "std")

    def var(self, *c: str) -> DataFrame:
        return self._named(c, "var")

    def median(self, *c: str) -> DataFrame:
        """Without a buffer of a group's values; ``agg`` has one in the group's task."""
        return self.quantiles(c[0], {f"{c[0]}_median": 0.5}) if len(c) == 1 else self._named(c, "median")

    def quantiles(self, column: str, named: dict[str, float]) -> DataFrame:
        return quantiles.quantiles(self.df, column, named, self.keys)

    def mode(self, column: str) -> DataFrame:
        return quantiles.mode(self.df, column, f"{column}_mode", self.keys)

    def first(self, *c: str) -> DataFrame:
        return self._named(c, "first")

    def last(self, *c: str) -> DataFrame:
        return self._named(c, "last")

    def count(self) -> DataFrame:
        """Rows of each group."""
        return self.df.groupBy(*[_c(k) for k in self.keys]).agg(F.count(F.lit(1)).alias("count"))


def group_ids(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, first, count, group_id) of each group; groups are numbered from 0 in
    the order they are first seen."""
    groups = df.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("count"))
    return windows.cumulative(groups, "first", {"group_id": ("row_number", None)}).withColumn("group_id", F.col("group_id") - 1)
