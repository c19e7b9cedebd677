"""A frame: a Spark DataFrame with, where rows have an order, the key of it.

Frames are immutable and lazy. What depends on places (head, tail, slice, take,
windows, fills) needs ``order``, a column whose values are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import aggregates as A
from tessera.functions import nested
from tessera.functions.semantics import _c
from tessera.operators import joins, quantiles, reshape, windows
from tessera.operators.groups import GroupBy


class Frame:
    def __init__(self, df: DataFrame, order: str | None = None):
        self.df, self.order = df, order

    def _new(self, df: DataFrame, order: str | None = None) -> Frame:
        order = order or self.order
        return Frame(df, order if order in df.columns else None)

    def _ordered(self) -> str:
        if self.order is None:
            raise ValueError("this needs an order: Frame(df, order=...)")
        return self.order

    # shape and schema
    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def width(self) -> int:
        return len(self.df.columns)

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def height(self) -> int:
        return self.df.count()

    def has_column(self, name: str) -> bool:
        return name in self.df.columns

    def column(self, name: str) -> Column:
        return self.df[f"`{name}`"]

    def column_by_index(self, i: int) -> Column:
        return self.column(self.df.columns[i])

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    # projection
    def select(self, *cols: str | Column, strict: bool = True) -> Frame:
        """Without ``strict``, names that do not exist are left out."""
        names = [c for c in cols if strict or not isinstance(c, str) or c in self.df.columns]
        return self._new(self.df.select(*names))

    def drop(self, *cols: str) -> Frame:
        return self._new(self.df.drop(*cols))

    def rename(self, names: dict[str, str]) -> Frame:
        return self._new(self.df.withColumnsRenamed(names), names.get(self.order or "", self.order))

    def with_column(self, name: str, value: Column) -> Frame:
        return self._new(self.df.withColumn(name, value))

    def clone(self) -> Frame:
        return Frame(self.df, self.order)

    # places
    def head(self, n: int) -> Frame:
        return self._new(self.df.orderBy(self._ordered()).limit(max(0, n)))

    def tail(self, n: int) -> Frame:
        return self._new(self.df.orderBy(F.desc(self._ordered())).limit(max(0, n)).orderBy(self.order))

    def slice(self, start: int, end: int) -> Frame:
        start = max(0, start)
        return self._new(self.df.orderBy(self._ordered()).offset(start).limit(max(0, end - start)))

    def limit(self, n: int) -> Frame:
        return self._new(self.df.limit(n))

    def at(self, column: str, i: int):
        """One value, or None; for looking, not for loops."""
        row = self.df.select(column, self._ordered()).orderBy(self.order).offset(i).first() if i >= 0 else None
        return row[0] if row else None

    def numbered(self, name: str = "place") -> Frame:
        """With the place of each row, from 0, without gathering rows in one task."""
        out = windows.cumulative(self.df, self._ordered(), {name: ("row_number", None)})
        return self._new(out.withColumn(name, F.col(name) - 1))

    def take(self, indices: DataFrame, default=0) -> Frame:
        """Rows at the places in ``indices`` (position, place); ``default`` in every
        other column where there is no such place."""
        placed = self.numbered("_place").df
        out = indices.join(placed, indices["place"] == placed["_place"], "left").drop("_place")
        return Frame(out.select("position", *[F.coalesce(F.col(c), F.lit(default).cast(self.df.schema[c].dataType)).alias(c) for c in self.df.columns]), "position")

    # filters
    def filter(self, condition: Column | str) -> Frame:
        return self._new(self.df.filter(condition))

    def filter_by_mask(self, mask: str | Column) -> Frame:
        return self._new(self.df.filter(F.coalesce(_c(mask).cast("boolean"), F.lit(False))))

    def indices_where(self, condition: Column) -> DataFrame:
        return self.numbered("place").df.where(condition).select("place")

    # sort and sets
    def sort(self, column: str | Column, ascending: bool = True, then: Sequence[str] = ()) -> Frame:
        c = _c(column)
        return self._new(self.df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), *then))

    def sort_by(self, *keys: tuple[str, bool]) -> Frame:
        """By several keys: (name, descending)."""
        return self._new(self.df.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in keys]))

    def argsort(self, column: str, ascending: bool = True) -> DataFrame:
        """The places of rows in the order of ``column``."""
        c = F.col(column)
        return self.numbered("place").df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "place").select("place")

    def top(self, n: int, *keys: tuple[str, bool]) -> Frame:
        return self._new(self.sort_by(*keys).df.limit(n))

    def distinct(self) -> Frame:
        return self._new(self.df.distinct())

    def unique(self, column: str) -> Frame:
        return self._new(self.df.select(column).distinct())

    def n_unique(self, column: str) -> int:
        return self.df.agg(A.n_unique(column)).first()[0]

    def concat(self, *others: Frame) -> Frame:
        out = self.df
        for o in others:
            out = out.unionByName(o.df)
        return self._new(out)

    def intersect(self, other: Frame) -> Frame:
        return self._new(self.df.intersect(other.df))

    def difference(self, other: Frame) -> Frame:
        return self._new(self.df.exceptAll(other.df))

    # aggregation
    def group_by(self, *keys: str | Column) -> GroupBy:
        return GroupBy(self.df, *keys, order=self.order)

    def agg(self, *exprs: Column) -> DataFrame:
        return self.df.agg(*exprs)

    def describe(self, *columns: str) -> DataFrame:
        """A row per numeric column: one pass over the frame for all but quartiles."""
        names = columns or [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)]
        keys = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")
        wide = self.df.agg(*[e for i, c in enumerate(names) for e in A.describe(c, f"{i}_")])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in keys if k[0] != "q"]) for i, c in enumerate(names)])
        quarters = [quantiles.quantiles(self.df, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumn("column", F.lit(c)) for c in names]
        return wide.select(F.inline(rows)).join(reduce(DataFrame.unionByName, quarters), "column").select("column", *keys)

    def quantiles(self, column: str, **named: float) -> DataFrame:
        return quantiles.quantiles(self.df, column, named)

    def mode(self, column: str, name: str = "mode") -> DataFrame:
        return quantiles.mode(self.df, column, name)

    # joins and shape
    def join(self, other: Frame | DataFrame, on=None, how: str = "inner", **options) -> Frame:
        return self._new(joins.join(self.df, other.df if isinstance(other, Frame) else other, on, how, **options))

    def left_join(self, other, on=None, **options) -> Frame:
        return self.join(other, on, "left", **options)

    def right_join(self, other, on=None, **options) -> Frame:
        return self.join(other, on, "right", **options)

    def outer_join(self, other, on=None, **options) -> Frame:
        return self.join(other, on, "outer", **options)

    def pivot(self, index, column: str, values: str, agg: str = "first", names=None) -> Frame:
        return self._new(reshape.pivot(self.df, index, column, values, agg, names, self.order))

    def melt(self, id_vars, value_vars=None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return self._new(reshape.melt(self.df, id_vars, value_vars, var_name, value_name))

    def explode(self, column: str, outer: bool = False) -> Frame:
        return self._new(reshape.explode(self.df, column, outer))

    def unnest(self, column: str, prefix: str = "") -> Frame:
        return self._new(nested.unnest(self.df, column, prefix))

    # windows over the frame's order
    def with_cumulative(self, **specs: tuple[str, str | None]) -> Frame:
        return self._new(windows.cumulative(self.df, self._ordered(), specs))

    def with_shifted(self, before: int = 0, after: int = 0, **specs) -> Frame:
        return self._new(windows.shifted(self.df, self._ordered(), specs, before, after))

    def with_rank(self, column: str, rank: str | None = "rank", dense: str | None = "dense_rank") -> Frame:
        """Ranks by ``column`` over the whole frame."""
        return self._new(windows.ranked(self.df, column, rank, dense))

    # functions of one's own
    def apply(self, column: str, fn: Callable[[pd.Series], pd.Series], returns: str | T.DataType, name: str | None = None) -> Frame:
        """A vectorised function of a column; it sees a batch of rows at a time."""
        return self._new(self.df.withColumn(name or column, F.pandas_udf(fn, returns)(F.col(column))))

    def apply_gathered(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> Frame:
        """A function that must see all rows at once: in one task, so only for frames
        that fit there."""
        one = self.df.withColumn("_all", F.lit(0)).groupBy("_all")
        return self._new(one.applyInPandas(lambda rows: fn(rows.drop(columns="_all")), schema))

    # execution
    def cache(self) -> Frame:
        return self._new(self.df.cache())

    def clear_cache(self) -> Frame:
        self.df.unpersist()
        return self

    def collect(self) -> list:
        return self.df.collect()

    def fetch(self, n: int) -> list:
        return self.df.limit(n).collect()

    def to_pandas(self) -> pd.DataFrame:
        return self.df.toPandas()

    def values(self, column: str) -> list:
        """A column's values, in order where there is one."""
        df = self.df.select(column, self.order).orderBy(self.order) if self.order else self.df.select(column)
        return [r[0] for r in df.collect()]

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.FormattedMode)
