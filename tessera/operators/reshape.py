"""Pivot, melt and explode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import aggregates as A


def pivot(df: DataFrame, index: str | Sequence[str], column: str, values: str, agg: str = "first", names: Sequence | None = None, order: str | None = None) -> DataFrame:
    """A column for each of ``names``, or each distinct value of ``column``."""
    if agg in ("first", "last"):
        value = (A.first if agg == "first" else A.last)(values, order or values)
    else:
        value = A.BY_NAME[agg](values)
    keys = [index] if isinstance(index, str) else list(index)
    grouped = df.groupBy(*keys)
    return (grouped.pivot(column, list(names)) if names is not None else grouped.pivot(column)).agg(value)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    rest = list(value_vars) if value_vars else [c for c in df.columns if c not in id_vars]
    return df.unpivot(list(id_vars), rest, var_name, value_name)


def explode(df: DataFrame, column: str, outer: bool = False) -> DataFrame:
    """A row for each item; with ``outer`` one with null for an empty or null list."""
    make = F.explode_outer if outer else F.explode
    return df.select(*[make(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
