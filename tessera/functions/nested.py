"""String, struct and list functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.semantics import _c


class Str:
    """Functions of a string column; lengths are in characters, patterns literal."""

    def __init__(self, c):
        self.c = _c(c)

    def upper(self) -> Column:
        return F.upper(self.c)

    def lower(self) -> Column:
        return F.lower(self.c)

    def len(self) -> Column:
        return F.length(self.c)

    def contains(self, pattern: str) -> Column:
        return self.c.contains(pattern)

    def starts_with(self, prefix: str) -> Column:
        return self.c.startswith(prefix)

    def ends_with(self, suffix: str) -> Column:
        return self.c.endswith(suffix)

    def replace(self, old: str, new: str) -> Column:
        return F.replace(self.c, F.lit(old), F.lit(new))

    def trim(self) -> Column:
        """Without white space of any kind on either side."""
        return F.regexp_replace(self.c, r"^\s+|\s+$", "")

    def eq(self, value: str) -> Column:
        return F.coalesce(self.c == F.lit(value), F.lit(False))

    def ne(self, value: str) -> Column:
        return F.coalesce(self.c != F.lit(value), F.lit(False))


class List:
    """Functions of a list column; nulls in a list are skipped, places count from 0."""

    def __init__(self, c):
        self.c = _c(c)

    def get(self, i) -> Column:
        return F.get(self.c, F.lit(i) if isinstance(i, int) else i)

    def len(self) -> Column:
        return F.array_size(self.c)

    def sum(self) -> Column:
        return F.aggregate(F.array_compact(self.c), F.lit(0.0), lambda a, x: a + x.cast("double"))

    def mean(self) -> Column:
        return self.sum() / F.nullif(F.array_size(F.array_compact(self.c)), F.lit(0))

    def min(self) -> Column:
        return F.array_min(self.c)

    def max(self) -> Column:
        return F.array_max(self.c)


def struct(**fields) -> Column:
    return F.struct(*[_c(c).alias(n) for n, c in fields.items()])


def field(c, name: str) -> Column:
    return _c(c).getField(name)


def row(c) -> Column:
    """The values of a struct as text by field name, as one row is looked at."""
    return F.to_json(_c(c), {"ignoreNullFields": "false"})


def field_names(df: DataFrame, c: str) -> list[str]:
    return [f.name for f in df.schema[c].dataType.fields]


def unnest(df: DataFrame, c: str, prefix: str = "") -> DataFrame:
    """The fields of a struct column as columns in its place."""
    if not isinstance(df.schema[c].dataType, T.StructType):
        raise TypeError(f"{c} is no struct")
    out = []
    for name in df.columns:
        out += [F.col(f"`{c}`.`{f}`").alias(prefix + f) for f in field_names(df, c)] if name == c else [F.col(f"`{name}`")]
    return df.select(*out)
