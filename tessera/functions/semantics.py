"""Column semantics that Spark does not have as such: IEEE division and
comparison, NaN as a missing value, horizontal folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ieee_div(a, b) -> Column:
    """Infinite or NaN on division by zero, null only where an operand is."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    # multiplied, zero by zero is the processor's own NaN, as in SQL, not a literal one with
    # another sign bit; only its text tells a negative zero, as both zeros are equal
    turned = F.when(b.cast("string") == "-0.0", F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    # nullif: the branch not taken must not divide by zero either
    return F.when(b == 0, a * turned).otherwise(a / F.nullif(b, F.lit(0.0)))


def compare(a, b, op: str) -> Column:
    """IEEE comparison as a mask: false where a side is null, and where one is NaN
    but for ``ne``."""
    a, b = _c(a), b if isinstance(b, Column) else _c(b) if isinstance(b, str) else F.lit(b)
    x, y = a.cast("double"), b.cast("double")
    nan = F.isnan(x) | F.isnan(y)
    base = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b, "eq": a == b, "ne": a != b}[op]
    return F.coalesce((base | nan) if op == "ne" else (base & ~nan), F.lit(False))


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(~F.isnan(c), c)


def is_null(c, nan_as_null: bool = False) -> Column:
    c = _c(c)
    return c.isNull() | F.isnan(c) if nan_as_null else c.isNull()


def is_not_null(c, nan_as_null: bool = False) -> Column:
    return ~is_null(c, nan_as_null)


def fill_null(c, value, nan_as_null: bool = False) -> Column:
    c = _c(c)
    return F.coalesce(nan_to_null(c) if nan_as_null else c, F.lit(value))


def coalesce(*cols, nan_as_null: bool = False) -> Column:
    return F.coalesce(*[nan_to_null(c) if nan_as_null else _c(c) for c in cols])


def count_null(c, nan_as_null: bool = False) -> Column:
    return F.count_if(is_null(c, nan_as_null))


def count_not_null(c, nan_as_null: bool = False) -> Column:
    return F.count_if(is_not_null(c, nan_as_null))


def select(mask, then, otherwise) -> Column:
    """``then`` where the mask holds, else ``otherwise``, also where it is null."""
    value = lambda x: x if isinstance(x, Column) else _c(x) if isinstance(x, str) else F.lit(x)
    return F.when(_c(mask), value(then)).otherwise(value(otherwise))


def sum_horizontal(*cols) -> Column:
    return reduce(lambda a, b: a + b, map(_c, cols))


def product_horizontal(*cols) -> Column:
    return reduce(lambda a, b: a * b, map(_c, cols))


def mean_horizontal(*cols) -> Column:
    return sum_horizontal(*cols) / F.lit(len(cols))


def min_horizontal(*cols) -> Column:
    """Skips nulls and NaN."""
    return F.least(*map(nan_to_null, cols)) if len(cols) > 1 else nan_to_null(cols[0])


def max_horizontal(*cols) -> Column:
    """Skips nulls and NaN."""
    return F.greatest(*map(nan_to_null, cols)) if len(cols) > 1 else nan_to_null(cols[0])


def any_horizontal(*cols) -> Column:
    return reduce(lambda a, b: a | b, map(_c, cols))


def all_horizontal(*cols) -> Column:
    return reduce(lambda a, b: a & b, map(_c, cols))


def count_non_null_horizontal(*cols, nan_as_null: bool = True) -> Column:
    return reduce(lambda a, b: a + b, [is_not_null(c, nan_as_null).cast("int") for c in cols])


def hash64(*cols) -> Column:
    """A deterministic 64-bit hash of the values together."""
    return F.xxhash64(*map(_c, cols))


def combine_hashes(*hashes) -> Column:
    """One hash of several, in their order; nulls count as no hash at all."""
    return F.xxhash64(*map(_c, hashes))


def min_with(c, value) -> Column:
    """The smaller of a column and a value; null where the column is."""
    c = _c(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(value)))


def max_with(c, value) -> Column:
    """The larger of a column and a value; null where the column is."""
    c = _c(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(value)))


def wrapping(op: str, a, b) -> Column:
    """Sum, difference or product (``add``, ``sub``, ``mul``) of 64-bit integers that
    wraps around at the ends, whatever the session's rule for overflow."""
    wide = [_c(x).cast("decimal(38,0)") for x in (a, b)]
    exact = {"add": wide[0] + wide[1], "sub": wide[0] - wide[1], "mul": wide[0] * wide[1]}[op]
    turn, half = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(exact.cast("decimal(38,0)") + half, turn) - half).cast("long")
