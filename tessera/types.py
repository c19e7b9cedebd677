"""Types: names, predicates, casts and schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names and what they are in Spark, which has no unsigned integers.
DTYPES: dict[str, T.DataType] = {
    "Float64": T.DoubleType(),
    "Float32": T.FloatType(),
    "Int64": T.LongType(),
    "Int32": T.IntegerType(),
    "UInt64": T.DecimalType(20, 0),
    "UInt32": T.LongType(),
    "Bool": T.BooleanType(),
    "String": T.StringType(),
    "Categorical": T.StringType(),
    "DateTime": T.TimestampType(),
    "Duration": T.DayTimeIntervalType(),
    "Null": T.NullType(),
}
#: Bytes of a value; -1: variable, 0: none.
SIZES = {"Float64": 8, "Int64": 8, "UInt64": 8, "DateTime": 8, "Duration": 8, "Float32": 4, "Int32": 4, "UInt32": 4, "Bool": 1, "String": -1, "Categorical": -1, "Null": 0}


def spark_type(name: str | T.DataType) -> T.DataType:
    return name if isinstance(name, T.DataType) else DTYPES[name]


def dtype_name(kind: T.DataType) -> str:
    """The first name of a Spark type; nested types by their own notation."""
    return next((n for n, t in DTYPES.items() if t == kind), kind.simpleString())


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or kind == DTYPES["UInt64"]


def is_signed(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or is_float(kind)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DatetimeType | T.AnsiIntervalType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType | T.ArrayType)


def byte_size(name: str) -> int:
    return SIZES.get(name, -1)


def struct_type(fields: dict[str, str | T.DataType]) -> T.StructType:
    """Raises on names that come twice, which a dict cannot hold but a list of pairs can."""
    pairs = list(fields.items()) if isinstance(fields, dict) else list(fields)
    names = [n for n, _ in pairs]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate names: {names}")
    return T.StructType([T.StructField(n, spark_type(t)) for n, t in pairs])


def list_type(item: str | T.DataType) -> T.ArrayType:
    return T.ArrayType(spark_type(item))


def fixed_array(col: Column, size: int) -> Column:
    """An array column, checked to have ``size`` items where it is not null."""
    wrong = F.raise_error(F.lit(f"array of other size than {size}"))
    return F.when(col.isNull() | (F.size(col) == size), col).otherwise(wrong)


def cast(col: Column, kind: str | T.DataType, source: T.DataType | None = None) -> Column:
    """To an integer, fractions are cut off; a number becomes true where it is
    positive (fractions) or not zero (integers); what has no value becomes null."""
    target = spark_type(kind)
    if isinstance(target, T.BooleanType) and source is not None and is_numeric(source):
        return col > 0 if is_float(source) else col != 0
    return col.try_cast(target)


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of an operation on two numbers."""
    if not (is_numeric(a) and is_numeric(b)):
        raise TypeError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    if is_float(a) or is_float(b):
        return T.FloatType() if isinstance(a, T.FloatType) and isinstance(b, T.FloatType) else T.DoubleType()
    order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DecimalType(20, 0)]
    return max(a, b, key=lambda t: order.index(t) if t in order else len(order))
