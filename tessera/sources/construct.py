"""Frames from data in the driver's memory."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.types import spark_type, struct_type

_PYTHON = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


def empty(spark: SparkSession, schema: dict | T.StructType | None = None) -> DataFrame:
    return spark.createDataFrame([], schema if isinstance(schema, T.StructType) else struct_type(schema or {}))


def infer(values: Sequence) -> T.DataType:
    """The type of the first value that is not None; fractions anywhere make floats."""
    first = next((v for v in values if v is not None), None)
    if first is None:
        return T.StringType()
    if isinstance(first, list | tuple):
        return T.ArrayType(infer([x for v in values if v for x in v]))
    if isinstance(first, Mapping):
        return T.StructType([T.StructField(k, infer([v.get(k) for v in values if v])) for k in first])
    if type(first) is int and any(isinstance(v, float) for v in values):
        return T.DoubleType()
    return _PYTHON.get(type(first)) or T._infer_type(first)


def series(spark: SparkSession, name: str, data: Sequence, dtype: str | T.DataType | None = None, valid: Sequence[bool] | None = None) -> DataFrame:
    """One column; ``valid`` marks the values that are not null."""
    return from_columns(spark, {name: [v if ok else None for v, ok in zip(data, valid or [True] * len(data), strict=True)]}, {name: dtype} if dtype else None)


def from_columns(spark: SparkSession, data: Mapping[str, Sequence], dtypes: Mapping | None = None, order: str | None = None) -> DataFrame:
    """Columns of one length, in the order given; with ``order`` also the place of
    each row, under that name."""
    if len({len(v) for v in data.values()}) > 1:
        raise ValueError(f"columns of different lengths: { {k: len(v) for k, v in data.items()} }")
    fields = [T.StructField(k, spark_type(dtypes[k]) if dtypes and dtypes.get(k) else infer(v)) for k, v in data.items()]
    as_is = lambda v, t: v if not isinstance(v, int) else float(v) if isinstance(t, T.DoubleType | T.FloatType) else Decimal(v) if isinstance(t, T.DecimalType) else v
    rows = [tuple(as_is(v, f.dataType) for v, f in zip(r, fields)) for r in zip(*data.values())]
    if order:
        fields.append(T.StructField(order, T.LongType()))
        rows = [(*r, i) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, T.StructType(fields))


def from_records(spark: SparkSession, records: Sequence[Mapping]) -> DataFrame:
    """Columns in the order of the first record; a missing key is null."""
    names = list(dict.fromkeys(k for r in records for k in r))
    return from_columns(spark, {n: [r.get(n) for r in records] for n in names})


def from_structs(spark: SparkSession, rows: Sequence) -> DataFrame:
    """Dataclass instances; a field's metadata ``name`` renames it, and ``-`` leaves
    it out."""
    fields = [(f, f.metadata.get("name", f.name)) for f in dataclasses.fields(rows[0]) if f.metadata.get("name") != "-"]
    hints = typing.get_type_hints(type(rows[0]))
    kinds = {}
    for f, name in fields:
        options = [t for t in typing.get_args(hints[f.name]) if t is not type(None)] or [hints[f.name]]
        kinds[name] = _PYTHON.get(options[0])
    return from_columns(spark, {n: [getattr(r, f.name) for r in rows] for f, n in fields}, kinds)
