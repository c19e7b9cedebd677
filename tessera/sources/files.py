"""CSV, JSON and Parquet files. Reads are lazy; scans prune columns and push
filters down where the format allows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import spark_type


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, names: Sequence[str] | None = None, types: Mapping | None = None, infer_types: bool = True, null_values: Sequence[str] = ("",), skip_rows: int = 0, max_rows: int | None = None, comment: str | None = None) -> DataFrame:
    """Types are the given ones, or inferred over all rows as Int64, Float64, Bool or
    String. ``skip_rows``: lines before the header, dropped from a file read whole
    by line number, so only for files of moderate size."""
    source = path
    if skip_rows:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).where((F.col("i") >= skip_rows) & (F.col("line") != ""))
        source = lines.orderBy("i").select("line").rdd.map(lambda r: r[0])
    reader = spark.read.option("sep", delimiter).option("header", header).option("nullValue", "\0")
    if comment:
        reader = reader.option("comment", comment)
    raw = reader.csv(source)
    if names:
        raw = raw.toDF(*names)
    if max_rows is not None:
        raw = raw.limit(max_rows)
    nulls = [v for v in null_values]
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(nulls), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    kinds = {c: spark_type(t) for c, t in (types or {}).items()}
    if infer_types and (rest := [c for c in clean.columns if c not in kinds]):
        kinds |= infer_csv_types(clean, rest)
    return clean.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in clean.columns])


def infer_csv_types(raw: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """The first of Int64, Float64, Bool and String that holds every value."""
    tests = {"long": r"^[+-]?\d{1,19}$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(NaN|Infinity|Inf)$", "boolean": r"^(?i:true|false)$"}
    checks = [F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(p) & (F.lit(True) if t != "long" else F.col(f"`{c}`").try_cast("long").isNotNull())), F.lit(False)).alias(f"{i}_{t}") for i, c in enumerate(columns) for t, p in tests.items()]
    row = raw.agg(*checks).first()
    types = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return {c: next((types[t] for t in tests if row[f"{i}_{t}"]), T.StringType()) for i, c in enumerate(columns)}


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, null_value: str = "", quote: str = '"', line_end: str = "\n", mode: str = "overwrite") -> None:
    df.write.mode(mode).options(sep=delimiter, header=header, nullValue=null_value, quote=quote, lineSep=line_end).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """An array of objects, or one object whose values are columns of one length."""
    reader = spark.read.option("multiLine", True)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    arrays = df.columns and all(isinstance(f.dataType, T.ArrayType) for f in df.schema)
    if schema is None and arrays and len(df.take(2)) == 1:
        return df.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])))
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_json(df: DataFrame, path: str, order: str | None = None, mode: str = "overwrite") -> None:
    """One JSON array in one file, made of a line for each row: sorted and written by
    one task as rows stream by, never as one value."""
    rows = (df.orderBy(order) if order else df).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)

    def bracket(batches):
        import pandas as pd

        first = True
        yield pd.DataFrame({"value": ["["]})
        for b in batches:
            if len(b):
                b = b.copy()
                b["value"] = ["" if first and i == 0 else "," for i in range(len(b))] + b["value"]
                first = False
                yield b
        yield pd.DataFrame({"value": ["]"]})

    rows.mapInPandas(bracket, "value string").write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: A scan is a read: nothing runs before an action.
scan_csv, scan_json, scan_jsonl, scan_parquet = read_csv, read_json, read_jsonl, read_parquet
