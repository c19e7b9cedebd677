"""What the optimizer made of a query: for tests and for looking at plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.FormattedMode)


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|single|round)", physical_plan(df), re.IGNORECASE))


def gathers_all_rows(df: DataFrame) -> bool:
    """Whether a window puts all rows into one task; what partial aggregates leave
    may well meet in one."""
    found = re.findall(r"Window \[.*\n(?:.*Sort.*\n)?.*Exchange SinglePartition.*\n((?:.*Project.*\n)?.*)", physical_plan(df))
    return any("Aggregate" not in below for below in found)


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", physical_plan(df))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)", physical_plan(df))
