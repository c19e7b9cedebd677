"""Event-time aggregation of streams; every function takes batches as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark, which a stream wants on timestamps with a zone."""
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late)


def windowed(events: DataFrame, time: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Tumbling or sliding windows with count and sum; rows later than ``late``
    behind the newest are dropped by a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = _marked(events, time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """Rows of a key that follow one another within ``gap``."""
    out = _marked(events, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_events(events: DataFrame, time: str, keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    return _marked(events, time, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))
