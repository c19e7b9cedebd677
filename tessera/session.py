"""Session settings: the engine's knobs are Spark's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(threads: int = 0, shuffle_partitions: int | None = None, app: str = "tessera") -> SparkSession:
    """A session; ``threads`` 0 means as many as there are cores (local mode only)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{threads or '*'}]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def set_max_threads(spark: SparkSession, n: int) -> None:
    """The number of tasks after a shuffle; cores are given when a session starts."""
    spark.conf.set("spark.sql.shuffle.partitions", str(n if n > 0 else spark.sparkContext.defaultParallelism))


def runtime_info(spark: SparkSession) -> dict[str, str]:
    """Parallelism and code generation, in place of thread and vector levels."""
    return {
        "max_threads": str(spark.sparkContext.defaultParallelism),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "codegen": spark.conf.get("spark.sql.codegen.wholeStage"),
        "version": spark.version,
    }


def is_running(spark: SparkSession) -> bool:
    return not spark.sparkContext._jsc.sc().isStopped()
