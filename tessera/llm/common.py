"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch at most, so that a batch of long texts stays small.
BATCH_ROWS = 1000
#: Bytes of a table that may be broadcast, in memory there.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``. Where
    the session names none, only a local one, whose tasks all see one disk, gets a
    folder of its own; on a cluster this raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    base = shared_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    path = f"{base.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(hadoop).deleteOnExit(jpath)
    return path


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: cuts
    the lineage and survives the loss of executors."""
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows of an Arrow batch, never raise them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def broadcasts(rows: int, row_bytes: int) -> bool:
    """Whether a table of so many rows is within the bound of what is broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def apart(docs: DataFrame, other: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``other`` with names that ``docs`` has none of, and its columns by their old names."""
    prefix = "_o_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return other.toDF(*[prefix + c for c in other.columns]), lambda c: F.col(prefix + c)


def ascii_lower(col):
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pack(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses what they have in common."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T.tobytes()


def unpack(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).reshape(-1).view(kind)
