"""Connected components of large graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcasts, materialize


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, ascending, and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, least = label.copy(), np.minimum(label[x], label[y])
        # the roots of both ends are hooked, then all paths are made short
        np.minimum.at(low, label[x], least)
        np.minimum.at(low, label[y], least)
        while (low[low] != low).any():
            low = low[low]
        if (low == label).all():
            return nodes, nodes[label]
        label = low


#: Of an edge on the driver, with its nodes and labels.
EDGE_BYTES = 32


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b), label being the smallest
    node that it reaches. Alternates large and small stars; each step's edges are
    written to the shared folder, so the plan stays short. Minima are taken by
    partial aggregation, so a node with a third of all edges costs no more. Edges
    within the size of a broadcast are joined on the driver, in place of many small jobs."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialize(spark, now, "edges")
    if broadcasts(now.count(), EDGE_BYTES):
        found = now.toArrow()
        nodes, label = smallest(found["a"].to_numpy(), found["b"].to_numpy())
        return materialize(spark, spark.createDataFrame(pa.table({"node": nodes, "label": label})), "labels")
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        now = materialize(spark, star.where("a <> b").distinct(), "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
