"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is normalised, turned by ``ROTATIONS`` random orthogonal matrices (from a
seed) and kept as one bit per dimension and rotation with a correction scalar for each:
the inner product of the turned vector and its code. A query is turned, too, and cut
to ``PLANES`` bits per dimension, so its inner product with a code is a sum of popcounts
of words: code AND plane of the query. With the correction it is an unbiased estimate
of the cosine, whose error bound shrinks with the rotations.

Rows are dealt evenly into blocks, queries into blocks of their own, and each pair of
blocks is searched in a task of bounded size, on codes alone, twice: first for the
rows with the best lower bounds, which over all blocks give each query a limit, then
for those whose upper bound reaches the limit. These get their vectors by a join on
ids and are reranked by the exact cosine in double precision. Of rows with equal vectors only the
smallest ids that can be among the best take part, so a vector that a third of all
rows share gives no more candidates than another. A vector is indexed whatever its
values, so recall depends on the bound alone (``EPSILON`` standard errors), not on a
partition of the space.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without an id, take no part; vectors of different length
are never neighbours; rows that share an id count once, by their best score, and
are not neighbours of one another; equal scores go to the smaller id; a query
with fewer candidates than asked gets them all; an empty table has no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches

SEED = 20
ROTATIONS, PLANES = 16, 4
EPSILON = 2.4
ROW_BLOCK, QUERY_BLOCK = 20_000, 2_048

INDEX = "vec_id bigint, dim int, code binary, correction binary, vec array<double>"

U = np.uint64


def rotations(dim: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrices side by side, the same in every task."""
    out = []
    for k in range(ROTATIONS):
        q, r = np.linalg.qr(np.random.default_rng([seed, dim, k]).standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.hstack(out)


def turn(vectors: np.ndarray, by: np.ndarray) -> np.ndarray:
    """(rows, rotations, dimensions) of the normalised and turned vectors."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    return (unit @ by).reshape(len(vectors), ROTATIONS, -1)


def words(bits: np.ndarray) -> np.ndarray:
    """The last axis as 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(U)


def usable(vec: Column) -> Column:
    numbers = F.transform(vec, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(numbers, lambda x: x != 0.0), F.lit(False))


def encode(vectors: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the sign bits, and correction scalars, of each row and rotation."""
    turned = turn(vectors, by)
    return words(turned > 0), np.abs(turned).sum(axis=2) / math.sqrt(vectors.shape[1])


def build_index(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """(vec_id, dim, code, correction, vec) of every usable row."""
    small_batches(spark, 5000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].map(len)):
                if dim not in turns:
                    turns[dim] = rotations(dim, seed)
                codes, correction = encode(np.stack(part["vec"].to_numpy()), turns[dim])
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "dim": dim, "code": [c.tobytes() for c in codes], "correction": [c.tobytes() for c in correction], "vec": part["vec"].to_numpy()})

    clean = rows.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vec"))
    return clean.mapInPandas(run, INDEX)


def estimate(codes: np.ndarray, ones: np.ndarray, correction: np.ndarray, query: np.ndarray, dim: int) -> tuple[np.ndarray, float]:
    """Estimated cosines of the rows with a turned query (rotations, dimensions), and
    the largest step of its dimensions; ``ones``: set bits of each row and rotation."""
    low, high = query.min(axis=1, keepdims=True), query.max(axis=1, keepdims=True)
    step = np.maximum(high - low, 1e-12) / ((1 << PLANES) - 1)
    levels = np.rint((query - low) / step).astype(np.uint8)
    inside = np.zeros(ones.shape, dtype=np.int32)
    for b in range(PLANES):
        plane = words(levels >> b & 1)
        for k in range(codes.shape[2]):
            inside += np.bitwise_count(codes[:, :, k] & plane[:, k]).astype(np.int32) << b
    held = low[:, 0] * ones + step[:, 0] * inside  # what the dimensions with a set bit add up to
    whole = low[:, 0] * dim + step[:, 0] * levels.sum(axis=1, dtype=np.int64)
    return ((2 * held - whole) / correction).mean(axis=1) / math.sqrt(dim), float(step.max())


def search_block(ids: np.ndarray, codes: np.ndarray, correction: np.ndarray, dim: int, query_ids: np.ndarray, queries: np.ndarray, k: int, by: np.ndarray, limits: np.ndarray | None = None, epsilon: float = EPSILON) -> list[tuple]:
    """(query ids, vec ids, lower bounds) of rows of a block for each query: with
    ``limits``, all whose upper bound reaches the query's; else the ``k`` ids with the
    largest lower bounds."""
    error = epsilon * np.sqrt(np.maximum(0.0, 1 - correction**2) / correction**2 / max(1, dim - 1)).mean(axis=1) / math.sqrt(ROTATIONS)
    ones, turned = np.bitwise_count(codes).sum(axis=2, dtype=np.int64), turn(queries, by)
    repeated = len(np.unique(ids)) < len(ids)
    out = []
    for j, (own, query) in enumerate(zip(query_ids.tolist(), turned)):
        guess, step = estimate(codes, ones, correction, query, dim)
        # a dimension of the query is off by a third of a step or so
        bound = error + epsilon * step / 3 / math.sqrt(ROTATIONS) + 1e-9
        low = np.where(ids == own, -np.inf, guess - bound)
        if limits is not None:
            take = np.flatnonzero((guess + bound >= limits[j]) & (ids != own))
        elif repeated:
            best = pd.Series(low).groupby(ids).idxmax().to_numpy()
            take = best[np.argsort(-low[best])[:k]]
        else:
            take = np.argpartition(-low, k)[:k] if len(low) > k else np.arange(len(low))
        take = take[np.isfinite(low[take])]
        out.append((np.full(len(take), own), ids[take], low[take]))
    return out


def _rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The exact cosine of each pair, summed row by row, so that equal vectors have
    equal scores wherever they stand."""
    for batch in batches:
        score = np.zeros(len(batch))
        dims = batch["vec"].map(len).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            v, q = (np.stack(batch[c].to_numpy()[at]).astype(np.float64) for c in ("vec", "query"))
            score[at] = (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        yield pd.DataFrame({"query_id": batch["query_id"], "vec_id": batch["vec_id"], "score": score})


def nearest(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of ``index`` to
    each row of ``queries`` (rows of an index, too)."""
    rows, asked = index.count(), queries.count()
    row_blocks, query_blocks = max(1, math.ceil(rows / ROW_BLOCK)), max(1, math.ceil(asked / QUERY_BLOCK))
    block = lambda n, key="vec_id": F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # of rows with one vector, which all have one score, the smallest ids can be found alone
    same = Window.partitionBy(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"), "dim").orderBy("vec_id")
    codes = index.select("vec_id", "dim", "code", "correction", F.dense_rank().over(same).alias("place")).where(F.col("place") <= k + 1).drop("place")
    left = codes.withColumn("rb", block(row_blocks)).withColumn("qb", each(query_blocks))
    right = queries.select(*[F.col(c).alias(f"asked_{c}") for c in ("vec_id", "dim", "vec")]).withColumn("qb", block(query_blocks, "asked_vec_id")).withColumn("rb", each(row_blocks))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for dim, qs in asked.groupby("asked_dim"):
            part = rows[rows["dim"] == dim]
            if len(part):
                codes = np.frombuffer(b"".join(part["code"]), dtype=U).reshape(len(part), ROTATIONS, -1)
                correction = np.frombuffer(b"".join(part["correction"])).reshape(len(part), ROTATIONS)
                out += search_block(part["vec_id"].to_numpy(), codes, correction, dim, qs["asked_vec_id"].to_numpy(), np.stack(qs["asked_vec"].to_numpy()), k, rotations(dim, seed), qs["limit"].to_numpy() if "limit" in qs else None)
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "low"], map(np.concatenate, zip(*out)))))

    kind = "query_id bigint, vec_id bigint, low double"
    search = lambda asked: left.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(run, kind)
    # first what each query can be sure of, over all blocks; then what may be better
    sure = search(right).groupBy("query_id", "vec_id").agg(F.max("low").alias("low"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    limit = materialize(spark, sure.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("low").alias("limit")), "ann-limits")
    limited = right.join(limit, F.col("asked_vec_id") == F.col("query_id"), "left").drop("query_id").withColumn("limit", F.coalesce("limit", F.lit(float("-inf"))))
    left_over = search(limited).select("query_id", "vec_id").distinct()
    pairs = left_over.join(index.select("vec_id", "vec"), "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")), "query_id").where(F.size("vec") == F.size("query"))
    scored = pairs.select("query_id", "vec_id", "vec", "query").mapInPandas(_rerank, "query_id bigint, vec_id bigint, score double")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
