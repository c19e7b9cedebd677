"""Window and sequence functions over an explicit order.

Within partitions they are plain window functions. Over a whole frame, one window
would put all rows into one task; there, rows beyond ``BLOCK_ROWS`` are dealt into
blocks by range of the order key, which may have any type. Cumulative functions run
in each block and add what the blocks before sum up to; shifted and rolling ones
work on blocks of numbered rows and get the neighbouring rows of the blocks beside
them. There is a total per block, and these are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.semantics import _c

BLOCK_ROWS = 1_000_000
#: Rows that are sampled for each block, to find its bounds.
SAMPLE = 40

UNBOUNDED, CURRENT = Window.unboundedPreceding, Window.currentRow


def over(order: str | Sequence[str], partition_by: Sequence[str] = ()) -> WindowSpec:
    keys = [order] if isinstance(order, str) else list(order)
    ordered = [_c(k).asc_nulls_last() for k in keys]
    return Window.partitionBy(*partition_by).orderBy(*ordered) if partition_by else Window.orderBy(*ordered)


def lag(c, w: WindowSpec, n: int = 1, default=None) -> Column:
    return F.lag(_c(c), n, default).over(w)


def lead(c, w: WindowSpec, n: int = 1, default=None) -> Column:
    return F.lead(_c(c), n, default).over(w)


def row_number(w: WindowSpec) -> Column:
    return F.row_number().over(w).cast("long")


def rank(w: WindowSpec) -> Column:
    return F.rank().over(w).cast("long")


def dense_rank(w: WindowSpec) -> Column:
    return F.dense_rank().over(w).cast("long")


def cum_sum(c, w: WindowSpec) -> Column:
    return F.sum(_c(c)).over(w.rowsBetween(UNBOUNDED, CURRENT))


def cum_min(c, w: WindowSpec) -> Column:
    return F.min(_c(c)).over(w.rowsBetween(UNBOUNDED, CURRENT))


def cum_max(c, w: WindowSpec) -> Column:
    return F.max(_c(c)).over(w.rowsBetween(UNBOUNDED, CURRENT))


def forward_fill(c, w: WindowSpec) -> Column:
    return F.last(_c(c), ignorenulls=True).over(w.rowsBetween(UNBOUNDED, CURRENT))


def backward_fill(c, w: WindowSpec) -> Column:
    return F.first(_c(c), ignorenulls=True).over(w.rowsBetween(CURRENT, Window.unboundedFollowing))


def rolling(c, w: WindowSpec, size: int, fn: Callable[[Column], Column], min_periods: int = 1, count_nulls: bool = True, nan_prefix: bool = False, least: int = 1) -> Column:
    """``fn`` over the last ``size`` rows where they are ``min_periods`` at least,
    counting rows or, without ``count_nulls``, values; else null, or NaN."""
    frame = w.rowsBetween(-(size - 1), CURRENT)
    seen = (F.count(F.lit(1)) if count_nulls else F.count(_c(c))).over(frame)
    enough = seen >= max(least, min_periods)
    if min_periods > size:
        enough = F.lit(False)
    return F.when(enough, fn(_c(c)).over(frame)).otherwise(F.lit(float("nan")) if nan_prefix else F.lit(None))


def rolling_sum(c, w, size, min_periods=1, **options) -> Column:
    return rolling(c, w, size, F.sum, min_periods, **options)


def rolling_mean(c, w, size, min_periods=1, **options) -> Column:
    return rolling(c, w, size, F.avg, min_periods, **options)


def rolling_min(c, w, size, min_periods=1, **options) -> Column:
    return rolling(c, w, size, F.min, min_periods, **options)


def rolling_max(c, w, size, min_periods=1, **options) -> Column:
    return rolling(c, w, size, F.max, min_periods, **options)


def rolling_std(c, w, size, min_periods=2, **options) -> Column:
    return rolling(c, w, size, F.stddev_samp, min_periods, least=2, **options)


def diff(c, w: WindowSpec, n: int = 1, default=None) -> Column:
    return F.when(F.row_number().over(w) <= n, F.lit(default)).otherwise(_c(c) - F.lag(_c(c), n).over(w))


def pct_change(c, w: WindowSpec) -> Column:
    """Null for the first row and after a zero."""
    before = F.lag(_c(c), 1).over(w)
    return F.when(before != 0, (_c(c) - before) / F.nullif(before, F.lit(0)))


def run_ids(df: DataFrame, id_col: str, order: str, name: str = "run") -> DataFrame:
    """``df`` with a number that grows with every change of ``id_col`` in order."""
    marked = shifted(df, order, {"_before": lambda w: F.lag(F.struct(id_col), 1).over(w)}, before=1)
    changed = F.when(F.col("_before").eqNullSafe(F.struct(id_col)), 0).otherwise(1)
    return cumulative(marked.withColumn("_changed", changed), order, {name: ("sum", "_changed")}).drop("_before", "_changed")


def _key(df: DataFrame, order: str) -> Column:
    """The order key as what can be handed over as a value without a time zone."""
    c = F.col(f"`{order}`")
    return F.unix_micros(c) if isinstance(df.schema[order].dataType, T.TimestampType) else c


def _bounds(df: DataFrame, order: str, n: int, blocks: int) -> DataFrame:
    """One row with ``blocks`` - 1 bounds at most, from a sample of the key, of any type."""
    keys = df.select(_key(df, order).alias("k")).where(F.col("k").isNotNull())
    picked = keys.sample(min(1.0, SAMPLE * blocks / n), seed=7).agg(F.array_sort(F.collect_list("k")).alias("s"))
    at = F.transform(F.sequence(F.lit(1), F.lit(blocks - 1)), lambda i: F.get("s", F.floor(i * F.size("s") / blocks).cast("int")))
    found = picked.select(F.array_distinct(F.array_compact(at)).alias("b"))
    # taken once, so that every use of the blocks sees the same bounds
    return df.sparkSession.createDataFrame(found.collect(), found.schema)


def _below(bounds: Column, key: Column, n: int) -> Column:
    """How many of at most ``n`` ascending bounds are below ``key``, by binary search."""
    steps = [1 << k for k in reversed(range(n.bit_length()))]
    further = lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) < key, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def blocked(df: DataFrame, order: str, rows: int | None = None, n: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with _block, by range of the order key (nulls in the last one), and the
    number of blocks."""
    n = df.count() if n is None else n
    blocks = math.ceil(n / (rows or BLOCK_ROWS))
    if blocks <= 1:
        return df.withColumn("_block", F.lit(0)), 1
    key = _key(df, order)
    found = df.withColumn("_bounds", _bounds(df, order, n, blocks).scalar())
    return found.withColumn("_block", F.when(key.isNull(), F.lit(blocks)).otherwise(_below(F.col("_bounds"), key, blocks - 1))).drop("_bounds"), blocks


def cumulative(df: DataFrame, order: str, specs: dict[str, tuple[str, str | None]], rows: int | None = None, n: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``specs``: (sum, min, max, row_number or
    ffill, column), from the first row to the present one. Rows with one key stand
    in any order, those with a null key at the end. ``n``: the rows, if known."""
    df, blocks = blocked(df, order, rows, n)
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "row_number": lambda _: F.count(F.lit(1)), "ffill": lambda c: F.last(c, ignorenulls=True)}
    inner = (Window.partitionBy("_block") if blocks > 1 else Window).orderBy(F.col(order).asc_nulls_last()).rowsBetween(UNBOUNDED, CURRENT)
    out = df.select("*", *[kinds[k](F.col(c) if c else None).over(inner).alias(name) for name, (k, c) in specs.items()])
    if blocks == 1:
        return out.drop("_block")
    whole = {"sum": F.sum, "min": F.min, "max": F.max, "row_number": lambda _: F.count(F.lit(1)), "ffill": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))}
    totals = df.groupBy("_block").agg(*[whole[k](F.col(c) if c else None).alias(f"_t_{name}") for name, (k, c) in specs.items()])
    before = Window.orderBy("_block").rowsBetween(UNBOUNDED, -1)  # over a row per block
    carry = {"sum": F.sum, "min": F.min, "max": F.max, "row_number": F.sum, "ffill": lambda c: F.last(c, ignorenulls=True)}
    totals = totals.select("_block", *[carry[k](F.col(f"_t_{name}")).over(before).alias(f"_c_{name}") for name, (k, _) in specs.items()])
    joined = out.join(F.broadcast(totals), "_block")

    def both(name: str, kind: str) -> Column:
        here, there = F.col(name), F.col(f"_c_{name}")
        if kind in ("sum", "row_number"):
            return F.when(here.isNull(), there).when(there.isNull(), here).otherwise(here + there)
        return {"min": F.least, "max": F.greatest, "ffill": F.coalesce}[kind](here, there)

    return joined.select(*df.drop("_block").columns, *[both(name, k).alias(name) for name, (k, _) in specs.items()])


def shifted(df: DataFrame, order: str, specs: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0, rows: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``specs``, a function of the window that
    looks at ``before`` rows back and ``after`` ahead at most. Rows are numbered and
    dealt by number, so every block but the last is full, and a row near its end is
    also sent to the next one. The order key should be unique: rows with one key
    stand in any order."""
    n, size = df.count(), max(rows or BLOCK_ROWS, before + after, 1)
    if n <= size:
        w = Window.orderBy(F.col(order).asc_nulls_last())
        return df.select("*", *[f(w).alias(name) for name, f in specs.items()])
    placed = cumulative(df, order, {"_place": ("row_number", None)}, rows, n)
    at, own = (F.col("_place") - 1) % size, F.floor((F.col("_place") - 1) / size)
    copy = lambda block, mine: F.struct(block.alias("block"), F.lit(mine).alias("own"))
    copies = F.array_compact(F.array(copy(own, True), F.when(at >= size - before, copy(own + 1, False)), F.when(at < after, copy(own - 1, False))))
    everything = placed.withColumn("_copy", F.explode(copies))
    w = Window.partitionBy("_copy.block").orderBy("_place")
    return everything.select("*", *[f(w).alias(name) for name, f in specs.items()]).where("_copy.own").drop("_copy", "_place")


def ranked(df: DataFrame, order: str, rank: str | None = "rank", dense: str | None = "dense_rank", rows: int | None = None) -> DataFrame:
    """``df`` with the rank and the dense rank of its rows by ``order`` over the whole
    frame, nulls last. Rows of each key are counted, the distinct keys are numbered
    in blocks, and what was found is joined back, so no task sees all rows."""
    key = F.col(f"`{order}`")
    keys = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    found = cumulative(keys, "_k", {"_upto": ("sum", "_n"), "_d": ("row_number", None)}, rows)
    names = [(F.col("_upto") - F.col("_n") + 1).alias(rank)] * bool(rank) + [F.col("_d").alias(dense)] * bool(dense)
    found = found.select("_k", *names)
    return df.join(found, key.eqNullSafe(F.col("_k")), "left").drop("_k")
