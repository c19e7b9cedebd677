"""Equi-joins; null keys never match, and the schema stays when nothing does."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}
#: A side up to this size, by the optimizer's estimate, may be broadcast.
BROADCAST_BYTES = 64 << 20


def _keys(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x or ())


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, how: str = "inner", left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None, suffix: str = "_right", strategy: str | None = None) -> DataFrame:
    """With ``on`` a key is one column; with ``left_on`` and ``right_on`` both sides
    keep theirs. A right column whose name is taken gets ``suffix``. ``strategy``:
    broadcast (only within ``BROADCAST_BYTES``), shuffle_hash or merge; without it
    the planner and adaptive execution choose."""
    keys_left, keys_right = (_keys(on), _keys(on)) if on is not None else (_keys(left_on), _keys(right_on))
    if not keys_left or len(keys_left) != len(keys_right):
        raise ValueError("a join needs as many keys on either side, and one at least")
    for df, keys in ((left, keys_left), (right, keys_right)):
        if missing := [k for k in keys if k not in df.columns]:
            raise KeyError(f"no such columns: {missing}")
    taken = set(left.columns)
    names = {}
    for c in right.columns:
        new = f"__key_{c}" if on is not None and c in keys_right else c + suffix if c in taken else c
        while new in taken and new != c:
            new += suffix
        names[c] = new
        taken.add(new)
    other = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if strategy == "broadcast":
        size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        other = F.broadcast(other) if size <= BROADCAST_BYTES else other
    elif strategy:
        other = other.hint(strategy)
    condition = reduce(lambda a, b: a & b, [left[f"`{a}`"] == other[f"`{names[b]}`"] for a, b in zip(keys_left, keys_right)])
    out = left.join(other, condition, HOW[how])
    if on is None or HOW[how].startswith("left_"):
        return out
    whole = HOW[how] in ("right", "full")
    key = lambda c: F.coalesce(left[f"`{c}`"], other[f"`{names[c]}`"]).alias(c) if whole else left[f"`{c}`"]
    return out.select(*[key(c) if c in keys_left else left[f"`{c}`"] for c in left.columns], *[other[f"`{names[c]}`"] for c in right.columns if c not in keys_right])
