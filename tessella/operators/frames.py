"""Frames with an index column: arithmetic on common index entries, updates, equality, exponential means."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators.keyed import same_rows
from tessella.operators.ranks import occurrence

_OPS = {"plus": lambda a, b: a + b, "minus": lambda a, b: a - b, "multiplies": lambda a, b: a * b, "divides": lambda a, b: F.try_divide(a, b)}


def index_arith(lhs: DataFrame, rhs: DataFrame, op: str, idx: str = "idx", pos: str = "pos") -> DataFrame:
    """Element-wise arithmetic on the columns of both frames, over the multiset intersection of their
    indexes: the k-th row of an index value meets the k-th on the other side."""
    shared = [c for c in lhs.columns if c in rhs.columns and c not in (idx, pos)]
    a, b = occurrence(lhs, idx, pos).alias("a"), occurrence(rhs, idx, pos).alias("b")
    f = _OPS[op]
    joined = a.join(b, [idx, "occ"])
    return joined.select(idx, "occ", *(f(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in shared))


def modify_by_idx(lhs: DataFrame, rhs: DataFrame, idx: str = "idx", pos: str = "pos") -> DataFrame:
    """Values of rhs replace those of the same index and occurrence in lhs; nothing else changes."""
    shared = [c for c in lhs.columns if c in rhs.columns and c not in (idx, pos)]
    new = occurrence(rhs, idx, pos).select(idx, "occ", *(F.col(c).alias(f"__{c}") for c in shared))
    joined = occurrence(lhs, idx, pos).join(new, [idx, "occ"], "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in lhs.columns))


def is_equal(lhs: DataFrame, rhs: DataFrame) -> bool:
    """The same columns with the same rows."""
    return same_rows(lhs, rhs)


def column_means(df: DataFrame, *columns: str) -> DataFrame:
    """Means of many columns in one pass."""
    return df.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))


def ewm_frame(alpha: float, bits: int = 56) -> int:
    """How many earlier rows still reach the last bit of a double."""
    import math

    return math.ceil(bits / -math.log2(1 - alpha))
