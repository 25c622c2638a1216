"""Set operations on bags and sets of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge of sets."""
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge of bags, vectors or queues."""
    return a.unionByName(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common rows with the smaller multiplicity."""
    return a.intersectAll(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a after taking out those of b, one for one."""
    return a.exceptAll(b)


def flatten(df: DataFrame, arrays: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of the inner arrays, with its place."""
    return df.select(*keep, F.posexplode(F.flatten(arrays)).alias("pos", "value"))
