"""Maps, multimaps, sets and the key-value primitives, as keyed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import bucket_of


def first_wins(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the value inserted first. Each task keeps one row per key before the shuffle."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the value put last."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """All values of a key as a sorted array."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value))


def distinct_set(df: DataFrame, *keys: str) -> DataFrame:
    """Set insert: every key once."""
    return df.select(*keys).distinct()


def bag(df: DataFrame, *keys: str) -> DataFrame:
    """Multiset as (key, multiplicity)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def get(table: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """Batch lookup that keeps misses: (key, value, found)."""
    held = table.select(key, value, F.lit(True).alias("found"))
    return keys.join(held, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def contains(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The asked keys that exist."""
    return keys.join(table.select(key), key, "left_semi")


def put(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: new rows replace those of the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def try_emplace(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert if absent: held rows stay."""
    return table.unionByName(new.join(table.select(key), key, "left_anti"))


def merge(destination: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Union of two maps; the destination wins."""
    return try_emplace(destination, source, key)


def erase(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without some keys."""
    return table.join(keys.select(key), key, "left_anti")


def get_and_remove(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is taken out, and what remains."""
    return table.join(keys.select(key), key, "left_semi"), erase(table, keys, key)


def update_if_equals(table: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """Compare and set: wanted has (key, old, new); a value changes where it equals old."""
    joined = table.join(wanted.select(key, F.col("old").alias("__old"), F.col("new").alias("__new"), F.lit(True).alias("__hit")), key, "left")
    hit = F.col("__hit") & F.col(value).eqNullSafe(F.col("__old"))
    return joined.withColumn(value, F.when(hit, F.col("__new")).otherwise(F.col(value))).drop("__old", "__new", "__hit")


def remove_if_equals(table: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """Removes the pairs (key, value) that are held exactly so."""
    w = wanted.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    return table.join(w, (F.col(key) == F.col("__k")) & F.col(value).eqNullSafe(F.col("__v")), "left_anti")


def get_or_emplace(table: DataFrame, keys: DataFrame, key: str, value: str, default) -> DataFrame:
    """The table after reading keys with default insertion."""
    absent = keys.select(key).distinct().join(table.select(key), key, "left_anti").withColumn(value, F.lit(default))
    return table.unionByName(absent.select(*table.columns))


def apply_on(table: DataFrame, updates: DataFrame, key: str, value: str, expr: Column, default) -> DataFrame:
    """Read-modify-write with default insertion; expr is over value and the update's columns (one per key)."""
    joined = table.join(updates.withColumn("__hit", F.lit(True)), key, "full").withColumn(value, F.coalesce(F.col(value), F.lit(default)))
    return joined.select(key, F.when(F.col("__hit"), expr).otherwise(F.col(value)).alias(value))


def apply_nullable(table: DataFrame, updates: DataFrame, key: str, value: str, present: Column, absent: Column) -> DataFrame:
    """Read-modify-write that may find nothing: `present` is over value and the update's columns (one per key), `absent`
    over the update's columns alone. A null from either leaves the key out, so nothing is inserted by looking."""
    held = table.select(key, value, F.lit(True).alias("__held"))
    joined = held.join(updates.withColumn("__hit", F.lit(True)), key, "full")
    new = F.when(F.col("__hit").isNull(), F.col(value)).when(F.col("__held"), present).otherwise(absent)
    gone = F.col("__hit") & new.isNull()
    return joined.filter(~F.coalesce(gone, F.lit(False))).select(key, new.alias(value))


def each_until(table: DataFrame, predicate: Column, n: int) -> DataFrame:
    """A scan that may end early: up to n matching rows."""
    return table.filter(predicate).limit(n)


def shards(table: DataFrame, key: str, power: int) -> DataFrame:
    """Adds the bucket of each key among 2^power."""
    return table.withColumn("shard", bucket_of(power, F.col(key)))


def strict_lookup(left: DataFrame, table: DataFrame, key: str, message: str = "missing key") -> DataFrame:
    """Inner lookup in which a missing key raises."""
    held = table.withColumn("__hit", F.lit(True))
    joined = left.join(held, key, "left")
    return joined.filter(F.assert_true(F.coalesce("__hit", F.lit(False)), message).isNull()).drop("__hit")


def default_lookup(left: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left lookup with a default for misses."""
    return left.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def multi_get(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Lookup of a list (pos, key): missing ids are skipped, pos keeps the order asked for."""
    return ids.join(table, key, "inner")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags, by counting each row on both sides (one shuffle)."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    cols = sorted(a.columns)
    both = a.select(*cols, F.lit(1).alias("__d")).unionAll(b.select(*cols, F.lit(-1).alias("__d")))
    return both.groupBy(*cols).agg(F.sum("__d").alias("__d")).filter("__d <> 0").isEmpty()
