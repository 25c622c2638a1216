"""Vectors (pos, value) and the executor's map, filter, sum and zip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators.ranks import with_pos


def for_all(df: DataFrame, expr: Column, value: str = "value") -> DataFrame:
    """Replaces every element by an expression over its row."""
    return df.withColumn(value, expr)


def for_all_unsupported(kind: str) -> None:
    """Sets, queues and stacks have no element-wise update."""
    raise NotImplementedError(f"for_all is not defined on a {kind}")


def copy_if(df: DataFrame, predicate: Column, renumber: bool = False) -> DataFrame:
    """Keeps the matching elements in their order; renumber gives them dense positions."""
    kept = df.filter(predicate)
    return with_pos(kept.withColumnRenamed("pos", "__old"), ["__old"]).drop("__old") if renumber else kept


def set_at(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Point updates (pos, value); positions that don't exist are left out."""
    new = updates.select("pos", F.col("value").alias("__new"), F.lit(True).alias("__hit"))
    return df.join(new, "pos", "left").withColumn("value", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("value"))).drop("__new", "__hit")


def at(df: DataFrame, pos: int) -> DataFrame:
    """The element at a position, or no row."""
    return df.filter(F.col("pos") == pos)


def scan_from(df: DataFrame, pos: int) -> DataFrame:
    """All elements from a position on."""
    return df.filter(F.col("pos") >= pos)


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """Appends the right vector behind the left one."""
    n = left.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("__n"))
    moved = right.crossJoin(F.broadcast(n)).withColumn("pos", F.col("pos") + F.col("__n")).drop("__n")
    return left.unionByName(moved)


def zipped(*vectors: DataFrame, check: bool = True) -> DataFrame:
    """Row i of every vector as (pos, v0, v1, ...); with check, different sizes raise."""
    named = [v.select("pos", F.col("value").alias(f"v{i}"), F.lit(True).alias(f"h{i}")) for i, v in enumerate(vectors)]
    out = named[0]
    for right in named[1:]:
        out = out.join(right, "pos", "full" if check else "inner")
    if check:
        present = F.col("h0")
        for i in range(1, len(named)):
            present = present & F.col(f"h{i}")
        fine = F.assert_true(F.coalesce(present, F.lit(False)), "zipped vectors differ in size")
        out = out.filter(fine.isNull())
    return out.select("pos", *(f"v{i}" for i in range(len(named))))


def map_shards(df: DataFrame, function, schema: str) -> DataFrame:
    """Runs an opaque function over whole partitions, one Arrow batch after the other."""
    return df.mapInPandas(function, schema)


def parallel_ranges(spark, begin: int, end: int, chunks: int, function, schema: str) -> DataFrame:
    """One call function(b, e) -> pandas frame for each of about `chunks` equal ranges."""
    size = max(1, -(-(end - begin) // chunks))

    def run(batches):
        for batch in batches:
            for b in batch["id"]:
                yield function(int(b), min(int(b) + size, end))

    return spark.range(begin, end, size, chunks).mapInPandas(run, schema)
