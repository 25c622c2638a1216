"""Two-phase aggregation, histograms, percentiles, partition sizes."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.operators.ranks import nth_values


def reduce_all(df: DataFrame, *aggs: Column) -> DataFrame:
    """One row; every task reduces its rows first."""
    return df.agg(*aggs)


def reduce_shards(df: DataFrame, shard: Column, *aggs: Column) -> DataFrame:
    """Partial results per shard, not merged."""
    return df.groupBy(shard.alias("shard")).agg(*aggs)


def map_reduce(df: DataFrame, key: Sequence[str], *aggs: Column) -> DataFrame:
    """Emitted (key, value) pairs combined per key; keys never emitted are absent."""
    return df.groupBy(*key).agg(*aggs)


def vector_sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise sums of vectors per key, with the number of vectors: (key, n, sums). Each task adds up its rows'
    vectors, so one row per key and task is shuffled, not one per element. Null keys are a key; vectors of a key have
    one length."""
    kind = df.schema[key].dataType.simpleString()

    def share(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for k, part in b.groupby(key, dropna=False)[vector]:
                s = np.sum(np.stack([np.asarray(v, float) for v in part]), axis=0)
                k = None if pd.isna(k) else k
                n, t = held.get(k, (0, 0.0))
                held[k] = n + len(part), t + s
        if held:
            yield pd.DataFrame({key: pd.Series(list(held), dtype=object), "n": [n for n, _ in held.values()], "sums": [t for _, t in held.values()]})

    parts = df.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(share, f"`{key}` {kind}, n long, sums array<double>")
    added = parts.select(key, "n", F.posexplode("sums").alias("i", "x")).groupBy(key, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return added.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("sums"))


def truncated_mean(total: Column, n: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", total, n)


def latency_histogram(spark: SparkSession, df: DataFrame, value: str, width: float = 50.0, buckets: int = 11) -> DataFrame:
    """Counts per bucket of a fixed width; the last one takes the rest, empty ones count 0."""
    b = F.least(F.floor(F.col(value) / width), F.lit(buckets - 1)).cast("long")
    counts = df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def percentiles(df: DataFrame, value: str, points: Sequence[float], exact: bool = True) -> DataFrame:
    """Percentiles as p<point> columns, one row. Exact ones are interpolated between the values at the two places about
    the point, which are found by shrinking brackets; neither values nor their counts meet in one task."""
    names = [f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}" for p in points]
    if not exact:
        return df.agg(*(F.percentile_approx(value, p, 10000).alias(n) for p, n in zip(points, names, strict=True)))
    held = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value))
    n = held.count()
    places = sorted({k for p in points for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else []
    found = dict(zip(places, nth_values(held, value, places), strict=True))
    out = []
    for p in points:
        low, part = (math.floor(p * (n - 1)), p * (n - 1) % 1) if n else (0, 0.0)
        out.append(found[low][0] * (1 - part) + found[math.ceil(p * (n - 1))][0] * part if n else None)
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"`{x}` double" for x in names))


def drain_reduce(df: DataFrame, *aggs: Column) -> tuple[DataFrame, DataFrame]:
    """A reduction that empties what it reads: the one row, and the table that is left."""
    return df.agg(*aggs), df.limit(0)


def partition_sizes(df: DataFrame, key: str) -> DataFrame:
    """(lowest key, rows) of every partition as it is."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.min(key).alias("low"), F.count("*").alias("n"))


def range_sizes(df: DataFrame, key: str, low: float, high: float, n: int) -> DataFrame:
    """Rows per equal range of a key."""
    return df.groupBy(F.width_bucket(F.col(key).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(n)).alias("bucket")).agg(F.min(key).alias("low"), F.count("*").alias("n"))


def size(df: DataFrame) -> int:
    """Rows."""
    return df.count()


def is_empty(df: DataFrame) -> bool:
    """Whether there is no row."""
    return df.isEmpty()


def rate_report(df: DataFrame, start_us: str = "start_us", duration_us: str = "duration_us") -> DataFrame:
    """Requests per second and latency percentiles of a trace, the latter with a relative rank error of 1/10,000."""
    took = F.max(F.col(start_us) + F.col(duration_us)) - F.min(start_us)
    return df.agg(
        F.count("*").alias("requests"),
        F.try_divide(F.count("*") * F.lit(1e6), took).alias("per_second"),
        F.avg(duration_us).alias("mean_us"),
        *(F.percentile_approx(duration_us, p, 10000).alias(f"p{n}") for p, n in ((0.5, "50"), (0.9, "90"), (0.99, "99"), (0.999, "99_9"))),
    )
