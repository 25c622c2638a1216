"""Ordered computations per key; all windows are partitioned."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.operators.frames import ewm_frame


def ewm(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], span: int = 3, name: str = "ewm") -> DataFrame:
    """Exponentially weighted mean, weights adjusted at the start: alpha = 2/(span+1).

    Weights below the last bit of a double are left out, so the frame has a fixed length.
    """
    keep = 1 - 2 / (span + 1)
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-ewm_frame(1 - keep), 0)
    items = F.collect_list(value).over(w)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    folded = F.aggregate(items, zero, lambda a, x: F.struct((a.s * keep + x).alias("s"), (a.w * keep + 1.0).alias("w")), lambda a: a.s / a.w)
    return df.withColumn(name, folded)


def ewma_reset(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], weight: float = 0.1, name: str = "ewma") -> DataFrame:
    """Plain exponential mean per key, in which an average of zero starts anew with the next value.

    The recursion is not linear, so a key's values are taken one after the other. Rows are sorted by key and order
    inside partitions of whole keys (Spark spills that sort); what goes on from batch to batch is one key and its average,
    so a key may be larger than memory.
    """
    columns = [*by, *order, value]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*columns).dtypes) + f", `{name}` double"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, 0.0
        for b in batches:
            out = np.empty(len(b))
            keys = zip(*(b[c] for c in by), strict=True) if by else iter([()] * len(b))
            for i, (key, x) in enumerate(zip(keys, b[value].astype(float), strict=True)):
                if key != last:
                    last, now = key, 0.0
                now = x if now == 0 else now * (1 - weight) + x * weight
                out[i] = now
            yield b.assign(**{name: out})

    rows = df.select(*columns)
    placed = (rows.repartition(*by) if by else rows.coalesce(1)).sortWithinPartitions(*by, *order)
    return placed.mapInPandas(run, schema)


def moving_min(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], n: int, name: str = "low") -> DataFrame:
    """The least of the last n values."""
    return df.withColumn(name, F.min(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)))


def timeline_slice(df: DataFrame, user: str, order: Sequence[Column], start: int, stop: int) -> DataFrame:
    """Entries start..stop-1 of each user's timeline; nothing when the bounds make no range."""
    if start < 0 or stop <= start:
        return df.withColumn("rank", F.lit(0).cast("long")).limit(0)
    ranked = df.withColumn("rank", (F.row_number().over(W.partitionBy(user).orderBy(*order)) - 1).cast("long"))
    return ranked.filter((F.col("rank") >= start) & (F.col("rank") < stop))


def deltas(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], name: str = "delta") -> DataFrame:
    """Difference to the sample before; null for the first."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(*order)))


def busy_schedule(df: DataFrame, arrival: str, by: Sequence[str], order: Sequence[str], service: int) -> DataFrame:
    """Start times of jobs that take `service` each and wait for the one before.

    start_i = service*i + max over j<=i of (arrival_j - service*j): a running maximum in the place of a fold.
    """
    w = W.partitionBy(*by).orderBy(*order)
    i = (F.row_number().over(w) - 1).cast("long")
    slack = df.withColumn("__i", i).withColumn("__d", F.col(arrival) - F.col("__i") * service)
    return slack.withColumn("start", F.max("__d").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("__i") * service).drop("__i", "__d")


def running_state(df: DataFrame, delta: str, by: Sequence[str], order: Sequence[str], initial: int, name: str = "state") -> DataFrame:
    """A counter per key after each request."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(delta).over(w) + F.lit(initial))


def utilisation(df: DataFrame, cycles: str, ts: str, invocations: str, samples: str, by: Sequence[str]) -> DataFrame:
    """Load per key from sampled cycles: sum of cycles over elapsed time, scaled by invocations per sample."""
    agg = df.groupBy(*by).agg(F.sum(cycles).alias("__c"), (F.max(ts) - F.min(ts)).alias("__t"), F.sum(invocations).alias("__i"), F.sum(samples).alias("__s"))
    return agg.select(*by, F.try_divide(F.col("__c") * F.col("__i"), F.col("__t") * F.col("__s")).alias("load"))


def tumbling(df: DataFrame, ts: str, width: str, *aggs: Column) -> DataFrame:
    """Aggregates per fixed interval of event time."""
    return df.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w")).agg(*aggs).select(F.col("w.start").alias("window_start"), *(c for c in _names(aggs)))


def _names(aggs: Sequence[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]
