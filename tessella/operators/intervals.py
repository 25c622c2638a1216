"""Intervals spread over fixed bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def utilisation_bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Share of each bin that intervals cover: (bin, busy), empty bins included.

    Bins start at the least start. Each interval is exploded into the bins it touches,
    then summed; this is an equi-aggregation, not a range join over all pairs.
    """
    bounds = df.agg(F.min(start).alias("__lo"), F.max(end).alias("__hi"))
    rows = df.crossJoin(F.broadcast(bounds)).filter(F.col(end) > F.col(start))
    first = F.floor((F.col(start) - F.col("__lo")) / width)
    last = F.ceil((F.col(end) - F.col("__lo")) / width) - 1
    spread = rows.select(start, end, "__lo", F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"))
    b0 = F.col("__lo") + F.col("bin") * width
    part = (F.least(F.col(end), b0 + width) - F.greatest(F.col(start), b0)) / width
    busy = spread.groupBy("bin").agg(F.sum(part).alias("busy"))
    ends = bounds.select("__lo", "__hi").first()
    n = max(0, math.ceil((ends[1] - ends[0]) / width)) if ends[0] is not None and ends[1] is not None else 0
    bins = df.sparkSession.range(n).withColumnRenamed("id", "bin")
    return bins.join(busy, "bin", "left").select("bin", F.coalesce("busy", F.lit(0.0)).alias("busy"))
