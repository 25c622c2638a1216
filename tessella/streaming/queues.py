"""Queue and state pipelines: file sources, micro-batches, keyed state, reordering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_queue(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a queue; each micro-batch takes up to per_batch files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Runs until all that is there is consumed, into a table in memory (for tests and small results)."""
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def drain_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs until all that is there is consumed, into Parquet files, each row exactly once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs an aggregation until all that is there is consumed; the folder holds the result after the last batch."""
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def consume(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch to a consumer."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling_counts(stream: DataFrame, ts: str, width: str, *aggs: Column, watermark: str = "0 seconds") -> DataFrame:
    """Counts per interval of event time. The watermark is an addition over plain queues."""
    typed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return typed.groupBy(F.window(ts, width).alias("w")).agg(*(aggs or (F.count("*").alias("n"),)))


#: Rows of a key that are handed back at a time.
_SLICE = 20_000


def running_counter(stream: DataFrame, key: str, delta: str, initial: int) -> DataFrame:
    """A counter per key: after each request its state, (key, seq, state). The state is created on first use. As in
    `windows.running_state`, a null delta counts for nothing, and the state is null until there is another."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        seqs, deltas, given = [], [], []
        for f in frames:  # Spark cuts a key's rows wherever an Arrow batch is full, so only all of them can be put in order
            seqs.append(f["seq"].to_numpy(np.int64))
            deltas.append(f["delta"].to_numpy(np.int64))
            given.append(f["given"].to_numpy(bool))
        seq = np.concatenate(seqs)
        order = np.argsort(seq, kind="stable")
        seq, values, known = seq[order], np.concatenate(deltas)[order], np.concatenate(given)[order]
        del seqs, deltas, given, order
        np.cumsum(values, out=values)
        values += initial if now is None else now
        known = np.logical_or.accumulate(known) | (now is not None)
        state.update((int(values[-1]) if known[-1] else None,))
        for i in range(0, len(seq), _SLICE):  # as one frame, a long key's rows would be in memory several times over
            at = slice(i, i + _SLICE)
            yield pd.DataFrame({"key": k[0], "seq": seq[at], "state": pd.arrays.IntegerArray(values[at], ~known[at])})

    rows = stream.select(F.col(key).alias("key"), "seq", F.coalesce(delta, F.lit(0)).cast("long").alias("delta"), F.col(delta).isNotNull().alias("given"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, seq long, state long", "now long", "append", GroupStateTimeout.NoTimeout)


def reorder(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of each key strictly by seq from 0; a row waits until all before it have come."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, *held = state.get if state.exists else (0, [], [])
        seqs, values = [np.array(held[0], np.int64)], [np.array(held[1], np.float64)]
        for f in frames:
            seqs.append(f["seq"].to_numpy(np.int64))
            values.append(f[value].to_numpy(np.float64))
        seq, vals = np.concatenate(seqs), np.concatenate(values)
        order = np.argsort(seq, kind="stable")
        order = order[np.append(np.diff(seq[order]) > 0, True)[: len(order)]]  # of repeated numbers the last one counts
        seq, vals = seq[order], vals[order]
        begin = int(np.searchsorted(seq, following))  # earlier numbers wait for good
        out = begin + int((np.cumsum(seq[begin:] != following + np.arange(len(seq) - begin)) == 0).sum())
        left = np.r_[0:begin, out : len(seq)]
        state.update((following + out - begin, seq[left].tolist(), vals[left].tolist()))
        if out > begin:
            yield pd.DataFrame({"key": k[0], "seq": seq[begin:out], "value": vals[begin:out]})

    return stream.groupBy(key).applyInPandasWithState(step, "key long, seq long, value double", "following long, seqs array<long>, vals array<double>", "append", GroupStateTimeout.NoTimeout)


def merge_into(path_of: Callable[[int], str], key: str, value: str) -> Callable[[DataFrame, int], None]:
    """A consumer that keeps a keyed table: each batch's upserts give a new version of the table."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(F.max_by(value, "seq").alias(value))
        if number:
            old = spark.read.parquet(path_of(number - 1))
            new = old.join(new.select(key), key, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(path_of(number))

    return handle


def updates_since(log: DataFrame, snapshot: DataFrame, version: int, ring: int = 1024) -> tuple[str, DataFrame]:
    """The log behind a version as ("log", rows), or ("snapshot", table) when the ring no longer has it."""
    bounds = log.agg(F.max("seq").alias("hi")).first()
    oldest = (bounds["hi"] if bounds["hi"] is not None else -1) - ring + 1
    return ("log", log.filter(F.col("seq") > version)) if version + 1 >= oldest else ("snapshot", snapshot)
