"""Lloyd's k-means with an exact fixed point on integer vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.session import checkpoints


def assign(points: DataFrame, means: list[list[float]], vector: str = "d", block: int = 1024) -> DataFrame:
    """Adds cluster: the nearest mean, the first one in a tie. Null vectors get null.

    The means, a parameter of k vectors, go to the tasks as one matrix; points are neither joined nor moved. Distances
    are sums of squared differences, as exact as doubles are, in blocks of about `block` thousand of them.
    """
    matrix = np.array(means, float)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=vectors.index, dtype="Int32")
        held = vectors[vectors.notna()]
        step = max(1, block * 1000 // matrix.size)
        for lo in range(0, len(held), step):
            part = held.iloc[lo : lo + step]
            x = np.stack([np.asarray(v, float) for v in part])
            dist = np.empty((len(x), len(matrix)))
            for k, m in enumerate(matrix):
                dist[:, k] = np.square(x - m).sum(axis=1)
            out[part.index] = dist.argmin(axis=1)
        return out

    return points.withColumn("cluster", nearest(F.col(vector)))


def update(assigned: DataFrame, means: list[list[float]], vector: str = "d", integral: bool = True) -> list[list[float]]:
    """New means; clusters without points keep theirs. Each task adds up its points; k * dims sums come to the driver."""
    out = [list(m) for m in means]
    for r in vector_totals(assigned, vector, integral).collect():
        out[r["cluster"]][r["i"]] = _trunc(r["x"], r["n"]) if integral else int(r["x"] / r["n"])
    return out


def vector_totals(assigned: DataFrame, vector: str = "d", integral: bool = True) -> DataFrame:
    """(cluster, i, n, x): per cluster and dimension the number of points and their sum, exact for integers (64 bits
    within a task, 38 digits beyond)."""
    dtype, kind = (np.int64, "long") if integral else (np.float64, "double")

    def share(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for k, part in b.dropna(subset=["cluster", "v"]).groupby("cluster")["v"]:
                n, t = held.get(k, (0, 0))
                held[k] = n + len(part), t + np.stack([np.asarray(v, dtype) for v in part]).sum(axis=0)
        if held:
            yield pd.DataFrame({"cluster": list(held), "n": [n for n, _ in held.values()], "sums": [t for _, t in held.values()]})

    parts = assigned.select("cluster", F.col(vector).alias("v")).mapInPandas(share, f"cluster int, n long, sums array<{kind}>")
    return _added(parts, integral)


def _added(parts: DataFrame, integral: bool = True) -> DataFrame:
    """(cluster, i, n, x) of all tasks' parts (cluster, n, sums)."""
    x = F.sum(F.col("x").cast("decimal(38,0)") if integral else F.col("x"))
    return parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), x.alias("x"))


def _trunc(total: int, n: int) -> int:
    total = int(total)
    return total // n if total >= 0 else -(-total // n)


def _nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Per integer vector the nearest mean, the first one in a tie. |m|^2 - 2 x.m orders as the distance does; sums that
    may pass 2^53, where doubles are no longer exact, are made from the differences."""
    largest = max(float(np.abs(x).max(initial=0)), float(np.abs(means).max(initial=0)))
    x = x.astype(float)
    if 4 * x.shape[1] * largest**2 < 2**53:
        return (np.square(means).sum(axis=1) - 2 * (x @ means.T)).argmin(axis=1)
    return np.stack([np.square(x - m).sum(axis=1) for m in means], axis=1).argmin(axis=1)


def _rounds(points: DataFrame, vector: str, block: int = 4096) -> Callable[[list[list[int]]], list[list[int]]]:
    """A round of assignment and update on integer vectors, as a function of the means. The vectors are written once to
    the checkpoint folder, as matrices of some thousand rows; a round reads them once, and only sums are moved."""
    checkpoints(points.sparkSession)

    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = b["v"].dropna()
            for lo in range(0, len(held), block):
                x = np.stack([np.asarray(v, np.int64) for v in held.iloc[lo : lo + block]])
                yield pd.DataFrame({"n": [len(x)], "x": [x.tobytes()]})

    matrices = points.select(F.col(vector).alias("v")).mapInPandas(pack, "n long, x binary").checkpoint()

    def one(means: list[list[int]]) -> list[list[int]]:
        matrix = np.array(means, float)

        def share(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count, total = np.zeros(len(matrix), np.int64), np.zeros(matrix.shape, np.int64)
            for b in batches:
                for n, raw in zip(b["n"], b["x"], strict=True):
                    x = np.frombuffer(raw, np.int64).reshape(n, -1)
                    near = _nearest(x, matrix)
                    for k in np.unique(near).tolist():
                        own = x[near == k]
                        count[k] += len(own)
                        total[k] += own.sum(axis=0)
            hit = np.flatnonzero(count)
            if len(hit):
                yield pd.DataFrame({"cluster": hit, "n": count[hit], "sums": list(total[hit])})

        out = [list(m) for m in means]
        for r in _added(matrices.mapInPandas(share, "cluster int, n long, sums array<long>")).collect():
            out[r["cluster"]][r["i"]] = _trunc(r["x"], r["n"])
        return out

    return one


def fit(points: DataFrame, means: list[list[int]], vector: str = "d", max_rounds: int = 100_000) -> tuple[list[list[int]], int]:
    """Repeats assignment and update until no mean changes: (means, rounds).

    Raises if means of an earlier round come back (rounded means may go in a circle, which has no fixed point),
    or if max_rounds, a safety bound, is met: unsettled means are never returned.
    """
    step = lambda m: update(assign(points, m, vector), m, vector)
    if isinstance(points, DataFrame) and isinstance(points.schema[vector].dataType.elementType, T.IntegralType):
        step = _rounds(points, vector)
    seen = set()
    for n in range(1, max_rounds + 1):
        new = step(means)
        if new == means:
            return new, n
        key = hashlib.sha256(repr(means).encode()).digest()
        if key in seen:
            raise RuntimeError(f"k-means goes in a circle, seen in round {n}")
        seen.add(key)
        means = new
    raise RuntimeError(f"k-means has not settled in {max_rounds} rounds")
