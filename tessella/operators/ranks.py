"""Global positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessella.session import checkpoints


def _order(keys: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_first() for k in keys]


def with_pos(df: DataFrame, keys: Sequence[str], name: str = "pos", ties: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds the 0-based position in the order of keys (ascending with nulls first, or descending with nulls last).

    Rows are range-partitioned by all keys, the ties and at last by the place they were read at, so that neither a
    common prefix nor a dominant key makes a range large; each range is sorted by Spark (which spills) and numbered
    inside. The sorted rows are written to the checkpoint folder, since ranges are drawn from a sample and must not be
    drawn anew; what is seen outside the ranges is one count per range. Among equal keys the order is any.
    """
    checkpoints(df.sparkSession)
    columns = df.columns
    read, place = "__read", "__place"
    order = [*_order([*keys, *ties], descending), F.col(read).asc()]
    ranged = df.withColumn(read, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    done = ranged.select(*columns, F.monotonically_increasing_id().alias(place)).checkpoint()
    part = F.call_function("shiftright", F.col(place), F.lit(33))
    sizes = sorted(tuple(r) for r in done.groupBy(part.cast("int").alias("p")).agg(F.count("*").alias("n")).collect())  # one row per range
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(starts, "__range int, __start long")
    placed = done.withColumn("__range", part.cast("int")).join(F.broadcast(table), "__range")
    return placed.select(*columns, (F.col("__start") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def scan_desc(df: DataFrame, keys: Sequence[str], name: str = "pos") -> DataFrame:
    """Positions of a scan from the largest key down."""
    return with_pos(df, keys, name, descending=True)


def find_by_order(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The n-th smallest row, from 0; no row when n is out of range. Only rows that share the n-th first key are sorted."""
    found = nth_values(df, keys[0], [n])
    if not found:
        return df.limit(0)
    value, below = found[0]
    return df.filter(F.col(keys[0]).eqNullSafe(F.lit(value))).orderBy(*_order(keys, False)).offset(n - below).limit(1)


def nth_values(df: DataFrame, key: str, ns: Sequence[int], few: int = 10_000) -> list[tuple]:
    """(value, rows below it) at places of the order of one key, nulls first, without sorting the table.

    Each round brackets the places by approximate percentiles of what is left, which take bounded memory, and counts
    the rows below; a bracket shrinks to a thousandth or so. Brackets of up to `few` rows come back as counts of their
    values. An empty list if some place is out of range.
    """
    x = F.col(key)
    first = df.agg(F.count("*").alias("n"), F.count(x).alias("held")).first()
    nulls, held = first["n"] - first["held"], df.filter(x.isNotNull())
    if any(not 0 <= n < first["n"] for n in ns):
        return []
    numeric = dict(df.select(key).dtypes)[key].split("(")[0] in {"tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz"}
    within = lambda b: F.lit(True) if b is None else (x >= F.lit(b[0])) & (x <= F.lit(b[1]))
    # place: bracket (None for all rows), rows below it, rows in it
    at: dict[int, tuple] = {n: (None, nulls, first["held"]) for n in ns if n >= nulls}
    open_ = {n for n in at if numeric and at[n][2] > few}
    while open_:
        bracket = at[min(open_)][0]
        same = sorted(n for n in open_ if at[n][0] == bracket)
        below, m = at[same[0]][1:]
        shares = [min(1.0, max(0.0, (n - below) / m + d)) for n in same for d in (-0.001, 0.001)]
        part = held.filter(within(bracket))
        cuts = part.agg(F.percentile_approx(x, shares, 10_000)).first()[0]
        pairs = list(zip(cuts[::2], cuts[1::2], strict=True))
        r = part.agg(*(c for i, p in enumerate(pairs) for c in (F.count_if(x < F.lit(p[0])).alias(f"b{i}"), F.count_if(within(p)).alias(f"m{i}")))).first()
        for i, (n, p) in enumerate(zip(same, pairs, strict=True)):
            if below + r[f"b{i}"] <= n < below + r[f"b{i}"] + r[f"m{i}"]:
                at[n] = p, below + r[f"b{i}"], r[f"m{i}"]
            if at[n][0] == bracket or at[n][2] <= few or p[0] == p[1]:
                open_.discard(n)  # small enough, one value, or values that percentiles can't tell apart
    small = [n for n in at if at[n][2] <= few]
    counted = []
    if small:
        wanted = F.lit(False)
        for b in {at[n][0] for n in small}:
            wanted = wanted | within(b)
        counted = sorted((r["v"], r["n"]) for r in held.filter(wanted).groupBy(x.alias("v")).agg(F.count("*").alias("n")).collect())
    found: dict[int, tuple] = {n: (None, 0) for n in ns if n < nulls}
    for n, (b, below, m) in at.items():
        if m <= few:
            values = [(v, k) for v, k in counted if b is None or b[0] <= v <= b[1]]
        elif b is not None and b[0] == b[1]:
            values = [(b[0], m)]
        else:  # one value after the other, as far as the place
            values = (tuple(r) for r in held.filter(within(b)).groupBy(x.alias("v")).agg(F.count("*").alias("n")).orderBy("v").toLocalIterator())
        for v, k in values:
            if n < below + k:
                found[n] = v, below
                break
            below += k
    return [found[n] for n in ns]


def occurrence(df: DataFrame, key: str, order: str = "pos", name: str = "occ") -> DataFrame:
    """Numbers the repeats of a key from 0."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order; each task keeps k rows at most."""
    return df.orderBy(*order).limit(k)


def pop_front(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """Up to n rows of a queue, oldest first."""
    return top_k(df, n, F.col(seq).asc())


def pop_top(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """Up to n rows of a stack, newest first."""
    return top_k(df, n, F.col(seq).desc())


def ends(df: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """Front and back of a sequence in one pass."""
    return df.agg(F.min_by(value, seq).alias("front"), F.max_by(value, seq).alias("back"))


def range_partitioned(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Range partitions, each sorted inside. A number of partitions is a hint; the rows don't depend on it."""
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def split_median(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds half: 0 for the lower floor(n/2) rows, 1 for the others."""
    placed = with_pos(df, keys)
    return placed.withColumn("half", (F.col("pos") >= F.lit(placed.count() // 2)).cast("int"))


def rebase(df: DataFrame, start: int, pos: str = "pos") -> DataFrame:
    """Moves all positions by a new first key."""
    return df.withColumn(pos, F.col(pos) + F.lit(start))
