"""Generated sources: sequences, closed-form series, seeded random draws, synthetic posts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def sequence_index(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """start, start+step, ... below stop."""
    return spark.range(start, stop, step).select(F.col("id").alias("idx"))


def datetime_index(spark: SparkSession, start: str, stop: str, seconds: int = 1) -> DataFrame:
    """Timestamps from start to stop (both included), made in parallel from a range of epochs."""
    lo, hi = (int(pd.Timestamp(x, tz="UTC").timestamp()) for x in (start, stop))
    return spark.range(lo, hi + 1, seconds).select(F.timestamp_seconds("id").alias("idx"))


def even_space(spark: SparkSession, n: int, first: float, last: float) -> DataFrame:
    """n numbers from first (included) to last (excluded), equally far apart."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.lit(first) + F.col("id") * F.lit((last - first) / n)).alias("value"))


def log_space(spark: SparkSession, n: int, first: float, last: float, base: float) -> DataFrame:
    """base to the power of n equally spaced exponents."""
    return even_space(spark, n, first, last).withColumn("value", F.pow(F.lit(float(base)), "value"))


def triangular(spark: SparkSession, last: int, first: int = 1) -> DataFrame:
    """The triangular numbers k(k+1)/2 from the first-th up to last."""
    top = int((math.isqrt(8 * last + 1) - 1) // 2)
    return spark.range(first, top + 1).select((F.col("id") - first).alias("pos"), F.expr("id * (id + 1) div 2").alias("value"))


def symmetric_triangle(spark: SparkSession, n: int, start: float = 1.0, normalize: bool = False) -> DataFrame:
    """Rises by start to the middle and falls again; normalized, the values add up to 1."""
    rise = F.least(F.col("id") + 1, F.lit(n) - F.col("id"))
    total = start * sum(min(i + 1, n - i) for i in range(n)) if normalize else 1.0
    return spark.range(n).select(F.col("id").alias("pos"), (rise * F.lit(start / total)).alias("value"))


def hashed(row: Column, *salt: str | int | Column) -> Column:
    """48 random-looking bits that depend on a row's number and the salt alone: the first 12 digits of a digest."""
    parts = [x if isinstance(x, Column) else F.lit(str(x)) for x in salt]
    return F.conv(F.substring(F.md5(F.concat_ws("/", row.cast("string"), *(x.cast("string") for x in parts))), 1, 12), 16, 10).cast("long")


def _unit(row: Column, *salt: str | int) -> Column:
    """Even draws between 0 and 1, both left out, from a row's number."""
    return (hashed(row, *salt) + 0.5) / float(1 << 48)


def _bell(row: Column, *salt: str | int) -> Column:
    """Standard normal draws by Box and Muller."""
    return F.sqrt(-2 * F.log(_unit(row, *salt, "r"))) * F.cos(_unit(row, *salt, "t") * (2 * math.pi))


def _by_inverse(kind: str, seed: int, p: dict) -> Column | None:
    """Families whose inverse distribution function is a built-in expression; draws depend on id and seed alone."""
    row = F.col("id")
    u = _unit(row, kind, seed)
    a, b = p.get("a", 1.0), p.get("b", 1.0)
    mean, std = p.get("mean", 0.0), p.get("std", 1.0)
    made = {
        "uniform_real": lambda: F.lit(p.get("min_value", 0.0)) + u * (p.get("max_value", 1.0) - p.get("min_value", 0.0)),
        "uniform_int": lambda: F.floor(F.lit(p.get("min_value", 0)) + u * (p.get("max_value", 1) - p.get("min_value", 0) + 1)).cast("double"),
        "bernoulli": lambda: (u < p.get("p", 0.5)).cast("double"),
        "geometric": lambda: F.floor(F.log(u) / math.log1p(-p.get("p", 0.5))).cast("double"),
        "exponential": lambda: -F.log(u) / p.get("lambda", 1.0),
        "weibull": lambda: F.pow(-F.log(u), 1.0 / a) * b,
        "extreme_value": lambda: F.lit(a) - F.lit(b) * F.log(-F.log(u)),
        "normal": lambda: _bell(row, kind, seed) * std + mean,
        "lognormal": lambda: F.exp(_bell(row, kind, seed) * std + mean),
        "cauchy": lambda: F.lit(a) + F.lit(b) * F.tan((u - 0.5) * math.pi),
    }
    return made[kind]() if kind in made else None


_NUMPY = {
    "binomial": lambda g, n, p: g.binomial(int(p.get("n", 1)), p.get("p", 0.5), n),
    "negative_binomial": lambda g, n, p: g.negative_binomial(int(p.get("n", 1)), p.get("p", 0.5), n),
    "poisson": lambda g, n, p: g.poisson(p.get("mean", 1.0), n),
    "gamma": lambda g, n, p: g.gamma(p.get("alpha", 1.0), p.get("beta", 1.0), n),
    "chi_squared": lambda g, n, p: g.chisquare(p.get("n", 1), n),
    "fisher_f": lambda g, n, p: g.f(p.get("n", 1), p.get("n2", 1), n),
    "student_t": lambda g, n, p: g.standard_t(p.get("n", 1), n),
}

#: All families that draw() takes.
FAMILIES = ("uniform_real", "uniform_int", "bernoulli", "binomial", "negative_binomial", "geometric", "poisson", "exponential", "gamma", "weibull", "extreme_value", "normal", "lognormal", "chi_squared", "cauchy", "fisher_f", "student_t")


def draw(spark: SparkSession, kind: str, total: int, seed: int = 0, partitions: int = 8, **params: float) -> DataFrame:
    """total seeded draws (pos, value). Families without an expression draw in blocks of 4096 positions,
    each block from its own generator, so that a lost task draws the same numbers again."""
    column = _by_inverse(kind, seed, params)
    base = spark.range(0, total, 1, partitions)
    if column is not None:
        return base.select(F.col("id").alias("pos"), column.alias("value"))
    if kind not in _NUMPY:
        raise ValueError(f"no such family: {kind}")
    family = _NUMPY[kind]

    def blocks(batches):
        for batch in batches:
            for block in batch["block"]:
                size = min(4096, total - block * 4096)
                values = family(np.random.default_rng([seed, int(block)]), size, params)
                yield pd.DataFrame({"pos": np.arange(size) + block * 4096, "value": values.astype(float)})

    return spark.range(0, -(-total // 4096), 1, partitions).withColumnRenamed("id", "block").mapInPandas(blocks, "pos long, value double")


def zipf(spark: SparkSession, n: int, num: int, q: float, seed: int = 0) -> DataFrame:
    """n draws from 0..num-1 with P(i) proportional to (i+1)^-q: a search in the cumulated weights,
    which are num numbers (a parameter, not data)."""
    weights = np.cumsum((np.arange(num) + 1.0) ** -q)
    cdf = weights / weights[-1]

    def look(batches):
        for batch in batches:
            yield pd.DataFrame({"pos": batch["pos"], "value": np.minimum(np.searchsorted(cdf, batch["u"], side="right"), num - 1)})

    return spark.range(n).select(F.col("id").alias("pos"), _unit(F.col("id"), "zipf", seed).alias("u")).mapInPandas(look, "pos long, value long")


def sort_input(spark: SparkSession, n: int, kind: str = "uniform", seed: int = 0) -> DataFrame:
    """Sort records: an unsigned 64-bit key as DECIMAL(20,0), uniform or normal, and a value of 90 equal bytes."""
    if kind == "normal":
        key = F.greatest(F.lit(0.0), _bell(F.col("id"), "key", seed) * (n / 10) + n / 2).cast("decimal(20,0)")
    else:
        digest = F.md5(F.concat_ws("/", F.col("id").cast("string"), F.lit("key"), F.lit(str(seed))))
        key = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return spark.range(n).select(key.alias("key"), F.encode(F.repeat(F.chr(F.pmod("id", F.lit(26)) + 97), 90), "UTF-8").alias("value"))


def users(spark: SparkSession, n: int) -> DataFrame:
    """Users 1..n with derived names, salted password hashes included."""
    i = F.col("id").cast("string")
    return spark.range(1, n + 1).select(
        F.col("id").alias("user_id"),
        F.concat(F.lit("first_name_"), i).alias("first_name"),
        F.concat(F.lit("last_name_"), i).alias("last_name"),
        F.concat(F.lit("username_"), i).alias("username"),
        F.sha2(F.concat(F.lit("password_"), i, F.lit("salt_"), i), 256).alias("password_hashed"),
        F.concat(F.lit("salt_"), i).alias("salt"),
    )


def posts(spark: SparkSession, n: int, n_users: int, seed: int = 0) -> DataFrame:
    """Synthetic posts: text with up to two mentions and two links, up to two media ids. Everything follows from the
    post's number and the seed."""
    row = F.col("id")

    def few(what: str, f) -> Column:
        count = F.pmod(hashed(row, what, seed), F.lit(3)).cast("int")
        return F.transform(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), count), f)

    mentions = few("mentions", lambda i: F.concat(F.lit("@username_"), (F.pmod(hashed(row, "mention", i, seed), F.lit(n_users)) + 1).cast("string")))
    urls = few("urls", lambda i: F.concat(F.lit("http://"), F.lower(F.hex(hashed(row, "url", i, seed))), F.lit(".example")))
    media = few("media", lambda i: F.struct(hashed(row, "media", i, seed).alias("media_id"), F.lit("png").alias("media_type")))
    return spark.range(n).select(
        row.alias("post_id"),
        (F.pmod(hashed(row, "user", seed), F.lit(n_users)) + 1).alias("user_id"),
        F.concat_ws(" ", F.sha2(F.concat(row.cast("string"), F.lit(str(seed))), 256), F.array_join(mentions, " "), F.array_join(urls, " ")).alias("text"),
        media.alias("media"),
        (F.lit(1_600_000_000_000) + row).alias("timestamp"),
    )
