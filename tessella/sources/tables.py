"""Table scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessella.session import checkpoints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table; filters and column lists are pushed to it by the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_values(spark: SparkSession, values: Iterable, kind: T.DataType = T.LongType()) -> DataFrame:  # noqa: B008
    """A literal vector: (pos, value), in the order given."""
    schema = T.StructType([T.StructField("pos", T.LongType(), False), T.StructField("value", kind)])
    return spark.createDataFrame(list(enumerate(values)), schema)


def load_columns(index: DataFrame, **columns: DataFrame) -> DataFrame:
    """Builds a frame from an index (pos, idx) and columns (pos, value), aligned by position."""
    out = index
    for name, column in columns.items():
        out = out.join(column.select("pos", F.col("value").alias(name)), "pos", "left")
    return out


def append(df: DataFrame, path: str) -> None:
    """Appends rows to a Parquet table: the push-back sink."""
    df.write.mode("append").parquet(path)


def truncate(df: DataFrame) -> DataFrame:
    """The same columns without rows."""
    return df.limit(0)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON configuration files, read with a given schema (nothing is inferred)."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_array(column: str, element: str = "string") -> F.col:
    """Decodes a JSON array argument; anything else gives null."""
    return F.from_json(F.col(column), f"array<{element}>")


def edge_list(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Whitespace-separated pairs (src, dst). With a header, the line of three numbers is left out."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 2)
    if header:
        rows = rows.filter(F.size("p") == 2)
    return rows.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))


def blobs(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Every regular file below a path as (path, length, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content")


def local_iter(df: DataFrame, keys: Sequence[str]) -> Iterable:
    """Ordered iteration that holds one partition at a time on the driver."""
    return df.orderBy(*keys).toLocalIterator()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a job writes and reads again, in the shared checkpoint folder."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
