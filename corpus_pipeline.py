"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing. Counted as part of tessella.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm.decontam import drop_leaks
from tessella.llm.names import free_name
from tessella.llm.neardup import drop_near_duplicates
from tessella.llm.packing import pack_documents
from tessella.llm.quality import keep_good
from tessella.llm.queries import TOKENIZER, _prepare
from tessella.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Each row counts by its own text, whatever its id; null texts and texts
    without words go. Repeated rows share their fate."""
    _prepare(spark)
    return keep_good(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (null ids come last). Each row counts by
    its own text, so rows of one id may fall into different groups; of repeated rows one stays. Texts without words stay."""
    _prepare(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row counts by its own text; null and empty texts hold none and stay."""
    _prepare(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text. Secrets are found and replaced in each row's
    own text, whatever its id; null texts stay null."""
    _prepare(spark)
    columns, before = docs.columns, free_name(docs, "before")
    done = redact_secrets(docs.withColumn(before, F.col("text")))
    length = F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return done.withColumn("n_chars", length).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences; every row has pieces, a null text that of the end id."""
    _prepare(spark)
    return pack_documents(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", decontaminate), ("secrets", secrets), ("packing", pack)]

#: The stages hold fitted models and a genetic search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the checkpoint folder and read by the next one."""
    _prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return docs
