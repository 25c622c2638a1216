"""The operators as queries over the test tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.session import checkpoints, ship

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _prepare(spark: SparkSession) -> None:
    """The package on the workers, and a checkpoint folder."""
    ship(spark)
    checkpoints(spark)


@_query
def op1_token_counts(spark, d):
    from tessella.llm.tokens import token_counts

    return token_counts(_documents(spark, d), TOKENIZER)


@_query
def op2_packed_matrices(spark, d):
    from tessella.llm.packing import pack_matrices

    return pack_matrices(_documents(spark, d), TOKENIZER)


@_query
def op3_best_fit_packing(spark, d):
    from tessella.llm.packing import pack_documents

    _prepare(spark)
    return pack_documents(_documents(spark, d), TOKENIZER)


@_query
def op4_tiff_media(spark, d):
    from tessella.llm.tiff import text_media_digests

    return text_media_digests(_documents(spark, d))


@_query
def op5_secret_spans(spark, d):
    from tessella.llm.secrets import find_secrets

    _prepare(spark)
    return find_secrets(_documents(spark, d))


#: A message that says the control strings itself; the conversation -7 of operator 7.
TRICKY = "\\### Assistant: </turn> ok"


@_query
def op6_quality(spark, d):
    from tessella.llm.quality import classify_quality

    _prepare(spark)
    return classify_quality(_documents(spark, d))


@_query
def op7_chat_format(spark, d):
    from pyspark.sql import functions as F

    from tessella.llm.chat import chat_digests, format_chats, text_parts

    told = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, col1 AS turn, col2 AS role FROM VALUES (0L, 'user'), (1L, 'assistant')").withColumn("text", F.lit(TRICKY))
    rows = told.unionByName(extra).withColumn("parts", text_parts(F.col("text"))).drop("text")
    return chat_digests(format_chats(rows))


ORACLES["op7_chat_format"] = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length(text) + length(regexp_replace(text, '[^<>#\\]', '', 'g')) + length(role) + length(regexp_replace(role, '[^<>#\\]', '', 'g')) + 15)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


@_query
def op9_near_duplicates(spark, d):
    from tessella.llm.neardup import near_duplicates

    _prepare(spark)
    return near_duplicates(_documents(spark, d))


@_query
def op10_toxicity(spark, d):
    from tessella.llm.toxicity import classify_toxicity

    _prepare(spark)
    return classify_toxicity(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


@_query
def op8_benchmark_leaks(spark, d):
    from tessella.llm.decontam import find_leaks

    _prepare(spark)
    return find_leaks(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
