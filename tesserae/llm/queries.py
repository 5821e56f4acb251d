"""One query for each operator, over whole tables with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, exact_dedup, jaccard_join, langid, mixing, quality, sharding, token_count, toxicity
from ._common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat_format.planted(spark))
    return chat_format.conversation_digests(chat_format.format_turns(rows))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate_path(spark, f"{sf_dir}/documents.parquet")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_source_mixing, op3_quality, op4_sharding, op5_chat_format, op6_language, op7_exact_dedup, op8_decontamination, op9_jaccard_join, op10_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.ORACLE_SQL.replace("{documents}", "documents"),
        "op4_sharding": f"SELECT doc_id, ({sharding.oracle_table()})[{sharding.ORACLE_SLOT} + 1]::INT AS shard FROM documents",
        "op5_chat_format": chat_format.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
        "op8_decontamination": decontaminate.ORACLE_SQL,
        "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    }
