"""The queries op1 to op10 and the corpus pipeline, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from scriptorium.llm import chat, class_lm, decontam, media, mixing, near_dup, pii, quality, token_ids, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(_table(spark, sf_dir, "documents"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_hashes(media.pictures(_table(spark, sf_dir, "embeddings")), "vec_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.perplexity(_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_pii(_table(spark, sf_dir, "documents"), pii.key_of(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_ids, op2_near_dup, op3_media, op4_lm_scoring, op5_chat, op6_decontamination, op7_mixing, op8_toxicity, op9_quality, op10_pii)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    rows = "SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, (epochs + CASE WHEN run <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM r WHERE epochs > 0 OR run <= rest"
    return {"op5_chat": chat.SQL, "op7_mixing": mixing.SQL + rows} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
