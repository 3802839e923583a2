"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphmax.llm import chat_format, line_dedup, quality_model, quality_rules, sentence_pieces, simhash_dedup, source_mix, substring_dedup, token_counts, top_k
from glyphmax.llm.common import small_batches

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("removed", "passages")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digest(chat_format.with_probe(table(spark, sf_dir, "conversations")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_classifier, op2_sentence_pieces, op3_token_counts, op4_quality_rules, op5_exact_top_k, op6_simhash_dedup, op7_substring_dedup, op8_line_dedup, op9_chat_format, op10_source_mix)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.ORACLE_SQL, "op5_exact_top_k": top_k.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op9_chat_format": chat_format.ORACLE_SQL}
