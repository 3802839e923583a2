"""Corpus pipeline: documents through five training-data operators, each stage's result written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphmax.llm.common import shared_table, small_batches
from glyphmax.llm.line_dedup import cleaned
from glyphmax.llm.quality_model import good_documents
from glyphmax.llm.sentence_pieces import encode_documents
from glyphmax.llm.simhash_dedup import one_of_each
from glyphmax.llm.source_mix import mixed

TOKENIZER = "piece_bpe_32k.model"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return good_documents(docs, labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line equals or nearly equals."""
    return cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the domains to their target weights."""
    return mixed(docs, labels(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("source mix", mix), ("sentence pieces", encode)]

#: The classifiers' decisions cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
