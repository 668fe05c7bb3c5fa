"""A corpus pipeline of operators from ``foliant.llm``; each stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import language, line_dedup, near_dedup, packing, secret_scan
from foliant.llm.store import with_small_batches, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model accepts go (operator 7); the models are fitted on this stage's own input."""
    with_small_batches(spark)
    return language.keep_known(docs, language.fit(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts (operator 1); no document goes."""
    return line_dedup.drop_boilerplate(docs, counts=None)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 5): five words, a similarity of 0.8."""
    with_small_batches(spark)
    return near_dedup.keep_one(docs, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts (operator 6)."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences (operator 10)."""
    with_small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("language", known_language), ("line dedup", drop_lines), ("near dedup", one_of_each), ("secret scan", hide_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs


ORACLE_SQL = None
