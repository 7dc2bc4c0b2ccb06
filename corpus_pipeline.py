"""The corpus pipeline: stages over ``documents``, each stored before the next one reads it.

quality rules -> near-duplicates -> benchmark decontamination -> mixing -> token files.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, mixing, quality, simhash, tokenbin
from panelspark.llm.common import table
from panelspark.session import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted by cross-document lines go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order; a row per stored document, read back from them."""
    manifest = tokenbin.write_token_files(docs, tokenbin.default_tokenizer(spark))

    def checksum(ids: np.ndarray) -> tuple:
        return (zlib.crc32(ids.astype("<u4").tobytes()),)

    return tokenbin.read_token_files(manifest, checksum, "ids_crc32 long")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: Neither similarity groups nor token ids have a SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    last = STAGES[-1][1](spark, docs, sf_dir)
    path = new_path(spark, "pipeline-result")
    last.write.parquet(path)
    return spark.read.schema(last.schema).parquet(path)
