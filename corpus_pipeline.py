"""A training-data pipeline over documents: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and reads it again as the next one's docs.

Defined cases, for every stage: no rows in give no rows out; columns beyond doc_id, text and source pass through untouched under any name; equal rows
and rows that share a doc_id each count; texts of any length are judged whole; ties go by doc_id. What nulls mean stands with each stage.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_dedup, quality, sharding
from tessera.llm.common import checkpoint_dir, remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept; null and empty texts go, as they hold fewer than 50 words."""
    return quality.keep_good(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. All rows with a kept doc_id stay, as do those with a null one or without words."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none, and rows with a null doc_id stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The flattest mix that shows every document at least once and no source more than twice; repeats are rows. Null sources are one source; texts without words are never drawn."""
    return mixing.drawn(docs, cover=True, max_repeats=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of each row; a null text has size 1, a null doc_id is a key like any other."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [("quality", keep_good), ("near_dedup", keep_one), ("decontaminate", keep_clean), ("mix", mix), ("shard", shard)]

#: Near-dedup, mixing and sharding go by hashes that SQL does not share: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written before the next; a stage's table goes once its successor is written, the last one when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            remove(spark, f"{base}/{number - 1}-{STAGES[number - 1][0]}")
    atexit.register(remove, spark, base)
    return docs
