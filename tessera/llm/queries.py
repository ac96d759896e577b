"""Queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, mixing, near_dedup, quality, secret_scan, sharding, token_scan, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_quality_rules": quality.op3,
    "op4_chat_formatting": chat.op4,
    "op5_mixing": mixing.op5,
    "op6_secret_scan": secret_scan.op6,
    "op7_token_counts": token_scan.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_toxicity": toxicity.op9,
    "op10_language_id": langid.op10,
}

SQL: dict[str, str] = {"op3_quality_rules": quality.OP3_SQL, "op4_chat_formatting": chat.OP4_SQL, "op8_decontamination": decontaminate.OP8_SQL}
