"""Streaming twin of the ledger: the log is read as it grows, and the state of each target is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import ledger

LOG_SCHEMA = "seq long, target string, action string, text string"


def stream_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger over a growing folder of JSON lines (LOG_SCHEMA); use output mode complete or update. Order is `seq`, so late files do no harm."""
    return ledger(spark.readStream.schema(LOG_SCHEMA).json(folder))


def append(events: DataFrame, folder: str) -> None:
    """Append events to the log, in folders of a month where they have a time."""
    out = events.withColumn("month", F.date_format("decided_at", "yyyyMM")) if "decided_at" in events.columns else events.withColumn("month", F.lit("none"))
    out.write.mode("append").partitionBy("month").json(folder)
