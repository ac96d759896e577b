"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and U+0009 to U+000D.
GAP = r"[\x20\x09-\x0D]+"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Side tables up to this many bytes may be broadcast; beyond, the plans shuffle.
BROADCAST_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"tessera-checkpoints-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run. Tables go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by `written` that no later plan reads."""
    remove(df.sparkSession, df._written_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file system, if the session still runs."""
    context = spark.sparkContext
    if context._jsc is None:  # the session has ended: its folder is the cluster's to clear
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and hand it to body (a lambda variable is never inlined again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """Array of the sums of an array up to each place, by doubling: n log n, where a list that `aggregate` adds to is copied at every step."""
    def doubled(sums: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0).cast("long")))

    def summed(a: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a).cast("double"))).cast("int") - 1)
        return F.when(F.size(a) < 2, a).otherwise(F.aggregate(rounds, a, doubled))

    return let(values.cast("array<bigint>"), summed)


def words(text: Column) -> Column:
    """Array of the words of text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Broadcast hint if rows (a count that was taken) times the row width is within the bound."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df
