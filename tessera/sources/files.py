"""Folders of resource files as tables, and tables of files back as folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_match


def _hadoop(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _relative(spark: SparkSession, root: str) -> Column:
    """Path below root of the file that a row was read from."""
    path, system = _hadoop(spark, root)
    base = system.makeQualified(path).toUri().getRawPath()
    below = F.substring(F.parse_url(F.col("_metadata.file_path"), F.lit("PATH")), len(base) + 2, 1 << 20)
    return F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))


def _chosen(rows: DataFrame, includes: Sequence[str], excludes: Sequence[str]) -> DataFrame:
    path = F.col("relative_path")
    return rows.where(glob_match(path, includes) & ~glob_match(path, excludes))


def scan(spark: SparkSession, root: str, includes: Sequence[str] = ("**/*",), excludes: Sequence[str] = ()) -> DataFrame:
    """relative_path, size of the files under root; their contents are not read."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _chosen(held.select(_relative(spark, root).alias("relative_path"), F.col("length").alias("size")), includes, excludes)


def contents(spark: SparkSession, root: str, includes: Sequence[str] = ("**/*",), excludes: Sequence[str] = ()) -> DataFrame:
    """relative_path, content (bytes) of the files under root, one row a file."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return _chosen(held.select(_relative(spark, root).alias("relative_path"), "content"), includes, excludes)


def texts(spark: SparkSession, root: str, includes: Sequence[str] = ("**/*",), excludes: Sequence[str] = ()) -> DataFrame:
    """relative_path, text (UTF-8, without byte order mark) of the files under root, one row a file."""
    return contents(spark, root, includes, excludes).select("relative_path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("text"))


def inventory(files: DataFrame) -> DataFrame:
    """relative_path, sha256, size of a table of contents; a path that occurs twice is an error."""
    one = files.groupBy("relative_path").agg(F.count("*").alias("_n"), F.first(F.sha2("content", 256)).alias("sha256"), F.first(F.length("content").cast("long")).alias("size"))
    return one.withColumn("relative_path", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate file: "), F.col("relative_path")))).otherwise(F.col("relative_path"))).drop("_n")


def unsafe_path(path: Column) -> Column:
    """Whether a relative path is null, empty, absolute or climbs."""
    return F.coalesce((path == "") | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), F.lit(True))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(relative_path, problem) of manifest rows (relative_path, sha256, size): unsafe, duplicate or malformed ones."""
    twice = manifest.groupBy("relative_path").agg(F.count("*").alias("_n"), F.min("sha256").alias("sha256"), F.min("size").alias("size"), F.max(F.coalesce((F.length("sha256") != 64) | (F.col("size") < 0), F.lit(True))).alias("_bad"))
    problem = F.when(unsafe_path(F.col("relative_path")), "unsafe path").when(F.col("_n") > 1, "duplicate resource").when(F.col("_bad"), "invalid descriptor")
    return twice.select("relative_path", problem.alias("problem")).where("problem is not null")


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(relative_path, problem): missing, changed and unexpected files, against a table of contents."""
    have = inventory(files).select("relative_path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    both = manifest.select("relative_path", "sha256", "size").join(have, "relative_path", "full")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when((F.col("sha256") != F.col("_sha")) | (F.col("size") != F.col("_size")), "changed")
    return both.select("relative_path", problem.alias("problem")).where("problem is not null")


def write_files(files: DataFrame, root: str, same: str = "skip") -> int:
    """Write (relative_path, content) below root, a file at a time; each is renamed into place when whole.

    Unsafe paths and two rows for one path are errors. A file that is there with the same bytes is left; with other bytes
    it is replaced if `same` is "replace", else an error.
    """
    spark, written = files.sparkSession, 0
    bad = files.groupBy("relative_path").count().where(unsafe_path(F.col("relative_path")) | (F.col("count") > 1)).first()
    if bad is not None:
        raise ValueError(f"unsafe or duplicate destination: {bad[0]!r}")
    there, system = _hadoop(spark, root)
    old = {r[0]: r[1] for r in inventory(contents(spark, root)).select("relative_path", "sha256").toLocalIterator()} if system.exists(there) and system.listStatus(there) else {}
    for row in files.select("relative_path", F.col("content").cast("binary").alias("content"), F.sha2(F.col("content").cast("binary"), 256).alias("sha")).toLocalIterator():
        if old.get(row.relative_path) == row.sha:
            continue
        if row.relative_path in old and same != "replace":
            raise ValueError(f"another file is at {row.relative_path!r}")
        target, _ = _hadoop(spark, f"{root}/{row.relative_path}")
        part, _ = _hadoop(spark, f"{root}/.{uuid.uuid4().hex}.part")
        out = system.create(part, True)
        try:
            out.write(bytearray(row.content))
        finally:
            out.close()
        system.mkdirs(target.getParent())
        if row.relative_path in old:
            system.delete(target, False)
        if not system.rename(part, target):
            raise OSError(f"cannot rename into {row.relative_path!r}")
        written += 1
    return written
