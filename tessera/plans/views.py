"""Deterministic views of the driver tables in the engine's data model, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined_digest

_MOD = lambda n: F.col("k") % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def u_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units out of part: k, coordinates, source, translation, identity, fingerprint."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    three = F.length("p_name") % 3
    text = F.when(_MOD(11) == 0, "").when((three == 0) | ((three == 1) & (_MOD(10) != 0)), F.upper("p_name")).otherwise(F.col("p_type"))
    out = p.select(
        "k", F.lit("corpus").alias("project_id"), F.when(_MOD(2) == 0, "gettext").otherwise("paradox").alias("adapter_id"),
        F.concat(F.lit("size/"), F.col("p_size").cast("string"), F.lit("/"), F.lower("p_brand")).alias("relative_path"), F.col("k").cast("string").alias("logical_key"),
        F.col("p_name").alias("source_text"), text.alias("translation"), "p_size", "p_brand", "p_type",
    )
    identity = joined_digest(*[F.col(c) for c in ("project_id", "adapter_id", "relative_path", "logical_key")])
    return out.withColumn("stable_identity", identity).withColumn("source_fingerprint", F.sha2("source_text", 256))


def tm_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory rows out of u_part, some of them stale, failed, moved, or of less authority."""
    u = u_part(spark, sf_dir).where(_MOD(9) != 0)
    pick = lambda n, *names: F.get(F.array(*[F.lit(x) for x in names]), (_MOD(n)).cast("int"))
    out = u.withColumn("relative_path", F.when(_MOD(7) == 3, F.element_at(F.split("relative_path", "/"), -1)).otherwise(F.col("relative_path")))
    out = out.withColumn("source_fingerprint", F.when(_MOD(5) == 0, F.sha2(F.concat("source_text", F.lit("!")), 256)).otherwise(F.col("source_fingerprint")))
    return out.withColumns({
        "origin": pick(4, "human", "machine", "legacy", "paratranz"),
        "review_state": pick(6, "locked", "reviewed", "unreviewed", "checked", "suspect", "quarantined"),
        "classification": F.when(_MOD(4) == 2, F.when(_MOD(3) == 1, "legacy_suspect").otherwise("legacy_clean")).otherwise("native"),
        "quality_state": F.when(_MOD(13) == 0, "failed").otherwise("passed"), "is_formal": (_MOD(4) != 2) & (_MOD(3) != 1),
        "human_authored": _MOD(4).isin(0, 3), "stage": F.when(_MOD(4) == 3, (_MOD(4) % 4).cast("int")), "updated_at": F.col("k"),
    })


U_SQL = """
u AS (SELECT *, sha256(project_id||chr(31)||adapter_id||chr(31)||relative_path||chr(31)||logical_key) AS stable_identity, sha256(source_text) AS source_fingerprint FROM (
  SELECT p_partkey AS k, 'corpus' AS project_id, CASE WHEN p_partkey%2=0 THEN 'gettext' ELSE 'paradox' END AS adapter_id,
    'size/'||p_size||'/'||lower(p_brand) AS relative_path, CAST(p_partkey AS VARCHAR) AS logical_key, p_name AS source_text,
    CASE WHEN p_partkey%11=0 THEN '' WHEN length(p_name)%3=0 OR (length(p_name)%3=1 AND p_partkey%10<>0) THEN upper(p_name) ELSE p_type END AS translation,
    p_size, p_brand, p_type FROM part))"""
TM_SQL = (
    U_SQL
    + """,
tm AS (SELECT k, project_id, adapter_id, CASE WHEN k%7=3 THEN lower(p_brand) ELSE relative_path END AS relative_path, logical_key, source_text, translation, stable_identity,
  CASE WHEN k%5=0 THEN sha256(source_text||'!') ELSE source_fingerprint END AS source_fingerprint,
  ['human','machine','legacy','paratranz'][k%4+1] AS origin, ['locked','reviewed','unreviewed','checked','suspect','quarantined'][k%6+1] AS review_state,
  CASE WHEN k%4=2 THEN CASE WHEN k%3=1 THEN 'legacy_suspect' ELSE 'legacy_clean' END ELSE 'native' END AS classification,
  CASE WHEN k%13=0 THEN 'failed' ELSE 'passed' END AS quality_state, (k%4<>2 AND k%3<>1) AS is_formal, k%4 IN (0,3) AS human_authored,
  CASE WHEN k%4=3 THEN 3 END AS stage, k AS updated_at FROM u WHERE k%9<>0)"""
)
