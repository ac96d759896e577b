"""Three-way merge of baseline, local and remote items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .memory import unique

PROTECTED = (-1, 2, 3, 5, 9)


def merge(baseline: DataFrame, local: DataFrame, remote: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """key, original, translation, stage, origin, upload, conflicts (array). One row for each key of local or remote.

    Sides have key, original, translation, stage, origin; of several rows of a key the greatest counts. Resolutions have key and side (local or remote);
    one that names a side without the key is an error.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return unique(df.select("key", "original", "translation", "stage", "origin"), "key").select("key", F.lit(True).alias(f"{p}_here"), F.struct("original", "translation", "stage", "origin").alias(p))

    met = side(baseline, "b").join(side(local, "l"), "key", "full").join(side(remote, "r"), "key", "full")
    if resolutions is not None:
        met = met.join(unique(resolutions.select("key", "side"), "key"), "key", "left")
    else:
        met = met.withColumn("side", F.lit(None).cast("string"))
    text = lambda p: F.coalesce(F.col(f"{p}.translation"), F.lit(""))
    no_l, no_r, no_b = (F.col(f"{p}_here").isNull() for p in "lrb")
    l_blank, r_blank = blank(text("l")), blank(text("r"))
    changed = lambda p, empty: F.when(no_b, ~empty).otherwise(text(p) != text("b"))
    both = changed("l", l_blank) & changed("r", r_blank) & (text("l") != text("r"))
    rule = (
        F.when(((F.col("side") == "remote") & no_r) | ((F.col("side") == "local") & no_l), F.raise_error(F.concat(F.lit("a resolution names a side without the key "), F.col("key").cast("string"))).cast("string"))
        .when(F.col("side") == "remote", "remote").when(F.col("side") == "local", "local")
        .when(no_r & ~no_l, "local").when(no_r & no_l, "none").when(F.col("r.stage") == -1, "adopt").when(no_l, "remote")
        .when(F.col("l.original") != F.col("r.original"), "source_changed").when(F.col("r.stage").isin(*PROTECTED), "adopt")
        .when((F.col("r.stage") == 1) & ~r_blank, "remote").when(both & (F.col("l.origin") == "machine") & ~r_blank, "remote")
        .when(both, "both_sides_changed").when(changed("l", l_blank) & ~l_blank, "local").otherwise("adopt")
    )
    ruled = met.withColumn("rule", rule).where("rule <> 'none'")
    adopts = F.col("rule").isin("adopt", "source_changed", "both_sides_changed")
    kept = adopts & blank(text("r")) & ~blank(text("l"))
    upload = F.col("rule") == "local"
    mine = upload | kept
    take = lambda c: F.when(mine, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}"))
    conflicts = F.array_compact(F.array(F.when(F.col("rule").isin("source_changed", "both_sides_changed"), F.col("rule")), F.when(kept, F.lit("remote_empty_would_clear_local"))))
    return ruled.select(
        "key", take("original").alias("original"), take("translation").alias("translation"), F.when(upload, 1).otherwise(take("stage")).alias("stage"),
        F.when(upload, "machine").otherwise(take("origin")).alias("origin"), upload.alias("upload"), conflicts.alias("conflicts"),
    )


def differences(accepted: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """path and kind (missing, extra, changed) of (path, digest) rows that do not agree."""
    met = accepted.select("path", F.col("digest").alias("a")).join(rebuilt.select("path", F.col("digest").alias("b")), "path", "full")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return met.select("path", kind.alias("kind")).where("kind is not null")
