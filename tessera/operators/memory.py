"""Translation-memory operators: lookups, the resolution cascade, guarded writes, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank, source_form
from .review import valid

#: Weight of review states among reviewed rows, and in the export.
REVIEWED = {"locked": 3, "reviewed": 2, "checked": 1}
EXPORT_WEIGHT = {"locked": 4, "reviewed": 3, "unreviewed": 2, "suspect": 1}


def weight(state: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, w in table.items():
        out = F.when(state == name, w).otherwise(out)
    return out


def usable(tm: DataFrame, allow_shadow: bool = True) -> Column:
    shadow = (F.col("classification") == "legacy_clean") if allow_shadow else F.lit(False)
    return ~blank(F.col("translation")) & (F.col("quality_state") != "failed") & (F.col("is_formal") | shadow) & ~F.col("review_state").isin("suspect", "quarantined")


def exact(units: DataFrame, tm: DataFrame) -> DataFrame:
    """(stable_identity, translation): rows of the same coordinate and source version."""
    held = tm.where(usable(tm)).select("stable_identity", "source_fingerprint", "translation")
    return units.select("stable_identity", "source_fingerprint").join(held, ["stable_identity", "source_fingerprint"]).select("stable_identity", "translation")


LEGACY = ("legacy_clean", "legacy_suspect")


def ranked(units: DataFrame, tm: DataFrame) -> DataFrame:
    """(stable_identity, translation, path_rank): the best legacy row under the unit's path, or else under its last segment.

    A conflict between sources makes a row unsafe elsewhere, not at its own place, so suspect rows count. Units may have `aliases`, further
    logical keys in order of preference. Ties go to the older row, then to the lesser text.
    """
    base = F.element_at(F.split("relative_path", "/"), -1)
    paths = F.array_distinct(F.array(F.col("relative_path"), base))
    more = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in units.columns else F.array().cast("array<string>")
    keys = F.array_distinct(F.filter(F.concat(F.array("logical_key"), more), lambda k: k != ""))
    asked = units.select("stable_identity", "project_id", "adapter_id", "source_fingerprint", F.posexplode(paths).alias("path_rank", "path"), keys.alias("_keys"))
    asked = asked.select("*", F.posexplode("_keys").alias("key_rank", "logical_key")).drop("_keys")
    held = tm.where((F.col("origin") == "legacy") & F.col("classification").isin(*LEGACY) & (F.col("review_state") != "quarantined") & (F.col("translation") != ""))
    held = held.select("project_id", "adapter_id", F.col("relative_path").alias("path"), "logical_key", "source_fingerprint", "translation", "updated_at")
    met = asked.join(held, ["project_id", "adapter_id", "path", "logical_key", "source_fingerprint"])
    best = F.min_by(F.struct("translation", "path_rank"), F.struct("path_rank", "key_rank", "updated_at", "translation")).alias("b")
    return met.groupBy("stable_identity").agg(best).select("stable_identity", "b.translation", "b.path_rank")


def reviewed_sources(tm: DataFrame) -> DataFrame:
    """(project_id, source_fingerprint, translation) of sources whose reviewed rows all agree."""
    held = tm.where(F.col("is_formal") & (F.col("quality_state") == "passed") & F.col("review_state").isin(*REVIEWED) & ~blank(F.col("translation")))
    grouped = held.groupBy("project_id", "source_fingerprint").agg(F.min("translation").alias("translation"), F.max("translation").alias("_max"))
    return grouped.where(F.col("translation") == F.col("_max")).drop("_max")


def converged(tm: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """(norm, translation, n, total): sources, in one form, on whose translation the valid legacy rows converge."""
    held = tm.where((F.col("origin") == "legacy") & F.col("classification").isin(*LEGACY) & (F.col("review_state") != "quarantined") & valid())
    counted = held.groupBy(source_form(F.col("source_text")).alias("norm"), "translation").agg(F.count("*").alias("n"))
    top = counted.groupBy("norm").agg(F.sum("n").alias("total"), F.max_by(F.struct("translation", "n"), F.struct(F.col("n"), F.col("translation"))).alias("b"))
    return top.select("norm", "b.translation", "b.n", "total").where((F.col("total") >= least) & (F.col("n") >= F.col("total") * share))


def valid_for(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates (stable_identity, translation, ...) that stand judgement against their unit's source."""
    return candidates.join(units.select("stable_identity", "source_text"), "stable_identity").where(valid()).drop("source_text")


def resolve(units: DataFrame, tm: DataFrame) -> DataFrame:
    """Decision of each unit: filtered, exact, ranked, reviewed_source, convergence, embedded or pending, with the text taken. Candidates that fail judgement are passed over."""
    e = valid_for(units, exact(units, tm)).withColumnRenamed("translation", "t1")
    r = valid_for(units, ranked(units, tm)).select("stable_identity", F.col("translation").alias("t2"))
    s = reviewed_sources(tm).withColumnRenamed("translation", "t3")
    c = converged(tm).select(F.col("norm"), F.col("translation").alias("t4"))
    met = units.withColumn("norm", source_form(F.col("source_text"))).join(e, "stable_identity", "left").join(r, "stable_identity", "left").join(s, ["project_id", "source_fingerprint"], "left").join(c, "norm", "left")
    for name in ("t3", "t4"):
        met = met.withColumn(name, F.when(valid(F.col("source_text"), F.col(name)), F.col(name)))
    embedded = F.when(~blank(F.col("translation")), F.col("translation"))
    filtered = ~F.col("source_text").rlike(r"[A-Za-z]")
    scope = F.when(filtered, "filtered")
    for name, t in (("coordinate_exact", F.col("t1")), ("legacy_coordinate", F.col("t2")), ("reviewed_source", F.col("t3")), ("convergence", F.col("t4")), ("embedded", embedded)):
        scope = scope.when(t.isNotNull(), name)
    text = F.when(~filtered, F.coalesce("t1", "t2", "t3", "t4", embedded))
    return met.select("stable_identity", "relative_path", scope.otherwise("pending").alias("decision"), text.alias("resolved"))


def stale(units: DataFrame, tm: DataFrame) -> DataFrame:
    """Formal rows whose source has changed, old and new side by side."""
    now = units.select("stable_identity", F.col("source_fingerprint").alias("new_fingerprint"), F.col("translation").alias("new_translation"))
    held = tm.where("is_formal").select("stable_identity", F.col("source_fingerprint").alias("old_fingerprint"), F.col("translation").alias("old_translation"))
    return held.join(now, "stable_identity").where("old_fingerprint <> new_fingerprint")


def unique(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key: of several the greatest by all other columns in order, so the result does not depend on how rows are dealt."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_b")).select(*keys, "_b.*")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Guarded write: stable_identity, translation, is_formal, human_authored, origin, outcome.

    A formal row gives way to formal rows only, a row by a human not to a machine's. Of several rows of an identity on a side the greatest counts (`unique`).
    """
    names = ["translation", "is_formal", "human_authored", "origin"]
    side = lambda d, p: unique(d.select("stable_identity", *names), "stable_identity").select("stable_identity", F.lit(True).alias(f"{p}here"), *[F.col(c).alias(p + c) for c in names])
    met = side(old, "o_").join(side(new, "n_"), "stable_identity", "full")
    free = (~F.col("o_is_formal") | F.col("n_is_formal")) & ~((F.col("n_origin") == "machine") & F.col("o_human_authored"))
    same = F.lit(True)
    for c in names:
        same = same & F.col("o_" + c).eqNullSafe(F.col("n_" + c))
    outcome = F.when(F.col("n_here").isNull(), "kept").when(F.col("o_here").isNull(), "inserted").when(same, "unchanged").when(free, "updated").otherwise("rejected")
    take = outcome.isin("inserted", "updated", "unchanged")
    return met.select("stable_identity", *[F.when(take, F.col("n_" + c)).otherwise(F.col("o_" + c)).alias(c) for c in names], outcome.alias("outcome"))


#: What a row that a person has reviewed must say of itself.
REVIEWED_ROW = {"origin": "human", "review_state": "reviewed", "quality_state": "passed", "classification": "native", "is_formal": True, "human_authored": True}


def guard_reason() -> Column:
    """Why a row must not give way to a local review: remote work by a person, or a lock; null if it may."""
    return F.when((F.col("origin") == "paratranz") & F.col("human_authored"), "remote_human").when(F.col("review_state") == "locked", "locked")


def human_write(tm: DataFrame, entries: DataFrame, override: bool = False) -> DataFrame:
    """stable_identity, outcome, reason of each reviewed entry (with the columns of REVIEWED_ROW): written, guarded or refused.

    Refused are blank texts and rows that are not shaped like reviewed ones (reason: the first column that is not); guarded are places whose row must stay, unless `override`.
    """
    shape = F.when(blank(F.col("translation")), "translation")
    for name, value in REVIEWED_ROW.items():
        shape = shape.when(~F.col(name).eqNullSafe(F.lit(value)), name)
    asked = unique(entries.select("stable_identity", "translation", *REVIEWED_ROW), "stable_identity").withColumn("_bad", shape.otherwise(F.lit(None)))
    held = unique(tm.select("stable_identity", guard_reason().alias("_why")), "stable_identity")
    met = asked.join(held, "stable_identity", "left")
    why = F.lit(None).cast("string") if override else F.col("_why")
    outcome = F.when(F.col("_bad").isNotNull(), "refused").when(why.isNotNull(), "guarded").otherwise("written")
    return met.select("stable_identity", outcome.alias("outcome"), F.coalesce("_bad", why).alias("reason"))


def restore(tm: DataFrame, snapshots: DataFrame) -> DataFrame:
    """tm with the before-images of snapshots (stable_identity, present, and tm's columns) put back: absent ones delete the row.

    Only rows that a person wrote here may be taken back; a snapshot of any other is an error.
    """
    names = [c for c in tm.columns if c != "stable_identity"]
    marked = snapshots.select("stable_identity", F.lit(True).alias("_s"), "present", *[F.col(c).alias("_" + c) for c in names])
    met = tm.withColumn("_t", F.lit(True)).join(marked, "stable_identity", "full")
    foreign = F.col("_s") & F.col("_t") & ~F.col("origin").eqNullSafe("human")
    wrong = F.raise_error(F.concat(F.lit("not written by a reviewer: "), F.col("stable_identity"))).cast("boolean")
    kept = F.when(foreign, wrong).otherwise(F.col("_s").isNull() | F.col("present"))
    pick = lambda c: F.when(F.col("_s"), F.col("_" + c)).otherwise(F.col(c)).alias(c)
    return met.where(kept).select("stable_identity", *[pick(c) for c in names]).select(*tm.columns)


def promote(tm: DataFrame, keys: DataFrame) -> DataFrame:
    """Make the rows of keys formal if they have passed; others stay."""
    marked = keys.select("stable_identity").distinct().withColumn("_p", F.lit(True))
    met = tm.join(marked, "stable_identity", "left")
    return met.withColumn("is_formal", F.col("is_formal") | (F.coalesce("_p", F.lit(False)) & (F.col("quality_state") == "passed"))).drop("_p")


def winners(tm: DataFrame, *coordinate: str) -> DataFrame:
    """The row of most authority per coordinate."""
    order = [F.desc("is_formal"), F.desc("human_authored"), F.desc(weight(F.col("review_state"), EXPORT_WEIGHT)), F.desc(F.coalesce("stage", F.lit(-1))), F.asc("adapter_id"), F.asc("stable_identity")]
    return tm.withColumn("_r", F.row_number().over(Window.partitionBy(*coordinate).orderBy(*order))).where("_r = 1").drop("_r")


def rebuild(pending: DataFrame, parent: DataFrame) -> DataFrame:
    """Disposition of each unit: reused, stale, retry, or resolved (failed before, no longer pending)."""
    met = pending.select("id", F.col("fp").alias("now")).join(parent.select("id", "state", "text", "fp"), "id", "full")
    kind = F.when(F.col("now").isNull(), F.when(F.col("state") == "failed", "resolved")).when(F.col("fp").isNotNull() & (F.col("fp") != F.col("now")), "stale")
    kind = kind.when((F.col("state") == "succeeded") & ~blank(F.col("text")) & (F.col("fp") == F.col("now")), "reused").otherwise(F.when(F.col("now").isNotNull(), "retry"))
    return met.select("id", kind.alias("disposition")).where("disposition is not null")
