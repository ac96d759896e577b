"""Projections of append-only logs; write order (`seq`) is the truth, not time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut

#: The state that each action leaves a target in; any other leaves it pending.
STATES = {"draft": "draft", "commit": "committed", "unify": "committed", "accept_debt": "committed", "revert": "reverted", "retire": "pending", "skip": "skipped", "defer": "deferred"}


def ledger(log: DataFrame) -> DataFrame:
    """State of each target after its last action; its text is that of the last action that has one. Of actions with the same seq the greatest name counts as last."""
    state = F.lit("pending")
    for action, name in STATES.items():
        state = F.when(F.col("action") == action, name).otherwise(state)
    order = F.struct("seq", "action", "text")
    spoken = F.when(F.col("text").isNotNull(), order)
    out = log.withColumn("_s", state).groupBy("target").agg(F.max_by("_s", order).alias("state"), F.max_by("text", spoken).alias("text"), F.max("seq").alias("cursor"), F.count("*").alias("events"))
    return out


def batches(events: DataFrame) -> DataFrame:
    """One row a batch: last state, last non-empty reason, tokens, attempts."""
    named = F.when(F.col("reason") != "", F.col("seq"))
    return events.groupBy("batch_id").agg(
        F.max_by("state", "seq").alias("state"), F.max_by("reason", named).alias("reason"), F.sum("tokens").alias("tokens"), F.count_if(F.col("state") == "view").alias("attempts")
    )


def transitions(events: DataFrame) -> DataFrame:
    """How often a batch went from one state to another."""
    from pyspark.sql.window import Window

    before = F.lag("state").over(Window.partitionBy("batch_id").orderBy("seq"))
    return events.withColumn("from_state", before).where("from_state is not null").groupBy("from_state", F.col("state").alias("to_state")).agg(F.count("*").alias("n"))


def lineage(edges: DataFrame, limit: int = 32) -> DataFrame:
    """(id, ancestor, depth) of each chain of parents, by doubling: after k joins chains of 2^k steps are known.

    Chains end after `limit` steps, so a cycle comes back as often as it fits. Each round is cut off from its plan and read by the next.
    """
    now = edges.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    for k in range(max(1, (limit - 1).bit_length())):
        step = 1 << k  # rows of depth up to `step` are known; those of exactly `step` reach on
        ends = now.where(F.col("depth") == step).select("id", F.col("ancestor").alias("_a"))
        more = ends.join(now.select(F.col("id").alias("_a"), F.col("ancestor"), F.col("depth").alias("_d")), "_a")
        more = cut(more.select("id", "ancestor", (F.col("_d") + step).alias("depth")))
        if more.isEmpty():
            break
        now = now.unionByName(more)
    return now.where(F.col("depth") <= limit)
