"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of `cells` cells. A key's hash names a cell, and the next point clockwise is its home.
A shard takes keys until its capacity is reached; the keys beyond continue clockwise to the next point whose shard has room.
With slack 0 the capacities add up to the number of rows, so the counts of any two shards differ by one at most (law `rows`).

What travels to the driver is one count a cell (a fixed number, whatever the input); the driver walks the ring over counts and
returns intervals of ranks, which are joined back. Rows that are equal in all key columns are counted first and numbered
arithmetically, so no window ever holds a hot key.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_of, table, written

CELLS, VNODES, CHUNK = 1 << 13, 64, 1 << 14


def ring(n_shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's points do not depend on the number of shards."""
    points = []
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"shard {shard} point {v}".encode(), digest_size=16).digest()
            points.append((int.from_bytes(digest[:8], "big") % cells, digest, shard))
    return [(cell, shard) for cell, _, shard in sorted(points)]


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: an even split for slack 0, else (1 + slack) times the mean, rounded up."""
    if slack:
        return [-int(-(1 + slack) * total // n_shards)] * n_shards
    return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]


def walk(counts: dict[int, int], n_shards: int, vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Place the keys of each cell. Returns (cell, first rank, end rank, shard, slot of the first rank)."""
    points = ring(n_shards, vnodes, cells)
    at = [cell for cell, _ in points]
    room, filled = capacities(sum(counts.values()), n_shards, slack), [0] * n_shards
    waiting: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for cell in sorted(counts):
        waiting[bisect_left(at, cell) % len(points)].append((cell, 0, counts[cell]))
    placed = []
    while waiting:
        moved: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for point in sorted(waiting):
            shard = points[point][1]
            for cell, low, high in waiting[point]:
                taken = min(high - low, room[shard] - filled[shard])
                if taken:
                    placed.append((cell, low, low + taken, shard, filled[shard]))
                    filled[shard] += taken
                if low + taken < high:
                    moved[(point + 1) % len(points)].append((cell, low + taken, high))
        waiting = moved
    return placed


def shard(df: DataFrame, keys: list[str], n_shards: int, vnodes: int = VNODES, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """Return the key columns of df with `shard` int and `slot` long (from 0 without gaps in each shard).

    One output row for each input row. Nulls in a key are a value like any other; equal rows get different slots;
    an empty table gives an empty result. `keys` may have any names except shard and slot.
    """
    spark = df.sparkSession
    names = [f"_k{i}" for i in range(len(keys))]
    held = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)])
    held = written(held.groupBy(*names).agg(F.count("*").alias("_n")).withColumn("_cell", F.pmod(F.xxhash64(*names), F.lit(cells)).cast("int")))
    counts = {r["_cell"]: r["n"] for r in held.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()}
    plan = spark.createDataFrame(
        walk(counts, n_shards, vnodes, cells, slack), "_cell int, _low long, _high long, shard int, _base long"
    )
    order = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(1), *names), *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("_first", F.sum("_n").over(order) - F.col("_n"))
    chunks = ranked.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))))
    one = chunks.withColumn("_nth", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("_n")) - 1))).withColumn("_rank", F.col("_first") + F.col("_nth"))
    met = one.join(F.broadcast(plan), (one["_cell"] == plan["_cell"]) & (one["_rank"] >= plan["_low"]) & (one["_rank"] < plan["_high"]))
    return met.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "shard", (F.col("_rank") - F.col("_low") + F.col("_base")).alias("slot"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `rows`."""
    return sharded(table(spark, sf_dir, "documents"))


def sharded(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), crc32_of(docs["text"]).alias("text_crc32"))
    done = shard(sized, ["doc_id", "size", "text_crc32"], n_shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
