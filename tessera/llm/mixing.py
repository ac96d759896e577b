"""Temperature mixing of sources, realised as budgeted block permutations.

A source with a share p of all tokens gets weight p^a / sum p^a. Entropy falls as the exponent a grows, from log K at 0, and the most that any source is repeated is
least at 1 and grows to both sides; so a is bisected to meet a target entropy, a share `flatten` of the way from the corpus's own entropy to log K, or (neither given) to be the
least in [0, 1] with which no source is seen more than `max_repeats` times. Where the target's exponent would repeat a source more often than that, the limit
holds and a moves towards 1 as far as it must. A target or a limit that no exponent meets is an error.
A source's documents fall into blocks by hash; a pass visits the blocks in an order hashed from the pass, and each block's
documents in a hashed order too. Blocks that fit into the source's budget are taken whole; the one that crosses it is taken up to the
document that reaches the budget. Each pass is a permutation of the source, so a document comes at most once more than any other.
Equal rows are counted first and numbered arithmetically, so each is a document of its own and no block holds them all.

Only one row a source travels to the driver (SOURCES at most; more raise, as weights for so many would be a table, not a setting).
Blocks hold about BLOCK rows each whatever the size of the source, and running sums go over blocks first, by chunks of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, words, written

BLOCK, SOURCES, MAX_REPEATS, CHUNK = 2048, 100_000, 4.0, 1 << 14
#: Exponents are sought up to this one.
STEEPEST = 1e6


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], exponent: float) -> list[float]:
    most = max(tokens)  # of the shares' ratios, not the shares, so that steep exponents do not lose them all
    raw = [(t / most) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raw) for r in raw]


def covering(tokens: list[int], weights: list[float]) -> float:
    """The least budget under which every source is seen once in full."""
    return max(t / w if w else math.inf for w, t in zip(weights, tokens, strict=True) if t)


def bisected(fits: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The least value in [low, high] that fits, given that all beyond one do and high does."""
    if fits(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def exponent_for(tokens: list[int], budget: float | None, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, flatten: float | None = None) -> float:
    """The exponent of the mix; a budget of None is the covering one of each exponent. target_entropy is a share of log K.

    No tokens at all: 0. A ValueError if nothing reaches the target or keeps the limit.
    """
    held = [t for t in tokens if t]
    if not held:
        return 0.0
    most = math.log(len(held)) if len(held) > 1 else 1.0
    share = lambda a: entropy(tempered(held, a)) / most

    def within(a: float) -> bool:
        w = tempered(held, a)
        asked = covering(held, w) if budget is None else budget
        return max_repeats is None or asked < math.inf and max(x * asked / t for x, t in zip(w, held, strict=True)) <= max_repeats * (1 + 1e-12)

    if not within(1.0):
        raise ValueError(f"no exponent repeats every source {max_repeats} times at most")
    if target_entropy is None and flatten is None:
        return bisected(within, 0.0, 1.0)
    target = target_entropy if flatten is None else share(1.0) + flatten * (1 - share(1.0))
    if len(held) > 1 and share(STEEPEST) > target:
        raise ValueError(f"no exponent up to {STEEPEST} has {target} of the greatest entropy")
    a = bisected(lambda x: share(x) <= target, 0.0, STEEPEST) if len(held) > 1 else 1.0
    if within(a):
        return a
    return bisected(within, a, 1.0) if a < 1 else -bisected(lambda x: within(-x), -a, -1.0)


def plan(spark: SparkSession, sized: DataFrame, budget: int | None, max_repeats: float | None, target_entropy: float | None, flatten: float | None, cover: bool = False) -> DataFrame:
    """One row a source: source, docs, tokens, weight, target tokens, blocks, passes.

    budget None: as many tokens as there are, or with `cover` as many as show every document of every source at least once.
    """
    held = sized.groupBy("source").agg(F.sum("_n").alias("docs"), F.sum(F.col("tokens") * F.col("_n")).alias("tokens")).limit(SOURCES + 1).collect()
    if len(held) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    tokens = [int(r["tokens"]) for r in held]
    asked = sum(tokens) if budget is None else budget
    exponent = exponent_for(tokens, None if cover else asked, max_repeats, target_entropy, flatten)
    weights = tempered(tokens, exponent) if any(tokens) else [0.0] * len(tokens)
    asked = covering(tokens, weights) if cover and any(tokens) else asked
    rows = []
    for r, t, w in zip(held, tokens, weights, strict=True):
        target = int(round(w * asked))
        rows.append((r["source"], int(r["docs"]), t, float(w), target, max(1, r["docs"] // BLOCK), max(1, -(-target // t)) if t else 0, float(exponent)))
    return spark.createDataFrame(rows, "source string, docs long, source_tokens long, weight double, target long, blocks int, passes int, exponent double")


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    """doc_id, source, tokens, _row (what tells rows of a doc_id apart), _n (how many rows are equal) of the rows that hold words."""
    held = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.size(words(F.col("text"))).cast("long").alias("tokens"), row.alias("_row"))
    return written(held.where("tokens > 0").groupBy("doc_id", "source", "tokens", "_row").agg(F.count("*").alias("_n")))


def mix(docs: DataFrame, budget: int | None = None, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, flatten: float | None = None, seed: int = 0, cover: bool = False) -> DataFrame:
    """One row per draw: doc_id, source, tokens, pass (from 0), block, position (running tokens of the source before it, earlier passes included), weight, exponent.

    docs: doc_id, source, text; other columns are not read. Tokens are the words of the whole text. Null sources are one source; rows of a doc_id are drawn each on
    their own, equal ones included; texts without words hold no tokens and are never drawn, nor are sources without any. An empty table gives no draws.
    """
    return _mixed(_sized(docs, F.xxhash64("text")), budget, max_repeats, target_entropy, flatten, seed, cover)


def _mixed(sized: DataFrame, budget: int | None, max_repeats: float | None, target_entropy: float | None, flatten: float | None, seed: int, cover: bool) -> DataFrame:
    spark = sized.sparkSession
    plans = plan(spark, sized, budget, max_repeats, target_entropy, flatten, cover)
    same = sized["source"].eqNullSafe(plans["source"])
    each = sized.join(F.broadcast(plans), same).drop(plans["source"])
    chunks = each.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))))
    each = chunks.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("_n")) - 1))).drop("_from")
    each = each.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_row", "_copy"), F.col("blocks")).cast("int"))
    draws = each.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    # every pass is a permutation: its blocks in an order of its own, within them the documents
    in_pass = F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass")
    sums = each.groupBy("source", "block", "passes").agg(F.sum("tokens").alias("_t")).select("source", "block", "_t", in_pass)
    shuffled = sums.withColumn("_place", F.xxhash64(F.lit(seed), F.col("pass"), "source", "block")).withColumn("_chunk", F.shiftrightunsigned("_place", 52))
    chunks = shuffled.groupBy("source", "pass", "_chunk").agg(F.sum("_t").alias("_c"))
    by_chunk = Window.partitionBy("source", "pass").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    in_chunk = Window.partitionBy("source", "pass", "_chunk").orderBy("_place", "block").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col("source").alias("_s"), F.col("pass").alias("_p"), F.col("_chunk").alias("_k"), F.coalesce(F.sum("_c").over(by_chunk), F.lit(0)).alias("_c0"))
    before = shuffled.join(chunks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("_chunk") == F.col("_k")))
    before = before.select("_s", "_p", F.col("block").alias("_b"), (F.col("_c0") + F.coalesce(F.sum("_t").over(in_chunk), F.lit(0))).alias("_before"))
    in_block = Window.partitionBy("source", "pass", "block").orderBy(F.xxhash64(F.lit(seed), F.col("pass"), "doc_id", "_row", "_copy"), "doc_id", "_row", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = draws.withColumn("_in", F.coalesce(F.sum("tokens").over(in_block), F.lit(0)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("block") == F.col("_b")))
    placed = placed.withColumn("position", F.col("pass") * F.col("source_tokens") + F.col("_before") + F.col("_in")).where("position < target")
    return placed.select("doc_id", "source", "tokens", "pass", "block", "position", "weight", "exponent", "_row", "_n")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw of a mix of the corpus's own size whose entropy lies half way from the corpus's own to the greatest, each source repeated four times at most."""
    return mix(table(spark, sf_dir, "documents"), flatten=0.5).drop("_row", "_n")


def drawn(docs: DataFrame, **settings: float | int | bool | None) -> DataFrame:
    """The documents of a mix with their own columns: as many rows of a document as it has draws.

    Equal rows (in all columns) share their draws out among them; which of them comes more often cannot be told. Null values are values like any other.
    """
    row = F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])
    given = {"budget": None, "max_repeats": MAX_REPEATS, "target_entropy": None, "flatten": None, "seed": 0, "cover": False} | settings
    sized = _sized(docs, row)
    drawn = _mixed(sized, **given).groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_r"))
    counted = written(drawn.agg(F.count("*").alias("_times"), F.first("_n").alias("_n")))
    keyed = docs.withColumn("_h", row)
    met = keyed.join(counted, keyed["doc_id"].cast("long").eqNullSafe(counted["_id"]) & (keyed["_h"] == counted["_r"]))
    # of equal rows one stands for all, so none is counted twice
    one = met.where("_n = 1").unionByName(met.where("_n > 1").dropDuplicates(["_id", "_h"]))
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
