"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number of their shingles, in powers of two. The sketch of an item holds its smallest shingle hashes:
those below a threshold that its partition sets so that SKETCH of them are expected (all of them for the small partitions), and the
very smallest always. A long document needs no sketch of its own size: its shingle hashes are held against those of the items.
A pair is a candidate if the share of the sketch that was found is not below the containment sought by more than SIGMAS
standard deviations of the estimate; all candidates are then verified on the whole sets of shingle strings.
The sketches are counted, and broadcast where they fit; where they do not, the documents' hashes pass a bitmap of fixed size before they are shuffled, so
what is shuffled are mostly hashes that some item holds.

Shingles are SHINGLE words of the lower-cased text; a shorter text is one shingle; an empty one has none and is in no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, let, small, table, words, written

SHINGLE, CONTAINMENT, SKETCH, SIGMAS = 5, 0.8, 16, 4.0
#: Bytes of a sketch row in a broadcast; binary logarithm of the bits of the sieve, which has 2^21 rows at most.
SKETCH_ROW, SIEVE = 40, 27


def shingle_strings(text: Column, size: int = SHINGLE) -> Column:
    """Distinct shingles as strings; words never hold a space, so a space joins them without ambiguity."""
    def cut(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return let(words(F.lower(text)), cut)


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles, repeats included: of the words' hashes, each word being hashed once."""
    def cut(h: Column) -> Column:
        n = F.size(h)
        full = F.transform(F.slice(h, 1, F.greatest(n - size + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]))
        return F.when(n >= size, full).when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.lit(size), h)))

    return let(F.transform(words(F.lower(text)), lambda x: F.xxhash64(x)), cut)


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, h, n_sketch): the sketch of each item, by its size partition."""
    sized = items.withColumn("h", F.array_distinct(shingle_hashes(F.col("text")))).where(F.size("h") > 0)
    part = F.floor(F.log2(F.size("h").cast("double")))
    share = F.least(F.lit(1.0), F.lit(float(SKETCH)) / F.pow(F.lit(2.0), part))
    unit = lambda x: F.shiftrightunsigned(x, 11).cast("double") / F.lit(float(1 << 53))
    least = F.array_min(F.transform("h", unit))
    taken = sized.withColumn("_share", share).withColumn("_least", least).withColumn("h", F.filter("h", lambda x: (unit(x) < F.col("_share")) | (unit(x) <= F.col("_least"))))
    return taken.select("item_id", "_share", F.size("h").alias("n_sketch"), F.explode("h").alias("h"))


def sieved(cut: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows of cut whose hash may be one of keyed: a table of 2^SIEVE bits, 64 to a row, so its size does not depend on the items."""
    word, bit = (lambda h: F.shiftrightunsigned(h, 70 - SIEVE)), (lambda h: F.shiftrightunsigned(h, 64 - SIEVE).bitwiseAND(F.lit(63)).cast("int"))
    shifted = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))
    bits = written(keyed.groupBy(word(F.col("h")).alias("_w")).agg(F.bit_or(shifted).alias("_bits")))
    held = cut.withColumn("_w", word(F.col("h"))).join(F.broadcast(bits), "_w")
    return held.where(F.call_function("shiftrightunsigned", F.col("_bits"), bit(F.col("h"))).bitwiseAND(F.lit(1).cast("long")) == 1).select(*cut.columns)


def leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document and item with at least `containment` of the item's shingles in the document.

    docs: doc_id, text; items: item_id, text (other columns are not read). Rows of the same doc_id count as one document
    that holds whatever one of its rows holds; rows of the same item_id likewise. Null texts and ids are in no pair.
    """
    items = written(items.select("item_id", "text").where("item_id is not null and text is not null").distinct().withColumn("_item", F.xxhash64("item_id", "text")))
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    keyed = written(sketches(items.select(F.col("_item").alias("item_id"), "text")).withColumnRenamed("item_id", "_item"))
    n = keyed.count()
    cut = docs.select("doc_id", F.explode(F.array_distinct(shingle_hashes(F.col("text")))).alias("h"))
    found = (cut if n * SKETCH_ROW <= BROADCAST_BYTES else sieved(cut, keyed)).join(small(keyed, n, SKETCH_ROW), "h")
    spread = F.when(F.col("_share") >= 1, F.lit(0.0)).otherwise(F.lit(SIGMAS) * F.sqrt(F.col("n_sketch") * containment * (1 - containment)))
    pairs = found.groupBy("doc_id", "_item").agg(F.count("*").alias("hits"), F.first("n_sketch").alias("n_sketch"), F.first("_share").alias("_share"))
    pairs = written(pairs.where(F.col("hits") >= F.greatest(F.lit(1.0), F.col("n_sketch") * containment - spread - 1e-9)).select("doc_id", "_item"))
    n = pairs.count()
    whole = docs.join(small(pairs.select("doc_id").distinct(), n, 16), "doc_id", "left_semi").select("doc_id", shingle_strings(F.col("text")).alias("_d"))
    asked = small(pairs, n, 32).join(small(items.select("_item", "item_id", shingle_strings(F.col("text")).alias("_i")), size["b"] // 8 + size["n"], 64), "_item")
    both = whole.join(asked, "doc_id").select("doc_id", "item_id", F.size(F.array_intersect("_i", "_d")).cast("long").alias("n_shared"), F.size("_i").cast("long").alias("n_item"))
    kept = both.where(F.col("n_shared") >= F.col("n_item") * containment - 1e-9).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    best = F.max(F.struct("containment", "n_shared", "n_item")).alias("_b")
    return kept.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "_b.n_shared", "_b.n_item", "_b.containment")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a leak, with their own columns; rows with a null doc_id stay."""
    found = written(leaks(docs, items).select("doc_id").distinct())
    return docs.join(small(found, found.count(), 16), "doc_id", "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item in a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CUT = r"""
  SELECT {id}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s
  FROM (SELECT {id}, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM {table}) WHERE len(w) > 0
"""
OP8_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, s FROM ({_CUT.format(id="item_id", table="benchmark")})),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, s FROM ({_CUT.format(id="doc_id", table="documents")})),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""
