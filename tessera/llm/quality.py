"""Quality rules: a threshold table compiled into one projection, with no user functions.

The measures of a text are built from built-in array functions over its words and lines; the table below is then turned into
one boolean expression over them. Nothing is shuffled. A null text has no words, lines or symbols.
"""

from __future__ import annotations

import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, let, table, words


class Rule(NamedTuple):
    name: str
    measure: str
    test: str
    bound: float


# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "was", "on", "this", "by", "from", "at", "as", "an", "are",
    "der", "die", "das", "und", "ist", "ein", "eine", "den", "von", "zu", "mit", "auf", "für", "im", "dem", "nicht", "des",
    "le", "la", "les", "de", "et", "un", "une", "est", "dans", "que", "qui", "pour", "en", "du", "au", "pas", "sur",
    "el", "los", "las", "y", "es", "por", "con", "una", "para", "se", "lo", "del", "su",
)

#: A text is kept if every rule holds.
RULES = (
    Rule("long_enough", "n_words", ">=", 50),
    Rule("words_not_too_short", "mean_word_chars", ">=", 2.0),
    Rule("words_not_too_long", "mean_word_chars", "<=", 16.0),
    Rule("few_symbols", "symbol_ratio", "<=", 0.05),
    Rule("has_stop_words", "stop_ratio", ">=", 0.03),
    Rule("few_repeated_lines", "dup_line_ratio", "<=", 0.5),
    Rule("few_repeated_words", "repeat_ratio", "<=", 0.5),
)
TESTS = {"<=": operator.le, ">=": operator.ge}


def repeated_words(held: Column) -> Column:
    """Words inside a 3-word window that the array holds twice or more, counting the first.

    Windows are hashed, sorted with their places, compared with their neighbours, and the places merged in one pass:
    n log n in the length of the text, whatever repeats.
    """
    marked = F.transform(
        F.slice(held, 1, F.greatest(F.size(held) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(held, i + 1), F.get(held, i + 2)).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def cover(i: Column) -> Column:
        gained = F.transform(i, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(i, k + 1) - x, F.lit(3))))
        return F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.sort_array(marked), lambda s: let(places(s), cover))


def measures(text: Column) -> Column:
    """Struct of the counts of a text, each long."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_part = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_part = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    symbols = (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long")
    return F.struct(word_part.alias("w"), line_part.alias("l"), symbols.alias("n_symbols"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one Column over the names that `measured` gives."""
    out = F.lit(True)
    for rule in rules:
        out = out & TESTS[rule.test](F.col(rule.measure), F.lit(float(rule.bound)))
    return out


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array_compact(F.array(*[F.when(~TESTS[r.test](F.col(r.measure), F.lit(float(r.bound))), F.lit(r.name)) for r in rules]))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with one struct column `_q` holding counts and ratios; ratios of an empty text are 0."""
    held = df.withColumn("_m", measures(F.col(text)))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
    c = lambda k: F.col("_m." + k)
    n, chars = c("w.n_words"), c("w.word_chars")
    return held.withColumn(
        "_q",
        F.struct(
            n.alias("n_words"), chars.alias("word_chars"), c("n_symbols").alias("n_symbols"), c("l.n_dup_lines").alias("n_dup_lines"), c("w.n_repeat_words").alias("n_repeat_words"),
            ratio(chars, n).alias("mean_word_chars"), ratio(c("n_symbols"), chars).alias("symbol_ratio"), ratio(c("w.n_stop_words"), n).alias("stop_ratio"),
            ratio(c("l.n_dup_lines"), c("l.n_lines")).alias("dup_line_ratio"), ratio(c("w.n_repeat_words"), n).alias("repeat_ratio"),
        ),
    ).drop("_m")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with the base counts, the ratios, `kept` and the names of the rules that failed.

    Null and empty texts have counts of 0 and fail; equal rows and repeated doc_ids are judged each; whole texts of any length, in n log n of their words;
    a measure that equals its bound passes; an empty table gives none. Only doc_id and text are read, so others may have any names.
    """
    flat = measured(docs.select("doc_id", "text")).select("doc_id", "_q.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules)).withColumn("failed", failed_rules(rules))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their own columns under any names; cases as in `judged`."""
    names = docs.columns
    flat = measured(docs).select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(names)], "_q.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return flat.where(~base & verdict()).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(names)])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; cases as in `judged`."""
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, w[i] || chr(31) || w[i+1] || chr(31) || w[i+2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS stops,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id
), r AS (
  SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CAST(word_chars AS DOUBLE) / n_words BETWEEN 2.0 AND 16.0 AND CAST(n_symbols AS DOUBLE) / word_chars <= 0.05
  AND CAST(stops AS DOUBLE) / n_words >= 0.03 AND CAST(n_dup_lines AS DOUBLE) / len(lines) <= 0.5 AS kept
FROM r
"""
