"""Language identification with error-correcting output codes.

Each language has a binary codeword; one linear classifier of byte trigrams per bit predicts it. Up to five languages take the
exhaustive code (all ways of splitting them in two), more a seeded random one, the best of CODE_TRIES by least distance. A text is
decoded to the language whose codeword has the least total loss over the bits, each weighted by the log-odds of the bit's training
accuracy, so a weak bit counts less. The score is the share of that language in a softmax over minus the losses, and a text whose
runner-up comes close is flagged as ambiguous.

Only fitting uses a sample: at most PER_LANGUAGE documents of each language, fewer where the languages are so many that this would pass
MAX_SAMPLE (but one at least), the first in the order of a hash of doc_id and text. A profile travels as 4 KB, so the driver takes 260 MB at
most and 8 MB for four languages, unless the languages are more than MAX_SAMPLE. Every language that occurs is fitted. Every document is predicted from its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, table, written
from .toxicity import _TABLE, remainder, sigmoid

WIDTH, PER_LANGUAGE, MAX_SAMPLE, CODE_TRIES = 2048, 500, 64_000, 50
STEPS, RATE, L2, CLOSE = 300, 0.05, 1e-4, 0.15
UNKNOWN = "und"
CHUNK = 1 << 20


def profile(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams over a whole text, letters only, runs of anything else as one space."""
    raw = b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    total = np.zeros(WIDTH)
    for start in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[start : start + CHUNK + 2], np.uint8).astype(np.uint32)
        if len(b) > 2:
            total += np.bincount(((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(2654435761) >> np.uint32(21)) % WIDTH, minlength=WIDTH)
    return np.sqrt(total / max(total.sum(), 1))


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of -1 and 1, every column splitting the languages."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        rest = range(1, n)  # the first language is on the positive side of every split
        columns = [[1 if i == 0 or i in side else -1 for i in range(n)] for k in range(n - 1) for side in combinations(rest, k)]
        return np.array(columns, float).T
    draw, bits = np.random.default_rng(7), math.ceil(10 * math.log2(n))
    tries = [draw.choice([-1.0, 1.0], (n, bits)) for _ in range(CODE_TRIES)]
    return max(tries, key=lambda c: bits - (c @ c.T - 2 * bits * np.eye(n)).max())  # twice the least distance


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, lead over the runner-up) of each row."""
        margins = profiles @ self.weights + self.bias
        losses = np.stack([(np.logaddexp(0, -margins * word) * self.trust).sum(1) for word in self.code], 1)
        e = np.exp(losses.min(1, keepdims=True) - losses)
        share = e / e.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        lead = ranked[:, -1] - ranked[:, -2] if share.shape[1] > 1 else np.ones(len(share))
        return losses.argmin(1), share.max(1), lead


def train(languages: list[str], x: np.ndarray, y: np.ndarray) -> Model:
    """x: profiles; y: language index of each. All bits are fitted at once, languages weighted alike."""
    code = codewords(len(languages))
    x, target = x.astype(np.float32, copy=False), code[y].astype(np.float32)
    share = ((1 / np.bincount(y, minlength=len(languages)))[y][:, None] / len(languages)).astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32), np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    for step in range(1, STEPS + 1):
        slope = -target * sigmoid(-target * (x @ w + b)) * share
        g = np.vstack([x.T @ slope + L2 * w, slope.sum(0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), (b - move[-1]).astype(np.float32)
    right = ((np.sign(x @ w + b) == target) * share).sum(0)
    right = np.clip(right, 0.51, 1 - 1 / (2 + len(x)))
    trust = np.log(right / (1 - right))
    return Model(languages, code, w, b, trust / trust.mean())


def _profiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "x": [profile(t).astype(np.float16).tobytes() for t in batch["text"]]})


def rows_a_language(languages: int) -> int:
    return max(1, min(PER_LANGUAGE, MAX_SAMPLE // languages))


def sampled(known: DataFrame, counts: DataFrame, rows: int) -> DataFrame:
    """doc_id, lang, _h (hash of doc_id and text) of `rows` texts of each language at most, the first by _h; equal rows are one.

    Only hashes below a bound that lets a little more than `rows` pass go on, so no task meets all rows of a frequent language.
    """
    let_by = F.least(F.lit(1.0), (F.lit(rows) + 10 * math.sqrt(rows) + 50) / F.col("_n"))
    unit = F.shiftrightunsigned("_h", 11).cast("double") / F.lit(float(1 << 53))
    few = known.select("doc_id", "lang", "_h").join(counts, "lang").where(unit < let_by).select("doc_id", "lang", "_h").distinct()
    order = Window.partitionBy("lang").orderBy(F.col("_h"), "doc_id")
    return few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= rows).drop("_r")


def fit(docs: DataFrame) -> Model | None:
    """Train on docs (doc_id, text, lang); None if no row has both a language and a text. Rows with a null doc_id count like others; other columns are not read."""
    known = docs.where("lang is not null and text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "lang", "text")
    known = known.withColumn("_h", F.xxhash64("doc_id", "text"))
    counts = written(known.groupBy("lang").agg(F.count("*").alias("_n")))
    n = counts.count()
    if not n:
        return None
    first = written(sampled(known, small(counts, n, 64), rows_a_language(n)))
    # bounded by MAX_SAMPLE, or by the languages if they are more, of fixed width each
    rows = known.join(small(first, max(n, MAX_SAMPLE), 64), ["doc_id", "lang", "_h"]).dropDuplicates(["doc_id", "lang", "_h"])
    held = rows.select("doc_id", "lang", "text").mapInPandas(_profiled, "doc_id long, lang string, x binary").collect()
    held.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    languages = sorted({r["lang"] for r in held})
    place = {lang: i for i, lang in enumerate(languages)}
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in held]).astype(np.float32)
    return train(languages, x, np.array([place[r["lang"]] for r in held]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row. Texts without a letter, or without a model, are `und` with score 0."""
    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                known = np.array([model is not None and isinstance(t, str) and any(map(str.isalpha, t)) for t in part["text"]], bool)
                names, score, close = np.full(len(part), UNKNOWN, object), np.zeros(len(part)), np.ones(len(part), bool)
                if known.any():
                    i, s, lead = model.decode(np.stack([profile(t) for t in part["text"][known]]))
                    names[known], score[known], close[known] = np.array(model.languages, object)[i], s, lead < CLOSE
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": names, "score": score, "ambiguous": close})

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return held.mapInPandas(predicted, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model that saw rows with crc32(doc_id) mod 5 other than 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs.where(remainder(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
