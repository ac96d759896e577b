"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U) train a linear classifier in numpy. With the class prior pi, the risk of
calling U negative is corrected by that of the positives in it, and held at zero from below, which keeps a flexible model from
overfitting P:  pi R_p(+) + max(0, R_u(-) - pi R_p(-)). The loss is logistic, so the sigmoid of the margin estimates the
probability of toxicity. Words are lower-cased runs of letters; each counts for itself and for its beginnings of PREFIXES bytes, so
that inflected and compounded forms of a stem add up. A feature is that such a count reaches 1, 2, ... LEVELS. Features that P
does not show clearly more or less often than U are left out, and the rest get an L2 penalty.

Only fitting uses a sample: at most MAX_POSITIVE and MAX_UNLABELLED documents, the first in the order of a hash of
doc_id. The class prior and the scores cover every document. The model is an array of at most FEATURES weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

BUCKETS, LEVELS, PREFIXES = 1 << 22, 4, range(4, 10)
FEATURES, MAX_POSITIVE, MAX_UNLABELLED = 512, 2000, 6000
Z_LEAST, L2, STEPS, RATE = 5.0, 1e-5, 1500, 0.05
THRESHOLD = 0.7
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


class Buckets(dict):
    """Buckets of a word and its beginnings, computed once a word; with `only`, their places in that sorted array instead."""

    def __init__(self, only: np.ndarray | None = None) -> None:
        super().__init__()
        self.only = None if only is None else {int(b): i for i, b in enumerate(only)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        parts = [b"=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]
        found = [xxhash.xxh3_64_intdigest(x) % BUCKETS for x in parts]
        out = self[word] = tuple(found if self.only is None else [self.only[b] for b in found if b in self.only])
        return out


def levels(text: str | None, seen: Buckets) -> np.ndarray:
    """Sorted features of a whole text: bucket * LEVELS + level - 1 for each level that the bucket's count reaches."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    ids, n = np.unique(np.fromiter(chain.from_iterable(map(seen.__getitem__, words)), np.int64), return_counts=True)
    n = np.minimum(n, LEVELS)
    return np.repeat(ids * LEVELS, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def tallied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """positive, text -> how many texts of either kind show each feature, one batch at a time."""
    seen = Buckets()
    for batch in batches:
        for kind in (True, False):
            held = [levels(t, seen) for t in batch["text"][batch["positive"] == kind]]
            f, n = np.unique(np.concatenate(held) if held else np.empty(0, np.int64), return_counts=True)
            yield pd.DataFrame({"f": f, "p": n * kind, "u": n * (not kind)})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def select(tallies: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """Features whose document frequencies in P and U differ by Z_LEAST standard errors, the FEATURES clearest of them."""
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    total = tallies.groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).withColumn("z", F.round(z, 9))
    return np.array(sorted(r["f"] for r in total.where(F.col("z") >= Z_LEAST).orderBy(F.desc("z"), "f").limit(FEATURES).collect()), np.int64)


def nn_pu(xp: np.ndarray, xu: np.ndarray, prior: float, l2: float = L2, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk with logistic loss, by Adam on full batches."""
    w = np.zeros(xp.shape[1] + 1)
    xp, xu = (np.hstack([x, np.ones((len(x), 1))]) for x in (xp, xu))
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp, zu = xp @ w, xu @ w
        up = -xp.T @ sigmoid(-zp) / len(xp)  # gradient of the loss of P as positive
        down_p, down_u = xp.T @ sigmoid(zp) / len(xp), xu.T @ sigmoid(zu) / len(xu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = prior * up + down_u - prior * down_p if negative >= 0 else -(down_u - prior * down_p)
        g = g + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


class Model:
    """Selected features (sorted), their weights, the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.features, self.weights, self.bias = features, weights, bias
        self.buckets = np.unique(features // LEVELS)
        self.grid = np.zeros((len(self.buckets), LEVELS))  # sum of the weights of the levels up to each
        np.add.at(self.grid, (np.searchsorted(self.buckets, features // LEVELS), features % LEVELS), weights)
        self.grid = self.grid.cumsum(1)

    def margin(self, text: str | None, seen: Buckets) -> float:
        """Of a whole text; `seen` is Buckets(self.buckets)."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
        found = np.fromiter(chain.from_iterable(map(seen.__getitem__, words)), np.int64)
        if not len(found):
            return self.bias
        ids, n = np.unique(found, return_counts=True)
        return float(self.grid[ids, np.minimum(n, LEVELS) - 1].sum() + self.bias)


def dense(batches: Iterator[pd.DataFrame], features: np.ndarray) -> Iterator[pd.DataFrame]:
    """doc_id, positive, text -> packed bits, one a selected feature."""
    seen = Buckets()
    for batch in batches:
        bits = [np.packbits(np.isin(features, levels(t, seen), assume_unique=True)).tobytes() for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "positive": batch["positive"], "x": bits})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on docs (doc_id, text) and labels (doc_id, toxic): rows of neither that the caller holds out. No toxic row: a model that says 0.5 * prior."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    prior = min(0.95, max(1e-4, n["p"] / n["n"])) if n["n"] else 1e-4
    none = Model(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    order = F.xxhash64("doc_id")
    chosen_p = known.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(MAX_POSITIVE)
    chosen_u = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_UNLABELLED)
    chosen = written(chosen_p.withColumn("positive", F.lit(True)).unionByName(chosen_u.withColumn("positive", F.lit(False))))
    # the sample is bounded by the two parameters, so its ids may be broadcast and its packed features collected
    sample = written(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text"))
    n_p, n_u = (sample.where(F.col("positive") == kind).count() for kind in (True, False))
    if not n_p or not n_u:
        return none
    features = select(sample.select("positive", "text").mapInPandas(tallied, "f long, p long, u long"), n_p, n_u)
    if not len(features):
        return none
    rows = sample.mapInPandas(lambda b: dense(b, features), "doc_id long, positive boolean, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["positive"], bytes(r["x"])))
    x = np.unpackbits(np.array([np.frombuffer(r["x"], np.uint8) for r in rows]), axis=1)[:, : len(features)].astype(np.float64)
    kind = np.array([r["positive"] for r in rows])
    return Model(features, *nn_pu(x[kind], x[~kind], prior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability of toxicity of each row; null and empty texts get that of a text without features."""
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Buckets(model.buckets)
        for batch in batches:
            margins = np.array([model.margin(t, seen) for t in batch["text"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": sigmoid(margins)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(scored, "doc_id long, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that saw labels of rows with crc32(doc_id) mod 3 other than 1."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    seen = lambda d: d.where(remainder(F.col("doc_id"), 3) != 1)
    out = score(docs, fit(seen(docs), seen(labels)))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
