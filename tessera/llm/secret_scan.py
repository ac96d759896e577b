"""Secret scans: fixed patterns, plus a randomness test battery over opaque tokens with length-aware false-discovery control.

Spans come from built-in functions alone: splitting a text by a pattern gives the pieces between its matches, and the lengths of
pieces and matches, added up alternately, give the places (code points, end exclusive).

The battery looks at every run of 20 or more characters of the base-64 alphabets, letters or digits alone included. Its encoding (hex, base32, base64) is the smallest
alphabet that holds it; hex may be of either case or mixed, and dashed as a UUID. Three statistics follow: chi-squared uniformity over the alphabet, the number of runs above and
below the alphabet's middle, and the lag-1 serial correlation. Each has a p-value under "random string" (normal
approximations; Wilson-Hilferty for chi-squared), and the least of the three, times three, must reach RANDOM_P. The null hypothesis that discovery has to
reject is "ordinary text or identifier": chi-squared higher, turns fewer and correlation higher than at random, by an excess that grows with the length. The three normal scores
against it are weighed together, so the one p-value that results falls with the length, and short tokens cannot be discovered by chance.
Benjamini-Hochberg over all tokens of the table, on a fixed histogram of -log10 p,
sets the level, so what is kept has a false-discovery rate of at most LEVEL under that model.

Defined cases: a null or empty text has no spans; each row is scanned on its own, so repeated doc_ids and rows come back as often as they are; an empty table gives
none; of tokens of equal score all are kept or none; texts of any length are scanned whole, in n log n of their matches; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, running, table, written

# The patterns of the base kinds, with the least length of what must match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 16
HEX, HEX_LEAST = r"[0-9a-f]{32,}", 32  # as [0-9a-f]+ without the shorter matches: a match is always a whole run
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
#: Name, size, characters in order and the tokens that fit; smallest first.
ALPHABETS = (
    ("hex", 16, "0123456789abcdef", r"^[0-9A-Fa-f-]+$"),
    ("base32", 32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+$"),
    ("base64", 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/_-]+$"),
)
LEVEL, RANDOM_P, BINS, STEP = 0.01, 0.001, 600, 0.05
#: Excess of chi-squared a character that letters of ordinary words show in each alphabet, on the cautious side.
TEXT_EXCESS = {"hex": 1.0, "base32": 1.0, "base64": 2.0}
#: Share of turns about the middle and lag-1 correlation of ordinary words, on the cautious side too.
TEXT_TURNS, TEXT_SERIAL = 0.42, 0.08
#: What the chi-squared, runs and serial test weigh when their evidence is put together.
WEIGHTS = (1.0, 0.5, 0.5)

SPAN = "array<struct<start:int,end:int,kind:int,m:string>>"


def spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, end, kind, m>> of the leftmost non-overlapping matches of a pattern that never matches empty."""
    def placed(found: Column, pieces: Column) -> Column:
        ends = running(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m)))
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).cast("int").alias("start"), e.cast("int").alias("end"), F.lit(kind).alias("kind"), m.alias("m")))

    both = lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: let(F.split(t, pattern, -1), lambda p: placed(m, p)))
    return F.when(text.rlike(pattern), let(text, both)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a rational approximation within 1e-5 near the centre and a bound of the right order in the tail."""
    x = F.abs(z)
    t = 1 / (1 + 0.33267 * x)
    upper = F.exp(-x * x / 2) * 0.3989422804 * (t * 0.4361836 - t * t * 0.1201676 + t * t * t * 0.9372980)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def statistics(name: str, k: int, v: Column) -> Column:
    """struct<encoding, p_random, score> of an array v of places in an alphabet of k."""
    n = F.size(v).cast("double")
    mid, var = (k - 1) / 2, (k * k - 1) / 12

    def tally(a: Column, x: Column) -> Column:
        run = F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1.0))
        return F.struct(x.alias("last"), run.alias("run"), (a["squares"] + 2 * run - 1).alias("squares"))

    def sums(pairs: Column) -> Column:
        squares = F.aggregate(F.array_sort(v), F.expr("named_struct('last', -1, 'run', 0.0D, 'squares', 0.0D)"), tally)["squares"]
        turns = F.size(F.filter(pairs, lambda x: (x["a"] > mid) != (x["b"] > mid))).cast("double")
        serial = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + (x["a"] - mid) * (x["b"] - mid)) / var / F.sqrt(n - 1)
        return F.struct(n.alias("n"), (F.lit(float(k)) * squares / n - n).alias("chi"), turns.alias("turns"), serial.alias("serial"))

    def scores(x: Column) -> Column:
        n, chi, turns, serial = (x[c] for c in ("n", "chi", "turns", "serial"))
        wilson = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5
        runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        excess = TEXT_EXCESS[name]
        against = [
            ((k - 1) + excess * n - chi) / F.sqrt(2 * ((k - 1) + 2 * excess * n)),
            (turns - TEXT_TURNS * (n - 1)) / F.sqrt(TEXT_TURNS * (1 - TEXT_TURNS) * (n - 1)), TEXT_SERIAL * F.sqrt(n - 1) - serial,
        ]
        weighed = sum(w * z for w, z in zip(WEIGHTS, against, strict=True)) / sum(w * w for w in WEIGHTS) ** 0.5
        return F.struct(wilson.alias("wilson"), F.abs(runs).alias("runs"), F.abs(serial).alias("serial"), weighed.alias("weighed"))

    def judged(z: Column) -> Column:
        p_random = F.least(F.lit(1.0), 3 * F.least(normal_tail(z["wilson"]), 2 * normal_tail(z["runs"]), 2 * normal_tail(z["serial"])))
        score = F.greatest(-F.log10(F.greatest(normal_tail(z["weighed"]), F.lit(1e-30))), F.lit(0.0))
        return F.struct(F.lit(name).alias("encoding"), p_random.alias("p_random"), score.alias("score"))

    # each step is bound, as nothing else keeps a lambda's parts from being evaluated again at every use
    follows = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return let(let(let(follows, sums), scores), judged)


def battery(token: Column) -> Column:
    """struct<encoding, p_random, score>: score is -log10 of the p-value of "ordinary text" (0: no evidence)."""
    out = F.struct(F.lit("none").alias("encoding"), F.lit(0.0).alias("p_random"), F.lit(0.0).alias("score"))
    for name, k, chars, fits in reversed(ALPHABETS):
        plain = F.translate(token, "-_", "+/") if name == "base64" else F.lower(F.translate(token, "-", "")) if name == "hex" else token
        out = F.when(token.rlike(fits), _tested(name, k, _places(plain, chars))).otherwise(out)
    return out


def _places(token: Column, chars: str) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(chars), c) - 1)


def _tested(name: str, k: int, places: Column) -> Column:
    return let(F.filter(places, lambda x: x >= 0), lambda v: statistics(name, k, v))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans, and each opaque token with its test results; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.filter(spans(F.col("text"), ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["m"], "^" + ASSIGN + "$", 2)) >= ASSIGN_LEAST).alias("_assign"),
        F.filter(spans(F.col("text"), ACCESS, 1), lambda s: F.length(s["m"]) >= ACCESS_LEAST).alias("_access"),
        spans(F.col("text"), HEX, 2).alias("_hex"), spans(F.col("text"), OPAQUE, 3).alias("_opaque"),
    )
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    tested = F.transform("_opaque", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["m"]).alias("b")))
    return base.select("doc_id", *[bare(F.col(c)).alias(c) for c in ("_assign", "_access", "_hex")], tested.alias("_opaque"))


def level(tokens: DataFrame, q: float = LEVEL) -> float:
    """Benjamini-Hochberg over the column `score` (-log10 p): the least score to keep. A histogram of BINS bins is all that travels."""
    held = tokens.groupBy(F.least(F.floor(F.col("score") / STEP), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    counts = {r["bin"]: r["n"] for r in held}
    total, passed, least = sum(counts.values()), 0, float("inf")
    for b in range(BINS - 1, -1, -1):
        passed += counts.get(b, 0)
        if passed and 10 ** (-b * STEP) * total / passed <= q:
            least = b * STEP
    return least


def secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id and `found`, sorted spans array<struct<start, kind, end>> (kind: place in KINDS)."""
    held = written(scanned(docs))
    tokens = held.select(F.explode("_opaque").alias("t")).select("t.b.*").where("encoding <> 'none'")
    least = level(tokens)
    good = lambda t: (t["b"]["score"] >= least) & (t["b"]["p_random"] >= RANDOM_P)
    added = F.transform(F.filter("_opaque", good), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return held.select("doc_id", F.sort_array(F.concat("_assign", "_access", "_hex")).alias("base"), F.sort_array(F.concat("_assign", "_access", "_hex", added)).alias("found"))


def rendered(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    out = secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.col("found")).alias("spans"),
    )
