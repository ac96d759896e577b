import random

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import batches as bt
from tessera.operators import review


def test_budgets_keep_margins():
    assert bt.budgets(32_000, 4_096) == (32_000 - 4_096 - 320, 4_096 - 204)
    assert bt.budgets(100, 40) == (60 - 15, 32)


def greedy(costs, overhead, most_in, most_out):
    """Longest prefix by trying all of them."""
    out, at, number = [], 0, 0
    while at < len(costs):
        n = 1
        for size in range(1, min(256, len(costs) - at) + 1):
            part = costs[at : at + size]
            if overhead + sum(a for a, _ in part) <= most_in and -(-6 * sum(b for _, b in part) // 5) <= most_out:
                n = size
        out += [number] * n
        at, number = at + n, number + 1
    return out


def test_packing_takes_the_longest_prefix(spark):
    rng = random.Random(5)
    paths = {p: [(rng.choice([0, 3, 9, 400]), rng.choice([0, 2, 30])) for _ in range(n)] for p, n in (("a", 700), ("b", 1), ("c", 90))} | {"z": [(0, 0)] * 600}
    rows = [(p, i, a, b) for p, costs in paths.items() for i, (a, b) in enumerate(costs)]
    got = bt.pack(spark.createDataFrame(rows, "relative_path string, ordinal long, input_tokens long, output_tokens long").repartition(5), 10, 300, 100).collect()
    assert len(got) == len(rows)
    for p, costs in paths.items():
        mine = [r.batch for r in sorted((r for r in got if r.relative_path == p), key=lambda r: r.ordinal)]
        assert mine == greedy(costs, 10, 300, 100)
    assert {r.over for r in got if dict(enumerate(paths[r.relative_path]))[r.ordinal][0] == 400} == {True}


def test_answers_are_read_or_refused(spark):
    cases = [
        ("[1] a\n[2]  b\nc\n---END---", 2, "stop", None, ["a", "b\nc"]), ("[1] a", 1, "stop", "no end mark", None), ("[1] a\n---END---", 1, "length", "truncated", None),
        ("a\n---END---", 1, None, "no items", None), ("[2] a\n---END---", 1, None, "wrong numbering", None), ("[1] a\n---END---", 2, None, "wrong numbering", None),
        ("[1] \n[2] b---END---", 2, None, "empty item", None), ("[01] a [2] b\n---END--- [2] z", 1, None, None, ["a [2] b"]), (None, 1, None, "no end mark", None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, n int, f string")
    got = df.select("i", bt.parse_answer(F.col("t"), F.col("n"), F.col("f")).alias("r")).orderBy("i").collect()
    assert [(r.r.error, r.r.translations) for r in got] == [c[3:] for c in cases]


def test_masks_come_back(spark):
    texts = ["", "%s", "a {x} b {x}%(n)s", "no", "<b>t</b>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", tx.mask(F.col("t"), F.lit("ns")))
    rows = df.withColumn("back", tx.restore(F.col("m.masked"), F.col("m.tokens"))).collect()
    assert [r.back for r in rows] == texts and [len(r.m.tokens) for r in rows] == [0, 1, 3, 0, 2]
    assert rows[2].m.masked.startswith("a [PH_") and rows[2].m.masked.endswith("_2]")


def test_forms_and_differences(spark):
    df = spark.createDataFrame([("\uff21\u00a0 \u0401ж\t", "\u3002ok! "), (None, None)], "a string, b string")
    rows = df.select(tx.source_form("a").alias("s"), tx.variant_form(F.col("b")).alias("v"), tx.diff(F.lit("abc"), F.lit("axc")).alias("d"), tx.diff("a", "a").alias("e")).collect()
    assert (rows[0].s, rows[0].v, rows[1].s, rows[1].v) == ("a еж", "ok", "", None)
    assert [tuple(o) for o in rows[0].d] == [("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c")]


def test_verdicts_count_what_a_blank_text_hides(spark):
    units = spark.createDataFrame([("i", "a %s", "")], "stable_identity string, source_text string, translation string")
    edits = spark.createDataFrame([("i", "b"), ("none", "b")], "stable_identity string, text string")
    got = {r.stable_identity: r for r in review.verdicts(units, edits).collect()}
    assert (got["i"].fixed, got["i"].remaining, got["i"].introduced) == (["empty_translation"], ["placeholder_mismatch"], [])
    assert not got["none"].known
