import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import events, memory, merge, review
from tessera.streaming.ledger import append, stream_ledger


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_globs_cross_slashes_and_may_start_anywhere(spark):
    for path, glob, want in (("a/b/c.po", "a/*.po", True), ("c.po", "**/*.po", True), ("a.PO", "*.po", False), ("ab", "a[!x]", True), ("a+b", "a+b", True)):
        assert one(spark, F.col("p").rlike(tx.glob_pattern(glob)), p=path) is want


def test_words_and_blanks_are_unicode(spark):
    assert one(spark, tx.blank(F.col("t")), t="  　") is True
    assert one(spark, F.col("t").rlike(tx.unicode(r"(?<!\w)Серебро")), t="аСеребро") is False


def test_tags(spark):
    for text, want in (("<b>x</b>", True), ("<b><i></b></i>", False), ("<br/>x<br>", True), ("</p>", False), ("no tags", True), ("<p>", False)):
        assert one(spark, tx.tags_balanced(F.col("t")), t=text) is want


def test_codes_are_suppressed_by_a_blank_text(spark):
    rows = spark.createDataFrame([(1, "Всего %(count)s", "总共"), (2, "x", " "), (3, "Rearmament", "Rearmament"), (4, "Нуль", "a\x00"), (5, "Токен", "[PH_a1b2c3d4_0] x")], "k int, source_text string, translation string")
    got = {r["k"]: r["c"] for r in rows.select("k", review.codes().alias("c")).collect()}
    assert got == {1: ["placeholder_mismatch"], 2: ["empty_translation"], 3: ["untranslated"], 4: ["invalid_control_character"], 5: ["placeholder_variant_residue"]}


def test_merge_keeps_a_local_text_that_remote_would_clear(spark):
    item = "key string, original string, translation string, stage int, origin string"
    base = spark.createDataFrame([("a", "o", "x", 0, "machine")], item)
    local = spark.createDataFrame([("a", "o", "x", 0, "machine"), ("n", "o", "mine", 3, "human")], item)
    remote = spark.createDataFrame([("a", "o2", " ", 3, "human"), ("r", "o", "theirs", 5, "human")], item)
    got = {r["key"]: r for r in merge.merge(base, local, remote).collect()}
    assert (got["a"]["translation"], got["a"]["conflicts"]) == ("x", ["source_changed", "remote_empty_would_clear_local"])
    assert (got["n"]["stage"], got["n"]["origin"], got["n"]["upload"]) == (1, "machine", True)
    assert got["r"]["translation"] == "theirs"


def test_guards_of_upsert(spark):
    row = "stable_identity string, translation string, is_formal boolean, human_authored boolean, origin string"
    old = spark.createDataFrame([("f", "x", True, False, "machine"), ("h", "x", False, True, "human"), ("p", "x", False, False, "machine")], row)
    new = spark.createDataFrame([("f", "y", False, False, "machine"), ("h", "y", True, False, "machine"), ("p", "y", False, False, "machine"), ("n", "y", False, False, "machine")], row)
    assert {r[0]: r["outcome"] for r in memory.upsert(old, new).collect()} == {"f": "rejected", "h": "rejected", "p": "updated", "n": "inserted"}


def test_lineage_has_every_ancestor(spark):
    edges = spark.createDataFrame([(i, i // 2) for i in range(2, 40)], "id long, parent long")
    got = {(r["id"], r["ancestor"], r["depth"]) for r in events.lineage(edges).collect()}
    want = {(i, i >> d, d) for i in range(2, 40) for d in range(1, 7) if i >> d}
    assert got == want


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    log = spark.createDataFrame([(1, "t", "commit", "x"), (2, "t", "skip", None), (3, "u", "draft", None)], "seq long, target string, action string, text string")
    append(log, str(tmp_path / "log"))
    query = stream_ledger(spark, str(tmp_path / "log")).writeStream.outputMode("complete").format("memory").queryName("ledger_twin").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("ledger_twin").collect())) == sorted(map(tuple, events.ledger(log).collect()))


def test_terms_of_many_words_modes_variants_and_scopes(spark):
    made = "source string, target string, match_mode string, variants array<string>, scope string, exclude_scope array<string>, status string"
    terms = spark.createDataFrame([
        ("battle pass", "BP", "word", None, None, None, "reviewed"), ("KV-1", "KV", None, ["KV 1", "Klim"], None, None, "reviewed"), ("C++", "CPP", "word", [], None, None, "reviewed"),
        ("gold", "AU", "substring", None, None, None, "reviewed"), ("Yes", "Y", "exact", None, None, None, "reviewed"), ("silver", "AG", "word", None, "shop/*.po", ["*/rank[!x].po"], "reviewed"),
        ("tank", "TK", "word", None, None, None, "candidate"), ("%", "PCT", "word", None, None, None, "reviewed"),
    ], made)
    units = spark.createDataFrame([
        (1, "Get the battle pass!", "x", "a"), (2, "battle bypass, pass battle", "x", "a"), (3, "a KV-1 or KV 1, Klim", "x", "a"), (4, "KV-12", "x", "a"), (5, "in C++ now", None, "a"),
        (6, "marigolds", "x", "a"), (7, "Yes", "x", "a"), (8, "Yes sir", "x", "a"), (9, "silver", "x", "shop/a.po"), (10, "silver", "x", "shop/rank1.po"), (11, "silver", "x", "b/a.po"),
        (12, "tank", "x", "a"), (13, "battle pass", "the BP", "a"), (14, "5 % off", "x", "a"), (15, "silver", "x", "shop/rankx.po"), (16, None, "x", "a"),
    ], "k long, source_text string, translation string, relative_path string")
    got = sorted((r["k"], r["term"]) for r in review.term_violations(units, terms).collect())
    assert got == [(1, "battle pass"), (3, "KV-1"), (5, "C++"), (6, "gold"), (7, "Yes"), (9, "silver"), (14, "%"), (15, "silver")]


def test_placeholders_of_every_general_form(spark):
    text = "%(n).2f %(who)s %5.1f %i %% {name.x[0]} {12} <b class='x'> </b> a\r\nb\nc {not this} {9a}"
    got = one(spark, tx.placeholders(F.col("t")), t=text)
    assert got == ["%(n).2f", "%(who)s", "%5.1f", "%i", "%%", "{name.x[0]}", "{12}", "<b class='x'>", "</b>", "\r\n", "\n"]
    rows = spark.createDataFrame([(1, "a\nb", "ab"), (2, "%(name)s", "%(name)s"), (3, "x", "【PH_a1b2c3d4_0】 y"), (4, None, None), (5, None, "y"), (6, "12 %", "12 %")], "k int, source_text string, translation string")
    assert {r["k"]: r["c"] for r in rows.select("k", review.codes().alias("c")).collect()} == {1: ["placeholder_mismatch"], 2: [], 3: ["placeholder_variant_residue"], 4: ["empty_translation"], 5: [], 6: ["untranslated"]}
    assert one(spark, tx.unmasked(F.col("t")), t="[PH_a1b2c3d4_0] [Root.GetName] $VAR$ {{x}} §Y %1$s") == ["[Root.GetName]", "$VAR$", "{{x}}", "§Y", "%1$s"]
    assert one(spark, tx.multiset_except(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.col("t"))), t="a") == ["a", "b"]


def test_runs_and_normal_forms(spark):
    assert one(spark, tx.runs(F.col("t"), "[A-Za-z]+", 2), t="装Rearmament Program, now还有Panzer。a-b") == ["Rearmament Program now", "a b"]
    assert one(spark, tx.runs(F.col("t"), "[A-Za-z]+", 1), t="") == []
    form = lambda t, *rules: tuple(one(spark, tx.normalized(F.col("t"), rules), t=t))
    assert form("a  b   c", ("  ", " ")) == ("a b c", True)
    assert form("ab", ("a", "b"), ("b", "a")) == ("aa", True) and form("ab", ("^a", "c"), ("^c", "d"), ("^d", "a")) == ("ab", True)
    assert form("x", ("x", "xx")) == ("x", False) and form("ab", ("^ab$", "ba#"), ("^ba$", "ab"), ("#$", "")) == ("ab", False)


def test_the_ledger_knows_every_action_and_ties(spark):
    log = spark.createDataFrame([(1, "a", "unify", "x"), (1, "b", "accept_debt", None), (1, "c", "commit", "x"), (2, "c", "revert", None), (1, "d", "retire", None), (3, "e", "skip", "p"), (3, "e", "commit", "q")], "seq long, target string, action string, text string")
    got = {r["target"]: (r["state"], r["text"]) for r in events.ledger(log).collect()}
    assert got == {"a": ("committed", "x"), "b": ("committed", None), "c": ("reverted", "x"), "d": ("pending", None), "e": ("skipped", "p")}


def test_terms_go_by_their_very_characters(spark):
    units = spark.createDataFrame([(1, "an Iron Ring", "x"), (2, "an iron ring", "x")], "k long, source_text string, translation string")
    terms = spark.createDataFrame([("iron ring", "IR")], "source string, target string")
    assert [r["k"] for r in review.term_violations(units, terms).collect()] == [2]


def test_legacy_rows_of_suspect_class_aliases_and_judgement(spark):
    row = "stable_identity string, project_id string, adapter_id string, relative_path string, logical_key string, source_text string, source_fingerprint string, translation string"
    tm = spark.createDataFrame([
        ("x1", "p", "a", "f.po", "old", "src %s", "h", "alt %s", "legacy", "legacy_suspect", "unreviewed", 2), ("x2", "p", "a", "d/f.po", "key", "src %s", "h", "quar %s", "legacy", "legacy_clean", "quarantined", 1),
        ("x3", "p", "a", "f.po", "gone", "src %s", "h", "lost", "legacy", "legacy_clean", "unreviewed", 1),
    ], row + ", origin string, classification string, review_state string, updated_at int")
    tm = tm.withColumn("quality_state", F.lit("passed")).withColumn("is_formal", F.lit(False))
    units = spark.createDataFrame([("u1", "p", "a", "d/f.po", "key", "src %s", "h", "", ["old"]), ("u2", "p", "a", "f.po", "gone", "src %s", "h", "", None)], row + ", aliases array<string>")
    assert {r[0]: (r[1], r[2]) for r in memory.ranked(units, tm).collect()} == {"u1": ("alt %s", 1), "u2": ("lost", 0)}
    got = {r["stable_identity"]: (r["decision"], r["resolved"]) for r in memory.resolve(units, tm).collect()}
    assert got == {"u1": ("legacy_coordinate", "alt %s"), "u2": ("pending", None)}  # a text without its placeholder is passed over


def test_repeated_keys_and_empty_tables_have_a_result(spark):
    row = "stable_identity string, translation string, is_formal boolean, human_authored boolean, origin string"
    old = spark.createDataFrame([("a", "x", False, False, "machine")], row)
    new = spark.createDataFrame([("a", "y", False, False, "machine"), ("a", "z", False, False, "machine")], row)
    assert [(r["translation"], r["outcome"]) for r in memory.upsert(old, new).collect()] == [("z", "updated")]
    assert memory.upsert(old.where("false"), new.where("false")).count() == 0
    item = "key string, original string, translation string, stage int, origin string"
    side = spark.createDataFrame([("a", "o", "x", 0, "machine"), ("a", "o", "y", 0, "machine")], item)
    assert merge.merge(side.where("false"), side, side.where("false")).count() == 1
    with pytest.raises(Exception, match="a resolution names a side without the key a"):
        merge.merge(side, side, side.where("false"), spark.createDataFrame([("a", "remote")], "key string, side string")).collect()
    assert events.ledger(spark.createDataFrame([], "seq long, target string, action string, text string")).count() == 0
    assert events.lineage(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), 4).count() == 8


def test_only_reviewed_rows_are_taken_back(spark):
    row = "stable_identity string, translation string, origin string"
    tm = spark.createDataFrame([("a", "x", "human"), ("b", "y", "machine")], row)
    image = lambda *rows: spark.createDataFrame(list(rows), row + ", present boolean")
    assert sorted(map(tuple, memory.restore(tm, image(("a", "was", "legacy", True))).collect())) == [("a", "was", "legacy"), ("b", "y", "machine")]
    assert sorted(map(tuple, memory.restore(tm, image(("a", None, None, False))).collect())) == [("b", "y", "machine")]
    with pytest.raises(Exception, match="not written by a reviewer: b"):
        memory.restore(tm, image(("b", "was", "machine", True))).collect()
