import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, formats
from tessera.sources import message_catalogue as mc

PO = '''msgid ""
msgstr "Language: de\\n"

#. said to guests
#, fuzzy, c-format
msgctxt "door"
msgid "open \\"it\\""
msgstr ""
"auf"
"machen\\n"

msgid "cat"
msgid_plural "cats"
msgstr[0] "Katze"
msgstr[1] "Katzen"

#~ msgid "old"
#~ msgstr "alt"
'''


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def texts(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "relative_path string, text string")


def test_scan_contents_inventory_and_verification(spark, tmp_path):
    put(tmp_path, "a b/x+1.po", "x")
    put(tmp_path, "a b/y.txt", "yy")
    got = {tuple(r) for r in files.scan(spark, str(tmp_path), ["**/*.po"]).collect()}
    assert got == {("a b/x+1.po", 1)}
    held = files.inventory(files.contents(spark, str(tmp_path)))
    assert {r.relative_path: r.size for r in held.collect()} == {"a b/x+1.po": 1, "a b/y.txt": 2}
    assert files.manifest_problems(held).count() == 0
    wrong = held.withColumn("sha256", F.when(F.col("size") == 1, F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256")))
    assert [tuple(r) for r in files.verify(wrong, files.contents(spark, str(tmp_path))).collect()] == [("a b/x+1.po", "changed")]
    bad = spark.createDataFrame([("../x", "0" * 64, 1), ("b", "0", 1), ("c", "0" * 64, 1), ("c", "0" * 64, 1)], "relative_path string, sha256 string, size long")
    assert {tuple(r) for r in files.manifest_problems(bad).collect()} == {("../x", "unsafe path"), ("b", "invalid descriptor"), ("c", "duplicate resource")}


def test_files_are_written_once_and_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("d/a.txt", bytearray(b"1")), ("b.txt", bytearray(b"2"))], "relative_path string, content binary")
    out = str(tmp_path / "out")
    assert files.write_files(rows, out) == 2 and files.write_files(rows, out) == 0
    assert (tmp_path / "out/d/a.txt").read_bytes() == b"1"
    other = rows.withColumn("content", F.lit(b"3"))
    with pytest.raises(ValueError, match="another file"):
        files.write_files(other, out)
    assert files.write_files(other, out, same="replace") == 2
    with pytest.raises(ValueError, match="unsafe or duplicate"):
        files.write_files(rows.withColumn("relative_path", F.lit("../x")), out)


def test_keyed_lines_read_backfill_and_render(spark, tmp_path):
    put(tmp_path, "english/a_l_english.yml", "﻿l_english:\n # note\n KEY:0 \"say \\\"hi\\\" # : x\" # end\nB: \"two\"\nbroken\n")
    put(tmp_path, "german/a_l_german.yml", "﻿l_german:\n KEY:0 \"hallo\"\n B:0 \" \"\n")
    lines = formats.key_lines(files.texts(spark, str(tmp_path)))
    units = formats.key_line_units(lines, "english", "german")
    assert {(r.logical_key, r.source_text, r.translation) for r in units.collect()} == {("KEY", 'say "hi" # : x', "hallo"), ("B", "two", None)}
    said = units.withColumn("translation", F.when(F.col("logical_key") == "B", 'zw"ei').otherwise(F.col("translation")))
    (path, content) = formats.render_key_lines(lines, said, "english", "german").first()
    assert path == "german/a_l_german.yml"
    assert content.decode() == '﻿l_german:\n KEY:0 "hallo" # end\nB: "zw\\"ei"\nbroken\n'
    twice = formats.key_lines(texts(spark, x='l_english:\n A:0 "1"\n A:0 "2"'))
    with pytest.raises(Exception, match="duplicate key"):
        formats.key_line_units(twice, "english", "german").collect()


def test_entry_lists_read_refuse_and_render(spark):
    raw = json.dumps([{"key": "k", "original": "o", "stage": 1, "id": 7, "more": [1]}, {"key": "l", "original": "p", "translation": "q"}])
    got = formats.entry_list(texts(spark, f=raw))
    assert [tuple(r) for r in got.orderBy("index").collect()] == [("f", 0, "k", "o", "", None, 1, "7"), ("f", 1, "l", "p", "q", None, 0, None)]
    done = formats.render_entry_list(texts(spark, f=raw), got.withColumn("translation", F.concat(F.lit("T"), "logical_key"))).first()
    assert json.loads(done.content) == [{"key": "k", "original": "o", "stage": 1, "id": 7, "more": [1], "translation": "Tk"}, {"key": "l", "original": "p", "translation": "Tl"}]
    for bad, why in (('{"key": 1}', "not a list"), ('[{"key": "k"}]', "no field original"), ('[{"key":"k","original":"o","stage":4}]', "unsupported stage")):
        with pytest.raises(Exception, match=why):
            formats.entry_list(texts(spark, f=bad)).collect()


def test_history_skips_malformed_nodes(spark):
    raw = {"d\\a.mo": {"k": {"ru": "r", "zh": "z"}, "n": {"ru": 1, "zh": "z"}, "m": "x"}, "b": [1], "c": {"e": {"ru": "r", "zh": ""}}}
    assert {tuple(r) for r in formats.history(texts(spark, f=json.dumps(raw))).collect()} == {("d/a.mo", "k", "r", "z"), ("c", "e", "r", "")}


def test_seeds_merge_defaults_and_name_what_they_refuse(spark):
    entry = {"logical_key": "k", "source_text": "s", "translation": ""}
    doc = {"schema_version": 1, "defaults": {"adapter_id": "po", "relative_path": "a\\b"}, "entries": [entry, {**entry, "adapter_id": "x"}, {**entry, "relative_path": "../a"}, {**entry, "odd": 1}, {**entry, "translation": 3}, {"source_text": "s", "translation": ""}]}
    got = formats.seed(texts(spark, f=json.dumps(doc)), ["po"]).orderBy("index").collect()
    assert [r.error for r in got] == [None, "adapter is not configured", "unsafe path", "unknown field of the entry", "translation is not a string", "logical_key is missing"]
    assert (got[0].adapter_id, got[0].relative_path) == ("po", "a/b")
    assert formats.seed(texts(spark, f='{"schema_version": 2, "entries": [{}]}'), ["po"]).first().error == "schema version is not 1"


def test_catalogues_read_and_render(spark):
    found = mc.parse_po(PO)
    assert found[1].flags == ["fuzzy", "c-format"] and mc.parse_po(mc.format_po(found)) == found
    compiled = mc.parse_mo(mc.format_mo(found))
    assert {(m["ctx"], m["id"], m["plural"], tuple(m["str"].values())) for m in compiled if m["id"]} == {("door", 'open "it"', None, ("aufmachen\n",)), (None, "cat", "cats", ("Katze", "Katzen"))}
    rows = spark.createDataFrame([("a.po", bytearray(PO.encode())), ("a.mo", bytearray(mc.format_mo(found)))], "relative_path string, content binary")
    units = mc.units(mc.messages(rows))
    for path in ("a.po", "a.mo"):
        assert {(r.logical_key, r.source_text, r.translation) for r in units.where(F.col("relative_path") == path).collect()} == {
            ('door\u0004open "it"', 'open "it"', "aufmachen\n"), ("cat[plural=0]", "cat", "Katze"), ("cat[plural=1]", "cats", "Katzen"),
        }
    assert {r.source_text for r in mc.units(mc.messages(rows), keyed=True).collect()} == {"aufmachen\n", "Katze", "Katzen"}
    done = mc.render(rows, units.withColumn("translation", F.upper("translation")))
    assert {r.translation for r in mc.units(mc.messages(done)).collect()} == {"AUFMACHEN\n", "KATZE", "KATZEN"}
    with pytest.raises(ValueError, match="line 2"):
        mc.parse_po('msgid "a"\nnonsense')
