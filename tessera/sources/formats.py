"""Text formats of translation resources, read and rendered with built-in functions where a file is a table of lines or of JSON."""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import unsafe_path

#: The head line and the entry line of the keyed-line format, and the stages of the entry-list format.
HEAD = r"^\s*l_([a-z_]+)\s*:\s*$"
ENTRY = r'^(\s*)([A-Za-z_][A-Za-z0-9_.\-]*)\s*:\s*(\d*)[ \t]+"((?:[^"\\]++|\\.)*+)"(.*)$'
STAGES = (0, 1, 2, 3, 5, 9, -1)


# ---- keyed lines: a head `l_<language>:`, then `key:version "value" trailer`


def key_lines(texts: DataFrame) -> DataFrame:
    """relative_path, language, line, key, version, indent, value, trailer, raw, error; blank lines and comments are left out."""
    each = texts.select("relative_path", F.regexp_extract(F.regexp_extract("text", r"^[^\r\n]*", 0), HEAD, 1).alias("language"), F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("_at", "raw"))
    each = each.where(~((F.col("_at") == 0) & F.col("raw").rlike(HEAD)) & ~F.col("raw").rlike(r"(?U)^\s*(#|$)"))
    ok = F.col("raw").rlike(ENTRY)
    group = lambda i: F.when(ok, F.regexp_extract("raw", ENTRY, i))
    return each.select(
        "relative_path", "language", (F.col("_at") + 1).alias("line"), group(2).alias("key"), group(3).alias("version"), group(1).alias("indent"),
        F.replace(group(4), F.lit('\\"'), F.lit('"')).alias("value"), group(5).alias("trailer"), "raw", F.when(~ok, "unparsable").alias("error"),
    )


def target_path(path: Column, source: str, target: str) -> Column:
    """Folder segments named `source` become `target`, and `l_source` in the file name `l_target`."""
    parts = F.transform(F.split(path, "/"), lambda p: F.when(p == source, F.lit(target)).otherwise(p))
    name = F.replace(F.element_at(parts, -1), F.lit(f"l_{source}"), F.lit(f"l_{target}"))
    return F.concat_ws("/", F.slice(parts, F.lit(1), F.size(parts) - 1), name)


def _once(rows: DataFrame) -> DataFrame:
    """Fail on a key that a file holds twice."""
    n = F.count("*").over(Window.partitionBy("relative_path", "key"))
    what = F.concat(F.lit("duplicate key "), F.col("key"), F.lit(" in "), F.col("relative_path"))
    return rows.withColumn("_n", n).withColumn("key", F.when(F.col("_n") > 1, F.raise_error(what)).otherwise(F.col("key"))).drop("_n")


def key_line_units(lines: DataFrame, source: str, target: str) -> DataFrame:
    """relative_path, logical_key, source_text, translation (from the target file of the same name; else null), version, indent, trailer."""
    own = _once(lines.where((F.col("language") == source) & F.col("error").isNull())).withColumn("_to", target_path(F.col("relative_path"), source, target))
    newest = F.max_by("value", "line").alias("translation")
    side = lines.where("error is null").where(F.trim("value") != "").groupBy(F.col("relative_path").alias("_to"), "key").agg(newest)
    found = own.join(side, ["_to", "key"], "left")
    return found.select("relative_path", F.col("key").alias("logical_key"), F.col("value").alias("source_text"), F.when(F.col("_to") != F.col("relative_path"), F.col("translation")).alias("translation"), "version", "indent", "trailer")


def render_key_lines(lines: DataFrame, units: DataFrame, source: str, target: str) -> DataFrame:
    """(relative_path, content): the source's files with the units' translations, malformed lines as they are, with a byte order mark."""
    said = units.select("relative_path", F.col("logical_key").alias("key"), "translation")
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("translation", "value"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = F.when(F.col("error").isNotNull(), F.col("raw")).otherwise(F.concat("indent", "key", F.lit(":"), "version", F.lit(" "), quoted, "trailer"))
    rows = lines.where(F.col("language") == source).join(said, ["relative_path", "key"], "left").select("relative_path", "line", line.alias("_text"))
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line", "_text"))), lambda x: x["_text"]))
    files = rows.groupBy("relative_path").agg(F.concat(F.lit(f"﻿l_{target}:\n"), body, F.lit("\n")).alias("text"))
    return files.select(target_path(F.col("relative_path"), source, target).alias("relative_path"), F.encode("text", "UTF-8").alias("content"))


# ---- entry lists: a JSON array of objects with a key, a text, a translation and a stage


def entry_list(texts: DataFrame, key: str = "key", source: str = "original", translation: str = "translation", context: str = "context", stage: str = "stage", id: str = "id") -> DataFrame:
    """relative_path, index, logical_key, source_text, translation, context, stage, entry_id; another shape is an error."""
    listed = F.when(F.trim("text").startswith("["), F.from_json("text", "array<map<string,string>>", {"mode": "FAILFAST"}))
    listed = F.coalesce(listed, F.raise_error(F.concat(F.lit("not a list of entries: "), F.col("relative_path"))).cast("array<map<string,string>>"))
    each = texts.select("relative_path", F.posexplode(listed).alias("index", "_e"))
    item = lambda name: F.col("_e").getItem(name)
    need = lambda name: F.when(F.coalesce(F.map_contains_key("_e", name), F.lit(False)), item(name)).otherwise(F.raise_error(F.concat(F.lit(f"no field {name} in "), F.col("relative_path"))))
    at = F.coalesce(item(stage), F.lit("0"))
    known = F.when(at.isin(*map(str, STAGES)), at).otherwise(F.raise_error(F.concat(F.lit("unsupported stage in "), F.col("relative_path")))).cast("int")
    return each.select(
        "relative_path", "index", need(key).alias("logical_key"), need(source).alias("source_text"), F.coalesce(item(translation), F.lit("")).alias("translation"),
        item(context).alias("context"), known.alias("stage"), item(id).alias("entry_id"),
    )


def _filled(batches: Iterator[pd.DataFrame], key: str, translation: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, said in zip(batch["text"], batch["said"], strict=True):
            items, by_key = json.loads(text), {r["logical_key"]: r["translation"] for r in said} if said is not None else {}
            for item in items:
                if by_key.get(str(item[key])) is not None:
                    item[translation] = by_key[str(item[key])]
            out.append((json.dumps(items, ensure_ascii=False, indent=2) + "\n").encode())
        yield pd.DataFrame({"relative_path": batch["relative_path"], "content": out})


def render_entry_list(texts: DataFrame, units: DataFrame, key: str = "key", translation: str = "translation") -> DataFrame:
    """(relative_path, content): the files with the units' translations; other fields stay as they are."""
    said = units.where("translation is not null").groupBy("relative_path").agg(F.collect_list(F.struct("logical_key", "translation")).alias("said"))
    return texts.select("relative_path", "text").join(said, "relative_path", "left").mapInPandas(lambda b: _filled(b, key, translation), "relative_path string, content binary")


# ---- nested history: {file: {key: {source, translation}}}


def history(texts: DataFrame, source: str = "ru", translation: str = "zh") -> DataFrame:
    """logical_file (slashes forward), logical_key, source_text, translation; nodes of another shape are skipped."""
    found = texts.sparkSession.sql(
        """SELECT replace(f.key, '\\\\', '/') AS logical_file, e.key AS logical_key, e.value AS v FROM {t} t,
           LATERAL variant_explode(parse_json(t.text)) f, LATERAL variant_explode(f.value) e WHERE f.key IS NOT NULL AND e.key IS NOT NULL""",
        t=texts,
    )
    part = lambda name: F.try_variant_get("v", f"$['{name}']", "variant")
    both = (F.schema_of_variant(part(source)) == "STRING") & (F.schema_of_variant(part(translation)) == "STRING")
    return found.where(both).select("logical_file", "logical_key", F.try_variant_get("v", f"$['{source}']", "string").alias("source_text"), F.try_variant_get("v", f"$['{translation}']", "string").alias("translation"))


# ---- seeds: {schema_version, defaults, entries}

SEED_FIELDS = ("adapter_id", "relative_path", "logical_key", "source_text", "translation", "context")
SEED_DEFAULTS = ("adapter_id", "relative_path")


def seed(texts: DataFrame, adapters: Collection[str]) -> DataFrame:
    """relative_path (of the entry), index, SEED_FIELDS, error: why an entry, or its file, is refused; null for a good one."""
    doc = texts.select(F.col("relative_path").alias("seed_file"), F.parse_json("text").alias("d"))
    each = texts.sparkSession.sql("SELECT seed_file, d, e.pos AS index, e.value AS v FROM {d} d, LATERAL variant_explode_outer(try_variant_get(d.d, '$.entries', 'variant')) e", d=doc)
    keys = lambda v: F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))
    top, base = F.col("d"), F.try_variant_get("d", "$.defaults", "variant")

    def field(name: str) -> Column:
        own = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.array_contains(keys(F.col("v")), name), own).otherwise(F.try_variant_get(base, f"$.{name}", "variant") if name in SEED_DEFAULTS else own)

    read = each.select("seed_file", "index", "d", "v", *[F.struct(F.schema_of_variant(field(n)).alias("kind"), F.try_variant_get(field(n), "$", "string").alias("text")).alias(n) for n in SEED_FIELDS])
    blank = lambda n: (F.coalesce(F.col(f"{n}.kind"), F.lit("VOID")) != "STRING") | (F.trim(f"{n}.text") == "")
    unknown = lambda v, allowed: F.size(F.array_except(keys(v), F.array(*map(F.lit, allowed)))) > 0
    error = F.when(unknown(top, ("schema_version", "defaults", "entries")), "unknown field of the file")
    error = error.when(~F.coalesce(F.try_variant_get("d", "$.schema_version", "int") == 1, F.lit(False)), "schema version is not 1")
    error = error.when(unknown(base, SEED_DEFAULTS), "unknown field of the defaults").when(F.col("v").isNull(), "no entries").when(unknown(F.col("v"), SEED_FIELDS), "unknown field of the entry")
    for name in ("adapter_id", "logical_key", "source_text"):
        error = error.when(blank(name), f"{name} is missing")
    error = error.when(F.coalesce(F.col("translation.kind"), F.lit("VOID")) != "STRING", "translation is not a string")
    error = error.when(~F.coalesce(F.col("context.kind"), F.lit("VOID")).isin("STRING", "VOID"), "context is not a string")
    error = error.when(~F.col("adapter_id.text").isin(*adapters), "adapter is not configured").when(unsafe_path(F.replace("relative_path.text", F.lit("\\"), F.lit("/"))), "unsafe path")
    path = F.replace("relative_path.text", F.lit("\\"), F.lit("/"))
    return read.select("seed_file", "index", *[(path if n == "relative_path" else F.col(f"{n}.text")).alias(n) for n in SEED_FIELDS], error.alias("error"))
