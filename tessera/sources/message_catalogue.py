"""Message catalogues, as text (.po) and compiled (.mo): parsed a file at a time in Arrow batches, units made of columns."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between context and msgid, and between the forms of a compiled message.
CONTEXT, FORM = "\u0004", "\u0000"
_SAID = re.compile(r'(msgctxt|msgid_plural|msgid|msgstr)(?:\[(\d+)\])?\s*"(.*)"$')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
ROWS = "relative_path string, entry_index int, context string, msgid string, msgid_plural string, plural_index int, msgstr string, comment string, flags array<string>"


class Message(dict):
    """ctx, id, plural: text or None; str: form number (None without forms) -> text; notes: comment lines; obsolete."""

    def __init__(self) -> None:
        super().__init__(ctx=None, id=None, plural=None, str={}, notes=[], obsolete=False)

    @property
    def flags(self) -> list[str]:
        return [f.strip() for n in self["notes"] if n.startswith("#,") for f in n[2:].split(",") if f.strip()]

    @property
    def comment(self) -> str:
        return "\n".join(n[2:].strip() for n in self["notes"] if n.startswith("#."))


def _open(quoted: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), quoted)


def _quote(text: str) -> str:
    for plain, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = text.replace(plain, name)
    return f'"{text}"'


def parse_po(text: str) -> list[Message]:
    """Messages in order, the obsolete ones too."""
    out: list[Message] = []
    now, slot = Message(), None
    for number, raw in enumerate(text.removeprefix("﻿").split("\n"), 1):
        line = raw.strip()
        gone = line.startswith("#~")
        line = line[2:].strip() if gone else line
        starts = line.startswith("#") or line.startswith("msgctxt") or (line.startswith("msgid") and not line.startswith("msgid_plural") and now["id"] is not None)
        if now["str"] and (not line or starts):
            out.append(now)
            now, slot = Message(), None
        if not line:
            continue
        if line.startswith("#"):
            now["notes"].append(line)
            continue
        now["obsolete"] |= gone
        if m := _SAID.match(line):
            kind, form = m[1], m[2] and int(m[2])
            slot = ("str", form) if kind == "msgstr" else ({"msgctxt": "ctx", "msgid": "id", "msgid_plural": "plural"}[kind],)
            value = ""
            tail = m[3]
        elif line.startswith('"') and line.endswith('"') and len(line) > 1 and slot:
            value, tail = now["str"][slot[1]] if slot[0] == "str" else now[slot[0]], line[1:-1]
        else:
            raise ValueError(f"line {number} is not part of a message: {raw!r}")
        value += _open(tail)
        if slot[0] == "str":
            now["str"][slot[1]] = value
        else:
            now[slot[0]] = value
    if now["str"]:
        out.append(now)
    return out


def format_po(messages: list[Message]) -> str:
    blocks = []
    for m in messages:
        lines = [f"{name} {_quote(m[slot])}" for name, slot in (("msgctxt", "ctx"), ("msgid", "id"), ("msgid_plural", "plural")) if m[slot] is not None]
        lines += [f"msgstr{'' if i is None else f'[{i}]'} {_quote(s)}" for i, s in m["str"].items()]
        blocks.append("\n".join([*m["notes"], *(["#~ " + x for x in lines] if m["obsolete"] else lines)]))
    return "\n\n".join(blocks) + "\n"


def parse_mo(data: bytes) -> list[Message]:
    order = {b"\xde\x12\x04\x95": "<", b"\x95\x04\x12\xde": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a compiled catalogue")
    count, ids, strs = struct.unpack_from(f"{order}3I", data, 8)

    def text(base: int, i: int) -> str:
        length, at = struct.unpack_from(f"{order}2I", data, base + 8 * i)
        return data[at : at + length].decode("utf-8")

    out = []
    for i in range(count):
        m, (name, said) = Message(), (text(ids, i), text(strs, i))
        if CONTEXT in name:
            m["ctx"], name = name.split(CONTEXT, 1)
        if FORM in name:
            name, m["plural"] = name.split(FORM, 1)
        m["id"] = name
        m["str"] = {None: said} if m["plural"] is None else dict(enumerate(said.split(FORM)))
        out.append(m)
    return out


def format_mo(messages: list[Message]) -> bytes:
    pairs = []
    for m in messages:
        if m["obsolete"] or not any(m["str"].values()):
            continue
        name = (m["ctx"] + CONTEXT if m["ctx"] else "") + m["id"] + (FORM + m["plural"] if m["plural"] is not None else "")
        pairs.append((name.encode(), FORM.join(s for _, s in sorted(m["str"].items(), key=lambda x: x[0] or 0)).encode()))
    pairs.sort()
    at, tables, body = 28 + 16 * len(pairs), [], b""
    for side in (0, 1):
        for pair in pairs:
            tables.append(struct.pack("<2I", len(pair[side]), at + len(body)))
            body += pair[side] + b"\0"
    return struct.pack("<7I", 0x950412DE, 0, len(pairs), 28, 28 + 8 * len(pairs), 0, 0) + b"".join(tables) + body


def parse(path: str, data: bytes) -> list[Message]:
    return parse_mo(data) if path.lower().endswith(".mo") else parse_po(data.decode("utf-8"))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ROWS.split(", ")]
    for batch in batches:
        for path, data in zip(batch["relative_path"], batch["content"], strict=True):
            out = []
            for i, m in enumerate(parse(path, data)):
                if m["obsolete"] or not m["id"]:
                    continue
                forms = m["str"] if m["plural"] is None else {k: m["str"][k] for k in sorted(k for k in m["str"] if k is not None)} or {0: "", 1: ""}
                out += [(path, i, m["ctx"], m["id"], m["plural"], k, s, m.comment, m.flags) for k, s in forms.items()]
            made = pd.DataFrame(out, columns=names)
            yield made.astype({"plural_index": "Int32", "entry_index": "int32"})


def messages(files: DataFrame) -> DataFrame:
    """ROWS of a table of contents: one row a message, or one a plural form; neither the head nor obsolete ones."""
    return files.select("relative_path", "content").mapInPandas(_rows, ROWS)


def logical_key(context: Column, msgid: Column, plural: Column) -> Column:
    base = F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit(CONTEXT), msgid)).otherwise(msgid)
    return F.concat(base, F.coalesce(F.concat(F.lit("[plural="), plural.cast("string"), F.lit("]")), F.lit("")))


def units(rows: DataFrame, keyed: bool = False, refuse_empty: bool = False, selected: Column | None = None) -> DataFrame:
    """relative_path, logical_key, source_text, translation, context, plural_index, entry_index, comment, flags.

    `keyed`: msgid is a key and msgstr the source. Empty sources are left out, or an error; `selected` is a condition on source_text.
    """
    source = F.col("msgstr") if keyed else F.when(F.coalesce("plural_index", F.lit(0)) == 0, F.col("msgid")).otherwise(F.col("msgid_plural"))
    key = logical_key(F.col("context"), F.col("msgid"), F.col("plural_index"))
    out = rows.select("relative_path", key.alias("logical_key"), source.alias("source_text"), (F.lit("") if keyed else F.col("msgstr")).alias("translation"), "context", "plural_index", "entry_index", "comment", "flags")
    empty = F.col("source_text").rlike(r"(?U)^\s*$")
    if refuse_empty:
        out = out.withColumn("source_text", F.when(empty, F.raise_error(F.concat(F.lit("empty source at "), F.col("relative_path"), F.lit(":"), F.col("logical_key")))).otherwise(F.col("source_text")))
    else:
        out = out.where(~empty)
    return out if selected is None else out.where(selected)


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, data, said in zip(batch["relative_path"], batch["content"], batch["said"], strict=True):
            by_key = {r["logical_key"]: r["translation"] for r in said} if said is not None else {}
            found = parse(path, data)
            for m in found:
                if m["obsolete"] or not m["id"]:
                    continue
                base = m["ctx"] + CONTEXT + m["id"] if m["ctx"] else m["id"]
                m["str"] = {i: by_key.get(base if m["plural"] is None else f"{base}[plural={i}]", s) for i, s in m["str"].items()}
            out.append(format_mo(found) if path.lower().endswith(".mo") else format_po(found).encode())
        yield pd.DataFrame({"relative_path": batch["relative_path"], "content": out})


def render(files: DataFrame, units: DataFrame) -> DataFrame:
    """(relative_path, content): the catalogues with the units' translations; a null one leaves the message as it is."""
    said = units.where("translation is not null").groupBy("relative_path").agg(F.collect_list(F.struct("logical_key", "translation")).alias("said"))
    return files.select("relative_path", "content").join(said, "relative_path", "left").mapInPandas(_rendered, "relative_path string, content binary")
