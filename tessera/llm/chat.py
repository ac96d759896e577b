"""Chat formatting with typed content parts.

A visitor flattens the parts of a turn, in order: text is escaped, and each image, audio or document part becomes a numbered
placeholder, with its reference and the tokens it expands to recorded beside the text. A conversation is then written as

    <|turn|>ROLE<|text|>TEXT<|end|>...

with every control string inside roles and texts broken by a backslash after its first character (backslashes are doubled), so
`read_back` restores the exact turns. The visitor builds Columns once, on the driver; rows meet built-in functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, running, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What a text must not hold as such: our own marks begin with the first, the others belong to common templates.
CONTROLS = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
PART_REST = (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
PART = "struct<type:string,text:string," + ",".join(f"{n}:{t}" for n, t in PART_REST) + ">"
#: Pixels of a side of an image patch, tokens a second of audio, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 1024


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class PartVisitor:
    """One method a part type; each returns (shown text, expanded tokens) as Columns. Subclass it to add types."""

    attachments = ("image", "audio", "document")

    def text(self, part: Column, number: Column) -> tuple[Column, Column]:
        return escape(part["text"]), F.lit(0).cast("long")

    def image(self, part: Column, number: Column) -> tuple[Column, Column]:
        side = lambda k: F.ceil(F.coalesce(part[k], F.lit(0)) / F.lit(PATCH))
        return self.mark("image", number), F.greatest(side("width") * side("height"), F.lit(1)).cast("long")

    def audio(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.mark("audio", number), F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)).cast("long")

    def document(self, part: Column, number: Column) -> tuple[Column, Column]:
        return self.mark("document", number), (F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS).cast("long")

    def mark(self, kind: str, number: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>"))

    def visit(self, parts: Column) -> Column:
        """array<struct<shown, type, ref, tokens>>: the texts and the attachments in turns, a text first and last.

        Texts that follow each other are one before they are escaped, so no control string can arise where two meet. Parts of unknown or no
        type count as text. The n-th attachment stands at place 2n, so numbers need no search.
        """
        given = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
        attached = lambda x: F.coalesce(x["type"].isin(*self.attachments), F.lit(False))
        plain = lambda p: F.struct(F.lit("text").alias("type"), p.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in PART_REST]).cast(PART)

        def pieces(held: Column, at: Column) -> Column:
            def piece(j: Column) -> Column:
                first = F.coalesce(F.get(at, j - 1), F.lit(0)) + 1
                texts = F.slice(held, first, F.coalesce(F.get(at, j), F.size(held) + 1) - first)
                said = plain(F.array_join(F.transform(texts, lambda x: F.coalesce(x["text"], F.lit(""))), ""))
                return F.when(j < F.size(at), F.array(said, F.get(held, F.get(at, j) - 1))).otherwise(F.array(said))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), piece))

        def one(part: Column, i: Column) -> Column:
            number = F.floor((i + 1) / 2).cast("int")
            shown, tokens = self.text(part, number)
            for kind in self.attachments:
                its_shown, its_tokens = getattr(self, kind)(part, number)
                same = F.coalesce(part["type"] == kind, F.lit(False))
                shown, tokens = F.when(same, its_shown).otherwise(shown), F.when(same, its_tokens).otherwise(tokens)
            return F.struct(shown.alias("shown"), part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens"))

        places = lambda held: F.array_compact(F.transform(held, lambda x, i: F.when(attached(x), i + 1)))
        return F.transform(let(given, lambda held: let(places(held), lambda at: pieces(held, at))), one)


def as_parts(text: Column) -> Column:
    """array<PART> of one part of type text."""
    lack = F.lit(None)
    return F.array(F.struct(F.lit("text"), text, lack, lack, lack, lack, lack)).cast(f"array<{PART}>")


def format_chat(turns: DataFrame, visitor: PartVisitor | None = None, key: str = "conv_id") -> DataFrame:
    """One row per conversation: formatted string, loss spans, attachments, expanded tokens.

    `turns` holds key, turn, role, and either `parts` (array of PART) or `text`, which is one part of type text. Rows go by turn; rows of the same turn by
    role and by their parts as given, before any escaping. Null texts, roles and parts are empty; equal rows all count; a null key is a conversation of its own; an empty
    table gives none. Only these columns are read, so others may have any names. loss_spans are [start, end) in code points of the assistant
    texts. The work grows with n log n of a conversation's turns and linearly with its texts; one conversation is a value of one row.
    """
    parts = F.col("parts") if "parts" in turns.columns else as_parts(F.col("text"))
    flat = turns.select(F.col(key).alias("_key"), "turn", F.coalesce("role", F.lit("")).alias("role"), parts.cast(f"array<{PART}>").alias("parts"))
    held = flat.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("_t"))

    def written_turn(x: Column) -> Column:
        def laid(seen: Column) -> Column:
            return F.struct(
                (x["role"] == "assistant").alias("learnt"), F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT)).alias("head"),
                F.array_join(F.transform(seen, lambda y: y["shown"]), "").alias("body"), F.filter(seen, lambda y: y["type"] != "text").alias("att"),
            )

        return let((visitor or PartVisitor()).visit(x["parts"]), laid)

    laid = held.select("_key", F.transform("_t", written_turn).alias("_t"))
    laid = laid.withColumn("_end", running(F.transform("_t", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END))))
    spans = F.zip_with("_t", "_end", lambda x, e: F.struct((e - len(END) - F.length(x["body"])).alias("start"), (e - len(END)).alias("end"), x["learnt"].alias("learnt")))
    learnt = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    att = F.flatten(F.transform("_t", lambda x: x["att"]))
    return laid.select(
        F.col("_key").alias(key), F.array_join(F.transform("_t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), learnt.alias("loss_spans"),
        F.transform(att, lambda x, i: F.struct((i + 1).alias("position"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(att, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(formatted, re.escape(END)), lambda x: x != "")

    def one(x: Column) -> Column:
        at = F.instr(x, TEXT)
        return F.struct(
            unescape(F.substring(x, F.lit(len(TURN) + 1), at - 1 - len(TURN))).alias("role"),
            unescape(F.substring(x, at + len(TEXT), F.length(x))).alias("text"),
        )

    return F.transform(turns, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


PROBE = "</s>[INST] ok [/INST]"


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of -1, read back from what `format_chat` wrote; each text is one part, met by the visitor."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS p(turn, role)")
    done = format_chat(given.unionByName(probe).select("conv_id", "turn", "role", as_parts(F.col("text")).alias("parts")))
    back = done.withColumn("_turns", read_back(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )


def _sql_escape(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(turn, role)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + len(TEXT) + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM t GROUP BY conv_id
"""
