"""Column functions over texts. Every pattern goes through `unicode`, as Java's classes are ASCII without it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: General placeholder forms (named printf, printf, percent sign, named and numbered braces, tags, line breaks), in the order they are tried.
PLACEHOLDERS = "|".join((
    r"%\([^)]+\)(?:[-+#0]*\d*(?:\.\d+)?[diouxXeEfFgGcrsa])?", r"%(?!\()[\-+#0]*\d*(?:\.\d+)?[diouxXeEfFgGcrsa]", r"%%",
    r"\{[A-Za-z_][A-Za-z0-9_.\[\]]*\}", r"\{\d+\}", r"</?[A-Za-z][^<>]*?>", r"\r\n|\r|\n",
))
#: A mask's token, what is left of one in any writing, what looks like a placeholder of an unknown kind, and characters that carry no meaning.
TOKEN = r"\[PH_[0-9a-f]{8}_\d+\]"
TOKEN_RESIDUE = r"[\[【〔（(]\s*[Pp][Hh][ _\-]?[0-9a-fA-F]{8}[ _\-]?\d+\s*[\]】〕）)]"
UNKNOWN = r"\$[^\s$]{1,40}\$|£[^\s£]{1,40}£|§.|\[[^\]\s]{1,40}\]|%[0-9]+\$[a-zA-Z]|\{\{[^}]{1,40}\}\}"
MEANINGLESS = " \t\r\n.,:;-—/|()[]{}%#*+"


def with_preset(extra: Sequence[str] = (), presets: Sequence[str] = ()) -> str:
    """The pattern of a project's own forms, an adapter's presets and the general ones, tried in this order."""
    return "|".join((*extra, *presets, PLACEHOLDERS))


def unicode(pattern: str) -> str:
    return "(?U)" + pattern


def strip(text: Column) -> Column:
    return F.regexp_replace(text, unicode(r"^\s+|\s+$"), "")


def blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def joined_digest(*parts: Column) -> Column:
    """SHA-256 of parts joined by U+001F; the parts must not be null."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def short_digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a case-sensitive glob whose * crosses slashes; a leading **/ may be absent."""
    out, i = "", 0
    body = glob[3:] if (optional := glob.startswith("**/")) else glob
    while i < len(body):
        c = body[i]
        if c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out += f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.^$+{}[]|()" else c
        i += 1
    return rf"(?s)\A{'(?:.*/)?' if optional else ''}{out}\z"


def glob_match(path: Column, globs: Sequence[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def placeholders(text: Column, pattern: str = PLACEHOLDERS) -> Column:
    return F.regexp_extract_all(text, F.lit(unicode(f"(?:{pattern})")), F.lit(0))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def token_estimate(text: Column) -> Column:
    """Four ASCII characters a token, one for each other character; an ASCII run counts one at least."""
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]"), F.lit(0))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + F.ceil(F.length(x) / F.lit(4)))


def tags_balanced(text: Column, void: Sequence[str] = ("br", "hr", "img", "meta", "link", "input")) -> Column:
    """Whether tags close in order. A stack as a string of names; a mismatch turns it into '!' for good."""
    tags = F.regexp_extract_all(text, F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*[^/<>]|\s*)?>"), F.lit(1))
    names = F.filter(F.transform(tags, F.lower), lambda t: ~t.isin(*void))

    def step(stack: Column, t: Column) -> Column:
        top = F.substring_index(stack, "\u001f", -1)
        closing = t.startswith("/")
        popped = F.substring(stack, F.lit(1), F.length(stack) - F.length(top) - 1)
        return F.when(stack == "!", stack).when(~closing, F.concat(stack, F.lit("\u001f"), t)).when(top == F.substring(t, F.lit(2), F.length(t)), popped).otherwise(F.lit("!"))

    return F.aggregate(names, F.lit("#"), step) == "#"


def mask(text: Column, namespace: Column, pattern: str = PLACEHOLDERS) -> Column:
    """struct(masked, tokens): the i-th placeholder gives way to [PH_<digest of namespace and text>_<i>]; tokens are (token, value) in order."""
    values = placeholders(text, pattern)
    mark = F.substring(joined_digest(namespace, text), 1, 8)
    tokens = F.transform(values, lambda v, i: F.struct(F.concat(F.lit("[PH_"), mark, F.lit("_"), i.cast("string"), F.lit("]")).alias("token"), v.alias("value")))
    pieces = F.split(text, unicode(f"(?:{pattern})"), -1)
    lead = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), tokens, lambda p, t: F.concat(p, t["token"]))
    return F.struct(F.concat(F.array_join(lead, ""), F.element_at(pieces, -1)).alias("masked"), tokens.alias("tokens"))


def restore(masked: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, masked, lambda a, t: F.replace(a, t["token"], t["value"]))


def translatable(text: Column, pattern: str = PLACEHOLDERS) -> Column:
    """Whether anything but placeholders, masks and characters without meaning is left of a text; null counts as empty."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), unicode(f"(?:{pattern})"), ""), TOKEN, "")
    return F.btrim(bare, F.lit(MEANINGLESS)) != ""


def unmasked(masked: Column) -> Column:
    """What still looks like a placeholder once a text has been masked."""
    return F.filter(F.regexp_extract_all(masked, F.lit(unicode(UNKNOWN)), F.lit(0)), lambda x: ~x.rlike(rf"\A{TOKEN}\z"))


def multiset_except(a: Column, b: Column) -> Column:
    """Sorted array of what a holds more often than b, as often as it does so."""
    times = lambda held, x: F.size(F.filter(held, lambda y: y == x))
    more = F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(times(a, x) - times(b, x), F.lit(0))))
    return F.array_sort(F.flatten(more))


def runs(text: Column, token: str, least: int) -> Column:
    """Runs of `least` or more tokens that only blanks and light punctuation part, each joined by single spaces. Tokens hold no blanks."""
    found = F.regexp_extract_all(text, F.lit(unicode(f"(?:{token})")), F.lit(0))
    gaps = F.split(text, unicode(f"(?:{token})"), -1)
    light = lambda i: F.get(gaps, i).rlike(r"""(?U)\A[\s.,;:!?'"()\[\]/\\-]*\z""")
    laid = F.array_join(F.transform(found, lambda x, i: F.concat(F.when(i == 0, "").when(light(i), " ").otherwise("\u001f"), x)), "")
    return F.filter(F.split(laid, "\u001f"), lambda r: (r != "") & (F.size(F.split(r, " ")) >= least))


def normalized(text: Column, rules: Sequence[tuple[str, str]], passes: int = 64, growth: int = 4) -> Column:
    """struct(text, converged): rules (pattern, replacement) applied in order until nothing changes.

    Rules that go round in circles, grow a text without bound or need more than `passes` rounds leave the text as it was, not converged.
    """
    def once(x: Column) -> Column:
        for pattern, replacement in rules:
            x = F.regexp_replace(x, unicode(pattern), replacement)
        return x

    limit = F.greatest(F.length(text) * growth, F.length(text) + 64)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), text, lambda x, _: F.when(F.length(x) > limit, x).otherwise(once(x)))
    return F.element_at(F.transform(F.array(last), lambda x: F.struct(F.when(once(x) == x, x).otherwise(text).alias("text"), (once(x) == x).alias("converged"))), 1)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def source_form(texts: pd.Series) -> pd.Series:
    """One form for equal sources: NFKC, io as ie, single spaces, case-folded; null counts as empty."""
    yo = str.maketrans("\u0451\u0401", "\u0435\u0415")
    return texts.map(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").translate(yo)).strip().casefold())


#: Marks and blanks that do not make another translation.
EDGE_MARKS = " \t\r\n。．.，,、：:；;！!？?"


def variant_form(text: Column) -> Column:
    """NFKC without blanks and EDGE_MARKS at both ends."""
    edge = "[" + EDGE_MARKS + "]"
    return F.regexp_replace(strip(nfkc(text)), f"^{edge}+|{edge}+$", "")


@F.pandas_udf(ArrayType(StructType().add("op", "string").add("text", "string")))
def diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Character differences: equal, delete and insert, in order. Null counts as empty; for short texts, as the work grows with the square."""

    def ops(a: str, b: str) -> list[dict[str, str]]:
        out = [] if a != b else [{"op": "equal", "text": b}]
        for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if a != b else ():
            if tag == "equal":
                out.append({"op": tag, "text": b[k:m]})
            else:
                out += [{"op": op, "text": t} for op, t in (("delete", a[i:j]), ("insert", b[k:m])) if t]
        return out

    return pd.Series([ops(a or "", b or "") for a, b in zip(before, after, strict=True)])
