"""Judgement, gate and review analytics over translated units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_RESIDUE, blank, placeholders, same_multiset, strip, translatable, unicode


def findings(source: Column | None = None, text: Column | None = None) -> Column:
    """Codes of a text for a source (else the columns translation and source_text) whether or not it is blank, in the order of judgement; nulls count as empty."""
    text, source = (F.coalesce(F.col(n) if x is None else x, F.lit("")) for n, x in (("translation", text), ("source_text", source)))
    rest = [
        (~same_multiset(placeholders(source), placeholders(text)), "placeholder_mismatch"),
        (translatable(source) & (strip(source) == strip(text)), "untranslated"),
        (F.contains(text, F.lit("\x00")), "invalid_control_character"),
        (text.rlike(unicode(TOKEN_RESIDUE)), "placeholder_variant_residue"),
    ]
    return F.array_compact(F.array(F.when(blank(text), F.lit("empty_translation")), *[F.when(c, F.lit(n)) for c, n in rest]))


def valid(source: Column | None = None, text: Column | None = None) -> Column:
    """Whether a text may stand for its source: the one judgement that planning, building and rechecking share."""
    return F.size(findings(source, text)) == 0


def codes() -> Column:
    """The findings that are reported: a blank text has only the first."""
    return F.when(blank(F.col("translation")), F.array(F.lit("empty_translation"))).otherwise(findings())


def verdicts(units: DataFrame, edits: DataFrame) -> DataFrame:
    """stable_identity, known, fixed, remaining, introduced for each edit (stable_identity, text); findings that a blank text hides count."""
    was = units.select("stable_identity", "source_text", findings().alias("_was"))
    now = edits.join(was, "stable_identity", "left").withColumn("translation", F.col("text")).withColumn("_now", findings())
    side = lambda x: F.array_sort(x)
    return now.select(
        "stable_identity", F.col("_was").isNotNull().alias("known"), side(F.array_except("_was", "_now")).alias("fixed"),
        side(F.array_intersect("_was", "_now")).alias("remaining"), F.when(F.col("_was").isNotNull(), side(F.array_except("_now", "_was"))).alias("introduced"),
    )


def classify_history(units: DataFrame, terms: DataFrame) -> DataFrame:
    """Units with classification and reason: quarantined by the first finding, suspect where clean translations of a source differ, else clean."""
    broken = term_violations(units, terms).select("stable_identity").distinct().withColumn("_term", F.lit(True))
    text, source = F.coalesce("translation", F.lit("")), F.col("source_text")
    reason = F.when(blank(text), "empty_translation").when(strip(text) == strip(source), "untranslated").when(~same_multiset(placeholders(source), placeholders(text)), "placeholder_mismatch")
    reason = reason.when(F.contains(text, F.lit("\x00")), "invalid_control_character").when(F.col("_term"), "glossary_violation")
    judged = units.join(broken, "stable_identity", "left").withColumn("reason", reason).drop("_term")
    split = judged.where("reason is null").groupBy("source_text").agg((F.min("translation") != F.max("translation")).alias("_split"))
    both = judged.join(split, "source_text", "left")
    kind = F.when(F.col("reason").isNotNull(), "legacy_quarantined").when(F.col("_split"), "legacy_suspect").otherwise("legacy_clean")
    why = F.coalesce("reason", F.when(F.col("_split"), F.lit("source_translation_conflict")).otherwise("clean"))
    return both.withColumn("classification", kind).withColumn("reason", why).drop("_split")


def records(units: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row per unit and code, and one per unit and violated term where terms are given; a blank text has only its first code."""
    out = units.withColumn("code", F.explode(codes()))
    if terms is None:
        return out
    broken = term_violations(units.where(~blank(F.col("translation"))), terms).select(*units.columns, F.lit("glossary_violation").alias("code"))
    return out.unionByName(broken)


def _glob(pattern: Column) -> Column:
    """Regular expression of a case-sensitive glob given as a Column; * crosses slashes, a [ that is not closed is itself."""
    plain = lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}])", r"\\$1")
    inner = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\[!?|\]$", ""), r"([\\\[\]^&])", r"\\$1")
    held = lambda x: F.concat(F.when(F.startswith(x, F.lit("[!")), F.lit("[^")).otherwise(F.lit("[")), inner(x), F.lit("]"))
    one = lambda x: F.when(x == "*", F.lit(".*")).when(x == "?", F.lit(".")).when(F.length(x) > 1, held(x)).otherwise(plain(x))
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?s)\[!?[^!][^\]]*\]|."), F.lit(0))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(pieces, one), ""), F.lit(r"\z"))


def _holds(mode: Column, source: Column, form: Column) -> Column:
    """Whether a source holds a form, by the very characters: as a whole, inside, or as words."""
    whole = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace(form, r"(?U)([^\w])", r"\\$1"), F.lit(r"(?!\w)"))
    return F.when(mode == "exact", source == form).when(mode == "substring", F.contains(source, form)).otherwise(F.rlike(source, whole))


def term_violations(units: DataFrame, terms: DataFrame) -> DataFrame:
    """Units whose source holds a term, or one of its variants, while the translation lacks its target; one row a unit and term.

    terms: source, target, and, where they differ from these, match_mode (word), variants (none), scope and exclude_scope (globs of
    relative_path, none), status (reviewed: terms of any other are not held). Sources are cut into words and met by an equi-join on the first
    word of a form, exact forms on the whole source, so the work is the number of words, not units times terms; only substrings
    and forms without a word are held against every source.
    """
    given = lambda c, other: F.col(c) if c in terms.columns else other
    none = F.lit(None)
    mode = F.coalesce(given("match_mode", none).cast("string"), F.lit("word"))
    wrong = F.raise_error(F.concat(F.lit("unsupported glossary match_mode: "), mode)).cast("string")
    forms = F.filter(F.concat(F.array("source"), F.coalesce(given("variants", none).cast("array<string>"), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    known = terms.where(given("status", F.lit("reviewed")) == "reviewed").select(
        F.col("source").alias("term"), "target", F.when(mode.isin("exact", "word", "substring"), mode).otherwise(wrong).alias("_mode"), forms.alias("_forms"),
        given("scope", none).cast("string").alias("_in"), F.coalesce(given("exclude_scope", none).cast("array<string>"), F.array().cast("array<string>")).alias("_out"),
    )
    each_form = known.select("*", F.posexplode("_forms").alias("_i", "_form"))
    key = F.when(F.col("_mode") == "exact", F.col("_form")).when(F.col("_mode") == "word", F.regexp_extract("_form", r"(?U)\w+", 0)).otherwise("")
    keyed = each_form.withColumn("_key", key)
    pieces = F.array_distinct(F.split("source_text", r"(?U)[^\w]+"))
    words = units.withColumn("_w", F.explode(pieces)).join(keyed.where("_mode = 'word' and _key <> ''"), F.col("_w") == F.col("_key")).drop("_w")
    exact = units.join(keyed.where("_mode = 'exact'"), F.col("source_text") == F.col("_key"))
    rest = units.join(keyed.where("_key = ''"), _holds(F.col("_mode"), F.col("source_text"), F.col("_form")))
    # of the forms that a source holds the first one counts
    earlier = F.exists(F.slice("_forms", 1, F.col("_i")), lambda f: _holds(F.col("_mode"), F.col("source_text"), f))
    met = words.unionByName(exact).unionByName(rest).where(_holds(F.col("_mode"), F.col("source_text"), F.col("_form")) & ~earlier)
    if "scope" in terms.columns or "exclude_scope" in terms.columns:
        on = lambda g: F.rlike(F.col("relative_path"), _glob(g))
        met = met.where((F.coalesce("_in", F.lit("")) == "") | on(F.col("_in"))).where(~F.exists("_out", on))
    missing = ~F.contains(F.coalesce("translation", F.lit("")), F.col("target"))
    return met.where(missing).select(*units.columns, "term", "target")


def debt_key(identity: Column, code: Column, details: Column) -> Column:
    return F.concat_ws("::", F.coalesce(identity, F.lit("")), code, F.substring(F.sha2(details, 256), 1, 12))


def gate(qa: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row: errors, new (provenance machine), carried, unaccepted, accepted, passed."""
    met = qa.join(accepted.select("debt_key").distinct().withColumn("_a", F.lit(True)), "debt_key", "left")
    error = F.col("severity") == "error"
    new = F.coalesce("provenance", F.lit("unknown")) == "machine"
    held = F.coalesce("_a", F.lit(False))
    count = lambda c: F.count_if(error & c)
    out = met.agg(F.count_if(error).alias("errors"), count(new).alias("new_errors"), count(~new).alias("carried_errors"), count(~new & ~held).alias("unaccepted"), count(~new & held).alias("accepted"))
    return out.withColumn("passed", (F.col("new_errors") == 0) & (F.col("unaccepted") == 0))


def inconsistent(units: DataFrame) -> DataFrame:
    """Sources with two non-empty translations or more."""
    held = units.where(~blank(F.col("translation")))
    grouped = held.groupBy("source_text").agg(F.collect_set("translation").alias("v"), F.count("*").alias("units"), F.min_by("logical_key", F.col("k")).alias("sample_key"))
    return grouped.where(F.size("v") > 1).select("source_text", F.size("v").cast("long").alias("variants"), "units", "sample_key", F.array_join(F.array_sort("v"), "|").alias("translations"))


def majorities(units: DataFrame, share: float = 0.8) -> DataFrame:
    """Divergent sources with their most frequent translation; `majority` where it has the share, `plurality` where no other ties."""
    counted = units.where(~blank(F.col("translation"))).groupBy("source_text", "translation").agg(F.count("*").alias("n"))
    grouped = counted.groupBy("source_text").agg(
        F.sum("n").alias("total"), F.count("*").alias("variants"), F.max_by("translation", F.struct(F.col("n"), F.col("translation"))).alias("top"),
        F.max("n").alias("top_n"), F.array_sort(F.collect_list("n")).alias("_n"),
    )
    divergent = grouped.where("variants > 1")
    return divergent.select(
        "source_text", "total", "variants", "top", "top_n", (F.col("top_n") >= F.col("total") * share).alias("majority"),
        (F.element_at("_n", -1) != F.element_at("_n", -2)).alias("plurality"),
    )


def consistency_delta(units: DataFrame, edits: DataFrame) -> DataFrame:
    """Sources whose consistency changes under edits (stable_identity, text): resolved or introduced."""
    now = units.select("stable_identity", "source_text", F.coalesce("translation", F.lit("")).alias("t"))
    edited = now.join(edits, "stable_identity")
    moves = now.select("source_text", "t", F.lit(1).alias("was"), F.lit(1).alias("now")).unionByName(
        edited.select("source_text", "t", F.lit(0).alias("was"), F.lit(-1).alias("now"))
    ).unionByName(edited.select("source_text", F.col("text").alias("t"), F.lit(0).alias("was"), F.lit(1).alias("now")))
    held = moves.where("t <> ''").groupBy("source_text", "t").agg(F.sum("was").alias("was"), F.sum("now").alias("now"))
    out = held.groupBy("source_text").agg(F.count_if(F.col("was") > 0).alias("variants_before"), F.count_if(F.col("now") > 0).alias("variants_after"))
    change = F.when((F.col("variants_before") > 1) & (F.col("variants_after") <= 1), "resolved").when((F.col("variants_before") <= 1) & (F.col("variants_after") > 1), "introduced")
    return out.withColumn("change", change).where("change is not null")
