"""Registered queries of the engine over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import batches as bt
from ..operators import events as ev
from ..operators import memory, review
from ..operators import merge as mg
from .views import TM_SQL, U_SQL, table, tm_part, u_part

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


N = "CAST({} AS BIGINT)".format


@query("""SELECT doc_id, sha256('corpus'||chr(31)||source||chr(31)||lang||'/'||source||chr(31)||doc_id) AS stable_identity, sha256(text) AS source_fingerprint,
  substr(sha256(text),1,16) AS digest FROM documents""")
def unit_identity(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", "lang", "source")
    return table(spark, d, "documents").select("doc_id", tx.joined_digest(F.lit("corpus"), F.col("source"), path, F.col("doc_id").cast("string")).alias("stable_identity"), F.sha2("text", 256).alias("source_fingerprint"), tx.short_digest(F.col("text")).alias("digest"))


@query("""SELECT l_orderkey AS path, arg_min(l_suppkey, (-l_quantity, l_linenumber, l_suppkey)) AS adapter, max(l_quantity) AS confidence FROM lineitem GROUP BY 1""")
def resource_arbitration(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct((-F.col("l_quantity")).alias("q"), F.col("l_linenumber"), F.col("l_suppkey"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.min_by("l_suppkey", order).alias("adapter"), F.max("l_quantity").alias("confidence"))


@query(f"""WITH {U_SQL} SELECT k, CASE WHEN regexp_matches(relative_path,'^size/1.*$') AND adapter_id='gettext' THEN 'small-gettext'
  WHEN regexp_full_match(source_text,'.* (ring|bolt)') THEN 'hardware' WHEN regexp_full_match(logical_key,'[0-9]*7') THEN 'sevens' END AS rule_id FROM u""")
def filter_first_match(spark: SparkSession, d: str) -> DataFrame:
    rule = F.when(tx.glob_match(F.col("relative_path"), ["size/1*"]) & (F.col("adapter_id") == "gettext"), "small-gettext")
    rule = rule.when(F.col("source_text").rlike(r"(?sU)\A(?:.* (ring|bolt))\z"), "hardware").when(F.col("logical_key").rlike(r"(?U)\A(?:[0-9]*7)\z"), "sevens")
    return u_part(spark, d).select("k", rule.alias("rule_id"))


_EXACT = """SELECT u.stable_identity, tm.translation FROM u JOIN tm ON u.stable_identity=tm.stable_identity AND u.source_fingerprint=tm.source_fingerprint
  WHERE trim(tm.translation)<>'' AND quality_state<>'failed' AND (is_formal OR classification='legacy_clean') AND review_state NOT IN ('suspect','quarantined')"""
_RANKED = """SELECT u.stable_identity, arg_min(tm.translation,(CASE WHEN tm.relative_path=u.relative_path THEN 0 ELSE 1 END, updated_at, tm.translation)) AS translation,
  min(CASE WHEN tm.relative_path=u.relative_path THEN 0 ELSE 1 END) AS path_rank
  FROM u JOIN tm ON u.adapter_id=tm.adapter_id AND u.logical_key=tm.logical_key AND u.source_fingerprint=tm.source_fingerprint AND tm.relative_path IN (u.relative_path, lower(u.p_brand))
  WHERE origin='legacy' AND classification IN ('legacy_clean','legacy_suspect') AND review_state<>'quarantined' AND tm.translation<>'' GROUP BY 1"""
_REVIEWED = """SELECT project_id, source_fingerprint, min(translation) AS translation FROM tm WHERE is_formal AND quality_state='passed'
  AND review_state IN ('locked','reviewed','checked') AND trim(translation)<>'' GROUP BY 1,2 HAVING count(DISTINCT translation)=1"""
_CONVERGED = """SELECT norm, translation, n, CAST(total AS BIGINT) AS total FROM (SELECT lower(source_text) AS norm, translation, count(*) AS n,
  sum(count(*)) OVER (PARTITION BY lower(source_text)) AS total, row_number() OVER (PARTITION BY lower(source_text) ORDER BY count(*) DESC, translation DESC) AS r
  FROM tm WHERE origin='legacy' AND classification IN ('legacy_clean','legacy_suspect') AND review_state<>'quarantined' AND trim(translation) NOT IN ('', trim(source_text)) GROUP BY 1,2) WHERE r=1 AND total>=2 AND n>=0.8*total"""


@query(f"WITH {TM_SQL} {_EXACT}")
def tm_lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    return memory.exact(u_part(spark, d), tm_part(spark, d))


@query(f"WITH {TM_SQL} {_RANKED}")
def tm_lookup_ranked(spark: SparkSession, d: str) -> DataFrame:
    return memory.ranked(u_part(spark, d), tm_part(spark, d))


@query(f"WITH {TM_SQL} {_REVIEWED}")
def reviewed_source_unanimous(spark: SparkSession, d: str) -> DataFrame:
    return memory.reviewed_sources(tm_part(spark, d))


@query(f"WITH {TM_SQL} {_CONVERGED}")
def source_convergence(spark: SparkSession, d: str) -> DataFrame:
    return memory.converged(tm_part(spark, d))


_CASCADE = f"""{TM_SQL}, e AS ({_EXACT}), r AS ({_RANKED}), s AS ({_REVIEWED}), c AS ({_CONVERGED}), res AS (
  SELECT u.stable_identity, u.relative_path, CASE WHEN NOT regexp_matches(u.source_text,'[A-Za-z]') THEN 'filtered' WHEN e.translation IS NOT NULL THEN 'coordinate_exact'
  WHEN r.translation IS NOT NULL THEN 'legacy_coordinate' WHEN s.translation IS NOT NULL THEN 'reviewed_source' WHEN c.translation IS NOT NULL THEN 'convergence'
  WHEN trim(u.translation)<>'' THEN 'embedded' ELSE 'pending' END AS decision,
  coalesce(e.translation,r.translation,s.translation,c.translation,CASE WHEN trim(u.translation)<>'' THEN u.translation END) AS resolved
  FROM u LEFT JOIN e USING (stable_identity) LEFT JOIN r USING (stable_identity) LEFT JOIN s ON u.source_fingerprint=s.source_fingerprint LEFT JOIN c ON lower(u.source_text)=c.norm)"""


@query(f"WITH {_CASCADE} SELECT * FROM res")
def resolution_cascade(spark: SparkSession, d: str) -> DataFrame:
    return memory.resolve(u_part(spark, d), tm_part(spark, d))


@query(f"""WITH {_CASCADE} SELECT relative_path, count(*) AS units, count(*) FILTER (WHERE decision='pending') AS pending, count(*) FILTER (WHERE decision='filtered') AS filtered,
  count(*) FILTER (WHERE resolved IS NOT NULL) AS resolved_units FROM res GROUP BY 1""")
def plan_by_file(spark: SparkSession, d: str) -> DataFrame:
    return memory.resolve(u_part(spark, d), tm_part(spark, d)).groupBy("relative_path").agg(F.count("*").alias("units"), F.count_if(F.col("decision") == "pending").alias("pending"), F.count_if(F.col("decision") == "filtered").alias("filtered"), F.count("resolved").alias("resolved_units"))


@query(f"WITH {TM_SQL} SELECT k, origin FROM tm WHERE stable_identity IN (SELECT stable_identity FROM u WHERE k%4=1)")
def tm_keys_semi(spark: SparkSession, d: str) -> DataFrame:
    return tm_part(spark, d).join(u_part(spark, d).where("k % 4 = 1").select("stable_identity"), "stable_identity", "left_semi").select("k", "origin")


@query(f"WITH {TM_SQL} SELECT k FROM u WHERE stable_identity NOT IN (SELECT stable_identity FROM tm)")
def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    return u_part(spark, d).join(tm_part(spark, d), "stable_identity", "left_anti").select("k")


@query(f"""WITH {TM_SQL} SELECT u.stable_identity, tm.source_fingerprint AS old_fingerprint, tm.translation AS old_translation, u.source_fingerprint AS new_fingerprint,
  u.translation AS new_translation FROM tm JOIN u USING (stable_identity) WHERE is_formal AND tm.source_fingerprint<>u.source_fingerprint""")
def stale_formal(spark: SparkSession, d: str) -> DataFrame:
    return memory.stale(u_part(spark, d), tm_part(spark, d))


TERMS = {"red": "RED", "blue": "BLUE", "small": "SMALL", "hot": "HOT", "ring": "RING", "widget": "WIDGET", "bolt": "BOLT", "gear": "GEAR"}
_TERMS = "t AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in TERMS.items()) + ") AS v(term, target))"
_VIOLATIONS = f"""{U_SQL}, {_TERMS}, viol AS (SELECT k, relative_path, term, target FROM u JOIN t ON regexp_matches(source_text, '(^|[^A-Za-z0-9_])'||term||'([^A-Za-z0-9_]|$)')
  WHERE NOT contains(translation, target))"""


def _violations(spark: SparkSession, d: str) -> DataFrame:
    return review.term_violations(u_part(spark, d), spark.createDataFrame(list(TERMS.items()), "source string, target string"))


@query(f"WITH {_VIOLATIONS} SELECT k, term, target FROM viol")
def glossary_violations(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d).select("k", "term", "target")


@query(f"WITH {_VIOLATIONS} SELECT term, target, count(*) AS violations, count(DISTINCT relative_path) AS files, min(k) AS first_unit FROM viol GROUP BY 1,2")
def glossary_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d).groupBy("term", "target").agg(F.count("*").alias("violations"), F.countDistinct("relative_path").alias("files"), F.min("k").alias("first_unit"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    pick = lambda m, change: F.when(F.col("k") % m == 0, "").when(F.col("k") % m == 1, F.concat("o_orderpriority", F.lit(change))).otherwise(F.col("o_orderpriority"))
    stage = F.get(F.array(*[F.lit(x) for x in (0, 1, 2, 3, 5, 9, -1)]), (F.col("k") % 7).cast("int"))
    original = lambda m: F.when(F.col("k") % m == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus"))
    origin = F.when(F.col("k") % 2 == 0, "machine").otherwise("human")
    make = lambda keep, m, change, om: o.where(keep).select(F.col("k").alias("key"), original(om).alias("original"), pick(m, change).alias("translation"), stage.alias("stage"), origin.alias("origin"))
    return make("k % 6 <> 0", 97, "", 89), make("k % 5 <> 0", 3, " l", 89), make("k % 8 <> 0", 4, " r", 11)


def _side_sql(name: str, keep: str, m: int, change: str, om: int) -> str:
    return f"""{name} AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey%{om}=0 THEN o_orderstatus||'!' ELSE o_orderstatus END AS original,
  CASE WHEN o_orderkey%{m}=0 THEN '' WHEN o_orderkey%{m}=1 THEN o_orderpriority||'{change}' ELSE o_orderpriority END AS translation,
  [0,1,2,3,5,9,-1][o_orderkey%7+1] AS stage, CASE WHEN o_orderkey%2=0 THEN 'machine' ELSE 'human' END AS origin FROM orders WHERE o_orderkey%{keep})"""


_MERGE = f"""{_side_sql("b", "6<>0", 97, "", 89)}, {_side_sql("l", "5<>0", 3, " l", 89)}, {_side_sql("r", "8<>0", 4, " r", 11)},
m AS (SELECT coalesce(b.key,l.key,r.key) AS key, b.key IS NULL AS no_b, l.key IS NULL AS no_l, r.key IS NULL AS no_r, coalesce(b.translation,'') AS bt, coalesce(l.translation,'') AS lt,
  coalesce(r.translation,'') AS rt, l.original AS lo, r.original AS ro, l.stage AS ls, r.stage AS rs, l.origin AS lg, r.origin AS rg
  FROM b FULL JOIN l ON b.key=l.key FULL JOIN r ON coalesce(b.key,l.key)=r.key),
c AS (SELECT *, CASE WHEN no_b THEN lt<>'' ELSE lt<>bt END AS lc, CASE WHEN no_b THEN rt<>'' ELSE rt<>bt END AS rc FROM m),
d AS (SELECT *, CASE WHEN no_r AND NOT no_l THEN 'local' WHEN no_r THEN 'none' WHEN rs=-1 THEN 'adopt' WHEN no_l THEN 'remote' WHEN lo<>ro THEN 'source_changed'
  WHEN rs IN (2,3,5,9) THEN 'adopt' WHEN rs=1 AND rt<>'' THEN 'remote' WHEN lc AND rc AND lt<>rt THEN CASE WHEN lg='machine' AND rt<>'' THEN 'remote' ELSE 'both_sides_changed' END
  WHEN lc AND lt<>'' THEN 'local' ELSE 'adopt' END AS rule FROM c),
e AS (SELECT *, rule IN ('adopt','source_changed','both_sides_changed') AND rt='' AND lt<>'' AS kept, rule='local' AS upload FROM d WHERE rule<>'none'),
f AS (SELECT key, CASE WHEN upload OR kept THEN lo ELSE ro END AS original, CASE WHEN upload OR kept THEN lt ELSE rt END AS translation, CASE WHEN upload THEN 1 WHEN kept THEN ls ELSE rs END AS stage,
  CASE WHEN upload THEN 'machine' WHEN kept THEN lg ELSE rg END AS origin, upload,
  concat_ws(',', CASE WHEN rule IN ('source_changed','both_sides_changed') THEN rule END, CASE WHEN kept THEN 'remote_empty_would_clear_local' END) AS conflicts FROM e)"""


@query(f"WITH {_MERGE} SELECT * FROM f")
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    return mg.merge(*_sides(spark, d)).withColumn("conflicts", F.array_join("conflicts", ","))


@query(f"WITH {_MERGE} SELECT conflict, count(*) AS n FROM (SELECT unnest(string_split(conflicts, ',')) AS conflict FROM f WHERE conflicts<>'') GROUP BY 1")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return mg.merge(*_sides(spark, d)).select(F.explode("conflicts").alias("conflict")).groupBy("conflict").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS id, sha256(o_orderpriority) AS fp FROM orders WHERE o_orderkey%3<>0), q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey%5=0 THEN 'failed' ELSE 'succeeded' END AS state,
  CASE WHEN o_orderkey%7=0 THEN '' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey%11=0 THEN 'old' ELSE sha256(o_orderpriority) END AS fp FROM orders WHERE o_orderkey%4<>0)
  SELECT id, disposition FROM (SELECT coalesce(p.id,q.id) AS id, CASE WHEN p.id IS NULL THEN CASE WHEN state='failed' THEN 'resolved' END WHEN q.fp<>p.fp THEN 'stale'
  WHEN state='succeeded' AND text<>'' AND q.fp=p.fp THEN 'reused' ELSE 'retry' END AS disposition FROM p FULL JOIN q ON p.id=q.id) WHERE disposition IS NOT NULL""")
def rebuild_disposition(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey")).withColumn("fp", F.sha2("o_orderpriority", 256))
    parent = o.where("id % 4 <> 0").select("id", F.when(F.col("id") % 5 == 0, "failed").otherwise("succeeded").alias("state"), F.when(F.col("id") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("text"), F.when(F.col("id") % 11 == 0, "old").otherwise(F.col("fp")).alias("fp"))
    return memory.rebuild(o.where("id % 3 <> 0").select("id", "fp"), parent)


@query("""WITH a AS (SELECT o_orderkey AS path, sha256(o_orderstatus) AS digest FROM orders WHERE o_orderkey%10<>3), b AS (SELECT DISTINCT l_orderkey AS path, sha256(CASE WHEN l_orderkey%13=0 THEN 'x' ELSE o_orderstatus END) AS digest
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey) SELECT coalesce(a.path,b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' ELSE 'changed' END AS kind
  FROM a FULL JOIN b ON a.path=b.path WHERE a.digest IS DISTINCT FROM b.digest""")
def artifact_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus")
    made = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path")).distinct().join(o, "path")
    return mg.differences(o.where("path % 10 <> 3").select("path", F.sha2("o_orderstatus", 256).alias("digest")), made.select("path", F.sha2(F.when(F.col("path") % 13 == 0, "x").otherwise(F.col("o_orderstatus")), 256).alias("digest")))


@query(f"WITH {TM_SQL} SELECT origin, review_state, classification, quality_state, count(*) AS n FROM tm GROUP BY GROUPING SETS ((origin),(review_state),(classification),(quality_state),())")
def tm_summary_sets(spark: SparkSession, d: str) -> DataFrame:
    keys = ["origin", "review_state", "classification", "quality_state"]
    return tm_part(spark, d).groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]).agg(F.count("*").alias("n"))


_DETAILS = """'{"key": "'||logical_key||'"}'"""
_QA = f"""{U_SQL}, q AS (SELECT k, relative_path, stable_identity, CASE WHEN trim(translation)='' THEN 'empty_translation' WHEN trim(source_text)=trim(translation) THEN 'untranslated' END AS code,
  {_DETAILS} AS details, CASE WHEN k%3=0 THEN 'machine' WHEN k%3=1 THEN 'embedded' END AS provenance FROM u),
qa AS (SELECT *, stable_identity||'::'||code||'::'||substr(sha256(details),1,12) AS debt_key, 'error' AS severity FROM q WHERE code IS NOT NULL)"""


def _qa(spark: SparkSession, d: str) -> DataFrame:
    details = F.concat(F.lit('{"key": "'), "logical_key", F.lit('"}'))
    prov = F.when(F.col("k") % 3 == 0, "machine").when(F.col("k") % 3 == 1, "embedded")
    return review.records(u_part(spark, d)).withColumns({"provenance": prov, "severity": F.lit("error"), "details": details, "debt_key": review.debt_key(F.col("stable_identity"), F.col("code"), details)})


@query(f"WITH {_QA} SELECT k, code, debt_key FROM qa")
def debt_keys(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).select("k", "code", "debt_key")


@query(f"WITH {_QA} SELECT severity, code, count(*) AS n FROM qa GROUP BY GROUPING SETS ((severity),(code))")
def qa_by_code(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).groupingSets([[F.col("severity")], [F.col("code")]], F.col("severity"), F.col("code")).agg(F.count("*").alias("n"))


@query(f"WITH {_QA} SELECT relative_path, k, code FROM qa WHERE severity='error' AND contains(lower(relative_path||' '||code||' '||details),'brand#1') ORDER BY relative_path, k LIMIT 50 OFFSET 5")
def qa_page(spark: SparkSession, d: str) -> DataFrame:
    held = _qa(spark, d).where(F.contains(F.lower(F.concat_ws(" ", "relative_path", "code", "details")), F.lit("brand#1")))
    return held.select("relative_path", "k", "code").orderBy("relative_path", "k").offset(5).limit(50)


@query(f"""WITH {_QA} SELECT count(*) AS errors, count(*) FILTER (WHERE provenance='machine') AS new_errors, count(*) FILTER (WHERE provenance IS DISTINCT FROM 'machine') AS carried_errors,
  count(*) FILTER (WHERE provenance IS DISTINCT FROM 'machine' AND k%2=0) AS unaccepted, count(*) FILTER (WHERE provenance IS DISTINCT FROM 'machine' AND k%2=1) AS accepted,
  count(*) FILTER (WHERE provenance='machine')=0 AND count(*) FILTER (WHERE provenance IS DISTINCT FROM 'machine' AND k%2=0)=0 AS passed FROM qa""")
def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    qa = _qa(spark, d)
    return review.gate(qa, qa.where("k % 2 = 1").select("debt_key"))


@query(f"WITH {_QA} SELECT debt_key FROM qa WHERE provenance IS DISTINCT FROM 'machine' EXCEPT SELECT debt_key FROM qa WHERE k%2=1")
def debt_ratchet(spark: SparkSession, d: str) -> DataFrame:
    qa = _qa(spark, d)
    return qa.where(~F.col("provenance").eqNullSafe("machine")).select("debt_key").distinct().join(qa.where("k % 2 = 1").select("debt_key"), "debt_key", "left_anti")


@query(f"""WITH {U_SQL} SELECT source_text, count(DISTINCT translation) AS variants, count(*) AS units, arg_min(logical_key, k) AS sample_key, string_agg(DISTINCT translation, '|' ORDER BY translation) AS translations
  FROM u WHERE trim(translation)<>'' GROUP BY 1 HAVING count(DISTINCT translation)>1""")
def same_source_inconsistency(spark: SparkSession, d: str) -> DataFrame:
    return review.inconsistent(u_part(spark, d))


@query("SELECT sha256(text) AS fingerprint, count(*) AS copies, count(DISTINCT source) AS sources, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*)>1")
def exact_copy_groups(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "documents").select(F.sha2("text", 256).alias("fingerprint"), "source", "doc_id")
    return held.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"""WITH {U_SQL}, c AS (SELECT source_text, translation, count(*) AS n FROM u WHERE trim(translation)<>'' GROUP BY 1,2),
  g AS (SELECT source_text, CAST(sum(n) AS BIGINT) AS total, count(*) AS variants, arg_max(translation,(n,translation)) AS top, max(n) AS top_n, list_reverse_sort(list(n)) AS ns FROM c GROUP BY 1)
  SELECT source_text, total, variants, top, top_n, top_n>=total*0.8 AS majority, ns[1]<>ns[2] AS plurality FROM g WHERE variants>1""")
def divergence_majority(spark: SparkSession, d: str) -> DataFrame:
    return review.majorities(u_part(spark, d))


@query(f"WITH {U_SQL} SELECT substr(sha256(source_text),1,16) AS source_digest, substr(sha256(translation),1,16) AS translation_digest, count(*) AS n FROM u GROUP BY 1,2")
def source_buckets(spark: SparkSession, d: str) -> DataFrame:
    return u_part(spark, d).groupBy(tx.short_digest(F.col("source_text")).alias("source_digest"), tx.short_digest(F.col("translation")).alias("translation_digest")).agg(F.count("*").alias("n"))


@query(f"""WITH {U_SQL}, a AS (SELECT source_text, count(DISTINCT translation) FILTER (WHERE translation<>'') AS variants_before, count(DISTINCT e) FILTER (WHERE e<>'') AS variants_after
  FROM (SELECT *, CASE WHEN p_size%2=0 THEN upper(source_text) ELSE translation END AS e FROM u) GROUP BY 1)
  SELECT *, CASE WHEN variants_before>1 THEN 'resolved' ELSE 'introduced' END AS change FROM a WHERE (variants_before>1)<>(variants_after>1)""")
def consistency_delta(spark: SparkSession, d: str) -> DataFrame:
    u = u_part(spark, d)
    return review.consistency_delta(u, u.where("p_size % 2 = 0").select("stable_identity", F.upper("source_text").alias("text")))


@query("""WITH p AS (SELECT p_partkey AS k, p_name||' %(n)s {'||(p_size%5)||'}' AS s, p_name||' %(n)s'||CASE WHEN p_partkey%7=0 THEN '' ELSE ' {'||(p_size%5)||'}' END||CASE WHEN p_partkey%7=1 THEN ' {'||(p_size%5)||'}' ELSE '' END AS t FROM part)
  SELECT k, list_sort(regexp_extract_all(s,'%\\([A-Za-z_]\\w*\\)[sd]|\\{[^{}\\s]*\\}'))<>list_sort(regexp_extract_all(t,'%\\([A-Za-z_]\\w*\\)[sd]|\\{[^{}\\s]*\\}')) AS mismatch FROM p""")
def placeholder_mismatch(spark: SparkSession, d: str) -> DataFrame:
    brace = F.concat(F.lit(" {"), (F.col("p_size") % 5).cast("string"), F.lit("}"))
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("k"), F.concat("p_name", F.lit(" %(n)s"), brace).alias("s"), F.concat(F.col("p_name"), F.lit(" %(n)s"), F.when(k % 7 == 0, "").otherwise(brace), F.when(k % 7 == 1, brace).otherwise("")).alias("t"))
    return p.select("k", (~tx.same_multiset(tx.placeholders(F.col("s")), tx.placeholders(F.col("t")))).alias("mismatch"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name||' %(n)s {'||(p_size%5)||'}' AS s, p_name||' %(n)s'||CASE WHEN p_partkey%7=0 THEN '' ELSE ' {'||(p_size%5)||'}' END||CASE WHEN p_partkey%7=1 THEN ' {'||(p_size%5)||'}' ELSE '' END AS t FROM part),
  h AS (SELECT k, unnest(regexp_extract_all(s,'%\\([A-Za-z_]\\w*\\)[sd]|\\{\\d+\\}')) AS x, 1 AS n FROM p UNION ALL SELECT k, unnest(regexp_extract_all(t,'%\\([A-Za-z_]\\w*\\)[sd]|\\{\\d+\\}')), -1 FROM p),
  c AS (SELECT k, x, sum(n) AS n FROM h GROUP BY 1,2)
  SELECT k, coalesce(string_agg(x, ',' ORDER BY x) FILTER (WHERE n>0), '') AS missing, coalesce(string_agg(x, ',' ORDER BY x) FILTER (WHERE n<0), '') AS extra FROM c GROUP BY 1""")
def placeholder_diff(spark: SparkSession, d: str) -> DataFrame:
    brace, k = F.concat(F.lit(" {"), (F.col("p_size") % 5).cast("string"), F.lit("}")), F.col("p_partkey")
    s, t = F.concat("p_name", F.lit(" %(n)s"), brace), F.concat(F.col("p_name"), F.lit(" %(n)s"), F.when(k % 7 == 0, "").otherwise(brace), F.when(k % 7 == 1, brace).otherwise(""))
    both = table(spark, d, "part").select(k.alias("k"), tx.placeholders(s).alias("s"), tx.placeholders(t).alias("t"))
    return both.select("k", F.array_join(tx.multiset_except(F.col("s"), F.col("t")), ",").alias("missing"), F.array_join(tx.multiset_except(F.col("t"), F.col("s")), ",").alias("extra"))


@query(f"""WITH {_VIOLATIONS}, {_QA[_QA.index("q AS (SELECT k") :]} SELECT k, code FROM qa
  UNION ALL SELECT k, 'glossary_violation' FROM viol WHERE k IN (SELECT k FROM u WHERE trim(translation)<>'')""")
def qa_records(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame(list(TERMS.items()), "source string, target string")
    return review.records(u_part(spark, d), terms).select("k", "code")


@query("""WITH j AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) SELECT event_id, key, json_extract_string(props, '$."'||key||'"') AS value FROM j""")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("SELECT lower(tag) AS tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html,'<(/?[A-Za-z][A-Za-z0-9]*)',1)) AS tag FROM pages) GROUP BY 1")
def tag_frequency(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("tag"))
    return held.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query()
def tag_balance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.tags_balanced(F.col("html")).alias("balanced"))


@query(r"SELECT doc_id, CAST(list_sum(list_transform(regexp_extract_all(text,'[\x00-\x7f]+|[^\x00-\x7f]'), lambda x: ceil(length(x)/4.0))) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


def _fragments(docs: DataFrame) -> DataFrame:
    held = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]*[äöüß][a-zäöüß]*"), F.lit(0))).alias("frag"))
    return held.groupBy("lang", "frag").agg(F.count("*").alias("n"))


@query(r"SELECT lang, frag, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text),'[a-z]*[äöüß][a-zäöüß]*')) AS frag FROM documents) GROUP BY 1,2")
def residue_fragments(spark: SparkSession, d: str) -> DataFrame:
    return _fragments(table(spark, d, "documents"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r<=20")
def anomaly_topk(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("_r", F.row_number().over(order)).where("_r <= 20").select("event_type", "event_id", "value")


_NEW = """n AS (SELECT stable_identity, CASE WHEN k%2=0 THEN upper(p_type) ELSE translation END AS translation, k%6=0 AS is_formal, k%10=0 AS human_authored,
  CASE WHEN k%5=0 THEN 'human' ELSE 'machine' END AS origin FROM u WHERE k%3<>1)"""
_UPSERT = f"""{TM_SQL}, {_NEW}, m AS (SELECT coalesce(o.stable_identity,n.stable_identity) AS stable_identity, o.translation AS ot, n.translation AS nt, o.is_formal AS os, n.is_formal AS ns, o.human_authored AS oh, n.human_authored AS nh,
  o.origin AS oo, n.origin AS no, CASE WHEN n.stable_identity IS NULL THEN 'kept' WHEN o.stable_identity IS NULL THEN 'inserted' WHEN o.translation=n.translation AND o.is_formal=n.is_formal AND o.human_authored=n.human_authored AND o.origin=n.origin THEN 'unchanged'
  WHEN (NOT o.is_formal OR n.is_formal) AND NOT (n.origin='machine' AND o.human_authored) THEN 'updated' ELSE 'rejected' END AS outcome FROM tm o FULL JOIN n ON o.stable_identity=n.stable_identity)"""


@query(f"""WITH {_UPSERT} SELECT stable_identity, CASE WHEN outcome IN ('kept','rejected') THEN ot ELSE nt END AS translation, CASE WHEN outcome IN ('kept','rejected') THEN os ELSE ns END AS is_formal,
  CASE WHEN outcome IN ('kept','rejected') THEN oh ELSE nh END AS human_authored, CASE WHEN outcome IN ('kept','rejected') THEN oo ELSE no END AS origin, outcome FROM m""")
def guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    new = u_part(spark, d).where(k % 3 != 1).select("stable_identity", F.when(k % 2 == 0, F.upper("p_type")).otherwise(F.col("translation")).alias("translation"), (k % 6 == 0).alias("is_formal"), (k % 10 == 0).alias("human_authored"), F.when(k % 5 == 0, "human").otherwise("machine").alias("origin"))
    return memory.upsert(tm_part(spark, d), new)


@query(f"WITH {TM_SQL} SELECT k, is_formal OR (k%4=1 AND quality_state='passed') AS is_formal FROM tm")
def promote_run(spark: SparkSession, d: str) -> DataFrame:
    tm = tm_part(spark, d)
    return memory.promote(tm, tm.where("k % 4 = 1").select("stable_identity")).select("k", "is_formal")


@query(f"""WITH {TM_SQL}, e AS (SELECT k, stable_identity, CASE WHEN k%7=0 THEN ' ' ELSE upper(p_type) END AS translation, CASE WHEN k%11=0 THEN 'failed' ELSE 'passed' END AS quality_state FROM u WHERE k%3=0),
  j AS (SELECT e.k, CASE WHEN trim(e.translation)='' THEN 'translation' WHEN e.quality_state<>'passed' THEN 'quality_state' END AS bad,
    CASE WHEN tm.origin='paratranz' AND tm.human_authored THEN 'remote_human' WHEN tm.review_state='locked' THEN 'locked' END AS why FROM e LEFT JOIN tm USING (stable_identity))
  SELECT k, CASE WHEN bad IS NOT NULL THEN 'refused' WHEN why IS NOT NULL THEN 'guarded' ELSE 'written' END AS outcome, coalesce(bad, why) AS reason FROM j""")
def human_write_guard(spark: SparkSession, d: str) -> DataFrame:
    u, k = u_part(spark, d), F.col("k")
    shaped = u.where(k % 3 == 0).withColumns({c: F.lit(v) for c, v in memory.REVIEWED_ROW.items()})
    entries = shaped.withColumns({"translation": F.when(k % 7 == 0, " ").otherwise(F.upper("p_type")), "quality_state": F.when(k % 11 == 0, "failed").otherwise("passed")})
    return memory.human_write(tm_part(spark, d), entries).join(u.select("stable_identity", "k"), "stable_identity").select("k", "outcome", "reason")


@query(f"""WITH {TM_SQL} SELECT k, CASE WHEN origin='human' AND k%3=0 THEN 'before '||k ELSE translation END AS translation FROM tm WHERE NOT (origin='human' AND k%3=0 AND k%8=0)
  UNION ALL SELECT k, 'before '||k FROM u WHERE k%9=0 AND k%3=0 AND k%4=0 AND k%8<>0""")
def retire_restore(spark: SparkSession, d: str) -> DataFrame:
    """Before-images of reviewed rows put back: some were absent, some (of rows deleted since) come anew."""
    tm, k = tm_part(spark, d), F.col("k")
    written = tm.where((F.col("origin") == "human") & (k % 3 == 0))
    gone = u_part(spark, d).where((k % 9 == 0) & (k % 4 == 0)).select(*[F.col(c) if c in u_part(spark, d).columns else F.lit(None).cast(t).alias(c) for c, t in tm.dtypes])
    images = written.unionByName(gone).withColumn("translation", F.concat(F.lit("before "), k.cast("string"))).withColumn("present", k % 8 != 0)
    return memory.restore(tm, images).select("k", "translation")


@query(f"""WITH {TM_SQL} SELECT k FROM tm WHERE NOT (origin='human' AND k%8=0)""")
def retire_human(spark: SparkSession, d: str) -> DataFrame:
    tm = tm_part(spark, d)
    gone = tm.where("origin = 'human' AND k % 8 = 0").select("stable_identity")
    return tm.join(gone, "stable_identity", "left_anti").select("k")


_WINNER = f"""{TM_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY source_text ORDER BY is_formal DESC, human_authored DESC,
  CASE review_state WHEN 'locked' THEN 4 WHEN 'reviewed' THEN 3 WHEN 'unreviewed' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END DESC, coalesce(stage,-1) DESC, adapter_id, stable_identity) AS r FROM tm)"""


@query(f"WITH {_WINNER} SELECT source_text, k, translation FROM w WHERE r=1")
def authority_winner(spark: SparkSession, d: str) -> DataFrame:
    return memory.winners(tm_part(spark, d), "source_text").select("source_text", "k", "translation")


@query(f"WITH {TM_SQL} SELECT count(DISTINCT source_text) AS exported, count(*)-count(DISTINCT source_text) AS collisions, count(*) AS total FROM tm")
def export_accounting(spark: SparkSession, d: str) -> DataFrame:
    tm = tm_part(spark, d)
    kept = memory.winners(tm, "source_text").agg(F.count("*").alias("exported"))
    return kept.join(F.broadcast(tm.agg(F.count("*").alias("total"))), F.lit(True)).select("exported", (F.col("total") - F.col("exported")).alias("collisions"), "total")


def _log(spark: SparkSession, d: str) -> DataFrame:
    action = F.col("event_type")
    for a, b in (("purchase", "commit"), ("view", "skip"), ("signup", "draft"), ("error", "revert"), ("click", "defer")):
        action = F.when(F.col("event_type") == a, b).otherwise(action)
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("target"), action.alias("action"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("text"))


_LEDGER = """l AS (SELECT user_id AS target, arg_max(CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'view' THEN 'skipped' WHEN 'signup' THEN 'draft' WHEN 'click' THEN 'deferred' WHEN 'error' THEN 'reverted' ELSE 'pending' END, event_id) AS state,
  arg_max(props, event_id) FILTER (WHERE event_type='purchase') AS text, max(event_id) AS cursor, count(*) AS events FROM events GROUP BY 1)"""


@query(f"WITH {_LEDGER} SELECT * FROM l")
def ledger_replay(spark: SparkSession, d: str) -> DataFrame:
    return ev.ledger(_log(spark, d))


@query(f"WITH {_LEDGER}, s AS (SELECT unnest(['committed','skipped','draft','deferred','reverted','pending','unseen']) AS state) SELECT s.state, count(l.target) AS n FROM s LEFT JOIN l ON s.state=l.state GROUP BY 1")
def ledger_counters(spark: SparkSession, d: str) -> DataFrame:
    states = spark.createDataFrame([(s,) for s in ("committed", "skipped", "draft", "deferred", "reverted", "pending", "unseen")], "state string")
    return F.broadcast(states).join(ev.ledger(_log(spark, d)), "state", "left").groupBy("state").agg(F.count("target").alias("n"))


@query("SELECT count(*)||':'||substr(sha256(arg_max(props,event_id)),1,16) AS revision FROM events")
def log_revision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.concat(F.count("*").cast("string"), F.lit(":"), tx.short_digest(F.max_by("props", "event_id"))).alias("revision"))


@query("SELECT strftime(ts,'%Y%m') AS shard, count(*) AS n FROM events GROUP BY 1")
def monthly_shards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyyMM").alias("shard")).agg(F.count("*").alias("n"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.expr("event_id div 6").alias("batch_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("user_id").cast("string"))).otherwise("").alias("reason"), F.floor("value").cast("long").alias("tokens"))


_BATCH = "b AS (SELECT event_id//6 AS batch_id, event_id AS seq, event_type AS state, CASE WHEN event_type='error' THEN 'e'||user_id ELSE '' END AS reason, CAST(floor(value) AS BIGINT) AS tokens FROM events)"


@query(f"WITH {_BATCH} SELECT batch_id, arg_max(state,seq) AS state, arg_max(reason,seq) FILTER (WHERE reason<>'') AS reason, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE state='view') AS attempts FROM b GROUP BY 1")
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ev.batches(_batches(spark, d))


@query(f"WITH {_BATCH} SELECT state, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, min(tokens) AS least, max(tokens) AS most FROM b GROUP BY 1")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return _batches(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))


@query(f"WITH {_BATCH} SELECT from_state, state AS to_state, count(*) AS n FROM (SELECT *, lag(state) OVER (PARTITION BY batch_id ORDER BY seq) AS from_state FROM b) WHERE from_state IS NOT NULL GROUP BY 1,2")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    return ev.transitions(_batches(spark, d))


@query(f"WITH {_BATCH} SELECT batch_id, seq, CAST(sum(tokens) OVER (PARTITION BY batch_id ORDER BY seq) AS BIGINT) AS used, sum(tokens) OVER (PARTITION BY batch_id ORDER BY seq)>100 AS exceeded FROM b")
def budget_running_total(spark: SparkSession, d: str) -> DataFrame:
    used = F.sum("tokens").over(Window.partitionBy("batch_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _batches(spark, d).select("batch_id", "seq", used.alias("used"), (used > 100).alias("exceeded"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS id, o_orderkey//2 AS parent FROM orders WHERE o_orderkey//2 IN (SELECT o_orderkey FROM orders)),
  c AS (SELECT id, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.id, e.parent, depth+1 FROM c JOIN e ON c.ancestor=e.id WHERE depth<32) SELECT id, ancestor, depth FROM c""")
def lineage_chain(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    edges = ids.select("id", F.expr("id div 2").alias("parent")).join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    return ev.lineage(edges)


@query(f"""WITH {_VIOLATIONS}, j AS (SELECT u.k, source_text, translation, CASE WHEN trim(translation)='' THEN 'empty_translation' WHEN trim(translation)=trim(source_text) THEN 'untranslated'
    WHEN EXISTS (SELECT 1 FROM viol WHERE viol.k=u.k) THEN 'glossary_violation' END AS reason FROM u),
  s AS (SELECT source_text, min(translation)<>max(translation) AS split FROM j WHERE reason IS NULL GROUP BY 1)
  SELECT k, CASE WHEN reason IS NOT NULL THEN 'legacy_quarantined' WHEN split THEN 'legacy_suspect' ELSE 'legacy_clean' END AS classification,
    coalesce(reason, CASE WHEN split THEN 'source_translation_conflict' ELSE 'clean' END) AS reason FROM j LEFT JOIN s USING (source_text)""")
def legacy_classify(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame(list(TERMS.items()), "source string, target string")
    return review.classify_history(u_part(spark, d), terms).select("k", "classification", "reason")


@query(f"""WITH {U_SQL}, e AS (SELECT stable_identity, CASE WHEN k%2=0 THEN source_text WHEN k%5=0 THEN '' ELSE 'x' END AS text, source_text, translation FROM u WHERE k%3=0),
  c AS (SELECT *, trim(translation)='' AS we, trim(translation)=trim(source_text) AS wu, trim(text)='' AS ne, trim(text)=trim(source_text) AS nu FROM e)
  SELECT stable_identity, concat_ws(',', CASE WHEN we AND NOT ne THEN 'empty_translation' END, CASE WHEN wu AND NOT nu THEN 'untranslated' END) AS fixed,
    concat_ws(',', CASE WHEN we AND ne THEN 'empty_translation' END, CASE WHEN wu AND nu THEN 'untranslated' END) AS remaining,
    concat_ws(',', CASE WHEN ne AND NOT we THEN 'empty_translation' END, CASE WHEN nu AND NOT wu THEN 'untranslated' END) AS introduced FROM c""")
def recheck_verdict(spark: SparkSession, d: str) -> DataFrame:
    u = u_part(spark, d)
    text = F.when(F.col("k") % 2 == 0, F.col("source_text")).when(F.col("k") % 5 == 0, "").otherwise("x")
    out = review.verdicts(u, u.where("k % 3 = 0").select("stable_identity", text.alias("text")))
    return out.select("stable_identity", *[F.array_join(c, ",").alias(c) for c in ("fixed", "remaining", "introduced")])


@query(f"WITH {U_SQL} SELECT source_text, translation, count(*) AS n, row_number() OVER (PARTITION BY source_text ORDER BY count(*) DESC, translation) AS place FROM u GROUP BY 1,2")
def variant_plurality(spark: SparkSession, d: str) -> DataFrame:
    counted = u_part(spark, d).groupBy("source_text", "translation").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("source_text").orderBy(F.desc("n"), "translation")).cast("long"))


@query(f"""WITH {_BATCH} SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE state='purchase') AS done, count(*) FILTER (WHERE state='error') AS failed,
  CAST(count(*) FILTER (WHERE state IN ('purchase','error'))*100//count(*) AS BIGINT) AS percent FROM b GROUP BY 1""")
def resource_progress(spark: SparkSession, d: str) -> DataFrame:
    out = _batches(spark, d).groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "purchase").alias("done"), F.count_if(F.col("state") == "error").alias("failed"))
    return out.withColumn("percent", F.expr("(done + failed) * 100 div total"))


@query()
def token_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language and source as budgeted batches."""
    tokens = tx.token_estimate(F.coalesce("text", F.lit("")))
    units = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("relative_path"), F.col("doc_id").alias("ordinal"), (tokens + 4).alias("input_tokens"), (tokens + 2).alias("output_tokens"))
    return bt.pack(units, 400, *bt.budgets(32_000, 4_096))


@query()
def response_parse(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant text as the answer to one unit."""
    said = table(spark, d, "conversations").where("role = 'assistant'")
    answer = F.concat(F.lit("[1] "), F.coalesce("text", F.lit("")), F.lit("\n---END---"))
    got = said.select("conv_id", "turn", bt.parse_answer(answer, F.lit(1), F.lit("stop")).alias("r"))
    return got.select("conv_id", "turn", "r.error", F.sha2(F.element_at("r.translations", 1), 256).alias("digest"))


@query()
def normalize_source(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each document's source form."""
    return table(spark, d, "documents").select("doc_id", tx.short_digest(tx.source_form(F.col("text"))).alias("digest"))


@query()
def variant_diff(spark: SparkSession, d: str) -> DataFrame:
    """Character differences of each unit's source and translation."""
    cut = F.transform(tx.diff(F.col("source_text"), F.col("translation")), lambda o: F.concat(o["op"], F.lit(":"), o["text"]))
    return u_part(spark, d).select("k", F.array_join(cut, "|").alias("ops"))
