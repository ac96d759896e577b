import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb

import corpus_pipeline
from tessera.llm import near_dedup, quality


def kept_by_plain_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
    if len(w) < 50 or 100 * len(hit) > 50 * len(w):
        return False
    chars, lines = sum(map(len, w)), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        2 <= chars / len(w) <= 16 and len(re.findall(r"[#*$%&|<>]", text)) / chars <= 0.05
        and sum(x.lower() in quality.STOP_WORDS for x in w) / len(w) >= 0.03 and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and len(hit) / len(w) <= 0.5
    )


def shingles(text, lower):
    w = (text.lower() if lower == "all" else "".join(c.lower() if c.isascii() else c for c in text)).split()
    w = re.findall(r"[^\x20\x09-\x0D]+", " ".join(w)) if w else []
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_the_stages_in_order_are_those_of_plain_loops(spark):
    folder = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{folder}/documents.parquet'").fetchall()
    items = [shingles(t, "all") for (t,) in duckdb.sql(f"SELECT text FROM '{folder}/benchmark.parquet'").fetchall()]
    left = {i: t for i, t, _ in docs if kept_by_plain_rules(t)}
    assert 0 < len(left) < len(docs)
    sets, root = {i: shingles(t, "ascii") for i, t in left.items()}, {i: i for i in left}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    left = {i: t for i, t in left.items() if find(i) == i}
    left = {i: t for i, t in left.items() if not any(10 * len(x & shingles(t, "all")) >= 8 * len(x) for x in items if x)}
    out = corpus_pipeline.run(spark, folder).toPandas()
    times = Counter(out.doc_id)
    assert set(times) == set(left) and set(times.values()) <= {1, 2}  # every document at least once, no source more than twice
    assert all((r.size_, r.crc) == (len(left[r.doc_id].encode()) + 1, zlib.crc32(left[r.doc_id].encode())) for r in out.rename(columns={"size": "size_", "text_crc32": "crc"}).itertuples())
    n = out.groupby("shard").size()
    assert n.max() - n.min() <= 1 and all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)


def test_stages_in_order(spark):
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    n = out.groupBy("shard").count().toPandas()["count"]
    assert out.count() > 0 and n.max() - n.min() <= 1


def test_a_stage_keeps_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_dedup.linked(docs.dropDuplicates(["doc_id"])).where("not kept").count() == 0
