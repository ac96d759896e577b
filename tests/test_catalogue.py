"""Each query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        held.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return held


def plain(x):
    return None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    quoted = ", ".join(f'"{c}"' for c in names)
    theirs = sorted(repr([plain(v) for v in r]) for r in duck.sql(f"SELECT {quoted} FROM ({catalogue.SQL[name]})").fetchall())
    assert mine == theirs


def test_residue_is_found_in_every_language(spark, tmp_path):
    rows = [(1, "en", "a Größe here"), (2, "de", "die größe"), (3, None, "für größe"), (4, "fr", "rien"), (5, "en", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["residue_fragments"](spark, str(tmp_path)).collect()}
    assert got == {("en", "größe", 1), ("de", "größe", 1), (None, "für", 1), (None, "größe", 1)}
