"""Every registered query outside ``llm`` against its SQL, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from arborlake.plans import catalogue
from arborlake.plans import relations as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if isinstance(v, Decimal) and v == int(v) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert got or name in ("has_outside",)


def test_every_level(spark):
    rows = catalogue.QUERIES["prolly_tree"](spark, SF).collect()
    top = {d: max(r.level for r in rows if r.directory == d) for d in {r.directory for r in rows}}
    assert max(top.values()) > 1 and all(sum(r.level == n for r in rows if r.directory == d) == 1 for d, n in top.items())


def test_every_file(spark):
    files = {r.h for r in R.documents(spark, SF).select("h").distinct().collect()}
    assert {r.wanted for r in catalogue.QUERIES["why_every_file"](spark, SF).collect()} == {f"f|{h}" for h in files}


def test_every_probe(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id").distinct().collect()
    got = {(r.directory, int(r.name)) for r in catalogue.QUERIES["lookup_every_entry"](spark, SF).collect()}
    assert got == {(r.source, r.doc_id + 7) for r in docs}


def test_every_reference_is_marked(spark):
    got = [r.node for r in catalogue.QUERIES["mark_every_live"](spark, SF).collect()]
    assert len(got) == len(set(got)) and {r.node for r in R.refs(spark, SF).collect()} <= set(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
