"""The pipeline's stages against plain versions of them, and the registered queries against their SQL."""

import re
import subprocess
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from arborlake.llm import ngram_join, queries, substring_dedup
from arborlake.llm.common import cut, read_table

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0)], docs.schema)
    out = [cut(docs.unionByName(odd), "test")]
    for name, f in pipeline.STAGES:
        out.append(cut(f(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == pipeline.COLUMNS
        assert df.where("n_chars <> length(text)").isEmpty() or df is stages[0]


def test_quality_stage(spark, stages):
    got = texts(stages[1])
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    before = texts(stages[0])
    for i, q in labels.items():
        short = len(W.findall(before[i])) < 50
        assert (i in got) == (q == 1 and not short)


def rows_of(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_near_copies_stage(stages):
    from test_llm_operators import brute_components

    before, after = stages[1].collect(), rows_of(stages[2])
    # by position: every row is a document of its own
    want = brute_components([(i, r.text) for i, r in enumerate(sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)))], 5, 80)
    at = {i: r for i, r in enumerate(sorted(before, key=lambda r: (r.doc_id is None, r.doc_id)))}
    assert after == sorted((str(at[i].doc_id), at[i].text) for i, [(_, c)] in want.items() if i == c)


def test_passages_stage(stages):
    before, after = texts(stages[2]), texts(stages[3])
    words = {i: W.findall(t) for i, t in before.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    assert set(before) == set(after)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        assert after[i] == (" ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else before[i])


def test_secrets_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    assert not any(re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", t) for t in after.values())
    clean = [i for i, t in before.items() if not re.search(r"(?i)password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{16}", t)]
    assert clean and all(before[i] == after[i] for i in clean)


def test_packing_stage(stages):
    rows = stages[5].collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(by) == set(texts(stages[4]))
    for p in by.values():
        at = 0
        for start, length, total in sorted(p):
            assert start == at
            at += length
        assert at == total


def test_rows_without_or_with_repeated_ids(spark):
    """No text is lost with its id, and of groups whose rows all lack an id one stays."""
    base, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(1, base), (2, base + " x"), (None, base), (None, "other " + base[::-1]), (3, "third " * 3), (5, "one text here"), (5, "and one more text"), (None, other), (None, other + " y"), (7, ""), (8, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_copies(spark, df, SF).collect()
    assert sorted((str(r.doc_id), r.text[:5]) for r in got) == [("1", "w0 w1"), ("3", "third"), ("5", "and o"), ("5", "one t"), ("7", ""), ("8", ""), ("None", "other"), ("None", "v0 v1")]


def test_stages_on_an_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    text = "\n".join(f"Line {i} of clean text says {' '.join(f'thing{i}x{j}' for j in range(6))} here." for i in range(12))
    again = spark.createDataFrame([(1, text, "en", "s", len(text))] * 3 + [(1, text + "\nOne more line of clean text is here.", "en", "s", 0)], docs.schema)
    for name, stage in pipeline.STAGES:
        docs, again = cut(stage(spark, docs, SF), name), cut(stage(spark, again, SF), name)
        assert docs.count() == 0
        assert again.count() == {"quality_rules": 4}.get(name, 1)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    tables = {"op2_exact_topk": "embeddings", "op10_url_filter": "pages"}
    n = read_table(spark, SF, tables.get(name, "documents")).count()
    assert len(rows) >= (n if name != "op2_exact_topk" else 1)
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(queries.ORACLE_SQL[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(x) for x in columns]
        plain = lambda v: int(v) if isinstance(v, Decimal) else v
        assert sorted(tuple(r[x] for x in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op3_language_id(spark, d).join(read_table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_idle_workers_give_memory_back():
    """What a task freed does not stay with its process, which waits beside the next stage."""
    code = """
import re
from arborlake.llm import substring_dedup
from arborlake.llm.common import frugal
def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) >> 10
pins = []
def work(batches):
    texts = [bytes(2000) for _ in range(100_000)]
    pins.append(bytes(2000))
    yield len(texts)
first = held()
assert list(frugal(work)(iter([]))) == [100_000]
print(held() - first)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 50
    for f in (substring_dedup, ngram_join):
        source = Path(f.__file__).read_text()
        assert source.count("mapInArrow(") == source.count("mapInArrow(frugal(") > 0
