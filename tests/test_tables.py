"""Written tables: where they lie, when they go, and what may be broadcast."""

import os
from types import SimpleNamespace

import pytest

from arborlake.sources import tables


def test_a_cluster_must_name_the_shared_folder(monkeypatch):
    monkeypatch.setattr(tables, "_own", {})
    session = lambda master, **conf: SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            tables.shared_dir(session(master))
        assert tables.shared_dir(session(master, **{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"


def test_written_tables_are_read_back_and_go(spark):
    before = spark.conf.get(tables.CLEANUP, "false")
    t = tables.written(spark.range(10), "numbers")
    assert os.path.isdir(t.written_to) and t.count() == 10 and spark.conf.get(tables.CLEANUP) == before
    tables.discard(t)
    assert not os.path.exists(t.written_to) and t.written_to not in tables._written
    tables.discard(t)  # what is gone stays gone


def test_only_a_proven_size_is_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    t = tables.written(spark.range(1000).selectExpr("id", "unhex('00112233') AS b", "'x' AS s"), "sized")
    assert "strategy=broadcast" in plan(spark.range(5).join(tables.small(t.select("id")), "id"))
    assert "strategy=broadcast" not in plan(spark.range(5).join(tables.small(t.select("id"), most=1000), "id"))
    assert "strategy=broadcast" in plan(spark.range(5).join(tables.small(t.select("id", "b"), binary=4), "id"))
    for columns in (["id", "s"], ["id", "b"]):
        with pytest.raises(TypeError, match="width"):
            tables.small(t.select(*columns))
