"""The inbox and replay protection as streams."""

from pyspark.sql import functions as F

from arborlake.functions.keys import text_key
from arborlake.streaming import inbox


def test_inbox_takes_what_is_new_once(spark, tmp_path):
    folder, store, failed, at = (str(tmp_path / x) for x in ("in", "store", "failed", "checkpoint"))

    def drop_in(rows):
        df = spark.createDataFrame(rows, "id int, text string, bad boolean")
        df.withColumn("key", F.when(F.col("bad"), F.lit("00")).otherwise(text_key(F.coalesce("text", F.lit(""))))).coalesce(1).write.mode("append").parquet(folder)

    def run():
        inbox.ingest(spark, folder, spark.read.parquet(folder).schema, "text", store, failed, at, key="key")
        return sorted(r.size for r in spark.read.parquet(store).collect()), sorted((r.id, r.reason) for r in spark.read.schema("id int, reason string").json(failed).collect())

    drop_in([(1, "a", False), (2, "a", False), (3, None, False), (4, "bbb", True)])
    assert run() == ([1], [(3, "payload"), (4, "key")])
    assert run() == ([1], [(3, "payload"), (4, "key")])
    drop_in([(5, "a", False), (6, "", False), (7, "bbb", False)])
    assert run() == ([0, 1, 3], [(3, "payload"), (4, "key")])


def test_roots_wait_for_their_files(spark):
    tagged = spark.createDataFrame([("f1", "a"), ("f2", "a"), ("f3", "b")], "file string, root string")
    done = spark.createDataFrame([("f1",), ("f3",), ("f3",)], "file string")
    roots = spark.createDataFrame([("a",), ("b",), ("c",)], "root string")
    assert sorted(map(tuple, inbox.waiting_roots(roots, tagged, done).collect())) == [("a", 1, False), ("b", 0, True), ("c", 0, True)]


def test_replays_are_dropped_from_a_stream(spark, tmp_path):
    rows = [("n1", "2024-01-01 00:00:00"), ("n1", "2024-01-01 00:00:30"), ("n2", "2024-01-01 00:00:10")]
    df = spark.createDataFrame(rows, "nonce string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "q"))
    stream = inbox.accepted(spark.readStream.schema(df.schema).parquet(str(tmp_path / "q")), ["nonce"], "at", "1 minute")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.nonce for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["n1", "n2"]
