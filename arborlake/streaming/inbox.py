"""Incremental ingestion as Structured Streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import text_key
from ..sources.tables import shared_dir

OBJECTS = "key string, size bigint"


def ingest(spark: SparkSession, folder: str, schema: StructType, text: str, store: str, failed: str, checkpoint: str, key: str | None = None) -> None:
    """Take what is new in ``folder`` into ``store`` once: verify, drop what is there already, append.

    A row fails if it has no payload, or if its payload isn't what its ``key`` (a
    column of the folder, if there is one) says; it goes to ``failed`` with the
    ``reason``, and the rest of its file is taken all the same.  A batch that runs
    again after a failure finds its objects stored, so it adds nothing.  Of the
    store only the keys are read.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        own = text_key(F.col(text))
        reason = F.when(F.col(text).isNull(), "payload")
        if key is not None:
            reason = reason.when(~F.col(key).eqNullSafe(own), "key")
        judged = batch.withColumn("reason", reason)
        judged.where("reason IS NOT NULL").write.mode("append").json(failed)
        new = judged.where("reason IS NULL").select(own.alias("key"), F.octet_length(text).cast("long").alias("size")).dropDuplicates(["key"])
        have = spark.read.schema(OBJECTS).parquet(store).select("key")
        new.join(have, "key", "left_anti").write.mode("append").parquet(store)
        batch.unpersist()

    spark.createDataFrame([], OBJECTS).write.mode("append").parquet(store)
    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def waiting_roots(roots: DataFrame, tagged: DataFrame, done: DataFrame) -> DataFrame:
    """``roots`` (root) plus ``n_waiting`` and ``open``: a reference to a root is taken once no file tagged with it waits.

    tagged: ``file, root``; done: ``file``, taken or failed.
    """
    left = tagged.join(done.select("file").distinct(), "file", "left_anti").groupBy("root").agg(F.count(F.lit(1)).alias("n_waiting"))
    return roots.join(left, "root", "left").withColumn("n_waiting", F.coalesce("n_waiting", F.lit(0))).withColumn("open", F.col("n_waiting") == 0)


def ingest_table(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The objects of a folder after an ingestion into a new store."""
    base = f"{shared_dir(spark)}/inbox-{uuid.uuid4().hex}"
    # a pattern that matches only itself, so that a table of one file will do as well as a folder
    ingest(spark, f"{folder[:-1]}[{folder[-1]}]", spark.read.parquet(folder).schema, text, f"{base}/store", f"{base}/failed", f"{base}/checkpoint")
    return spark.read.schema(OBJECTS).parquet(f"{base}/store")


def accepted(requests: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """A stream's requests without replays: one row of a key within the watermark's delay."""
    return requests.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)
