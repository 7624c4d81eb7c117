"""Objects, segments and collection of garbage as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import RECORD_HEADER


def first_occurrences(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that comes first."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def newest_copies(records: DataFrame, key: str = "key", segment: str = "segment_id") -> DataFrame:
    """The copy that a read takes: that of the newest segment, by number."""
    if records.schema[segment].dataType.typeName() == "string":
        raise TypeError("segment ids are numbers: text sorts 9 after 10")
    w = Window.partitionBy(key).orderBy(F.desc(segment))
    return records.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def number_segments(records: DataFrame, writer: str, number: str, out: str) -> DataFrame:
    """``records`` plus a LONG segment id over the whole store: the segments of earlier writers count before."""
    each = records.groupBy(writer).agg((F.max(number) + 1).alias("n"))  # a row for each writer
    before = each.select(writer, (F.sum("n").over(Window.orderBy(writer)) - F.col("n")).alias("before"))
    return records.join(before, writer).withColumn(out, (F.col("before") + F.col(number)).cast("long")).drop("before")


def missing_keys(wanted: DataFrame, have: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``wanted`` whose key isn't in ``have``, repeated ones too."""
    return wanted.join(have.select(key).distinct(), key, "left_anti")


def present_keys(wanted: DataFrame, have: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(have.select(key).distinct(), key, "left_semi")


def in_other_segments(records: DataFrame) -> DataFrame:
    """Records whose key another segment holds too."""
    spread = records.groupBy("key").agg(F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi")).where("lo <> hi")
    return records.join(spread.select("key"), "key", "left_semi")


def record_size(slen: Column) -> Column:
    return slen + RECORD_HEADER


def liveness(records: DataFrame, live: DataFrame) -> DataFrame:
    """Per segment: live and dead keys and bytes (a record counts with its header)."""
    marked = records.join(live.select("key").distinct().withColumn("is_live", F.lit(True)), "key", "left")
    alive, size = F.col("is_live").isNotNull(), record_size(F.col("slen"))
    return marked.groupBy("segment_id").agg(
        F.count_if(alive).alias("live_keys"), F.count_if(~alive).alias("dead_keys"),
        F.sum(F.when(alive, size).otherwise(0)).alias("live_bytes"), F.sum(F.when(~alive, size).otherwise(0)).alias("dead_bytes"),
    )


def victims(scores: DataFrame, ratio: float, eligible: Column | None = None) -> DataFrame:
    """Segments worth rewriting: some key is dead, and dead bytes reach ``ratio`` of all."""
    chosen = scores.where((F.col("dead_keys") > 0) & (F.col("dead_bytes") >= ratio * (F.col("live_bytes") + F.col("dead_bytes"))))
    return chosen if eligible is None else chosen.where(eligible)


def selection_ratio(forced: float | None, free_share: float) -> float:
    """The line above which a segment is rewritten: forced, else 0.5, else 0.1 with less than 5 % of the disk free."""
    if forced is not None and forced >= 0:
        return forced
    return 0.1 if free_share < 0.05 else 0.5


def copy_set(records: DataFrame, chosen: DataFrame, live: DataFrame) -> DataFrame:
    """Live keys of the chosen segments that no other segment keeps: what a rewrite has to copy."""
    gone = records.join(chosen.select("segment_id"), "segment_id", "left_semi")
    stays = records.join(chosen.select("segment_id"), "segment_id", "left_anti")
    return gone.join(live.select("key"), "key", "left_semi").join(stays.select("key"), "key", "left_anti").select("key", "slen").distinct()


def fanout(keys: DataFrame, key: str = "key") -> DataFrame:
    """Keys by their last byte, with the running count that an index starts with."""
    counts = keys.select(F.conv(F.substring(key, 63, 2), 16, 10).cast("int").alias("byte")).groupBy("byte").count()
    return counts.select("byte", F.col("count").alias("n_keys"), F.sum("count").over(Window.orderBy("byte")).alias("cumulative"))  # at most 256 rows


def compact(records: DataFrame, live: DataFrame, grey: DataFrame | None, ratio: float, new_segment: int) -> tuple[DataFrame, DataFrame]:
    """(records after a cycle, chosen segments): live keys and those seen by writes meanwhile survive."""
    kept = live.select("key") if grey is None else live.select("key").unionByName(grey.select("key")).distinct()
    chosen = victims(liveness(records, kept), ratio)
    moved = copy_set(records, chosen, kept).select("key", "slen", F.lit(new_segment).cast("long").alias("segment_id"))
    stays = records.join(chosen.select("segment_id"), "segment_id", "left_anti")
    return stays.select("key", "slen", "segment_id").unionByName(moved), chosen


def located(wanted: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """``wanted`` plus ``segment_id, off, slen`` of the newest copy of its key, and ``found``."""
    return wanted.join(newest_copies(index, key), key, "left").withColumn("found", F.col("segment_id").isNotNull())


def eligible(segments: DataFrame, horizon: int | None) -> DataFrame:
    """``segments`` (sealed, sealed_at) plus ``eligible``: sealed, and not after the horizon."""
    return segments.withColumn("eligible", F.coalesce(F.col("sealed") & (F.col("sealed_at") <= F.lit(horizon)), F.lit(False)))


def valid_prefix(records: DataFrame, good: str = "good") -> DataFrame:
    """Records before the first of their segment (by ``off``) that isn't good; what follows it is never looked at again."""
    bad = records.where(~F.col(good)).groupBy("segment_id").agg(F.min("off").alias("bad_at"))
    return records.join(bad, "segment_id", "left").where(F.col("bad_at").isNull() | (F.col("off") < F.col("bad_at"))).drop("bad_at")


def scrub(records: DataFrame, index: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment: records, index entries that point elsewhere or nowhere, and whether the records end where it does."""
    both = records.select("segment_id", "key", "off", "slen").join(index.select("segment_id", "key", "at"), ["segment_id", "key"], "left")
    sums = both.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("at").isNull() | (F.col("at") != F.col("off"))).alias("misplaced"), F.max(F.col("off") + record_size(F.col("slen"))).alias("end"))
    return sums.join(segments, "segment_id").select("segment_id", "n_records", "misplaced", (F.col("end") == F.col("body")).alias("ends_well"))
