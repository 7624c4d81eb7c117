"""A corpus pipeline of five stages, each an operator of ``arborlake.llm``.

Every stage takes all that its predecessor kept.  ``run`` writes each stage's
result to the shared folder and reads it for the next, so a lost executor costs
a reread.  All but the last stage return the columns of ``documents``, with
``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.common import cut, drop, fresh, read_table
from arborlake.llm.ngram_join import link_components
from arborlake.llm.packing import pack_documents
from arborlake.llm.quality_rules import judge
from arborlake.llm.secret_scan import redact, scan
from arborlake.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines.  Null texts are rejected, repeated rows judged alike."""
    kept = judge(docs.select(*COLUMNS)).where("kept")
    return _as_documents(kept.withColumn("text", F.when(F.col("lost_chars") > 0, F.col("clean_text")).otherwise(F.col("text"))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id: five words, similarity 0.8.

    Groups are of texts, not of ids: rows with the same id and different texts are
    judged each on its own, and rows without an id as well.  Empty texts stay.
    """
    (body,) = fresh(COLUMNS, "body")
    found = link_components(docs.select(*COLUMNS).withColumn(body, F.col("text")), text=body, n=5, percent=80)
    kept = cut(found.where("leads_group").select(*COLUMNS), "kept")
    drop(*found.reads)
    return kept


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that also start elsewhere go; documents without such words keep their text as it is."""
    found = remove_repeats(docs.select(*COLUMNS))
    return _as_documents(found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; null texts become empty, repeated rows are treated alike."""
    return _as_documents(redact(scan(docs.select(*COLUMNS))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset; an empty text is one piece, repeated rows are packed each on its own."""
    return pack_documents(docs.select("doc_id", "text")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("ngram_join", near_copies), ("substring_dedup", repeated_passages), ("secret_scan", secrets), ("packing", packing)]

#: Substring windows, components and tokenization have no SQL of reasonable cost; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents").select(*COLUMNS), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
