"""The corpus as a content-addressed tree: relations for the registered queries, and their SQL.

A document is a file at /source/lang/doc_id; its lines are its chunks.  Objects
are distinct texts, first occurrence by doc_id.  A source is a writer, whose
objects fill segments in order, and also a reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import SEGMENT_HEADER, text_key
from ..operators.folds import SegmentFold, fold
from ..operators.store import first_occurrences, number_segments, record_size
from ..sources.tables import table

SEGMENT_BYTES = 65536


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, lang, text, size, h, key"""
    t = table(spark, d, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return t.select("*", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("h"), text_key(F.col("text")).alias("key"))


def objects(spark: SparkSession, d: str) -> DataFrame:
    """key, size, source, doc_id: each text once."""
    return first_occurrences(documents(spark, d).select("key", "size", "source", "doc_id"), "key", ["doc_id"])


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, pos (from 0), line, size"""
    t = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    return t.select("doc_id", "source", F.col("pos").cast("long").alias("pos"), "line", F.octet_length("line").cast("long").alias("size"))


def records(spark: SparkSession, d: str) -> DataFrame:
    """key, slen, segment_id (LONG, numbered over the store in the order of writers), source, doc_id.  A source writes all
    its files, so a text that two sources have is stored twice."""
    own = documents(spark, d).select("source", "key", "size", "doc_id")
    own = own.groupBy("source", "key", "size").agg(F.min("doc_id").alias("doc_id"))
    cutting = fold(own, SegmentFold(SEGMENT_BYTES), ["source"], ["doc_id"], ["size"], "n")
    numbered = number_segments(cutting, "source", "n", "segment_id")
    return numbered.select("key", F.col("size").alias("slen"), "segment_id", "source", "doc_id")


def placed(spark: SparkSession, d: str) -> DataFrame:
    """``records`` plus ``off``, the byte in its segment where each begins."""
    w = Window.partitionBy("segment_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return records(spark, d).withColumn("off", F.coalesce(F.sum(record_size(F.col("slen"))).over(w), F.lit(0)) + SEGMENT_HEADER)


def segments(spark: SparkSession, d: str) -> DataFrame:
    """segment_id, source, n_keys, body, sealed, sealed_at: a writer's last segment is still open; a segment is sealed with
    its last record, a record is written in the second of its doc_id."""
    own = records(spark, d).groupBy("segment_id", "source").agg(F.count(F.lit(1)).alias("n_keys"), (F.sum(record_size(F.col("slen"))) + SEGMENT_HEADER).alias("body"), F.max("doc_id").alias("last"))
    sealed = F.col("segment_id") < F.max("segment_id").over(Window.partitionBy("source"))
    return own.select("segment_id", "source", "n_keys", "body", sealed.alias("sealed"), F.when(sealed, F.col("last")).alias("sealed_at"))


def live_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the references of English and German files keep."""
    return documents(spark, d).where("lang IN ('en', 'de')").select("key").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, child: source, directory, file and line nodes.  Rows of equal text meet by their lines' hashes: 32 bytes of a
    line travel, not the line."""
    t = documents(spark, d)
    file, folder = F.concat(F.lit("f|"), "h"), F.concat_ws("|", F.lit("d"), "source", "lang")
    top = t.select(F.concat(F.lit("s|"), "source").alias("parent"), folder.alias("child"))
    mid = t.select(folder.alias("parent"), file.alias("child"))
    hashes = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.sha2(x, 256)))
    packed = t.select("h", F.unhex(F.array_join(hashes, "")).alias("lines")).dropDuplicates(["h"])
    each = F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("lines"), F.lit(32)), lambda i: F.col("lines").substr(i, F.lit(32))))
    low = packed.select(file.alias("parent"), each.alias("line")).select("parent", F.concat(F.lit("l|"), F.lower(F.hex("line"))).alias("child"))
    return top.distinct().unionByName(mid.distinct()).unionByName(low)


def refs(spark: SparkSession, d: str) -> DataFrame:
    """name, node: a reference for every source."""
    return table(spark, d, "documents").select(F.col("source").alias("name"), F.concat(F.lit("s|"), "source").alias("node")).distinct()


def present_nodes(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    """The nodes of a store that lost some: those whose last hex digit isn't 7, and all but files and lines.  e: its edges,
    where they are there already."""
    e = edges(spark, d) if e is None else e
    nodes = e.select(F.col("parent").alias("node")).unionByName(e.select(F.col("child").alias("node"))).distinct()
    return nodes.where("node NOT LIKE '%7' OR node LIKE 's|%' OR node LIKE 'd|%'")


def sql_length(size: str) -> str:
    x = f"format('{{:x}}', {size})"
    return f"(CASE WHEN length({x}) % 2 = 1 THEN '0' || {x} ELSE {x} END)"


def sql_key(kind: int, size: str, h: str) -> str:
    p = sql_length(size)
    return f"(format('{{:02x}}', {kind} * 16 + length({p}) // 2 - 1) || {p} || substr({h}, 1, 62 - length({p})))"


DOCS = f"""docs AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS h,
    {sql_key(0, "strlen(coalesce(text, ''))", "sha256(coalesce(text, ''))")} AS key
  FROM documents
)"""
OBJECTS = f"""{DOCS}, objects AS (
  SELECT key, size, source, doc_id FROM docs QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1
)"""
LINES = """lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
)"""
RECORDS = f"""{DOCS}, own AS (
  SELECT source, key, size, min(doc_id) AS doc_id FROM docs GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM own
), cutting AS (
  SELECT source, key, size, doc_id, rn, CAST(0 AS BIGINT) AS n, 8 + 46 + size AS fill FROM numbered WHERE rn = 1
  UNION ALL
  SELECT b.source, b.key, b.size, b.doc_id, b.rn,
    CASE WHEN a.fill >= {SEGMENT_BYTES} THEN a.n + 1 ELSE a.n END,
    CASE WHEN a.fill >= {SEGMENT_BYTES} THEN 8 ELSE a.fill END + 46 + b.size
  FROM cutting a JOIN numbered b ON b.source = a.source AND b.rn = a.rn + 1
), records AS (
  SELECT key, size AS slen, dense_rank() OVER (ORDER BY source, n) - 1 AS segment_id, source, doc_id FROM cutting
), live AS (
  SELECT DISTINCT key FROM docs WHERE lang IN ('en', 'de')
)"""
GRAPH = f"""{DOCS}, edges AS (
  SELECT 's|' || source AS parent, 'd|' || source || '|' || lang AS child FROM docs
  UNION SELECT 'd|' || source || '|' || lang, 'f|' || h FROM docs
  UNION SELECT 'f|' || h, 'l|' || sha256(line) FROM (SELECT h, unnest(string_split(text, chr(10))) AS line FROM docs)
), refs AS (
  SELECT DISTINCT source AS name, 's|' || source AS node FROM docs
), present AS (
  SELECT node FROM (SELECT parent AS node FROM edges UNION SELECT child FROM edges)
  WHERE node NOT LIKE '%7' OR node LIKE 's|%' OR node LIKE 'd|%'
)"""
PLACED = f"""{RECORDS}, placed AS (
  SELECT *, 8 + CAST(coalesce(sum(46 + slen) OVER (PARTITION BY segment_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM records
), segments AS (
  SELECT segment_id, source, count(*) AS n_keys, CAST(sum(46 + slen) + 8 AS BIGINT) AS body, max(doc_id) AS last, segment_id < max(segment_id) OVER (PARTITION BY source) AS sealed FROM records GROUP BY segment_id, source
)"""
