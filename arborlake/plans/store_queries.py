"""Queries over keys, objects, segments and garbage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import store
from ..operators.folds import BatchFold, fold
from ..sources.tables import table
from . import relations as R

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {R.DOCS} SELECT doc_id, key FROM docs")
def blob_keys(s, d):
    return R.documents(s, d).select("doc_id", "key")


@query(f"""WITH {R.DOCS} SELECT doc_id, CAST(('0x' || substr(key, 1, 2))::INT // 16 AS INT) AS kind,
  CAST(('0x' || substr(key, 1, 2))::INT % 8 + 1 AS INT) AS len_size, size AS length,
  substr(key, 3 + 2 * (('0x' || substr(key, 1, 2))::INT % 8 + 1)) AS digest FROM docs""")
def key_fields(s, d):
    k = F.col("key")
    return R.documents(s, d).select("doc_id", K.key_type(k).cast("int").alias("kind"), K.key_length_bytes(k).cast("int").alias("len_size"), K.key_length(k).cast("long").alias("length"), K.key_digest(k).alias("digest"))


@query(f"""WITH {R.DOCS}, bent AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN key WHEN 1 THEN '0f' || substr(key, 3)
  WHEN 2 THEN '70' || substr(key, 3) WHEN 3 THEN '0100' || substr(key, 5) ELSE substr(key, 3) END AS key FROM docs)
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'reserved_bit' WHEN 2 THEN 'reserved_type' WHEN 3 THEN 'length_padding' WHEN 4 THEN 'size' END AS error FROM bent""")
def key_canonical_check(s, d):
    k, i = F.col("key"), F.col("doc_id") % 5
    bent = F.when(i == 0, k).when(i == 1, F.concat(F.lit("0f"), F.substring(k, 3, 64))).when(i == 2, F.concat(F.lit("70"), F.substring(k, 3, 64))).when(i == 3, F.concat(F.lit("0100"), F.substring(k, 5, 64))).otherwise(F.substring(k, 3, 64))
    return R.documents(s, d).select("doc_id", K.key_error(bent).alias("error"))


@query(f"""WITH {R.DOCS}, first AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS nth FROM docs)
SELECT source, count(*) FILTER (nth = 1) AS stored, count(*) FILTER (nth > 1) AS deduped,
  CAST(coalesce(sum(size) FILTER (nth = 1), 0) AS BIGINT) AS bytes_stored FROM first GROUP BY source""")
def dedup_stats(s, d):
    docs = R.documents(s, d).select("source", "key", "size", "doc_id")
    first = docs.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")))
    return first.groupBy("source").agg(F.count_if(F.col("nth") == 1).alias("stored"), F.count_if(F.col("nth") > 1).alias("deduped"), F.sum(F.when(F.col("nth") == 1, F.col("size")).otherwise(0)).alias("bytes_stored"))


@query(f"WITH {R.DOCS} SELECT key, count(*) AS copies, min(doc_id) AS first_doc FROM docs GROUP BY key HAVING count(*) > 1")
def dup_groups(s, d):
    return R.documents(s, d).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"WITH {R.RECORDS} SELECT source, segment_id, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(46 + slen) + 8 AS BIGINT) AS body, min(doc_id) AS first_doc FROM records GROUP BY ALL".replace("WITH", "WITH RECURSIVE", 1))
def segment_assign(s, d):
    return R.records(s, d).groupBy("source", "segment_id").agg(F.count(F.lit(1)).alias("n_keys"), (F.sum(store.record_size(F.col("slen"))) + K.SEGMENT_HEADER).alias("body"), F.min("doc_id").alias("first_doc"))


@query(f"WITH RECURSIVE {R.RECORDS} SELECT key, segment_id FROM records r WHERE EXISTS (SELECT 1 FROM records o WHERE o.key = r.key AND o.segment_id <> r.segment_id)")
def has_outside(s, d):
    return store.in_other_segments(R.records(s, d)).select("key", "segment_id")


@query(f"WITH RECURSIVE {R.RECORDS} SELECT key, max(segment_id) AS segment_id FROM records GROUP BY key")
def newest_copy(s, d):
    return store.newest_copies(R.records(s, d)).select("key", "segment_id")


_WANT = f"WITH {R.DOCS}, have AS (SELECT key FROM docs WHERE lang = 'en' OR doc_id % 3 = 0) SELECT doc_id AS pos, key FROM docs WHERE key NOT IN (SELECT key FROM have)"


def _have(docs):
    return docs.where("lang = 'en' OR doc_id % 3 = 0")


@query(_WANT)
def missing_keys(s, d):
    docs = R.documents(s, d).select(F.col("doc_id"), "lang", "key")
    return store.missing_keys(docs.select(F.col("doc_id").alias("pos"), "key"), _have(docs)).select("pos", "key")


@query(_WANT.replace("key NOT IN", "key IN"))
def has_keys(s, d):
    docs = R.documents(s, d).select(F.col("doc_id"), "lang", "key")
    return store.present_keys(docs.select(F.col("doc_id").alias("pos"), "key"), _have(docs)).select("pos", "key")


_SCORE = f"""WITH RECURSIVE {R.RECORDS}, score AS (
  SELECT segment_id, count(*) FILTER (key IN (SELECT key FROM live)) AS live_keys, count(*) FILTER (key NOT IN (SELECT key FROM live)) AS dead_keys,
    CAST(coalesce(sum(46 + slen) FILTER (key IN (SELECT key FROM live)), 0) AS BIGINT) AS live_bytes,
    CAST(coalesce(sum(46 + slen) FILTER (key NOT IN (SELECT key FROM live)), 0) AS BIGINT) AS dead_bytes
  FROM records GROUP BY segment_id
)"""


def _scores(s, d):
    return store.liveness(R.records(s, d), R.live_keys(s, d))


@query(f"{_SCORE} SELECT * FROM score")
def segment_liveness(s, d):
    return _scores(s, d)


@query(f"""{_SCORE.replace(R.RECORDS, R.PLACED)} SELECT segment_id, live_bytes + dead_bytes AS body, round(CASE WHEN live_bytes + dead_bytes = 0 THEN 0 ELSE dead_bytes / (live_bytes + dead_bytes) END, 6) AS garbage,
  coalesce(sealed AND last <= (SELECT max(doc_id) FROM docs) - 300, false) AS eligible FROM score JOIN (SELECT segment_id, sealed, last FROM segments) USING (segment_id)""")
def pack_status(s, d):
    body = F.col("live_bytes") + F.col("dead_bytes")
    now = R.documents(s, d).agg(F.max("doc_id") - 300).first()[0]
    may = store.eligible(R.segments(s, d), now).select("segment_id", "eligible")
    return _scores(s, d).join(may, "segment_id").select("segment_id", body.alias("body"), F.round(F.when(body == 0, 0.0).otherwise(F.col("dead_bytes") / body), 6).alias("garbage"), "eligible")


@query(f"{_SCORE} SELECT segment_id, dead_keys, dead_bytes FROM score WHERE dead_keys > 0 AND dead_bytes >= 0.5 * (live_bytes + dead_bytes)")
def gc_victims(s, d):
    return store.victims(_scores(s, d), store.selection_ratio(None, 1.0)).select("segment_id", "dead_keys", "dead_bytes")


_VICTIMS = f"{_SCORE}, victim AS (SELECT segment_id FROM score WHERE dead_keys > 0 AND dead_bytes >= 0.3 * (live_bytes + dead_bytes)), copied AS (SELECT DISTINCT key, slen FROM records WHERE segment_id IN (SELECT segment_id FROM victim) AND key IN (SELECT key FROM live) AND key NOT IN (SELECT key FROM records WHERE segment_id NOT IN (SELECT segment_id FROM victim)))"


@query(f"{_VICTIMS} SELECT key, slen FROM copied")
def gc_copy_set(s, d):
    r, live = R.records(s, d), R.live_keys(s, d)
    return store.copy_set(r, store.victims(store.liveness(r, live), 0.3), live)


@query(f"{_SCORE} SELECT CAST(sum(live_bytes) AS BIGINT) AS live_bytes, CAST(sum(dead_bytes) AS BIGINT) AS dead_bytes, count(*) AS n_segments, (SELECT count(*) FROM live) AS n_marked, (SELECT count(DISTINCT source) FROM docs) AS n_refs FROM score")
def gc_totals(s, d):
    names = ("live_bytes", "dead_bytes", "n_segments", "n_marked", "n_refs")
    row = lambda df, **x: df.select(*[x.get(c, F.lit(0)).cast("long").alias(c) for c in names])
    parts = row(_scores(s, d), live_bytes=F.col("live_bytes"), dead_bytes=F.col("dead_bytes"), n_segments=F.lit(1)).unionByName(row(R.live_keys(s, d), n_marked=F.lit(1))).unionByName(row(R.refs(s, d), n_refs=F.lit(1)))
    return parts.agg(*[F.sum(c).alias(c) for c in names])


@query(f"WITH {R.DOCS} SELECT key FROM docs WHERE lang IN ('en', 'de') UNION SELECT key FROM docs WHERE doc_id % 10 = 3")
def grey_union(s, d):
    return R.live_keys(s, d).unionByName(R.documents(s, d).where("doc_id % 10 = 3").select("key")).distinct()


@query(f"{_VICTIMS} SELECT (SELECT count(*) FROM score) AS scored, (SELECT count(*) FROM victim) AS reaped, (SELECT count(*) FROM copied) AS copied_records, (SELECT CAST(coalesce(sum(46 + slen), 0) AS BIGINT) FROM copied) AS copied_bytes, (SELECT CAST(sum(46 + slen) AS BIGINT) FROM records WHERE segment_id IN (SELECT segment_id FROM victim)) - (SELECT CAST(coalesce(sum(46 + slen), 0) AS BIGINT) FROM copied) AS freed_bytes")
def gc_cycle_stats(s, d):
    r, live = R.records(s, d), R.live_keys(s, d)
    scores = store.liveness(r, live)
    chosen = store.victims(scores, 0.3)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    row = lambda df, **x: df.select(*[x.get(c, zero).alias(c) for c in ("scored", "reaped", "copied_records", "copied_bytes", "gone")])
    parts = row(scores, scored=one).unionByName(row(chosen, reaped=one, gone=F.col("live_bytes") + F.col("dead_bytes"))).unionByName(row(store.copy_set(r, chosen, live), copied_records=one, copied_bytes=store.record_size(F.col("slen"))))
    out = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    return out.select("scored", "reaped", "copied_records", "copied_bytes", (F.col("gone") - F.col("copied_bytes")).alias("freed_bytes"))


@query(f"WITH {R.OBJECTS}, c AS (SELECT CAST(('0x' || substr(key, 63, 2))::INT AS INT) AS byte, count(*) AS n_keys FROM objects GROUP BY 1) SELECT byte, n_keys, CAST(sum(n_keys) OVER (ORDER BY byte) AS BIGINT) AS cumulative FROM c")
def fanout_histogram(s, d):
    return store.fanout(R.objects(s, d))


@query(f"WITH {R.OBJECTS} SELECT key, substr(key, 63, 2) AS bucket, row_number() OVER (PARTITION BY substr(key, 63, 2) ORDER BY key) AS place FROM objects")
def index_order(s, d):
    return R.objects(s, d).select("key", F.substring("key", 63, 2).alias("bucket"), F.row_number().over(Window.partitionBy(F.substring("key", 63, 2)).orderBy("key")).cast("long").alias("place"))


@query(f"WITH RECURSIVE {R.PLACED} SELECT segment_id, key, off, slen FROM placed")
def record_offsets(s, d):
    return R.placed(s, d).select("segment_id", "key", "off", "slen")


_BEST = f"WITH RECURSIVE {R.PLACED}, best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment_id DESC) = 1)"


@query(f"""{_BEST}, found AS (SELECT docs.doc_id, docs.key, best.segment_id, best.off FROM docs LEFT JOIN (SELECT * FROM best WHERE key IN (SELECT key FROM live)) best USING (key))
SELECT doc_id, key, segment_id, CASE WHEN segment_id IS NULL THEN 1 ELSE 0 END AS absent, rank() OVER (PARTITION BY segment_id ORDER BY off) AS place FROM found""")
def location_order(s, d):
    """Where to read what: present keys by segment and offset, the place within the segment with ties for repeated keys."""
    best = store.newest_copies(R.placed(s, d)).select("key", "segment_id", "off").join(R.live_keys(s, d), "key", "left_semi")
    out = R.documents(s, d).select("doc_id", "key").join(best, "key", "left")
    place = F.rank().over(Window.partitionBy("segment_id").orderBy("off")).cast("long")
    return out.select("doc_id", "key", "segment_id", F.when(F.col("segment_id").isNull(), 1).otherwise(0).alias("absent"), place.alias("place")).orderBy("absent", "segment_id", "place")


@query(f"{_BEST}, wanted AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN substr(key, 1, 60) || 'ffff' ELSE key END AS key FROM docs) SELECT doc_id, wanted.key, segment_id, off, slen, segment_id IS NOT NULL AS found FROM wanted LEFT JOIN (SELECT key, segment_id, off, slen FROM best) USING (key)")
def get_object(s, d):
    """Where each wanted key is read: the newest copy's segment, offset and stored length; one key in five is of nothing stored."""
    wanted = R.documents(s, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring("key", 1, 60), F.lit("ffff"))).otherwise(F.col("key")).alias("key"))
    return store.located(wanted, R.placed(s, d).select("key", "segment_id", "off", "slen"))


@query(f"{_BEST} SELECT key, slen FROM best")
def stored_size(s, d):
    return store.newest_copies(R.placed(s, d)).select("key", "slen")


@query(f"WITH RECURSIVE {R.PLACED} SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY off) AS nth, key, off, slen FROM placed")
def segment_scan(s, d):
    """A segment's records in order, without their payload."""
    nth = F.row_number().over(Window.partitionBy("segment_id").orderBy("off")).cast("long")
    return R.placed(s, d).select("segment_id", nth.alias("nth"), "key", "off", "slen")


@query(f"WITH RECURSIVE {R.PLACED} SELECT segment_id, sealed, CASE WHEN sealed THEN last END AS sealed_at, coalesce(sealed AND last <= (SELECT max(doc_id) FROM docs) - 300, false) AS eligible FROM segments")
def segment_horizon(s, d):
    """Segments that a cycle may rewrite: sealed, and before the horizon, the grace time before now."""
    now = R.documents(s, d).agg(F.max("doc_id") - 300).first()[0]
    return store.eligible(R.segments(s, d), now).select("segment_id", "sealed", "sealed_at", "eligible")


@query(f"WITH RECURSIVE {R.PLACED}, bad AS (SELECT segment_id, min(off) AS off FROM placed WHERE doc_id % 37 = 11 GROUP BY segment_id) SELECT segment_id, count(*) AS kept, CAST(max(placed.off + 46 + slen) AS BIGINT) AS valid_end FROM placed LEFT JOIN bad USING (segment_id) WHERE bad.off IS NULL OR placed.off < bad.off GROUP BY segment_id")
def recover_tail(s, d):
    """What an opened segment keeps: its records before the first that is damaged."""
    p = R.placed(s, d).withColumn("good", F.col("doc_id") % 37 != 11)
    return store.valid_prefix(p).groupBy("segment_id").agg(F.count(F.lit(1)).alias("kept"), F.max(F.col("off") + store.record_size(F.col("slen"))).alias("valid_end"))


@query(f"""WITH RECURSIVE {R.PLACED}, p AS (SELECT *, CASE WHEN doc_id % 41 = 7 THEN off + 1 ELSE off END AS told FROM placed)
SELECT segment_id, count(*) AS n_records, count(*) FILTER (told <> off) AS misplaced, CAST(max(off + 46 + slen) AS BIGINT) = any_value(body) AS ends_well FROM p JOIN segments USING (segment_id) GROUP BY segment_id""")
def scrub_segments(s, d):
    """Index against records: entries whose offset is not where the records before end, and whether the last ends with the segment."""
    p = R.placed(s, d)
    index = p.select("segment_id", "key", F.when(F.col("doc_id") % 41 == 7, F.col("off") + 1).otherwise(F.col("off")).alias("at"))
    return store.scrub(p, index, R.segments(s, d).select("segment_id", "body"))


@query("""WITH RECURSIVE item AS (
  SELECT source, doc_id, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents
), b AS (
  SELECT source, doc_id, size, rn, CAST(0 AS BIGINT) AS batch, size AS bytes, 1 AS n FROM item WHERE rn = 1
  UNION ALL
  SELECT i.source, i.doc_id, i.size, i.rn, CASE WHEN b.bytes + i.size > 20000 OR b.n >= 8 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.bytes + i.size > 20000 OR b.n >= 8 THEN i.size ELSE b.bytes + i.size END, CASE WHEN b.bytes + i.size > 20000 OR b.n >= 8 THEN 1 ELSE b.n + 1 END
  FROM b JOIN item i ON i.source = b.source AND i.rn = b.rn + 1
) SELECT source, doc_id, size, batch FROM b""")
def batch_pack(s, d):
    items = table(s, d, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return fold(items, BatchFold(20_000, 8), ["source"], ["doc_id"], ["size"], "batch")


@query(f"WITH {R.OBJECTS} SELECT source, key, (row_number() OVER (PARTITION BY source ORDER BY key) - 1) // 16 AS chunk FROM objects")
def negotiation_chunks(s, d):
    return R.objects(s, d).select("source", "key", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("key")) - 1) / 16).alias("chunk"))


@query(f"""WITH {R.DOCS} SELECT source, count(*) AS checked, count(*) FILTER (doc_id % 17 = 5) AS corrupt FROM docs GROUP BY source""")
def scrub_rehash(s, d):
    docs = R.documents(s, d).withColumn("stored", F.when(F.col("doc_id") % 17 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    bad = (K.key_digest(F.col("key")) != F.substring(F.sha2("stored", 256), F.lit(1), F.length(K.key_digest(F.col("key"))))) | (K.key_length(F.col("key")) != F.octet_length("stored"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("checked"), F.count_if(bad).alias("corrupt"))


@query(f"WITH {R.DOCS}, mine AS (SELECT DISTINCT key, size FROM docs), theirs AS (SELECT key FROM docs WHERE doc_id % 2 = 0) SELECT count(*) AS total, count(*) FILTER (key NOT IN (SELECT key FROM theirs)) AS pushed, CAST(sum(46 + size) FILTER (key NOT IN (SELECT key FROM theirs)) AS BIGINT) AS bytes FROM mine")
def push_stats(s, d):
    docs = R.documents(s, d).select("doc_id", "key", "size")
    mine = docs.select("key", "size").distinct()
    theirs = docs.where("doc_id % 2 = 0").select("key").distinct().withColumn("there", F.lit(True))
    out = mine.join(theirs, "key", "left")
    return out.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("there").isNull()).alias("pushed"), F.sum(F.when(F.col("there").isNull(), store.record_size(F.col("size")))).alias("bytes"))


@query(f"WITH {R.DOCS}, a AS (SELECT DISTINCT key FROM docs WHERE doc_id % 4 <> 0), b AS (SELECT DISTINCT key FROM docs WHERE doc_id % 4 <> 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL JOIN b USING (key)")
def tree_diff(s, d):
    docs = R.documents(s, d).select("doc_id", "key")
    return docs.groupBy("key").agg(F.bool_or(F.col("doc_id") % 4 != 0).alias("a"), F.bool_or(F.col("doc_id") % 4 != 1).alias("b")).where("a OR b").select("key", F.expr("CASE WHEN NOT b THEN 'left' WHEN NOT a THEN 'right' ELSE 'both' END").alias("side"))
