"""Queries over references, rights, requests, names and ingestion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ignore, refs
from ..sources.tables import table
from ..streaming.inbox import ingest_table
from . import relations as R

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT user_id AS name, event_id AS record FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events)
WHERE nth = 1 AND event_type <> 'error'""")
def ref_latest(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("record"), "ts", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("action"))
    return refs.latest(log, "name", ["ts", "record"], "action").select("name", "record")


_WRITES = """w AS (SELECT event_id, user_id AS name, CASE WHEN event_type IN ('view', 'click') THEN 'a' ELSE 'b' END AS signer, event_id // 3 AS created, event_id % 2 AS record, event_type = 'signup' AS admin,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


@query(f"""WITH RECURSIVE {_WRITES}, o AS (
  SELECT name, rn, event_id, 204 AS outcome, signer AS s, created AS c, record AS r FROM w WHERE rn = 1
  UNION ALL
  SELECT w.name, w.rn, w.event_id, x.outcome, CASE WHEN x.outcome = 204 THEN w.signer ELSE o.s END, CASE WHEN x.outcome = 204 THEN w.created ELSE o.c END, CASE WHEN x.outcome = 204 THEN w.record ELSE o.r END
  FROM o JOIN w ON w.name = o.name AND w.rn = o.rn + 1, LATERAL (SELECT CASE WHEN w.admin THEN 204 WHEN o.s <> w.signer THEN 403 WHEN w.created <= o.c AND w.record <> o.r THEN 409 ELSE 204 END AS outcome) x
) SELECT event_id, CAST(outcome AS BIGINT) AS outcome FROM o""")
def ref_overwrite_outcome(s, d):
    e = table(s, d, "events")
    writes = e.select("event_id", F.col("user_id").alias("name"), F.when(F.col("event_type").isin("view", "click"), "a").otherwise("b").alias("signer"), F.floor(F.col("event_id") / 3).alias("created"), (F.col("event_id") % 2).alias("record"), (F.col("event_type") == "signup").alias("admin"), "ts")
    return refs.overwrite_outcomes(writes, "name", ["ts", "event_id"], "signer", "created", "record", "admin").select("event_id", "outcome")


@query(r"""WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN encode(url) WHEN 1 THEN encode(replace(url, '.', '@')) WHEN 2 THEN encode(repeat(url, 40)) WHEN 3 THEN encode(url || chr(9)) ELSE encode(url) || '\xFF'::BLOB END AS name FROM pages),
t AS (SELECT page_id, name, TRY(decode(name)) AS text FROM n)
SELECT page_id, CASE WHEN octet_length(name) < 1 OR octet_length(name) > 1024 THEN 'length' WHEN text IS NULL THEN 'encoding' WHEN contains(text, '@') THEN 'at' WHEN regexp_matches(text, '[\x00-\x1F\x7F]') THEN 'control' END AS error FROM t""".replace("\\\\", "\\"))
def ref_name_validation(s, d):
    """Names with too many bytes, bytes that are no text, ``@`` or control characters."""
    i, u = F.col("page_id") % 5, F.col("url")
    name = F.when(i == 0, u).when(i == 1, F.replace(u, F.lit("."), F.lit("@"))).when(i == 2, F.repeat(u, 40)).when(i == 3, F.concat(u, F.lit("\t"))).otherwise(F.concat(F.encode(u, "UTF-8"), F.unhex(F.lit("ff"))).cast("string"))
    return table(s, d, "pages").select("page_id", S.name_error(name).alias("error"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
def name_filter(s, d):
    return table(s, d, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("AN")))).select("p_partkey", "p_name")


IGNORE = (("", "*.html"), ("", "!/en/1*.html"), ("", "fr/"), ("de", "[0-4]*"), ("", "/es/**"), ("", "# comment"), ("", "!/es/1*"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://[^/]*/', ''), '[?#].*$', '') AS path FROM pages), q AS (SELECT page_id, rtrim(path, '/') AS path FROM p)
SELECT page_id, path, CASE WHEN regexp_matches(path, '^fr/') THEN true
  WHEN regexp_matches(path, '^es/1[^/]*$') THEN false WHEN regexp_matches(path, '^es/.+$') THEN true WHEN regexp_matches(path, '^de/([^/]+/)*[0-4][^/]*$') THEN true
  WHEN regexp_matches(path, '^en/1[^/]*\.html$') THEN false WHEN regexp_matches(path, '\.html$') THEN true ELSE false END AS is_ignored FROM q""")
def ignore_filter(s, d):
    path = F.rtrim(F.regexp_replace(F.regexp_replace("url", r"^[^:]*://[^/]*/", ""), r"[?#].*$", ""), F.lit("/"))
    pages = table(s, d, "pages").select("page_id", path.alias("path"))
    return pages.withColumn("is_ignored", ignore.ignored(F.col("path"), F.lit(False), ignore.parse(IGNORE)))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 1 THEN false ELSE true END AS textual FROM pages""")
def textual_detect(s, d):
    body = F.when(F.col("page_id") % 3 == 1, F.concat(F.unhex(F.lit("89504e470d0a1a0a00")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    return table(s, d, "pages").select("page_id", S.is_textual(body).alias("textual"))


_MODES = "m AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 16384 WHEN 1 THEN 32768 WHEN 2 THEN 40960 WHEN 3 THEN 4096 WHEN 4 THEN 8192 WHEN 5 THEN 24576 ELSE 49152 END + l_orderkey % 4096 AS mode FROM lineitem)"


def _modes(s, d):
    kinds = F.array(*[F.lit(x) for x in (16384, 32768, 40960, 4096, 8192, 24576, 49152)])
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.get(kinds, F.col("l_linenumber") % 7) + F.col("l_orderkey") % 4096).alias("mode"))


@query(f"""WITH {_MODES} SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'dir' WHEN 1 THEN 'file' WHEN 2 THEN 'symlink' WHEN 3 THEN 'fifo' WHEN 4 THEN 'char' WHEN 5 THEN 'block' ELSE 'socket' END AS kind FROM m""")
def entry_kind(s, d):
    return _modes(s, d).select("l_orderkey", "l_linenumber", S.entry_kind(F.col("mode")).alias("kind"))


_X = "CASE WHEN mode & {s} <> 0 THEN CASE WHEN mode & {x} <> 0 THEN '{a}' ELSE '{b}' END ELSE CASE WHEN mode & {x} <> 0 THEN 'x' ELSE '-' END END"


@query(f"""WITH {_MODES} SELECT l_orderkey, l_linenumber, substr('d-lpcbs', CAST(l_linenumber % 7 + 1 AS BIGINT), 1)
  || CASE WHEN mode & 256 <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 128 <> 0 THEN 'w' ELSE '-' END || {_X.format(s=2048, x=64, a="s", b="S")}
  || CASE WHEN mode & 32 <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 16 <> 0 THEN 'w' ELSE '-' END || {_X.format(s=1024, x=8, a="s", b="S")}
  || CASE WHEN mode & 4 <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 2 <> 0 THEN 'w' ELSE '-' END || {_X.format(s=512, x=1, a="t", b="T")} AS shown FROM m""")
def mode_string(s, d):
    return _modes(s, d).select("l_orderkey", "l_linenumber", S.mode_string(F.col("mode")).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN CAST(CAST(round(v / 1024, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KiB' ELSE CAST(CAST(round(v / 1048576, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' MiB' END AS human
FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 9000000 AS v FROM orders)""")
def human_size(s, d):
    return table(s, d, "orders").select("o_orderkey", S.human_size(F.col("o_orderkey") * F.col("o_orderkey") % 9_000_000).alias("human"))


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events), f AS (
  SELECT event_id, user_id, event_type, rn, us AS first, 0 AS replay FROM r WHERE rn = 1
  UNION ALL SELECT r.event_id, r.user_id, r.event_type, r.rn, CASE WHEN r.us - f.first <= 86400000000 THEN f.first ELSE r.us END, CASE WHEN r.us - f.first <= 86400000000 THEN 1 ELSE 0 END
  FROM f JOIN r ON r.user_id = f.user_id AND r.event_type = f.event_type AND r.rn = f.rn + 1
) SELECT event_id, CAST(replay AS BIGINT) AS replay FROM f""")
def replay_dedup(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return refs.replays(e, ["user_id", "event_type"], "at", 43_200_000_000, ["at", "event_id"]).select("event_id", "replay")


@query("SELECT event_id FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) <= 3600000000 * 12")
def request_window(s, d):
    at, now = F.unix_micros(F.col("ts").cast("timestamp")), F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp_ntz").cast("timestamp"))
    return table(s, d, "events").where(refs.in_window(at, now, 12 * 3_600_000_000)).select("event_id")


_CAPS = "CASE c_mktsegment WHEN 'BUILDING' THEN ['read'] WHEN 'AUTOMOBILE' THEN ['push-objects', 'read'] WHEN 'MACHINERY' THEN ['admin', 'read'] ELSE ['write-refs', 'delegate'] END"


@query(f"""WITH c AS (SELECT c_custkey, {_CAPS} AS caps FROM customer)
SELECT c_custkey, list_contains(caps, 'admin') OR list_contains(caps, 'push-objects') AS may_push,
  CASE WHEN list_contains(caps, 'admin') THEN 'admin' ELSE array_to_string(list_filter(['read', 'push-objects', 'write-refs', 'delegate', 'wipe'], lambda x: list_contains(caps, x)), ',') END AS shown FROM c""")
def capability_check(s, d):
    some = lambda *x: F.array(*[F.lit(c) for c in x])
    seg = F.col("c_mktsegment")
    caps = F.when(seg == "BUILDING", some("read")).when(seg == "AUTOMOBILE", some("push-objects", "read")).when(seg == "MACHINERY", some("admin", "read")).otherwise(some("write-refs", "delegate"))
    return table(s, d, "customer").select("c_custkey", refs.allows(caps, "push-objects").alias("may_push"), refs.shown(caps).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'caps' WHEN o_custkey % 10 = 0 THEN 'subject' WHEN TIMESTAMP '1995-06-01' < o_orderdate - INTERVAL 30 DAY THEN 'early' WHEN TIMESTAMP '1995-06-01' > o_orderdate + INTERVAL 130 DAY THEN 'expired' END AS error FROM orders""")
def grant_window(s, d):
    o, day = table(s, d, "orders"), 86_400_000_000
    issued, now = F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.unix_micros(F.lit("1995-06-01").cast("timestamp_ntz").cast("timestamp"))
    caps = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("wipe"))).otherwise(F.array(F.lit("read")))
    key = F.when(F.col("o_custkey") % 10 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))
    return o.select("o_orderkey", refs.grant_error(caps, F.col("o_custkey"), key, issued, issued + 100 * day, now, 30 * day).alias("error"))


@query("SELECT min(ts) AS oldest FROM events WHERE event_type = 'purchase'")
def oldest_inflight(s, d):
    spans = table(s, d, "events").select("ts", F.when(F.col("event_type") != "purchase", F.col("ts")).alias("ended"))
    return refs.oldest_open(spans, "ts", "ended")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS pending FROM events GROUP BY user_id")
def pending_per_root(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    return refs.pending(e, e.where("event_type <> 'error'"), "user_id", "event_id")


@query(f"SELECT DISTINCT {R.sql_key(0, 'strlen(text)', 'sha256(text)')} AS key, strlen(text) AS size FROM conversations WHERE text IS NOT NULL")
def inbox_ingest(s, d):
    return ingest_table(s, f"{d}/conversations.parquet", "text")
