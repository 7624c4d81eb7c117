"""Queries over paths, references, rights, exchange and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import scalars as S
from ..operators import graph, ignore, refs, store, tree
from ..operators.folds import BatchFold, fold
from ..sources.tables import table, written
from . import relations as R

QUERIES, SQL = {}, {}
LEAF = "node LIKE 'l|%'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# paths and specs

_FS = f"""{R.DOCS}, fs AS (
  SELECT '' AS parent, source AS name, '/' || source AS child, true AS is_dir FROM docs
  UNION SELECT '/' || source, lang, '/' || source || '/' || lang, true FROM docs
  UNION SELECT '/' || source || '/' || lang, CAST(doc_id AS VARCHAR), 'f|' || h, false FROM docs
)"""
_WALK = """walk AS (
  SELECT doc_id, parts, 0 AS i, start AS node, true AS inside, CASE WHEN parts IS NULL THEN 'path' WHEN start IS NULL THEN 'missing' END AS outcome FROM p
  UNION ALL
  SELECT w.doc_id, w.parts, w.i + 1, fs.child, coalesce(fs.is_dir, false), CASE WHEN NOT w.inside THEN 'not_a_directory' WHEN fs.child IS NULL THEN 'missing' END
  FROM walk w LEFT JOIN fs ON w.inside AND fs.parent = w.node AND fs.name = w.parts[w.i + 1] WHERE w.outcome IS NULL AND w.i < len(w.parts)
), ends AS (
  SELECT doc_id, CASE WHEN outcome IS NULL THEN node END AS node, coalesce(outcome, 'ok') AS outcome FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1
)"""
_PARTS = "CASE WHEN NOT list_contains(string_split({0}, '/'), '..') THEN list_filter(string_split({0}, '/'), lambda x: x <> '' AND x <> '.') END"


def _fs(s, d):
    """parent, name, child, is_dir: the directories by their path, files by their hash."""
    t = R.documents(s, d)
    top = t.select(F.lit("").alias("parent"), F.col("source").alias("name"), F.concat(F.lit("/"), "source").alias("child"), F.lit(True).alias("is_dir"))
    mid = t.select(F.concat(F.lit("/"), "source"), "lang", F.concat_ws("/", F.lit(""), "source", "lang"), F.lit(True))
    low = t.select(F.concat_ws("/", F.lit(""), "source", "lang"), F.col("doc_id").cast("string"), F.concat(F.lit("f|"), "h"), F.lit(False))
    return top.union(mid).union(low).distinct()


def _case(column, *values):
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(column == i, v).otherwise(out)
    return out


@query(f"""WITH RECURSIVE {_FS}, w AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/' || source || '/' || lang || '/' || doc_id WHEN 1 THEN '/./' || source || '//' || lang || '/' WHEN 2 THEN source || '/xx/' || doc_id
  WHEN 3 THEN source || '/' || lang || '/' || doc_id || '/nope/deeper' WHEN 4 THEN source || '/../' || source ELSE '/' END AS path FROM docs),
p AS (SELECT doc_id, '' AS start, {_PARTS.format("path")} AS parts FROM w), {_WALK} SELECT doc_id, node, outcome FROM ends""")
def resolve_paths(s, d):
    """Paths as asked: whole, with empty and ``.`` components, of nothing, below a file, with ``..``, and the root itself."""
    i, source, lang = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    sep = lambda *x: F.concat_ws("/", *x)
    path = _case(F.col("doc_id") % 6, sep(F.lit(""), source, lang, i), sep(F.lit("/."), source, F.lit(""), lang, F.lit("")), sep(source, F.lit("xx"), i), sep(source, lang, i, F.lit("nope"), F.lit("deeper")), sep(source, F.lit(".."), source), F.lit("/"))
    wanted = table(s, d, "documents").select("doc_id", F.lit("").alias("start"), S.path_parts(path).alias("parts"))
    return tree.resolve(wanted, _fs(s, d)).select("doc_id", "node", "outcome")


@query(f"""WITH RECURSIVE {_FS}, w AS (SELECT doc_id, source, CASE doc_id % 5 WHEN 0 THEN 'ref:' || source || '@' || lang || '/' || doc_id WHEN 1 THEN 'ref:' || source WHEN 2 THEN 'ref:nobody@x'
  WHEN 3 THEN sha256('/' || source) || '/' || lang ELSE 'bad:' || source END AS spec FROM docs),
r AS (SELECT doc_id, CASE WHEN starts_with(spec, 'ref:') THEN 'ref' WHEN regexp_matches(spec, '^[0-9a-f]{{64}}(/|$)') THEN 'key' ELSE 'bad' END AS kind,
  CASE WHEN starts_with(spec, 'ref:') THEN split_part(substr(spec, 5), '@', 1) ELSE split_part(spec, '/', 1) END AS target, CASE WHEN starts_with(spec, 'ref:') THEN split_part(spec, '@', 2) ELSE substr(spec, 66) END AS path FROM w),
roots AS (SELECT DISTINCT 'ref' AS kind, source AS target, '/' || source AS start FROM docs UNION SELECT 'key', sha256('/' || source), '/' || source FROM docs),
p AS (SELECT doc_id, start, {_PARTS.format("path")} AS parts FROM r LEFT JOIN roots USING (kind, target)), {_WALK}
SELECT doc_id, kind, node, CASE WHEN kind = 'bad' THEN 'spec' ELSE outcome END AS outcome FROM ends JOIN r USING (doc_id)""")
def spec_resolve(s, d):
    """``ref:NAME[@PATH]`` and ``KEY[/PATH]``."""
    source, lang, root = F.col("source"), F.col("lang"), F.concat(F.lit("/"), F.col("source"))
    spec = _case(F.col("doc_id") % 5, F.concat(F.lit("ref:"), source, F.lit("@"), lang, F.lit("/"), F.col("doc_id").cast("string")), F.concat(F.lit("ref:"), source), F.lit("ref:nobody@x"), F.concat(F.sha2(root, 256), F.lit("/"), lang), F.concat(F.lit("bad:"), source))
    kind, target, path = refs.spec_parts(spec)
    wanted = table(s, d, "documents").select("doc_id", kind.alias("kind"), target.alias("target"), S.path_parts(path).alias("parts"))
    sources = table(s, d, "documents").select(source, root.alias("start")).distinct()
    roots = sources.select(F.lit("ref").alias("kind"), source.alias("target"), "start").unionByName(sources.select(F.lit("key").alias("kind"), F.sha2("start", 256).alias("target"), "start"))
    out = tree.resolve(wanted.join(roots, ["kind", "target"], "left"), _fs(s, d))
    return out.select("doc_id", "kind", "node", F.when(F.col("kind") == "bad", "spec").otherwise(F.col("outcome")).alias("outcome"))


@query(f"WITH {_FS} SELECT parent, CAST(sum(n) AS BIGINT) AS n_repeated FROM (SELECT parent, child, count(*) AS n FROM fs GROUP BY ALL HAVING count(*) > 1) GROUP BY parent")
def dir_fan_in(s, d):
    """Directories that hold a child more than once, which a flat listing refuses."""
    return tree.repeated_children(_fs(s, d))


@query(f"WITH {R.LINES} SELECT doc_id, substr(hex(encode(string_agg(line, '' ORDER BY pos))), 1, 600) AS head FROM lines GROUP BY doc_id")
def prefix_content(s, d):
    """The first 300 bytes of a file, across its chunks: only chunks that begin before that are gathered."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    near = R.lines(s, d).withColumn("off", F.coalesce(F.sum("size").over(w), F.lit(0))).where("off < 300 AND (size > 0 OR pos = 0)")
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    return near.groupBy("doc_id").agg(F.hex(F.substring(F.encode(head, "UTF-8"), 1, 300)).alias("head"))


# references


@query(f"""WITH {R.DOCS}, r AS (SELECT 'doc' || doc_id AS name, CASE doc_id % 5 WHEN 0 THEN key WHEN 1 THEN '2' || substr(key, 2) WHEN 2 THEN '3' || substr(key, 2) WHEN 3 THEN '4' || substr(key, 2) ELSE 'zz' || substr(key, 3) END AS key FROM docs)
SELECT name, key, CASE WHEN NOT regexp_matches(key, '^[0-9a-f]{{64}}$') THEN 'invalid' WHEN substr(key, 1, 1) IN ('0', '1') THEN 'file' WHEN substr(key, 1, 1) IN ('2', '3') THEN 'dir' ELSE 'invalid' END AS kind FROM r""")
def ref_listing(s, d):
    """References in order of their name; what can't be decoded is listed as invalid."""
    k = F.col("key")
    kinds = [F.concat(F.lit(x), F.substring(k, 2, 63)) for x in "234"]
    r = R.documents(s, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), _case(F.col("doc_id") % 5, k, *kinds, F.concat(F.lit("zz"), F.substring(k, 3, 62))).alias("key"))
    kind = F.when(K.key_error(k).isNotNull(), "invalid").when(K.key_type(k) <= K.FILE_NODE, "file").when(K.key_type(k) <= K.DIR_NODE, "dir").otherwise("invalid")
    return r.withColumn("kind", kind).orderBy("name")


_ABSENT = f"reach AS (SELECT name, node FROM refs UNION SELECT r.name, e.child FROM reach r JOIN present p ON p.node = r.node JOIN edges e ON e.parent = r.node)"


@query(f"WITH RECURSIVE {R.GRAPH}, {_ABSENT}, lacking AS (SELECT name, count(*) AS n FROM reach WHERE node NOT IN (SELECT node FROM present) GROUP BY name) SELECT name, coalesce(n, 0) AS n_missing, n IS NULL AS complete FROM refs LEFT JOIN lacking USING (name)")
def put_ref(s, d):
    """The gate before a reference is stored: all below it must be there."""
    return graph.gate(R.refs(s, d), R.edges(s, d), R.present_nodes(s, d), LEAF).select("name", "n_missing", "complete")


@query(f"""WITH RECURSIVE {R.GRAPH}, walk AS (
  SELECT node, CASE WHEN node IN (SELECT node FROM present) THEN 0 ELSE 1 END AS k FROM refs
  UNION SELECT e.child, w.k + CASE WHEN e.child IN (SELECT node FROM present) THEN 0 ELSE 1 END FROM walk w JOIN edges e ON e.parent = w.node
) SELECT node, CAST(min(k) AS INT) AS round FROM walk WHERE node NOT IN (SELECT node FROM present) GROUP BY node""")
def pull_rounds(s, d):
    """Fetch what is missing, look below it, until nothing is: each fetched node with its round."""
    edges = written(R.edges(s, d), "edges")
    return graph.pull(R.refs(s, d), edges, R.present_nodes(s, d, edges), LEAF)


@query(f"""WITH RECURSIVE {R.PLACED}, theirs AS (SELECT key FROM docs WHERE doc_id % 2 = 0), best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY segment_id DESC) = 1),
item AS (SELECT source, key, 46 + slen AS size, row_number() OVER (PARTITION BY source ORDER BY segment_id, off) AS rn FROM best WHERE key NOT IN (SELECT key FROM theirs)), b AS (
  SELECT source, key, size, rn, CAST(0 AS BIGINT) AS batch, size AS bytes, 1 AS n FROM item WHERE rn = 1
  UNION ALL
  SELECT i.source, i.key, i.size, i.rn, CASE WHEN b.bytes + i.size > 30000 OR b.n >= 16 THEN b.batch + 1 ELSE b.batch END,
    CASE WHEN b.bytes + i.size > 30000 OR b.n >= 16 THEN i.size ELSE b.bytes + i.size END, CASE WHEN b.bytes + i.size > 30000 OR b.n >= 16 THEN 1 ELSE b.n + 1 END
  FROM b JOIN item i ON i.source = b.source AND i.rn = b.rn + 1
) SELECT source, key, size, batch FROM b""")
def push_batches(s, d):
    """What the other side lacks, in the order of the disk, in batches bounded by bytes and keys."""
    theirs = R.documents(s, d).where("doc_id % 2 = 0").select("key")
    mine = store.newest_copies(R.placed(s, d).select("key", "source", "segment_id", "off", "slen"))
    want = store.missing_keys(mine, theirs).select("source", "key", "segment_id", "off", store.record_size(F.col("slen")).alias("size"))
    return fold(want, BatchFold(30_000, 16), ["source"], ["segment_id", "off"], ["size"], "batch").select("source", "key", "size", "batch")


@query(f"WITH RECURSIVE {R.GRAPH}, reach AS (SELECT name, node FROM refs UNION SELECT r.name, e.child FROM reach r JOIN edges e ON e.parent = r.node) SELECT DISTINCT name, node, node IN (SELECT node FROM refs) AS is_root FROM reach")
def content_keys(s, d):
    """All keys below each reference, each once, its root first."""
    seen = graph.closure(R.refs(s, d), R.edges(s, d), ("name",), leaf=LEAF)
    return seen.join(R.refs(s, d).select("name", "node", F.lit(True).alias("root")), ["name", "node"], "left").select("name", "node", F.coalesce("root", F.lit(False)).alias("is_root")).orderBy("name", F.desc("is_root"))


_SIZES = "r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 7 % 80000 END AS signature, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 5 % 20000 END AS public_key FROM orders)"


@query(f"WITH {_SIZES} SELECT o_orderkey, CASE WHEN (signature IS NULL) <> (public_key IS NULL) THEN 'half_signed' WHEN signature > 65536 THEN 'signature' WHEN public_key > 16384 THEN 'public_key' END AS error FROM r")
def ref_record_bounds(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", refs.record_error(F.when(k % 3 > 0, k * 7 % 80000), F.when(k % 4 > 0, k * 5 % 20000)).alias("error"))


# rights and remotes

_LINES = """l AS (SELECT c_custkey AS pos, CASE c_custkey % 5 WHEN 0 THEN '# ' || c_name WHEN 1 THEN 'ssh-ed25519 AAAA' || c_custkey || ' ' || c_name WHEN 2 THEN 'caps="read,push-objects" ssh-rsa BBBB' || c_custkey // 40
  WHEN 3 THEN CASE WHEN c_custkey % 10 = 3 THEN 'caps="fly" ssh-rsa CCCC' || c_custkey ELSE 'caps="admin"  ssh-rsa   BBBB' || c_custkey // 40 END ELSE ' ' END AS value FROM customer)"""


@query(f"""WITH {_LINES}, k AS (SELECT pos, regexp_extract(value, '((?:ssh|ecdsa|sk)-[A-Za-z0-9@.-]+)\\s+[A-Za-z0-9+/=]+', 1) || ' ' || regexp_extract(value, '(?:ssh|ecdsa|sk)-[A-Za-z0-9@.-]+\\s+([A-Za-z0-9+/=]+)', 1) AS key, regexp_extract(value, '^caps="([^"]*)"', 1) AS caps FROM l WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#'))
SELECT key, CASE WHEN caps = '' THEN 'read,push-objects,write-refs' WHEN caps <> 'fly' THEN caps END AS caps FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1""")
def allow_lines(s, d):
    """An allow list from its lines: the last line of a key wins, unknown capabilities make it null."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    group = F.floor(k / 40).cast("string")
    odd = F.when(k % 10 == 3, F.concat(F.lit('caps="fly" ssh-rsa CCCC'), n)).otherwise(F.concat(F.lit('caps="admin"  ssh-rsa   BBBB'), group))
    line = _case(k % 5, F.concat(F.lit("# "), "c_name"), F.concat(F.lit("ssh-ed25519 AAAA"), n, F.lit(" "), "c_name"), F.concat(F.lit('caps="read,push-objects" ssh-rsa BBBB'), group), odd, F.lit(" "))
    out = refs.allow_list(table(s, d, "customer").select(k.alias("pos"), line.alias("value")))
    return out.select("key", F.array_join("caps", ",").alias("caps"))


_CAPS = "CASE c_mktsegment WHEN 'BUILDING' THEN ['read'] WHEN 'AUTOMOBILE' THEN ['push-objects', 'read'] WHEN 'MACHINERY' THEN ['admin', 'read'] ELSE ['write-refs', 'delegate'] END"


@query(f"""WITH allowed AS (SELECT c_custkey AS key, {_CAPS} AS caps FROM customer), q AS (SELECT o_orderkey, o_custkey AS key, o_custkey + 1 AS issuer, CASE o_orderkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'push-objects' ELSE 'write-refs' END AS cap,
  CASE WHEN o_orderkey % 2 = 0 THEN ['read'] ELSE ['read', 'push-objects', 'write-refs'] END AS granted FROM orders)
SELECT o_orderkey, CASE WHEN list_contains(a.caps, 'admin') OR list_contains(a.caps, cap) THEN 'own'
  WHEN (list_contains(i.caps, 'admin') OR list_contains(i.caps, 'delegate')) AND list_contains(granted, cap) AND cap IN ('read', 'push-objects') THEN 'grant' ELSE 'denied' END AS outcome
FROM q LEFT JOIN allowed a ON a.key = q.key LEFT JOIN allowed i ON i.key = q.issuer""")
def authorise_requests(s, d):
    some = lambda *x: F.array(*[F.lit(c) for c in x])
    seg, o = F.col("c_mktsegment"), F.col("o_orderkey")
    caps = F.when(seg == "BUILDING", some("read")).when(seg == "AUTOMOBILE", some("push-objects", "read")).when(seg == "MACHINERY", some("admin", "read")).otherwise(some("write-refs", "delegate"))
    allowed = table(s, d, "customer").select(F.col("c_custkey").alias("key"), caps.alias("caps"))
    asked = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), (F.col("o_custkey") + 1).alias("issuer"), _case(o % 3, F.lit("read"), F.lit("push-objects"), F.lit("write-refs")).alias("cap"), F.when(o % 2 == 0, some("read")).otherwise(some("read", "push-objects", "write-refs")).alias("granted"))
    return refs.authorise(asked, allowed).select("o_orderkey", "outcome")


@query("""WITH g AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ['read', 'push-objects', 'read'] WHEN 1 THEN ['push-objects'] WHEN 2 THEN ['read', 'wipe'] ELSE [] END AS caps, o_orderkey % 11 AS issued, o_orderkey % 13 AS expires FROM orders)
SELECT o_orderkey, CASE WHEN len(caps) = 0 OR list_contains(caps, 'wipe') THEN 'caps' WHEN issued > expires THEN 'times' END AS error, array_to_string(list_sort(list_distinct(caps)), ',') AS caps FROM g""")
def grant_issue(s, d):
    some = lambda *x: F.array(*[F.lit(c) for c in x]).cast("array<string>")
    k = F.col("o_orderkey")
    caps = _case(k % 4, some("read", "push-objects", "read"), some("push-objects"), some("read", "wipe"), some())
    return table(s, d, "orders").select("o_orderkey", refs.issue_error(caps, k % 11, k % 13).alias("error"), refs.issued_caps(caps).alias("caps"))


@query("""WITH remotes AS (SELECT s_nationkey AS owner, 'r' || s_suppkey AS name, 'https://' || s_suppkey AS url FROM supplier), n AS (SELECT owner, count(*) AS n, min(url) AS only_url FROM remotes GROUP BY owner),
w AS (SELECT c_custkey, c_nationkey AS owner, CASE WHEN c_custkey % 3 > 0 THEN 'r' || c_custkey % 12 END AS name FROM customer)
SELECT c_custkey, coalesce(r.url, CASE WHEN w.name IS NULL AND n.n = 1 THEN only_url END) AS url, CASE WHEN r.url IS NOT NULL OR w.name IS NULL AND n.n = 1 THEN 'ok' WHEN w.name IS NULL AND n.n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome
FROM w LEFT JOIN remotes r ON r.owner = w.owner AND r.name = w.name LEFT JOIN n ON n.owner = w.owner""")
def remote_resolve(s, d):
    k = F.col("c_custkey")
    remotes = table(s, d, "supplier").select(F.col("s_nationkey").alias("owner"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("https://"), F.col("s_suppkey").cast("string")).alias("url"))
    wanted = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("owner"), F.when(k % 3 > 0, F.concat(F.lit("r"), (k % 12).cast("string"))).alias("name"))
    return refs.resolve_remote(wanted, remotes).select("c_custkey", "url", "outcome")


# listings and views


@query(f"""WITH {R.DOCS} SELECT doc_id, CAST(to_json({{'name': CAST(doc_id AS VARCHAR), 'mode': '-rw-r--r--', 'size': size, 'key': key}}) AS VARCHAR) AS line FROM docs""")
def listing_json(s, d):
    row = F.struct(F.col("doc_id").cast("string").alias("name"), S.mode_string(F.lit(0o100644)).alias("mode"), "size", "key")
    return R.documents(s, d).select("doc_id", F.to_json(row).alias("line"))


@query(f"""WITH {R.DOCS}, a AS (SELECT doc_id, strlen(lang) AS l, strlen(source) AS s, strlen(substr(text, 1, 220)) AS h FROM docs), z AS (SELECT doc_id, 1 + 5 + CASE WHEN l < 24 THEN 1 ELSE 2 END + l + 7 + CASE WHEN s < 24 THEN 1 ELSE 2 END + s + 5 + CASE WHEN h < 24 THEN 1 WHEN h < 256 THEN 2 ELSE 3 END + h AS size FROM a)
SELECT doc_id, CAST(size AS INT) AS size, size <= 256 AS is_inline FROM z""")
def attribute_spill(s, d):
    """Attributes of an entry: encoded size, and whether they stay inline."""
    text = R.documents(s, d).select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("head"), F.substring("text", 1, 220)).alias("attributes"))
    size = S.attributes_size(F.col("attributes"))
    return text.select("doc_id", size.alias("size"), (size <= 256).alias("is_inline"))


@query("""WITH b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN ' {"page": ' || page_id || '}' WHEN 2 THEN '[1, ' || page_id ELSE chr(0) || html END AS body FROM pages)
SELECT page_id, CASE WHEN contains(body, chr(0)) THEN 'hex' WHEN regexp_matches(body, '^\\s*[\\[{]') AND json_valid(body) THEN 'json' ELSE 'text' END AS mode, strlen(body) > 200 AS truncated FROM b""".replace("\\\\", "\\"))
def view_modes(s, d):
    """How payloads are shown, and whether the first 200 bytes are all of them."""
    n = F.col("page_id").cast("string")
    body = F.encode(_case(F.col("page_id") % 4, F.col("html"), F.concat(F.lit(' {"page": '), n, F.lit("}")), F.concat(F.lit("[1, "), n), F.concat(F.lit("\x00"), "html")), "UTF-8")
    return table(s, d, "pages").select("page_id", S.view_mode(body).alias("mode"), (F.octet_length(body) > 200).alias("truncated"))


@query("""WITH b AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.html' WHEN 1 THEN 'pic.PNG' WHEN 4 THEN 'x.bin' ELSE 'none' END AS name, CASE page_id % 5 WHEN 2 THEN html WHEN 3 THEN 'plain ' || page_id ELSE chr(0) || html END AS body FROM pages)
SELECT page_id, CASE WHEN name = 'a.html' THEN 'text/html; charset=utf-8' WHEN name = 'pic.PNG' THEN 'image/png' WHEN regexp_matches(lower(ltrim(substr(body, 1, 64))), '^(<!doctype html|<html)') THEN 'text/html; charset=utf-8' WHEN contains(body, chr(0)) THEN 'application/octet-stream' ELSE 'text/plain; charset=utf-8' END AS media FROM b""")
def media_types(s, d):
    i = F.col("page_id") % 5
    name = F.when(i == 0, "a.html").when(i == 1, "pic.PNG").when(i == 4, "x.bin").otherwise("none")
    body = F.when(i == 2, F.col("html")).when(i == 3, F.concat(F.lit("plain "), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("\x00"), "html"))
    return table(s, d, "pages").select("page_id", S.media_type(name, F.encode(body, "UTF-8")).alias("media"))


@query("SELECT CAST(max(length(source)) AS INT) AS source, CAST(max(length(lang)) AS INT) AS lang, CAST(max(length(CAST(n_chars AS VARCHAR))) AS INT) AS n_chars FROM documents")
def column_widths(s, d):
    return table(s, d, "documents").agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in ("source", "lang", "n_chars")])


@query("SELECT event_type AS route, user_id % 4 AS code, count(*) AS n, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY ALL")
def request_metrics(s, d):
    """Requests by route and code, with cumulative counts of durations."""
    e = table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("route"), (F.col("user_id") % 4).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") <= 10).alias("le_10"), F.count_if(F.col("value") <= 100).alias("le_100"))


@query("SELECT c_custkey, 'SHA256:' || rtrim(to_base64(unhex(sha256(c_name))), '=') AS fingerprint FROM customer")
def key_fingerprints(s, d):
    return table(s, d, "customer").select("c_custkey", S.fingerprint(F.base64(F.encode("c_name", "UTF-8"))).alias("fingerprint"))


@query("""WITH n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '/it''s here/' ELSE '//' END AS name FROM pages)
SELECT page_id, CASE WHEN regexp_replace(name, '/', '', 'g') = '' THEN '/' ELSE list_filter(string_split(name, '/'), lambda x: x <> '')[-1] END AS base, CASE WHEN regexp_matches(name, '^[A-Za-z0-9_@%+=:,./-]+$') THEN name ELSE '''' || replace(name, '''', '''\\''''') || '''' END AS quoted FROM n""")
def name_strings(s, d):
    name = _case(F.col("page_id") % 3, F.col("url"), F.concat("url", F.lit("/it's here/")), F.lit("//"))
    return table(s, d, "pages").select("page_id", S.base_name(name).alias("base"), S.shell_quoted(name).alias("quoted"))


@query("""SELECT o_orderkey, CASE WHEN v < 1024 THEN v || ' B' WHEN v < 1023.95 * 1024 THEN CAST(CAST(round(v / 1024, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KiB' ELSE CAST(CAST(round(v / 1048576, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' MiB' END AS shown
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1048000 + o_orderkey % 600 ELSE o_orderkey * 37 % 3000000 END AS v FROM orders)""")
def progress_size(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", S.promoted_size(F.when(k % 2 == 0, 1048000 + k % 600).otherwise(k * 37 % 3_000_000)).alias("shown"))


@query("""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN format('{:016x}', page_id * 1000003) || '.seg' WHEN 1 THEN format('{:016X}', page_id * 1000003 + 11) || '.seg' WHEN 2 THEN format('{:x}', page_id) || '.seg' ELSE format('{:016x}', page_id) || '.tmp' END AS name FROM pages)
SELECT page_id, CASE WHEN regexp_matches(name, '^[0-9a-f]{16}\\.seg$') THEN CAST(CAST('0x' || substr(name, 1, 16) AS UBIGINT) AS BIGINT) END AS number FROM n""")
def segment_names(s, d):
    k = F.col("page_id").cast("long")
    padded = lambda x: F.lpad(F.hex(x), 16, "0")
    name = _case(k % 4, F.concat(F.lower(padded(k * 1000003)), F.lit(".seg")), F.concat(padded(k * 1000003 + 11), F.lit(".seg")), F.concat(F.lower(F.hex(k)), F.lit(".seg")), F.concat(F.lower(padded(k)), F.lit(".tmp")))
    return table(s, d, "pages").select("page_id", S.segment_number(name).cast("long").alias("number"))


@query(f"""WITH {R.DOCS} SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN sha256(substr(text, 1, 20)) END AS signed, CASE WHEN doc_id % 7 > 0 THEN to_base64(encode('sig' || doc_id)) END AS signature FROM docs""")
def trailer_split(s, d):
    """Bodies that end in a signature and its length; one in seven gives a length that leads outside."""
    signature = F.base64(F.encode(F.concat(F.lit("sig"), F.col("doc_id").cast("string")), "UTF-8"))
    size = F.when(F.col("doc_id") % 7 > 0, F.length(signature)).otherwise(F.lit(2_000_000_000))
    body = F.concat(F.encode(F.substring("text", 1, 20), "UTF-8"), F.encode(signature, "UTF-8"), F.unhex(F.lpad(F.hex(size.cast("long")), 8, "0")))
    signed, found = S.trailer_parts(F.col("body"))
    return R.documents(s, d).select("doc_id", body.alias("body")).select("doc_id", F.sha2(signed, 256).alias("signed"), found.alias("signature"))


@query(f"""WITH {R.DOCS}, l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN key || sha256(lang) || key WHEN 1 THEN key ELSE key || 'ab' END AS keys FROM docs), p AS (SELECT doc_id, keys, unnest(range(0, len(keys) // 64)) AS pos FROM l WHERE len(keys) % 64 = 0)
SELECT doc_id, CAST(pos AS INT) AS pos, substr(keys, pos * 64 + 1, 64) AS key FROM p""")
def key_lists(s, d):
    """Concatenated keys; lists whose length is no multiple of a key give nothing."""
    k = F.col("key")
    keys = _case(F.col("doc_id") % 3, F.concat(k, F.sha2("lang", 256), k), k, F.concat(k, F.lit("ab")))
    return R.documents(s, d).select("doc_id", F.posexplode(K.split_key_list(keys)).alias("pos", "key"))


_RULES = (("", "fr/"), ("", "*7"), ("", "!/de/*"))


@query(f"WITH {R.DOCS} SELECT source, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM docs WHERE NOT (lang = 'fr' OR doc_id % 10 = 7 AND lang <> 'de') GROUP BY source")
def scan_totals(s, d):
    """Files and bytes of each source's tree before it is taken in, without what is ignored."""
    docs = R.documents(s, d).withColumn("path", F.concat_ws("/", "lang", F.col("doc_id").cast("string")))
    kept = docs.where(~ignore.ignored(F.col("path"), F.lit(False), ignore.parse(_RULES)))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
