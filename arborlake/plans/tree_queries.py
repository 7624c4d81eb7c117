"""Queries over trees, files and the object graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, tree
from ..sources.tables import table
from . import relations as R

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


BITS, LEAST, MOST = 2, 2, 16


def sql_runs(source: str, key: str, order: str, digest: str, name: str) -> str:
    """Recursive SQL for the runs of item chunking: a run closes at MOST items, or at a hit from LEAST on."""
    closes = f"(a.len >= {MOST} OR (a.len >= {LEAST} AND a.hit))"
    return f"""{name}_n AS (
  SELECT *, ('0x' || substr({digest}, 1, 2))::INT % {1 << BITS} = 0 AS hit, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}
), {name} AS (
  SELECT {key}, rn, hit, CAST(0 AS BIGINT) AS run, 1 AS len FROM {name}_n WHERE rn = 1
  UNION ALL
  SELECT b.{key}, b.rn, b.hit, CASE WHEN {closes} THEN a.run + 1 ELSE a.run END, CASE WHEN {closes} THEN 1 ELSE a.len + 1 END
  FROM {name} a JOIN {name}_n b ON b.{key} = a.{key} AND b.rn = a.rn + 1
)"""


def _entries(s, d):
    """Directory of a source: its documents by zero-padded name."""
    docs = table(s, d, "documents").select(F.col("source").alias("directory"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"))
    return docs.withColumn("digest", F.sha2("name", 256))


_ENTRIES = "entries AS (SELECT source AS directory, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS name, sha256(lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS digest FROM documents)"
_LEVEL0 = f"""WITH RECURSIVE {_ENTRIES}, {sql_runs("entries", "directory", "name", "digest", "r")}, leaf AS (
  SELECT n.directory, r.run, count(*) AS n_children, min(n.name) AS first_name, max(n.name) AS sep_name, sha256(string_agg(n.digest, '' ORDER BY n.name)) AS node
  FROM r JOIN r_n n USING (directory, rn) GROUP BY ALL
)"""


@query(f"""WITH RECURSIVE {R.LINES}, item AS (SELECT doc_id, pos, sha256(line) AS digest FROM lines), {sql_runs("item", "doc_id", "pos", "digest", "r")}
SELECT doc_id, rn - 1 AS pos, run FROM r""")
def item_runs(s, d):
    items = R.lines(s, d).select("doc_id", "pos", F.sha2("line", 256).alias("digest"))
    return tree.runs(items, BITS, ["doc_id"], ["pos"]).select("doc_id", "pos", "run")


@query(f"{_LEVEL0} SELECT directory, run, n_children, first_name, sep_name, node FROM leaf")
def prolly_level0(s, d):
    return tree.leaf_runs(_entries(s, d), BITS)


@query(f"""{_LEVEL0}, up AS (SELECT directory, sep_name AS name, node AS digest FROM leaf WHERE directory IN (SELECT directory FROM leaf GROUP BY 1 HAVING count(*) > 1)),
{sql_runs("up", "directory", "name", "digest", "q")}, inner_nodes AS (
  SELECT n.directory, q.run, count(*) AS n_children, max(n.name) AS sep_name, sha256(string_agg(n.digest, '' ORDER BY n.name)) AS node FROM q JOIN q_n n USING (directory, rn) GROUP BY ALL
) SELECT directory, 0 AS level, node, sep_name, n_children FROM leaf UNION ALL SELECT directory, 1, node, sep_name, n_children FROM inner_nodes WHERE n_children > 1""")
def prolly_index(s, d):
    levels = tree.directory_levels(_entries(s, d), BITS)
    return levels.where("level <= 1").select("directory", "level", "node", "sep_name", "n_children")


_ITEMS = "STRUCT(name VARCHAR, digest VARCHAR)[]"


@query(f"""WITH RECURSIVE {_ENTRIES}, walk AS (
  SELECT directory, 0 AS level, list({{'name': name, 'digest': digest}} ORDER BY name)::{_ITEMS} AS todo, []::{_ITEMS} AS run, []::{_ITEMS} AS done, 0 AS made, NULL::VARCHAR AS node, NULL::VARCHAR AS sep_name, 0::BIGINT AS n_children FROM entries GROUP BY directory
  UNION ALL
  SELECT directory, CASE WHEN ends THEN level + 1 ELSE level END, CASE WHEN NOT ends THEN rest WHEN len(nodes) > 1 THEN nodes ELSE []::{_ITEMS} END, CASE WHEN closes THEN []::{_ITEMS} ELSE r END,
    CASE WHEN ends THEN []::{_ITEMS} ELSE nodes END, level, CASE WHEN closes AND NOT moved THEN digest END, x.name, len(r)::BIGINT
  FROM (SELECT *, CASE WHEN closes THEN list_append(done, {{'name': x.name, 'digest': digest}}) ELSE done END AS nodes
    FROM (SELECT *, CASE WHEN moved THEN x.digest ELSE sha256(array_to_string(list_transform(r, lambda y: y.digest), '')) END AS digest
      FROM (SELECT *, len(r) = 1 AND level > 0 AS moved, len(rest) = 0 AS ends, len(rest) = 0 OR len(r) >= {MOST} OR (len(r) >= {LEAST} AND ('0x' || substr(x.digest, 1, 2))::INT % {1 << BITS} = 0) AS closes
        FROM (SELECT directory, level, done, todo[1] AS x, todo[2:] AS rest, list_append(run, todo[1]) AS r FROM walk WHERE len(todo) > 0))))
) SELECT directory, made AS level, node, sep_name, n_children FROM walk WHERE node IS NOT NULL""")
def prolly_tree(s, d):
    return tree.directory_levels(_entries(s, d), BITS).select("directory", "level", "node", "sep_name", "n_children")


@query(f"{_LEVEL0} SELECT directory, sep_name FROM leaf")
def sep_names(s, d):
    return tree.leaf_runs(_entries(s, d), BITS).select("directory", "sep_name")


@query(f"""{_LEVEL0}, probe AS (SELECT DISTINCT source AS directory, lpad(CAST(doc_id + 7 AS VARCHAR), 12, '0') AS name FROM documents WHERE doc_id % 5 = 0)
SELECT p.directory, p.name, (SELECT min(sep_name) FROM leaf l WHERE l.directory = p.directory AND l.sep_name >= p.name) AS sep_name,
  EXISTS (SELECT 1 FROM entries e WHERE e.directory = p.directory AND e.name = p.name) AS found FROM probe p""")
def lookup_entry(s, d):
    probes = table(s, d, "documents").where("doc_id % 5 = 0").select(F.col("source").alias("directory"), F.lpad((F.col("doc_id") + 7).cast("string"), 12, "0").alias("name"))
    leaves = tree.leaf_runs(_entries(s, d), BITS)
    return tree.lookup(probes, leaves, _entries(s, d))


@query(f"""{_LEVEL0}, probe AS (SELECT DISTINCT source AS directory, lpad(CAST(doc_id + 7 AS VARCHAR), 12, '0') AS name FROM documents)
SELECT p.directory, p.name, (SELECT min(sep_name) FROM leaf l WHERE l.directory = p.directory AND l.sep_name >= p.name) AS sep_name,
  EXISTS (SELECT 1 FROM entries e WHERE e.directory = p.directory AND e.name = p.name) AS found FROM probe p""")
def lookup_every_entry(s, d):
    probes = table(s, d, "documents").select(F.col("source").alias("directory"), F.lpad((F.col("doc_id") + 7).cast("string"), 12, "0").alias("name"))
    leaves = tree.leaf_runs(_entries(s, d), BITS)
    return tree.lookup(probes, leaves, _entries(s, d))


_FS = f"""{R.DOCS}, fs AS (
  SELECT '' AS parent, source AS name, '/' || source AS child FROM docs
  UNION SELECT '/' || source, lang, '/' || source || '/' || lang FROM docs
  UNION SELECT '/' || source || '/' || lang, CAST(doc_id AS VARCHAR), 'f|' || h FROM docs
)"""


def _fs(s, d):
    """parent, name, child: the directories by their path, files by their hash."""
    t = R.documents(s, d)
    top = t.select(F.lit("").alias("parent"), F.col("source").alias("name"), F.concat(F.lit("/"), "source").alias("child"))
    mid = t.select(F.concat(F.lit("/"), "source"), "lang", F.concat_ws("/", F.lit(""), "source", "lang"))
    low = t.select(F.concat_ws("/", F.lit(""), "source", "lang"), F.col("doc_id").cast("string"), F.concat(F.lit("f|"), "h"))
    return top.union(mid).union(low).distinct()


@query(f"""WITH {_FS}, wanted AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS lang FROM docs)
SELECT w.doc_id, c.child AS node FROM wanted w LEFT JOIN fs a ON a.parent = '' AND a.name = w.source LEFT JOIN fs b ON b.parent = a.child AND b.name = w.lang
LEFT JOIN fs c ON c.parent = b.child AND c.name = CAST(w.doc_id AS VARCHAR)""")
def path_resolve(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat_ws("/", F.lit("/."), "source", F.lit(""), F.when(F.col("doc_id") % 4 == 0, "xx").otherwise(F.col("lang")), F.col("doc_id").cast("string")).alias("path"))
    return tree.resolve(docs.select("doc_id", F.lit("").alias("start"), S.path_parts(F.col("path")).alias("parts")), _fs(s, d).withColumn("is_dir", ~F.startswith("child", F.lit("f|")))).select("doc_id", "node")


@query("SELECT o_orderkey AS name, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40")
def list_page(s, d):
    return tree.page(table(s, d, "orders").select(F.col("o_orderkey").alias("name"), "o_totalprice"), 500, 40).drop("more")


@query("SELECT o_orderkey AS name, (SELECT count(*) FROM orders WHERE o_orderkey > 500) > 40 AS more FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40")
def list_page_more(s, d):
    return tree.page(table(s, d, "orders").select(F.col("o_orderkey").alias("name")), 500, 40)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before >= o_orderdate")
def order_violations(s, d):
    rows = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tree.out_of_order(rows, "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey")


@query(f"""WITH {R.DOCS} SELECT doc_id, 'file' AS kind, '-rw-r--r--' AS shown_mode, size, CASE WHEN size < 1024 THEN size || ' B' ELSE CAST(CAST(round(size / 1024, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KiB' END AS human, key FROM docs""")
def ls_listing(s, d):
    mode = F.lit(0o100644)
    return R.documents(s, d).select("doc_id", S.entry_kind(mode).alias("kind"), S.mode_string(mode).alias("shown_mode"), "size", S.human_size(F.col("size")).alias("human"), "key")


@query(f"""WITH RECURSIVE {_FS}, walk AS (SELECT '' AS node, '' AS path, 0 AS depth UNION ALL SELECT fs.child, walk.path || '/' || fs.name, walk.depth + 1 FROM walk JOIN fs ON fs.parent = walk.node)
SELECT node, path, depth FROM walk""")
def subtree_paths(s, d):
    return tree.subtree_paths(s.createDataFrame([("", "")], "node string, path string"), _fs(s, d))


@query(f"WITH {R.LINES} SELECT doc_id, pos, CAST(coalesce(sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, strlen(line) AS size FROM lines")
def chunk_offsets(s, d):
    return _offsets(s, d)


def _offsets(s, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return R.lines(s, d).select("doc_id", "pos", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("off"), "size")


@query(f"""WITH {R.LINES}, o AS (SELECT doc_id, pos, coalesce(sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, strlen(line) AS size FROM lines)
SELECT doc_id, max(pos) AS pos, CAST(300 - arg_max(off, pos) AS BIGINT) AS inside FROM o WHERE off <= 300 GROUP BY doc_id HAVING arg_max(off + size, pos) > 300""")
def seek_chunk(s, d):
    at = _offsets(s, d).where("off <= 300").groupBy("doc_id").agg(F.max("pos").alias("pos"), F.max_by("off", "pos").alias("off"), F.max_by("size", "pos").alias("size"))
    return at.where("off + size > 300").select("doc_id", "pos", (300 - F.col("off")).alias("inside"))


@query(f"WITH {R.LINES} SELECT doc_id, count(*) AS n_chunks, CAST(sum(strlen(line)) AS BIGINT) AS size FROM lines GROUP BY doc_id")
def file_size_rollup(s, d):
    return R.lines(s, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("size"))


@query(f"WITH {R.DOCS} SELECT source, lang, CAST(sum(size) AS BIGINT) AS footprint, count(*) AS n_files FROM docs GROUP BY ROLLUP (source, lang)")
def dir_footprint(s, d):
    return R.documents(s, d).rollup("source", "lang").agg(F.sum("size").alias("footprint"), F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {R.DOCS} SELECT doc_id, h FROM docs")
def content_concat(s, d):
    whole = R.lines(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return whole.select("doc_id", F.sha2("text", 256).alias("h"))


@query(f"WITH {R.LINES} SELECT doc_id, substr(line, 1, 20) AS head FROM lines WHERE pos = 0")
def prefix_bytes(s, d):
    return R.lines(s, d).where("pos = 0").select("doc_id", F.substring("line", 1, 20).alias("head"))


#: Lines have nothing below them.
LEAF = "node LIKE 'l|%'"
_REACH = """reach AS (SELECT name, node FROM refs UNION SELECT r.name, e.child FROM reach r JOIN edges e ON e.parent = r.node)"""


@query(f"WITH RECURSIVE {R.GRAPH}, reach AS (SELECT node FROM refs WHERE name = 'src1' UNION SELECT e.child FROM reach r JOIN edges e ON e.parent = r.node) SELECT node FROM reach")
def reachable_keys(s, d):
    return graph.closure(R.refs(s, d).where("name = 'src1'"), R.edges(s, d), leaf=LEAF)


@query(f"WITH RECURSIVE {R.GRAPH}, {_REACH} SELECT name, count(*) AS n_keys FROM reach GROUP BY name")
def reachable_per_ref(s, d):
    return graph.closure(R.refs(s, d), R.edges(s, d), ("name",), leaf=LEAF).groupBy("name").agg(F.count(F.lit(1)).alias("n_keys"))


@query(f"WITH RECURSIVE {R.GRAPH}, reach AS (SELECT node FROM refs WHERE name LIKE 'src1%' UNION SELECT e.child FROM reach r JOIN edges e ON e.parent = r.node) SELECT node FROM reach")
def mark_live(s, d):
    return graph.closure(R.refs(s, d).where("name LIKE 'src1%'"), R.edges(s, d), leaf=LEAF)


@query(f"WITH RECURSIVE {R.GRAPH}, reach AS (SELECT node FROM refs UNION SELECT e.child FROM reach r JOIN edges e ON e.parent = r.node) SELECT node FROM reach")
def mark_every_live(s, d):
    return graph.closure(R.refs(s, d), R.edges(s, d), leaf=LEAF)


@query(f"WITH RECURSIVE {R.GRAPH}, {_REACH} SELECT name, count(*) AS visited, count(*) FILTER (node NOT IN (SELECT node FROM present)) AS absent FROM reach GROUP BY name")
def completeness(s, d):
    seen = graph.closure(R.refs(s, d), R.edges(s, d), ("name",), leaf=LEAF).join(R.present_nodes(s, d).withColumn("there", F.lit(True)), "node", "left")
    return seen.groupBy("name").agg(F.count(F.lit(1)).alias("visited"), F.count_if(F.col("there").isNull()).alias("absent"))


@query(f"WITH RECURSIVE {R.GRAPH}, reach AS (SELECT name, node FROM refs UNION SELECT r.name, e.child FROM reach r JOIN present p ON p.node = r.node JOIN edges e ON e.parent = r.node) SELECT name, node FROM reach WHERE node NOT IN (SELECT node FROM present)")
def missing_frontier(s, d):
    return graph.missing(R.refs(s, d), R.edges(s, d), R.present_nodes(s, d), ("name",), leaf=LEAF)


@query(f"WITH RECURSIVE {R.GRAPH}, wanted AS (SELECT DISTINCT 'f|' || h AS node FROM docs WHERE doc_id % 20 = 3), up AS (SELECT node AS wanted, node FROM wanted UNION SELECT up.wanted, e.parent FROM up JOIN edges e ON e.child = up.node) SELECT up.wanted, refs.name FROM up JOIN refs USING (node)")
def why_alive(s, d):
    wanted = R.documents(s, d).where("doc_id % 20 = 3").select(F.concat(F.lit("f|"), "h").alias("node")).distinct()
    return graph.why(wanted, R.edges(s, d), R.refs(s, d))


@query(f"WITH RECURSIVE {R.GRAPH}, wanted AS (SELECT DISTINCT 'f|' || h AS node FROM docs), up AS (SELECT node AS wanted, node FROM wanted UNION SELECT up.wanted, e.parent FROM up JOIN edges e ON e.child = up.node) SELECT up.wanted, refs.name FROM up JOIN refs USING (node)")
def why_every_file(s, d):
    return graph.why(R.documents(s, d).select(F.concat(F.lit("f|"), "h").alias("node")).distinct(), R.edges(s, d), R.refs(s, d))
