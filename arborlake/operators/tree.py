"""Directories as trees of runs: building, looking up, paging and walking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .folds import ItemFold, fold


def hits(digest: Column, bits: int) -> Column:
    """True where the low bits (at most 8) of the digest, read as little-endian, are zero: those of its first byte."""
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int").bitwiseAND((1 << bits) - 1) == 0


def runs(items: DataFrame, bits: int, key: list[str], order: list[str], digest: str = "digest", out: str = "run") -> DataFrame:
    """``items`` plus the number of their run within the key."""
    marked = items.withColumn("is_hit", hits(F.col(digest), bits))
    return fold(marked, ItemFold(bits), key, order, ["is_hit"], out).drop("is_hit")


def ordered_digest(name: str, digest: str) -> Column:
    """SHA-256 over the digests of a group in order of a column."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, digest))), lambda x: x[digest]), ""), 256)


def directory_levels(entries: DataFrame, bits: int, directory: str = "directory") -> DataFrame:
    """Rows ``directory, level, node, sep_name, n_children`` of all tree nodes over ``entries`` (directory, name, digest).

    Level 0 are leaves over runs of entries; each next level has nodes over runs
    of nodes until a directory has one.  A last run of a single node moves up as
    it is.  A node's separator is the greatest name below it.  A run's length is
    bounded, so what a group collects is bounded too.
    """
    items = entries.select(directory, "name", "digest")
    out, level = [], 0
    while True:
        cutting = runs(items, bits, [directory], ["name"])
        node = cutting.groupBy(directory, "run").agg(ordered_digest("name", "digest").alias("node"), F.max("name").alias("name"), F.count(F.lit(1)).alias("n_children"), F.max("digest").alias("only"))
        up = (F.col("n_children") == 1) & F.lit(level > 0)
        node = written(node.select(directory, "name", F.when(up, F.col("only")).otherwise(F.col("node")).alias("digest"), "n_children", up.alias("moved")), "tree_level")
        out.append(node.where("NOT moved").select(directory, F.lit(level).alias("level"), F.col("digest").alias("node"), F.col("name").alias("sep_name"), "n_children"))
        more = node.groupBy(directory).count().where("count > 1").select(directory)
        items = written(node.join(more, directory, "left_semi").select(directory, "name", "digest"), "tree_items")
        level += 1
        if items.isEmpty():
            return reduce(DataFrame.unionByName, out)


def leaf_runs(entries: DataFrame, bits: int, directory: str = "directory") -> DataFrame:
    """Rows ``directory, run, n_children, first_name, sep_name, node`` of the leaves alone."""
    cutting = runs(entries.select(directory, "name", "digest"), bits, [directory], ["name"])
    return cutting.groupBy(directory, "run").agg(F.count(F.lit(1)).alias("n_children"), F.min("name").alias("first_name"), F.max("name").alias("sep_name"), ordered_digest("name", "digest").alias("node"))


def lookup(probes: DataFrame, separators: DataFrame, entries: DataFrame, directory: str = "directory") -> DataFrame:
    """``probes`` (directory, name) plus ``sep_name``, the first separator not below the name, and ``found``.

    Probes, separators and entries are sorted together once by directory and name,
    from the end; the last separator met on the way is a probe's, so the work is
    that of a sort, not of probes times separators.
    """
    row = lambda df, name, kind: df.select(directory, F.col(name).alias("name"), F.lit(kind).alias("kind"))
    together = row(separators, "sep_name", "separator").unionByName(row(entries, "name", "entry")).unionByName(row(probes, "name", "probe"))
    # one row for each name: what it is
    names = together.groupBy(directory, "name").agg(*[F.bool_or(F.col("kind") == k).alias(f"is_{k}") for k in ("separator", "entry", "probe")])
    back = Window.partitionBy(directory).orderBy(F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    found = names.withColumn("sep_name", F.last(F.when(F.col("is_separator"), F.col("name")), ignorenulls=True).over(back))
    return found.where("is_probe").select(directory, "name", "sep_name", F.col("is_entry").alias("found"))


PAGE, LARGEST_PAGE = 500, 1000


def page(entries: DataFrame, after: str | None, limit: int, name: str = "name") -> DataFrame:
    """Names above ``after`` in order, at most ``limit``; ``more`` says whether another follows.

    One row beyond the page tells; Spark keeps the limit + 1 least rows of each
    partition, so nothing is sorted as a whole.
    """
    if limit < 1:
        raise ValueError("the limit of a page must be positive")
    rows = entries if after is None else entries.where(F.col(name) > after)
    rows = rows.orderBy(name).limit(limit + 1)
    w = Window.orderBy(name)
    numbered = rows.withColumn("nth", F.row_number().over(w)).withColumn("more", F.count(F.lit(1)).over(Window.partitionBy()) > limit)
    return numbered.where(F.col("nth") <= limit).drop("nth")


def out_of_order(entries: DataFrame, directory: str, position: str, name: str) -> DataFrame:
    """Rows whose name isn't above that of the row before."""
    before = F.lag(name).over(Window.partitionBy(directory).orderBy(position))
    return entries.withColumn("before", before).where(F.col("before") >= F.col(name))


def subtree_paths(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows ``node, path, depth`` below ``roots`` (node, path); a shared subtree appears under each path.

    entries: ``parent, name, child``.  A tree of content keys has no cycle, so the levels end.
    """
    entries = written(entries.select(F.col("parent").alias("node"), "name", "child"), "entries")
    level, out, depth = roots.select("node", "path").withColumn("depth", F.lit(0)), [], 0
    while True:
        out.append(level)
        depth += 1
        level = written(level.join(entries, "node").select(F.col("child").alias("node"), F.concat_ws("/", "path", "name").alias("path"), F.lit(depth).alias("depth")), "paths")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        if len(out) == 64:
            out = [written(reduce(DataFrame.unionByName, out), "paths")]


def resolve(wanted: DataFrame, entries: DataFrame, start: str = "start", parts: str = "parts") -> DataFrame:
    """``wanted`` plus ``node`` and ``outcome``: ok, path (no parts: the path isn't allowed), missing or not_a_directory.

    entries: ``parent, name, child, is_dir``.  ``start`` is the node a path begins
    at (null: missing); no parts left means the node itself.  A join for each
    component, as many as the longest path has; a row whose path has ended, or
    failed, has a null parent and finds nothing more.
    """
    state = F.when(F.col(parts).isNull(), "path").when(F.col(start).isNull(), "missing")
    at = wanted.withColumn("node", F.col(start)).withColumn("outcome", state).withColumn("inside", F.lit(True))
    step = entries.select(F.col("parent").alias("at_parent"), F.col("name").alias("at_name"), F.col("child").alias("at_child"), F.col("is_dir").alias("at_dir"))
    for i in range(wanted.agg(F.max(F.size(parts))).first()[0] or 0):
        open_ = F.col("outcome").isNull() & (F.size(parts) > i)
        at = at.withColumn("from", F.when(open_ & F.col("inside"), F.col("node"))).withColumn("part", F.get(parts, F.lit(i)))
        at = at.join(step, (at["from"] == step["at_parent"]) & (at["part"] == step["at_name"]), "left")
        error = F.when(~F.col("inside"), "not_a_directory").when(F.col("at_child").isNull(), "missing")
        at = at.withColumn("outcome", F.when(open_, error).otherwise(F.col("outcome"))).withColumn("node", F.when(open_, F.col("at_child")).otherwise(F.col("node")))
        at = at.withColumn("inside", F.when(open_, F.coalesce("at_dir", F.lit(False))).otherwise(F.col("inside"))).drop("from", "part", "at_parent", "at_name", "at_child", "at_dir")
        if i % 8 == 7:  # a plan of very many joins would itself be the cost
            at = written(at, "resolved")
    done = F.coalesce("outcome", F.lit("ok"))
    return at.drop("inside").withColumn("outcome", done).withColumn("node", F.when(F.col("outcome") == "ok", F.col("node")))


def repeated_children(entries: DataFrame) -> DataFrame:
    """Directories (``parent``) with the number of entries whose child another entry of theirs has too."""
    again = entries.groupBy("parent", "child").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return again.groupBy("parent").agg(F.sum("n").alias("n_repeated"))
