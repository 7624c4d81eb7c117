"""Closures over an edge table, by frontier loops.

Each round joins the frontier with the edges, keeps what hasn't been seen, and
writes it, so plans stay short and a lost executor costs a reread.  Only ids
travel, no payloads.  Rounds are as many as the graph is deep, without a limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, written


def closure(roots: DataFrame, edges: DataFrame, labels: tuple[str, ...] = (), expand: DataFrame | None = None, leaf: str | None = None) -> DataFrame:
    """Rows ``labels..., node`` reachable from ``roots`` (same columns), roots included, each once.

    edges: ``parent, child``.  expand: if given, only nodes in it (column
    ``node``) are descended from; the others are reached all the same.  leaf: a
    condition on ``node`` for nodes known to have no children, which never meet
    the edges.  What was seen is one table, rewritten when the new rounds outgrow
    it, so that a round reads no more than twice what it must.
    """
    on = [*labels, "node"]
    # every round joins them: computed once
    edges = written(edges.select(F.col("parent").alias("node"), "child"), "edges")
    expand = None if expand is None else written(expand.select("node").where("true" if leaf is None else f"NOT ({leaf})").distinct(), "expand")
    frontier = written(roots.select(*on).distinct(), "frontier")
    seen, size, rounds, fresh = frontier, frontier.count(), [], 0
    while True:
        source = frontier if leaf is None else frontier.where(f"NOT ({leaf})")
        source = source if expand is None else source.join(expand, "node", "left_semi")
        step = source.join(edges, "node").select(*labels, F.col("child").alias("node")).distinct()
        frontier = written(step.join(reduce(DataFrame.unionByName, rounds, seen), on, "left_anti"), "frontier")
        n = frontier.count()
        if not n:
            return reduce(DataFrame.unionByName, rounds, seen)
        rounds, fresh = [*rounds, frontier], fresh + n
        if fresh > size or len(rounds) == 16:
            seen, size, rounds, fresh = written(reduce(DataFrame.unionByName, rounds, seen), "seen"), size + fresh, [], 0


def missing(roots: DataFrame, edges: DataFrame, present: DataFrame, labels: tuple[str, ...] = (), leaf: str | None = None) -> DataFrame:
    """Reachable nodes that aren't in ``present`` (column ``node``); absent nodes aren't descended from."""
    present = written(present.select("node"), "present")
    return closure(roots, edges, labels, expand=present, leaf=leaf).join(present, "node", "left_anti")


def pull(roots: DataFrame, edges: DataFrame, present: DataFrame, leaf: str | None = None) -> DataFrame:
    """Rows ``node, round``: what a pull fetches, and when.  Fetch what is missing, look below it, until nothing is.

    ``edges`` are those of the remote side: of an absent node they are known once it has come.  A node's round is the
    least number of absent nodes on a way to it, itself included, so one walk gives all rounds: what is there continues
    the round that reached it, what is absent begins the next.  Leaves don't take part in the walk; they get the least
    round of their parents in one pass over their edges, so these are sent once, whatever the number of rounds.
    """
    inner = "true" if leaf is None else f"NOT ({leaf})"
    edges = edges.select(F.col("parent").alias("parent_node"), F.col("child").alias("node")).where("parent_node IS NOT NULL AND node IS NOT NULL")
    roots = roots.select("node").where("node IS NOT NULL").distinct()
    there = present.select("node").where(inner).distinct().withColumn("there", F.lit(True))
    walked, there = written(edges.where(inner), "edges"), written(there, "present")

    # what was walked, with round and whether it was there: 16 tables become one of the next level
    levels: list[list[DataFrame]] = [[]]

    def add(new: DataFrame, i: int = 0) -> None:
        levels[i].append(new)
        if len(levels[i]) == 16:
            levels.extend([[]] if i + 1 == len(levels) else [])
            merged, levels[i] = written(reduce(DataFrame.unionByName, levels[i]), "seen"), []
            add(merged, i + 1)

    def reach(nodes: DataFrame) -> DataFrame:
        seen = [t for level in levels for t in level]
        new = nodes.join(reduce(DataFrame.unionByName, seen).select("node"), "node", "left_anti") if seen else nodes
        return written(new.join(there, "node", "left").select("node", F.coalesce("there", F.lit(False)).alias("there")), "reached")

    step, waiting, k = reach(roots.where(inner)), [], 0  # waiting: absent nodes of the next round
    while True:
        on, off = step.where("there"), step.where("NOT there")
        if not off.isEmpty():
            waiting.append(off.select("node"))
        if not on.isEmpty():
            frontier = on
        elif waiting:
            k += 1
            frontier = written(reduce(DataFrame.unionByName, waiting).distinct().withColumn("there", F.lit(False)), "fetched")
            waiting = []
        else:
            break
        add(frontier.withColumn("round", F.lit(k)))
        below = frontier.select(F.col("node").alias("parent_node")).join(walked, "parent_node").select("node").distinct()
        step = reach(below)
    discard(walked, there)
    nothing = roots.where("false").select("node", F.lit(True).alias("there"), F.lit(0).alias("round"))
    seen = reduce(DataFrame.unionByName, [t for level in levels for t in level], nothing)
    out = seen.where("NOT there").select("node", "round")
    if leaf is None:
        return out
    leaves = seen.select(F.col("node").alias("parent_node"), "round").join(edges.where(leaf), "parent_node").select("node", "round")
    leaves = leaves.unionByName(roots.where(leaf).withColumn("round", F.lit(0))).groupBy("node").agg((F.min("round") + 1).alias("round"))
    return out.unionByName(leaves.join(present.select("node").where(leaf), "node", "left_anti"))


def gate(refs: DataFrame, edges: DataFrame, present: DataFrame, leaf: str | None = None) -> DataFrame:
    """``refs`` (name, node) plus ``n_missing`` and ``complete``: a reference is taken only if all below it is there."""
    lacking = missing(refs.select("name", "node"), edges, present, ("name",), leaf).groupBy("name").agg(F.count(F.lit(1)).alias("n_missing"))
    return refs.join(lacking, "name", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0))).withColumn("complete", F.col("n_missing") == 0)


def why(nodes: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows ``wanted, name`` of the references (``name, node``) whose closure holds a wanted node, over reversed edges."""
    back = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    above = closure(nodes.select(F.col("node").alias("wanted"), "node"), back, ("wanted",))
    return above.join(refs.select("name", "node"), "node").select("wanted", "name").distinct()
