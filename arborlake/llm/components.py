"""Connected components of an undirected edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Contracted edges that one task may finish, 16 bytes each.
FEW = 1_000_000


def _finish(edges: DataFrame) -> DataFrame:
    """Rows ``node, up`` of at most ``FEW`` edges, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "up"])

    return edges.select("u", "v").repartition(1).mapInArrow(run, "node long, up long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``node, component`` (the smallest node reachable) for every node of an edge.

    Each pass hooks every vertex to its smallest neighbour, shortens the paths
    by pointer jumping, and contracts the edges, so the number of passes grows
    with the logarithm of the input.  Once the edges left are few, by count, one
    task finishes them.  Tables are written between passes.  Nodes are LONG;
    null ends, loops and repeated edges are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    known: DataFrame | None = None

    def follow(parent: DataFrame) -> DataFrame:
        if known is None:
            return parent
        step = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        out = cut(known.join(step, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "components")
        drop(known, parent)
        return out

    while (n := e.count()) > FEW:
        table = e
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the parent of a vertex is its smallest neighbour or itself: parents never rise, so there is no cycle
        first = parent = cut(e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")), "parents")
        for _ in range(2):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            parent = parent.join(above, "up").select("node", F.col("upper").alias("up"))
        parent = cut(parent, "parents")
        drop(first)
        left = parent.select(F.col("node").alias("u"), F.col("up").alias("x"))
        right = parent.select(F.col("node").alias("v"), F.col("up").alias("y"))
        e = e.join(left, "u").join(right, "v").where("x <> y")
        e = cut(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
        drop(table)
        known = follow(parent)
    if n or known is None:
        known = follow(cut(_finish(e), "parents"))
    drop(e)
    return known.select("node", F.col("up").alias("component"))
