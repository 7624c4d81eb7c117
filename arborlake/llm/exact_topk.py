"""Exact top-k search by inner product, with pivot-table elimination.

Components become integers, so scores are exact.  Vectors are lifted by one
coordinate to a common norm M; then the nearest vectors of a query (lifted with
zero) are those of largest inner product.  Distances of every vector to many
pivots are computed once.  For a query, the largest difference of its and a
vector's pivot distances bounds their distance from below, hence the score from
above.  Candidates are evaluated in the order of that bound until it falls below
the k-th score found, with a slack for rounding; ties are kept.

Vectors lie in cells by their nearest pivot, in blocks of about ``block`` rows,
queries in blocks of about ``query_block``.  One join brings a block of queries
to the blocks of those cells that the ranges of pivot distances do not rule out,
for all queries in one job; a pair of blocks streams through a task, and gives at
most k rows for a query.  The k-th score among a bounded sample of the vectors,
from which pivots are taken too, is every query's first threshold.  The driver
sees the sample and the ranges of the cells, both of fixed size.

Vectors that are null, hold null or non-finite components, or have no id take no
part.  A query meets the vectors of its own length, but not its own row; rows
that repeat its id or vector are candidates.  A repeated query row is answered
once for each row.  Scores beyond 64 bits are cut to that range.  Other columns
of the input are not looked at; an empty table gives no answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

KINDS = (np.int64, np.int64, np.float64, np.float64)


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows with q as int64."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).sum())
    if bound < 2**53:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row.tolist(), q.tolist(), strict=True)) for row in x]
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in exact], np.int64)


@dataclass(frozen=True)
class Pivots:
    """Pivots with their lift, and the largest squared norm of all vectors."""

    rows: np.ndarray
    top: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        """Distances of vectors to the pivots."""
        d = 2 * self.top - 2 * (x @ self.rows.T + np.outer(self.lift(x), self.lift(self.rows)))
        return np.sqrt(np.maximum(d, 0.0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        d = (q * q).sum(axis=1)[:, None] + self.top - 2 * (q @ self.rows.T)
        return np.sqrt(np.maximum(d, 0.0))


def choose_pivots(sample: np.ndarray, top: float, count: int) -> Pivots:
    """Each next pivot is the row of the sample furthest from those before."""
    chosen, near = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        near = np.minimum(near, Pivots(sample[chosen[-1:]], top).of_vectors(sample)[:, 0])
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return Pivots(sample[chosen], top)


class Best:
    """The k best of what a query has met: higher scores first, ties to smaller ids."""

    def __init__(self, k: int, least: int | None):
        self.k, self.score, self.id, self.first = k, np.zeros(0, np.int64), np.zeros(0, np.int64), least

    @property
    def least(self) -> int | None:
        found = int(self.score[-1]) if len(self.score) == self.k else None
        return found if self.first is None else self.first if found is None else max(found, self.first)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score))[: self.k]
        self.score, self.id = score[order], ids[order]


def search_rows(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, top: float, query_rows: np.ndarray, q: np.ndarray, q_table: np.ndarray, best: list[Best]) -> int:
    """Update ``best`` with these rows; the number of rows evaluated."""
    done = 0
    norms = (q * q).sum(axis=1)
    slack = 1e-7 * (top + norms) + 1.0
    for j in range(len(q)):
        low = np.abs(table - q_table[j]).max(axis=1) if table.shape[1] else np.zeros(len(x))
        bound = (norms[j] + top - low * low) / 2 + slack[j]
        bound[rows == query_rows[j]] = -np.inf
        least = best[j].least
        at = np.flatnonzero(bound >= (least if least is not None else -np.finfo(float).max))
        at = at[np.argsort(-bound[at], kind="stable")]
        i, step = 0, 64
        while i < len(at):
            least = best[j].least
            if least is not None and bound[at[i]] < least:
                break
            part = at[i : i + step]
            best[j].add(exact_products(x[part], q[j]), ids[part])
            done += len(part)
            i, step = i + step, step * 2
    return done


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _packed(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Rows ``key..., name`` (a list of four byte strings) for each group of ``df`` (key..., row, id, v, d)."""
    names, n = [*key, *(f"{name}{i}" for i in range(4))], len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            parts = [t.column(n + i).combine_chunks() for i in range(4)]
            data = [p.to_numpy(zero_copy_only=False).astype(k) if i < 2 else p.flatten().to_numpy(zero_copy_only=False).astype(k) for i, (p, k) in enumerate(zip(parts, KINDS, strict=True))]
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in now), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=names)

        for b in batches:
            keys = np.column_stack([b.column(i).to_numpy() for i in range(n)]) if len(b) else np.zeros((0, n), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])) if len(b) else [0]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[i]) != now:
                    if held:
                        yield done()
                    now, held = tuple(keys[i].tolist()), []
                held.append(b.slice(i, j - i))
        if held:
            yield done()

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([*(f"{k} bigint" for k in key), *(f"{name}{i} binary" for i in range(4))])
    return df.select(*key, "row", "id", "v", "d").repartition(tasks, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, pivots: int = 48, sample_rows: int = 2048, block: int = 16384, query_block: int = 1024, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows ``query_id, rank, vec_id, score`` for the rows of ``vectors`` that ``is_query`` (a column) holds for."""
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("q"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite)
    rows = rows.select("id", F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"), F.coalesce("q", F.lit(False)).alias("q"), F.size(v).alias("n"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    found = spark.createDataFrame([], "row bigint, query_id bigint, vec_id bigint, score bigint")
    for r in rows.groupBy("n").agg(F.max(norm).alias("top"), F.count(F.lit(1)).alias("count"), F.count_if("q").alias("queries")).orderBy("n").collect():  # one row for each length of vector
        if r["queries"]:
            found = found.unionByName(_search(rows.where(F.col("n") == r["n"]), r["n"], r["top"], r["count"], r["queries"], k, pivots, sample_rows, block, query_block))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, width: int, top: float, count: int, queries: int, k: int, pivots: int, sample_rows: int, block: int, query_block: int) -> DataFrame:
    spark = rows.sparkSession
    # the share is taken by hash before the order, so that tasks send few rows
    place, share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)), min(1.0, 4 * sample_rows / count)
    sample = rows.where(place < int(share * (1 << 40))).orderBy(place, "id", "v").limit(sample_rows).collect()
    s_rows = np.array([r["row"] for r in sample], np.int64)
    s = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), width)
    chosen = choose_pivots(s, top, pivots) if len(sample) else Pivots(np.zeros((0, width)), top)
    p = len(chosen.rows)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = chosen.of_vectors(_matrix(b.column(2), width)) if p else np.zeros((len(b), 0))
            cell = d.argmin(axis=1) if p else np.zeros(len(b), np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * p, pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell, pa.int64()), flat], names=["row", "id", "v", "cell", "d"])

    table = cut(rows.select("row", "id", "v").mapInArrow(distances, "row bigint, id bigint, v array<double>, cell bigint, d array<double>"), "pivot_table")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full((max(p, 1), p), np.inf), np.full((max(p, 1), p), -np.inf), np.zeros(max(p, 1), np.int64)
        for b in batches:
            cell, d = b.column(0).to_numpy(), _matrix(b.column(1), p) if p else np.zeros((len(b), 0))
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
            n += np.bincount(cell, minlength=len(n))
        for c in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array([c] * max(p, 1), pa.int64()), pa.array(range(max(p, 1)), pa.int64()), pa.array(low[c] if p else [0.0]), pa.array(high[c] if p else [0.0]), pa.array([n[c]] * max(p, 1), pa.int64())], names=["cell", "pivot", "low", "high", "n"])

    low, high, n = np.full((max(p, 1), p), np.inf), np.full((max(p, 1), p), -np.inf), np.zeros(max(p, 1), np.int64)
    parts = table.select("cell", "d").mapInArrow(ranges, "cell bigint, pivot bigint, low double, high double, n bigint")
    for r in parts.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # at most pivots x pivots rows
        n[r["cell"]] = r["n"]
        if p:
            low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
    splits = [max(1, math.ceil(x / block)) for x in n.tolist()]
    groups = max(1, math.ceil(queries / query_block))

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their pivot distances and first threshold, once for each cell that may hold a better score."""
        for b in batches:
            at, q = b.column(0).to_numpy(), _matrix(b.column(2), width) if width else np.zeros((len(b), 0))
            d = chosen.of_queries(q) if p else np.zeros((len(b), 0))
            norms = (q * q).sum(axis=1)
            row, cell, first = [], [], []
            for i in range(len(q)):
                scores = exact_products(s[s_rows != at[i]], q[i])
                least = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None
                near = np.maximum(0, np.maximum(low - d[i], d[i] - high)).max(axis=1) if p else np.zeros(1)
                bound = (norms[i] + top - near * near) / 2 + 1e-7 * (top + norms[i]) + 1.0
                ok = np.flatnonzero((n > 0) & (bound >= (least if least is not None else -np.inf)))
                row += [i] * len(ok)
                cell += ok.tolist()
                first += [[-1.0, 0.0] if least is None else [1.0, float(least)]] * len(ok)
            # the threshold, beyond doubles rounded down, travels in front of the distances
            first = [[x[0], np.nextafter(x[1], -np.inf) if abs(x[1]) > 2**53 else x[1]] for x in first]
            both = np.concatenate([np.array(first, np.float64).reshape(len(row), 2), d[row]], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * (p + 2), pa.int32()), pa.array(both.ravel()))
            taken = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), flat, pa.array(cell, pa.int64())], names=["row", "id", "v", "d", "cell"])

    part_of = lambda x, seed, m: F.pmod(F.xxhash64(x, F.lit(seed)), m)
    many = F.element_at(F.array(*[F.lit(x).cast("long") for x in splits]), (F.col("cell") + 1).cast("int"))
    blocks = _packed(table.withColumn("split", part_of("row", 5, many)), ["cell", "split"], "x")
    asked = rows.where("q").select("row", "id", "v").mapInArrow(allowed, "row bigint, id bigint, v array<double>, d array<double>, cell bigint")
    asked = _packed(asked.withColumn("group", part_of("row", 6, F.lit(groups))), ["cell", "group"], "q")
    asked = asked.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x, q = ([np.frombuffer(b.column(f"{c}{j}")[i].as_py(), kind) for j, kind in enumerate(KINDS)] for c in "xq")
                rest = q[3].reshape(-1, p + 2)
                best = [Best(k, math.floor(f[1]) if f[0] > 0 else None) for f in rest[:, :2]]
                search_rows(x[0], x[1], x[2].reshape(len(x[0]), width), x[3].reshape(-1, p) if p else np.zeros((len(x[0]), 0)), top, q[0], q[2].reshape(len(q[0]), width), rest[:, 2:], best)
                m = [len(y.id) for y in best]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[0], m)), pa.array(np.repeat(q[1], m)), pa.array(np.concatenate([y.id for y in best])), pa.array(np.concatenate([y.score for y in best]))], names=["row", "query_id", "vec_id", "score"])

    return blocks.join(asked, ["cell", "split"]).mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score bigint")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rn, q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.rn <> v.rn AND len(q.x) = len(v.x)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
