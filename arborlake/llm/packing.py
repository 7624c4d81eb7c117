"""Packing of token sequences: shortest-pack-first over the length histogram.

A document's ids are cut every ``max_length``; full pieces are sequences of
their own, and the rest takes part in packing.  Only the histogram of piece
lengths (at most ``max_length`` rows) reaches the driver.  There lengths are
placed longest first, many equal pieces at a time, each into the packing
pattern with the most room; a pattern is a list of lengths and a count of
sequences.  Patterns are joined back to pieces by rank: a piece's rank among
those of its length says which slot of which sequence is its own.

Ranks take no sort: a task that cuts documents numbers its pieces of each length,
and the tasks' counts, summed up in order, say where each task's numbers begin.
Patterns are broadcast: a length splits at most one pattern and begins at most
two, so there are at most ``3 * max_length`` of them, whatever the corpus.

Null text counts as empty, which leaves the single closing id.  Rows that repeat
are packed each on its own; pieces of equal length are alike, so ties may fall in
any order.  A very long text is many pieces.  Columns named as those made here are
replaced, others keep their names; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, load
from .common import cut, fresh, read_table, small

Pattern = tuple[int, tuple[int, ...]]


def pack_histogram(histogram: dict[int, int], max_length: int) -> list[Pattern]:
    """Patterns as (number of sequences, lengths in order), covering the histogram exactly."""
    room: list[list[Pattern]] = [[] for _ in range(max_length + 1)]
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, most = histogram[length], max_length
        while left:
            while most >= length and not room[most]:
                most -= 1
            if most < length:
                room[max_length - length].append((left, (length,)))
                # a new pack may itself have room for more of this length
                if max_length - length >= length and left > 1:
                    count, lengths = room[max_length - length].pop()
                    each = min(max_length // length, left)
                    packs, over = divmod(count, each)
                    room[max_length - length * each].append((packs, lengths * each))
                    if over:
                        room[max_length - length * over].append((1, lengths * over))
                left = 0
                continue
            count, lengths = room[most].pop()
            take = min(count, left)
            if count > take:
                room[most].append((count - take, lengths))
            room[most - length].append((take, (*lengths, length)))
            left -= take
    return [p for ps in room for p in ps]


class Slots:
    """Places of a length in the patterns, by rank."""

    def __init__(self, patterns: list[Pattern]):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for count, lengths in patterns:
            offset = 0
            for length in lengths:
                rows.setdefault(length, []).append((count, first, offset))
                offset += length
            first += count
        self.tables = {}
        for length, x in rows.items():
            a = np.array(x, np.int64)
            self.tables[length] = (np.concatenate([[0], a[:, 0].cumsum()[:-1]]), a[:, 1], a[:, 2])

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, first, offset = self.tables[length]
        i = np.searchsorted(start, rank, side="right") - 1
        return first[i] + rank - start[i], offset[i]


MADE = ["start", "length", "ids_crc32", "doc_tokens"]
PLACED = ["sequence_id", "offset"]


def pieces(docs: DataFrame, text: str = "text", max_length: int = 1024, path: str | None = None, closing_id: int = 0) -> DataFrame:
    """A row for each piece: the other columns plus ``start, length, ids_crc32, doc_tokens``, and two last columns with the
    task that cut it and its number among the task's pieces of that length."""
    path = path or default_vocabulary()
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), *MADE, *PLACED)]
    x, task, nth = fresh(rest + MADE + PLACED, "text_to_pack", "pack_task", "pack_nth")
    df = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias(x))
    schema = df.drop(x).schema
    for name in (*MADE, task, nth):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, closing, own = load(path), np.array([closing_id], np.uint32), TaskContext.get().partitionId()
        counts = [0] * (max_length + 1)
        for b in batches:
            row, start, length, crc, total, number = [], [], [], [], [], []
            for i, v in enumerate(b.column(b.num_columns - 1)):
                ids = np.concatenate([bpe.encode(v.as_py() or ""), closing]).astype("<u4")
                for at in range(0, len(ids), max_length):
                    part = ids[at : at + max_length]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    number.append(counts[len(part)])
                    counts[len(part)] += 1
            kept = b.select(list(range(b.num_columns - 1))).take(pa.array(row, pa.int64())) if b.num_columns > 1 else None
            yield pa.RecordBatch.from_arrays([*(kept.columns if kept else []), *(pa.array(c, pa.int64()) for c in (start, length, crc, total, [own] * len(row), number))], names=schema.names)

    return df.mapInArrow(run, schema)


def pack(parts: DataFrame, max_length: int = 1024) -> DataFrame:
    """``parts``, a written table that ``pieces`` gave, with ``sequence_id, offset`` in place of its last two columns."""
    spark = parts.sparkSession
    *columns, task, nth = parts.columns
    counts = cut(parts.groupBy("length", task).agg(F.count(F.lit(1)).alias("n")), "pack_counts")
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_length rows
    shared = spark.sparkContext.broadcast(Slots(pack_histogram(sizes, max_length)))
    before = (F.sum("n").over(Window.partitionBy("length").orderBy(task)) - F.col("n")).alias("n")
    begin, rank = fresh(parts.columns + PLACED, "pack_begin", "pack_rank")
    begins = cut(counts.select("length", task, before).withColumnRenamed("n", begin), "pack_begins")
    df = parts.join(small(begins), ["length", task]).select(*[F.col(f"`{c}`") for c in columns], (F.col(nth) + F.col(begin)).cast("long").alias(rank))
    schema = df.drop(rank).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for b in batches:
            length, r = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                sequence[at], offset[at] = slots.find(int(x), r[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return df.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, text: str = "text", max_length: int = 1024, path: str | None = None) -> DataFrame:
    """Pieces of ``docs`` with their sequence and offset."""
    return pack(cut(pieces(docs, text, max_length, path), "pieces"), max_length)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
