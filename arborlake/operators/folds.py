"""Order-dependent segmentation: where the next group starts depends on where the last one did.

``fold`` gives each row a group number within its key, in order.  Rows are
sorted within partitions by (key, position) and streamed through a small state
machine, so a key of any size needs constant memory.  A key's order is one
chain by definition; a writer, a directory or a stream is a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


class BatchFold:
    """A batch closes before it would overflow ``max_bytes`` or ``max_keys``; an oversized item is alone."""

    def __init__(self, max_bytes: int, max_keys: int):
        self.max_bytes, self.max_keys = max_bytes, max_keys
        self.start()

    def start(self) -> None:
        self.bytes = self.keys = self.group = 0

    def step(self, size: int) -> int:
        size = size or 0
        if self.keys and (self.bytes + size > self.max_bytes or self.keys >= self.max_keys):
            self.group, self.bytes, self.keys = self.group + 1, 0, 0
        self.bytes, self.keys = self.bytes + size, self.keys + 1
        return self.group


class SegmentFold:
    """A segment closes after the append that reaches the threshold; it starts with a header, and so does every record."""

    def __init__(self, threshold: int, segment_header: int = 8, record_header: int = 46):
        self.threshold, self.segment_header, self.record_header = threshold, segment_header, record_header
        self.start()

    def start(self) -> None:
        self.bytes, self.group = self.segment_header, 0

    def step(self, size: int) -> int:
        group = self.group
        self.bytes += self.record_header + (size or 0)
        if self.bytes >= self.threshold:
            self.group, self.bytes = self.group + 1, self.segment_header
        return group


class ItemFold:
    """A run closes after the item that makes it ``max`` long, or after one whose hash hits once it is ``min`` long.

    With k bits: min = max(2^k / 4, 2), max = 4 * 2^k.
    """

    def __init__(self, bits: int):
        self.min, self.max = max((1 << bits) // 4, 2), 4 << bits
        self.start()

    def start(self) -> None:
        self.run = self.group = 0

    def step(self, hit: bool) -> int:
        group = self.group
        self.run += 1
        if self.run >= self.max or (self.run >= self.min and hit):
            self.run, self.group = 0, self.group + 1
        return group


class ReplayFold:
    """Group 0: accepted, 1: a replay.  A sighting counts for ``keep`` from the first accepted one, its end included."""

    def __init__(self, keep: int):
        self.keep = keep
        self.start()

    def start(self) -> None:
        self.first: int | None = None

    def step(self, at: int) -> int:
        if self.first is not None and at - self.first <= self.keep:
            return 1
        self.first = at
        return 0


class OwnerFold:
    """Outcome of writing a reference, by the record that is stored: 204 (accepted, or the same record again), 403 (another
    signer's) or 409 (not newer).  An admin may do either."""

    def start(self) -> None:
        self.stored: tuple | None = None

    def step(self, signer, created: int, record, admin: bool) -> int:
        if self.stored is not None and not admin:
            owner, at, same = self.stored
            if owner != signer:
                return 403
            if created <= at and record != same:
                return 409
        self.stored = (signer, created, record)
        return 204


def fold(df: DataFrame, machine, key: list[str], order: list[str], values: list[str], out: str = "group_no") -> DataFrame:
    """``df`` plus ``out`` (LONG): the machine's answer for each row of a key, in order, given the row's ``values``.

    A null key is a key of its own; ties in ``order`` fall in any order.
    """
    schema = StructType([*df.schema.fields, StructField(out, LongType())])
    at_key, at_value = ([df.columns.index(c) for c in x] for x in (key, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        for b in batches:
            keys = zip(*(b.column(i).to_pylist() for i in at_key), strict=True)
            rows = zip(*(b.column(i).to_pylist() for i in at_value), strict=True)
            found = np.empty(len(b), np.int64)
            for i, (k, row) in enumerate(zip(keys, rows, strict=True)):
                if k != now:
                    now = k
                    machine.start()
                found[i] = machine.step(*row)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=schema.names)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
