"""Content-defined cuts of byte strings, by a rolling gear hash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .hashing import blake3_many


@cache
def _gear() -> np.ndarray:
    """A 64-bit number for each byte, from the content hash."""
    return np.array([int.from_bytes(h[:8], "little") for h in blake3_many([bytes([i]) for i in range(256)])], np.uint64)


def cuts(data: bytes, least: int = 32 << 10, average: int = 512 << 10, most: int = 1 << 20) -> list[int]:
    """Ends of the chunks: each has at least ``least`` bytes (but the last) and at most ``most``, and equal
    stretches of content are cut alike.  Empty data has no chunks."""
    if not 0 < least <= average <= most:
        raise ValueError("chunk sizes must rise from least to most")
    n = len(data)
    bits = max(1, (average - least).bit_length() - 1)
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))
    # the hash at a byte covers the 64 bytes up to it: older ones are shifted out
    h = _gear()[np.frombuffer(data, np.uint8)]
    step = 1
    while step < 64:
        later = h.copy()
        later[step:] += h[:-step] << np.uint64(step)
        h, step = later, step * 2
    hits = np.flatnonzero((h & mask) == 0) + 1
    out, at = [], 0
    while at < n:
        i = np.searchsorted(hits, at + least)
        end = int(hits[i]) if i < len(hits) and hits[i] <= at + most else min(n, at + most)
        out.append(min(end, n))
        at = out[-1]
    return out


def chunked(files: DataFrame, content: str = "content", least: int = 32 << 10, average: int = 512 << 10, most: int = 1 << 20) -> DataFrame:
    """A row for each chunk: the other columns plus ``pos, off, chunk``.  A file without bytes has one empty chunk, null content none."""
    rest = [c for c in files.columns if c != content]
    df = files.where(F.col(content).isNotNull()).select(*rest, content)
    schema = StructType([*df.drop(content).schema.fields, StructField("pos", LongType()), StructField("off", LongType()), StructField("chunk", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in enumerate(b.column(b.num_columns - 1)):
                data = v.as_py()
                ends = cuts(data, least, average, most) or [0]
                starts = [0, *ends[:-1]]
                row = b.select(list(range(b.num_columns - 1))).take(pa.array([i] * len(ends), pa.int64())) if b.num_columns > 1 else None
                yield pa.RecordBatch.from_arrays([*(row.columns if row else []), pa.array(range(len(ends)), pa.int64()), pa.array(starts, pa.int64()), pa.array([data[x:y] for x, y in zip(starts, ends, strict=True)], pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)
