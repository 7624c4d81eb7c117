"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql.types import StructType

from ..sources.tables import discard as drop
from ..sources.tables import shared_dir, small
from ..sources.tables import table as read_table
from ..sources.tables import written as cut

__all__ = ["ASCII_LOWER", "ASCII_UPPER", "SPACES", "cut", "drop", "fresh", "frugal", "read_table", "shared_dir", "small", "widened"]

#: Word separators of every operator here: space and \t \n \v \f \r (ASCII).
SPACES = "\\x20\\x09-\\x0D"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``columns`` (compared without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def widened(schema: StructType, ddl: str) -> StructType:
    """``schema`` with further fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, for mapInArrow, after which its process gives back what the C library and Arrow keep of freed memory: an
    idle Python worker stays for a minute beside whatever its executor does next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return run
