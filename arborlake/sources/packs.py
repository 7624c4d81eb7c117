"""Packs of objects as a source and a sink."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.codec import MAGIC, Malformed, encode_record, parse_pack, verify

ROWS = "file string, off bigint, key binary, payload binary, error string"


def read_packs(spark: SparkSession, path: str, magic: bytes = MAGIC, verified: bool = True) -> DataFrame:
    """Rows ``file, off, key, payload, error`` of the packs at a path, on any file system that Spark reads.

    A record that isn't what its key says has an error (``hash``, ``length``);
    where a file stops making sense, a last row has the reason and no key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    for key, payload, at in parse_pack(data.as_py(), magic):
                        rows.append((name, at, key, payload, verify(key, payload) if verified else None))
                except Malformed as e:
                    rows.append((name, None, None, None, str(e)))
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "off", "key", "payload", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ROWS)


class PackSink(DataSource):
    """``df.write.format("objectpack").save(folder)`` writes a pack for each partition of rows ``key, payload``."""

    @classmethod
    def name(cls) -> str:
        return "objectpack"

    def schema(self) -> str:
        return "key binary, payload binary"

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], bytes.fromhex(self.options.get("magic", MAGIC.hex())))


class PackWriter(DataSourceWriter):
    """Tasks write under names of their own, and a commit gives the files of the tasks that count their place."""

    def __init__(self, path: str, magic: bytes):
        self.path, self.magic = path, magic

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        where.create_dir(base, recursive=True)
        name = f"{base}/_{uuid.uuid4().hex}.pending"
        with where.open_output_stream(name) as out:
            out.write(self.magic)
            for r in rows:
                out.write(encode_record(bytes(r.key), bytes(r.payload)))
            out.write(b"\0")
        return Written(name)

    def commit(self, messages) -> None:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for i, m in enumerate(messages):
            if m is not None:
                where.move(m.name, f"{base}/part-{i:05d}.pack")

    def abort(self, messages) -> None:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for m in messages:
            if m is not None:
                where.delete_file(m.name)


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


def missing_from_packs(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted keys that no pack has, in their order and number."""
    return wanted.join(packs.where("error IS NULL").select("key").distinct(), "key", "left_anti").orderBy(F.col("pos"))
