"""Reading tables, and written tables that end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType

_own: dict[str, str] = {}
_written: set[str] = set()
#: Whether finished executions remove their shuffle files at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a folder of this process;
    on a cluster, whose machines would not see such a folder, it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own.get("dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = _own["dir"] = tempfile.mkdtemp(prefix="arborlake-")
        atexit.register(shutil.rmtree, found, True)
    return found


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    The lineage ends there, so a lost executor costs a reread, not a recompute,
    a table that is used twice is computed once, and the shuffle files of its
    making go.  ``discard`` deletes it; what is left goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: [_delete(p) for p in list(_written)])
    _written.add(path)
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(path: str) -> None:
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    if where.get_file_info(base).type == fs.FileType.Directory:
        where.delete_dir(base)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing reads any more."""
    for df in tables:
        _delete(df.written_to)


def small(df: DataFrame, most: int = 32 << 20, binary: int = 0) -> DataFrame:
    """A written table marked for broadcast if its rows have at most ``most`` bytes, else as it is: joins then shuffle.

    Its columns are numbers, or BINARY values of exactly ``binary`` bytes.
    """
    if not all(isinstance(f.dataType, NumericType) or binary and isinstance(f.dataType, BinaryType) for f in df.schema.fields):
        raise TypeError("only columns of fixed width have a provable size")
    width = 8 + sum(8 if isinstance(f.dataType, NumericType) else binary + 16 for f in df.schema.fields)
    return F.broadcast(df) if df.count() * width <= most else df
