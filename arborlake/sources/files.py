"""File trees as a source, and tar archives as a sink."""

from __future__ import annotations

import io
import os
import stat
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TREE = "path string, name binary, kind string, mode bigint, uid bigint, gid bigint, mtime_ns bigint, size bigint, content binary, link_target binary, rdev array<bigint>, xattrs map<binary,binary>"


class TreeSource(DataSource):
    """``spark.read.format("filetree").load(folder)``: a row for each entry below a folder of a local or mounted file system.

    A partition is an entry with all below it; directories are split into their
    entries until there are ``splits`` partitions (64 unless said otherwise), level
    by level.  Other options: ``content`` (true or false), ``max_bytes`` (files
    above it have null content, and an archive refuses them).
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("content", "true") == "true", int(self.options.get("max_bytes", 1 << 30)), int(self.options.get("splits", 64)))


class Below(InputPartition):
    """Entries of one part: (path, whether what lies below it belongs to the part)."""

    def __init__(self, parts: list[tuple[bytes, bool]]):
        super().__init__(parts)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, content: bool, max_bytes: int, splits: int):
        self.root, self.content, self.max_bytes, self.splits = os.fsencode(root), content, max_bytes, splits

    def partitions(self) -> list[Below]:
        open_, done = sorted(os.listdir(self.root)), []
        while open_ and len(open_) + len(done) < self.splits:
            folders = [p for p in open_ if stat.S_ISDIR(os.lstat(os.path.join(self.root, p)).st_mode)]
            done += [(p, False) for p in folders] + [(p, True) for p in set(open_) - set(folders)]
            open_ = [os.path.join(p, n) for p in folders for n in sorted(os.listdir(os.path.join(self.root, p)))]
        return [Below([x]) for x in sorted(done + [(p, True) for p in open_])] or [Below([])]

    def read(self, partition: Below) -> Iterator[tuple]:
        for path, below in partition.value:
            yield from self._entry(os.path.join(self.root, path), path, below)

    def _entry(self, full: bytes, path: bytes, below: bool = True) -> Iterator[tuple]:
        st = os.lstat(full)
        kinds = ((stat.S_ISDIR, "dir"), (stat.S_ISREG, "file"), (stat.S_ISLNK, "symlink"), (stat.S_ISFIFO, "fifo"), (stat.S_ISCHR, "char"), (stat.S_ISBLK, "block"), (stat.S_ISSOCK, "socket"))
        kind = next((k for test, k in kinds if test(st.st_mode)), "unknown")
        content = None
        if kind == "file" and self.content and st.st_size <= self.max_bytes:
            with open(full, "rb") as f:
                content = f.read()
        device = [os.major(st.st_rdev), os.minor(st.st_rdev)] if kind in ("char", "block") else None
        yield (path.decode("utf-8", "backslashreplace"), os.path.basename(path), kind, st.st_mode, st.st_uid, st.st_gid, st.st_mtime_ns, st.st_size, content, os.readlink(full) if kind == "symlink" else None, device, _attributes(full))
        if kind == "dir" and below:
            for n in sorted(os.listdir(full)):
                yield from self._entry(os.path.join(full, n), os.path.join(path, n))


def _attributes(full: bytes) -> dict[bytes, bytes] | None:
    """Extended attributes, null where there are none or the file system has none."""
    try:
        return {os.fsencode(n): os.getxattr(full, n, follow_symlinks=False) for n in sorted(os.listxattr(full, follow_symlinks=False))} or None
    except OSError:
        return None


_TAR = {"dir": tarfile.DIRTYPE, "file": tarfile.REGTYPE, "symlink": tarfile.SYMTYPE, "fifo": tarfile.FIFOTYPE, "char": tarfile.CHRTYPE, "block": tarfile.BLKTYPE}


def write_tar(entries: DataFrame, out: io.BufferedIOBase | str, compressed: bool = False) -> int:
    """Stream entries, in order of path, into a PAX archive with nanosecond times; the number written.

    Rows come to the writer a partition at a time.  Sockets are left out, and a
    path with an unsafe component, or a file whose content wasn't read, is an error.
    Extended attributes travel as PAX records.
    """
    n = 0
    opened = open(out, "wb") if isinstance(out, str) else out  # noqa: SIM115
    try:
        with tarfile.open(fileobj=opened, mode="w|gz" if compressed else "w|", format=tarfile.PAX_FORMAT) as tar:
            for r in entries.orderBy("path").toLocalIterator():
                if r["kind"] not in _TAR:
                    continue
                if any(x in ("", ".", "..") for x in r["path"].split("/")):
                    raise ValueError(f"unsafe path {r['path']!r}")
                info = tarfile.TarInfo(r["path"])
                info.type, info.mode, info.uid, info.gid = _TAR[r["kind"]], r["mode"] & 0o7777, r["uid"], r["gid"]
                seconds, rest = divmod(r["mtime_ns"], 1_000_000_000)
                info.mtime = seconds
                if rest:
                    info.pax_headers["mtime"] = f"{seconds}.{rest:09d}"
                if r["kind"] == "symlink":
                    info.linkname = os.fsdecode(bytes(r["link_target"]))
                if r["rdev"]:
                    info.devmajor, info.devminor = r["rdev"]
                if r["kind"] == "file" and r["content"] is None:
                    raise ValueError(f"the content of {r['path']!r} wasn't read")
                for k, v in (r["xattrs"] or {}).items():
                    info.pax_headers[f"SCHILY.xattr.{os.fsdecode(bytes(k))}"] = os.fsdecode(bytes(v))
                data = bytes(r["content"]) if r["kind"] == "file" else b""
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                n += 1
    finally:
        if isinstance(out, str):
            opened.close()
    return n


def extract_tar(source: io.BufferedIOBase | str, folder: str) -> int:
    """Unpack an archive below a folder; links cannot lead outside it, and directories get their times last."""
    later, n = [], 0
    opened = open(source, "rb") if isinstance(source, str) else source  # noqa: SIM115
    try:
        with tarfile.open(fileobj=opened, mode="r|*") as tar:
            for info in tar:
                parts = info.name.split("/")
                if any(x in ("", ".", "..") for x in parts):
                    raise ValueError(f"unsafe path {info.name!r}")
                for i in range(1, len(parts)):
                    if os.path.islink(os.path.join(folder, *parts[:i])):
                        raise ValueError(f"{info.name!r} lies below a link")
                tar.extract(info, folder, set_attrs=not info.isdir(), filter="fully_trusted" if info.issym() or info.isdev() else "tar")
                if info.isdir():
                    later.append(info)
                n += 1
        for info in reversed(later):
            full = os.path.join(folder, info.name)
            os.chmod(full, info.mode)
            os.utime(full, (info.mtime, info.mtime))
    finally:
        if isinstance(source, str):
            opened.close()
    return n
