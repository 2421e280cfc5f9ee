"""Hosted files: a read-only folder of Parquet files that are opened by name as `hosted://name`."""

from __future__ import annotations

import fnmatch
import struct

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.settings import Settings

SCHEME = "hosted://"


class HostedError(OSError):
    """A name that isn't hosted, or a write to what is read-only."""


def _status(spark: SparkSession, path: str) -> tuple[list, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.globStatus(where) or []), fs


def resolve_inputs(spark: SparkSession, inputs: list[str]) -> list[tuple[str, str, int]]:
    """(name, path, size) of files; folders stand for their sorted *.parquet files; two files of one name are refused."""
    out: dict[str, tuple[str, str, int]] = {}
    for given in inputs:
        found, fs = _status(spark, given)
        if not found:
            raise HostedError(f"no such input: {given}")
        for status in found:
            inside = [status]
            if status.isDirectory() and not status.getPath().getName().endswith(".parquet"):
                listed = (s for s in fs.listStatus(status.getPath()) if s.getPath().getName().endswith(".parquet"))
                inside = sorted(listed, key=lambda s: s.getPath().getName())
            for s in inside:
                name = s.getPath().getName()
                if name in out:
                    raise HostedError(f"duplicate file name: {name}")
                size = sum(x.getLen() for x in fs.listStatus(s.getPath())) if s.isDirectory() else s.getLen()
                out[name] = (name, str(s.getPath()), size)
    return list(out.values())


def catalog(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(name, path, offset, size): the hosted files one after another behind the directory, as one region would hold them."""
    found = resolve_inputs(spark, inputs)
    rows, offset = [], directory_size([name for name, _, _ in found])
    for name, path, size in found:
        rows.append((name, path, offset, size))
        offset += size
    return spark.createDataFrame(rows, "name string, path string, offset long, size long")


def directory_size(names: list[str]) -> int:
    """Bytes of the directory of so named files, its own size field included."""
    return 8 + sum(24 + len(name.encode()) for name in names)


def pack_directory(entries: list[tuple[str, int, int]]) -> bytes:
    """A directory's header: its size with this field, then for each file its name's length, name, offset in the region and size, all numbers in 64 bits."""
    body = b"".join(struct.pack("<Q", len(name.encode())) + name.encode() + struct.pack("<QQ", offset, size) for name, offset, size in entries)
    return struct.pack("<Q", 8 + len(body)) + body


def parse_directory(data: bytes) -> list[tuple[str, int, int]]:
    """The inverse of pack_directory, from a region's first bytes; of a name that stands twice the first counts.

    A size of 8 or less is an empty directory; a header that ends too early is an error.
    """
    if len(data) < 8:
        raise HostedError("truncated directory")
    (end,) = struct.unpack_from("<Q", data)
    if end <= 8:
        return []
    if len(data) < end:
        raise HostedError("truncated directory")
    out: dict[str, tuple[str, int, int]] = {}
    at = 8
    while at < end:
        if at + 8 > end:
            raise HostedError("truncated directory entry (name_len)")
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 24 + n > end:
            raise HostedError("truncated directory entry (name/offset/size)")
        name = data[at + 8 : at + 8 + n].decode()
        out.setdefault(name, (name, *struct.unpack_from("<QQ", data, at + 8 + n)))
        at += 24 + n
    return list(out.values())


def _root(spark: SparkSession) -> str:
    root = Settings(spark).get("hosted_root")
    if not root:
        raise HostedError(f"{SCHEME} needs the setting hosted_root")
    return root.rstrip("/")


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Hosted names that match, sorted; files in folders below the root go by their path from it."""
    root = _root(spark)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.getFileStatus(where).getPath().toString().rstrip("/")
    found, out = fs.listFiles(where, True), []
    while found.hasNext():
        name = found.next().getPath().toString()[len(base) + 1 :]
        hidden = any(part[0] in "._" for part in name.split("/"))
        if name.endswith(".parquet") and not hidden and fnmatch.fnmatchcase(name, pattern.removeprefix(SCHEME)):
            out.append(name)
    return sorted(out)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_status(spark, f"{_root(spark)}/{path.removeprefix(SCHEME)}")[0])


def resolve(spark: SparkSession, path: str) -> str:
    """The real path of a hosted name; patterns stay patterns."""
    name = path.removeprefix(SCHEME)
    if not exists(spark, path):
        raise HostedError(f"{name} not found in hosted directory")
    return f"{_root(spark)}/{name}"


def open_for_write(path: str) -> None:
    raise HostedError(f"the hosted filesystem is read-only: {path}")


class HostedFile:
    """One hosted file, open for reading at a place or from a cursor on."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(resolve(spark, path))
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(where)
        self.path, self._spark, self._cursor = path, spark, 0
        self.size: int = status.getLen()
        #: Seconds since 1970.
        self.modified: float = status.getModificationTime() / 1000
        self._stream = fs.open(where)

    def read_at(self, n: int, location: int) -> bytes:
        """Exactly n bytes from a place; the cursor stays."""
        if n < 0:
            raise HostedError(f"negative read size on {self.path}")
        if location < 0 or location + n > self.size:
            raise HostedError(f"read past end of file {self.path}")
        if not n:
            return b""
        self._stream.seek(location)
        return bytes(self._spark._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, n))

    def read(self, n: int) -> bytes:
        """Up to n bytes from the cursor on, none at the end."""
        if n < 0:
            raise HostedError(f"negative read size on {self.path}")
        data = self.read_at(min(n, self.size - self._cursor), self._cursor)
        self._cursor += len(data)
        return data

    def seek(self, location: int) -> None:
        if not 0 <= location <= self.size:
            raise HostedError(f"seek past end of file {self.path}")
        self._cursor = location

    def tell(self) -> int:
        return self._cursor

    def close(self) -> None:
        self._stream.close()
