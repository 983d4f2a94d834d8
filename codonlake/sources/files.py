"""Files as the tasks of a data source see them: listing, opening, replacing; through Arrow's file systems."""

from __future__ import annotations

import posixpath
import threading
import weakref

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

#: Schemes that Arrow opens without Spark; other stores are left to Spark's own readers.
SCHEMES = ("", "file", "s3", "gs", "hdfs")


def scheme(path: str) -> str:
    head, colon, _ = path.partition(":")
    return head if colon and "/" not in head else ""


def known(path: str) -> bool:
    """Whether tasks can open the path themselves."""
    return scheme(path) in SCHEMES


def placed(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if not known(path):
        raise ValueError(f"{path}: only Spark's own readers reach a {scheme(path)} store")
    if scheme(path) in ("", "file"):
        bare = path.partition(":")[2] if scheme(path) else path
        return fs.LocalFileSystem(), "/" + bare.lstrip("/") if scheme(path) else bare
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder but for those that begin with `_` or `.`; sorted."""
    system, own = placed(path)
    info = system.get_file_info(own)
    prefix = path[: len(path) - len(own)] if path.endswith(own) else f"{scheme(path)}://" if scheme(path) not in ("", "file") else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = system.get_file_info(fs.FileSelector(own, recursive=True))
    hidden = lambda f: any(p.startswith(("_", ".")) for p in posixpath.relpath(f, own).split("/"))
    return sorted((prefix + f.path, f.size) for f in below if f.type == fs.FileType.File and not hidden(f.path))


def opened(path: str) -> pa.NativeFile:
    system, own = placed(path)
    return system.open_input_file(own)


def compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst"))


def streamed(path: str) -> pa.NativeFile:
    """A file from its beginning, unpacked if its name says that it is compressed."""
    system, own = placed(path)
    return system.open_input_stream(own, compression="detect")


_KNOWN: weakref.WeakKeyDictionary[SparkSession, set[type]] = weakref.WeakKeyDictionary()
_LOCK = threading.Lock()


def registered(spark: SparkSession, source: type[DataSource]) -> SparkSession:
    """spark, with the data source made known to it once; runs of several threads may ask at a time."""
    with _LOCK:
        known = _KNOWN.setdefault(spark, set())
        if source not in known:
            spark.dataSource.register(source)
            known.add(source)
    return spark
