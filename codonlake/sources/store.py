"""Stored tables: matrices written once and shared by all that need them, and the reports."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.functions import features
from codonlake.functions.codons import Tables, weights_key
from codonlake.sources import files, report


def content(rows: DataFrame, *columns: str) -> str:
    """Number of rows and a digest of the named columns' values, whatever their order."""
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return f"{n}-{abs(int(total or 0)) % 10**18}"


def snapshot(spark: SparkSession, path: str, *parameters: str | None) -> str:
    """Digest of the files at a path (names, bytes, times of change) and of how they are read: no input is scanned."""
    where, fs = _at(spark, path)
    listing, found = fs.listFiles(where, True), []
    while listing.hasNext():
        one = listing.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return hashlib.sha256(repr((sorted(found), parameters)).encode()).hexdigest()[:32]


def fingerprint(transcripts: DataFrame, species: str | Tables, groups: list[str] | None, keep: tuple[str, ...] = (), source: str | None = None) -> str:
    """Digest of all that a stored matrix holds or depends on: sequences, sizes, the columns kept, weights, groups, version.

    source: a snapshot that stands for the rows; without one they are digested.
    """
    columns = dict.fromkeys(("gene_id", "tx_sequence", "utr5_size", "cds_size", *keep))
    return f"{weights_key(species)}-v{features.VERSION}-{'-'.join(features.chosen(groups))}-{source or content(transcripts, *columns)}"


def _at(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Whether a file of this name and content was put there; False if the name was taken. Never seen half written."""
    where, fs = _at(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(text.encode())
    out.close()
    try:
        if fs.getScheme() == "file":  # a local move replaces, a link does not
            os.link(draft.toUri().getPath(), where.toUri().getPath())
        else:
            options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri()).rename(draft, where, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    finally:
        fs.delete(draft, False)


def removed(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="store-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def committed(spark: SparkSession, path: str) -> str | None:
    """The folder of the complete table at path; None if there is none."""
    return f"{path}/{read_text(spark, f'{path}/COMMIT')}" if exists(spark, f"{path}/COMMIT") else None


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame], check: Callable[[], None] | None = None) -> DataFrame:
    """The table at path, built and written first unless it is there and complete.

    Several jobs may build it at once: each writes a folder of its own, the first to claim COMMIT is read by all, and the
    others remove theirs. check is called after the write and before the claim; if it raises, nothing is left.
    """
    if committed(spark, path) is None:
        own = uuid.uuid4().hex
        try:
            build().write.parquet(f"{path}/{own}")
            if check is not None:
                check()
        except BaseException:
            removed(spark, f"{path}/{own}")
            raise
        if not claimed(spark, f"{path}/COMMIT", own):
            removed(spark, f"{path}/{own}")
    return spark.read.parquet(committed(spark, path))


def held(df: DataFrame) -> DataFrame:
    """df, written once below the shared folder and read from there; the files go when the driver's JVM ends."""
    path = f"{shared_root(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _at(df.sparkSession, path)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def feature_cache(
    transcripts: DataFrame, species: str | Tables = "human", groups: list[str] | None = None, keep: tuple[str, ...] = ("gene_id",), root: str | None = None, source: str | None = None,
) -> DataFrame:
    """The feature matrix, from the store or computed and written. Columns are wide, so a selection is pruned in the scan.

    Edited rows, folds, targets or weights are other contents, so they never meet a matrix of older ones. With `source`, a
    snapshot of the files that transcripts come from, a stored matrix is found without a look at the rows.
    """
    spark = transcripts.sparkSession
    path = f"{root or shared_root(spark)}/features/{fingerprint(transcripts, species, groups, keep, source)}-{'-'.join(keep)}"
    return stored(spark, path, lambda: features.matrix(transcripts, species, groups, keep))


def write_csv(rows: DataFrame, path: str, sep: str = ",", order: list[str | Column] | None = None) -> str:
    """A report as one file of exactly this name, with a header, replaced as a whole when all tasks have succeeded.

    Where only Spark's own writers reach the store, a folder of that name with one file in it.
    """
    ordered = rows.orderBy(*order) if order else rows
    if files.known(path):
        report.register(rows.sparkSession)
        ordered.write.format("report").mode("overwrite").option("sep", sep).save(path)
    else:
        ordered.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def write_file(spark: SparkSession, path: str, text: str) -> str:
    """A small text as one file, which replaces an older one when it is complete."""
    where, fs = _at(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(text.encode())
    out.close()
    fs.delete(where, False)
    fs.rename(draft, where)
    return path
