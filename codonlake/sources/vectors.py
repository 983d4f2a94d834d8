"""A cache of vectors by content hash that several jobs may fill at once.

Layout below a shared folder: `data/` Parquet files in Spark's bucket layout (by seq_hash, sorted), `log/` one small file for each
committed batch, `blooms/` a Bloom filter for each batch and bucket, `staging/` batches on their way.

Append. New vectors are written to a staging folder. A batch is committed when its entry is the first under the next number
of the log (a move that fails where the name is taken). Who finds that others were first takes the hashes that are there
by now out of its own batch and tries again, so a hash has one row, whoever came first. A batch with the id of a committed
one is dropped: a job that is run again appends nothing twice. Files are moved into `data/` after the commit; whoever
opens the cache finishes what a lost job left there. Readers see whole files of committed batches only.

Look-up. `data/` is read as a bucketed table, so it is never exchanged: the asking side is dealt by the same hash, or
broadcast. `missing` first asks the Bloom filters by bucket, in tasks: a hash that none of its bucket's filters has is
missing, and only files whose filter has a wanted hash are read for the rest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.sources.store import claimed, read_text

BUCKETS = 64
SCHEMA = "seq_hash string, embedding array<float>"
#: Bits a key and probes of a filter: about one false alarm in 10,000.
BITS, PROBES = 20, 13
BLOOM = "version int, bucket int, bits binary"
#: With a larger share of all bytes to read, the bucketed table is joined as a whole.
SHARE = 0.5


def bucket_of(key: Column, buckets: int) -> Column:
    """Spark's own bucket of a key."""
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def _places(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        return (first.view(np.uint64) + steps * (second.view(np.uint64) | np.uint64(1))) % np.uint64(size)


def _bloom(version: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        size = max(64, rows.num_rows * BITS)
        bits = np.zeros(size, bool)
        bits[_places(rows["h1"].to_numpy(), rows["h2"].to_numpy(), size).ravel()] = True
        return pa.table({"version": pa.array([version], pa.int32()), "bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([size.to_bytes(8, "little") + np.packbits(bits).tobytes()], pa.binary())})

    return run


def _asked(key: tuple, rows: pa.Table, blooms: pa.Table) -> pa.Table:
    """(seq_hash, version) for each filter of the bucket that has the hash."""
    hashes, versions = [], []
    for version, packed in zip(blooms["version"].to_pylist(), blooms["bits"].to_pylist(), strict=True):
        size = int.from_bytes(packed[:8], "little")
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=8), count=size).view(bool)
        found = np.flatnonzero(bits[_places(rows["h1"].to_numpy(), rows["h2"].to_numpy(), size)].all(0))
        hashes.append(rows["seq_hash"].take(pa.array(found)).combine_chunks() if rows.num_rows else pa.array([], pa.string()))
        versions += [version] * len(found)
    whole = pa.concat_arrays([h.combine_chunks() if isinstance(h, pa.ChunkedArray) else h for h in hashes]) if hashes else pa.array([], pa.string())
    return pa.table({"seq_hash": whole, "version": pa.array(versions, pa.int32())})


@dataclass
class Entry:
    version: int
    batch: str
    staging: str
    files: list[str]
    rows: int


class VectorCache:
    """The cache below `root`; opening it finishes committed batches that a lost job has left in staging."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("data", "log", "blooms", "staging"):
            self.fs.mkdirs(self._path(part))
        if not self.fs.exists(self._path("buckets")):
            self._claimed("buckets", str(buckets))
        self.buckets = int(self._read("buckets"))
        #: What this object has seen of the log: its look-ups stand on that.
        self.seen = 0
        self.refresh()

    # ---- files
    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if not s.getPath().getName().startswith((".", "_")))

    def _read(self, name: str) -> str:
        return read_text(self.spark, f"{self.root}/{name}")

    def _claimed(self, name: str, text: str) -> bool:
        return claimed(self.spark, f"{self.root}/{name}", text)

    # ---- log
    def entries(self, after: int = 0) -> list[Entry]:
        return [Entry(**json.loads(self._read(f"log/{n}"))) for n in self._names("log") if int(n) > after]

    def refresh(self) -> VectorCache:
        """Takes note of all that is committed; moves files that a lost job has left."""
        left = set(self._names("staging"))
        versions = [int(n) for n in self._names("log")]
        if left:
            for e in self.entries():
                if e.staging in left:
                    self._placed(e)
        self.seen = max(versions, default=0)
        self.name = f"vectors_{hashlib.md5(self.root.encode()).hexdigest()}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (seq_hash) SORTED BY (seq_hash) INTO {self.buckets} BUCKETS LOCATION '{self.root}/data'")
        self.spark.catalog.refreshTable(self.name)
        return self

    def _placed(self, entry: Entry) -> None:
        for name in entry.files:
            source = self._path(f"staging/{entry.staging}/{name}")
            if self.fs.exists(source):
                self.fs.rename(source, self._path(f"data/{name}"))
        self.fs.delete(self._path(f"staging/{entry.staging}"), True)

    # ---- reading
    def table(self) -> DataFrame:
        """All committed vectors, one row a hash, as a bucketed table."""
        return self.spark.table(self.name)

    def found(self, rows: DataFrame) -> DataFrame:
        """rows, joined with their vectors by seq_hash; the cache's side is not exchanged."""
        return rows.join(self.table(), "seq_hash")

    def missing(self, rows: DataFrame) -> DataFrame:
        """One row of each seq_hash that the cache does not hold."""
        once = rows.filter("seq_hash IS NOT NULL").dropDuplicates(["seq_hash"])
        if not self.seen:
            return once
        wanted = once.select("seq_hash", F.xxhash64("seq_hash", F.lit(1)).alias("h1"), F.xxhash64("seq_hash", F.lit(2)).alias("h2"), bucket_of(F.col("seq_hash"), self.buckets).alias("bucket"))
        blooms = self.spark.read.schema(BLOOM).parquet(f"{self.root}/blooms").filter(F.col("version") <= self.seen)
        maybe = wanted.groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInArrow(_asked, "seq_hash string, version int").withColumn("bucket", bucket_of(F.col("seq_hash"), self.buckets))
        files = self._files(maybe)
        held = self.table() if files is None else self.spark.read.schema(SCHEMA).parquet(*files) if files else None
        return once if held is None else once.join(held.select("seq_hash"), "seq_hash", "left_anti")

    def _files(self, maybe: DataFrame) -> list[str] | None:
        """Files that may hold a wanted hash; None if that is most of the cache. A name a batch and bucket comes back."""
        touched = {(r["version"], r["bucket"]) for r in maybe.select("version", "bucket").distinct().collect()}
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._path("data"))}
        own = [n for e in self.entries() if e.version <= self.seen for n in e.files if (e.version, int(n.split("_")[-1].split(".")[0])) in touched]
        return None if sum(sizes.get(n, 0) for n in own) > SHARE * sum(sizes.values()) else [f"{self.root}/data/{n}" for n in own]

    # ---- appending
    def append(self, vectors: DataFrame, batch: str) -> int:
        """Commits those of vectors(seq_hash, embedding) that are new, and returns how many; `batch` names the batch."""
        staging = self._staged(vectors.filter("seq_hash IS NOT NULL").dropDuplicates(["seq_hash"]))
        while True:
            others = self.entries(self.seen)
            for e in others:
                self._placed(e)
            self.refresh()
            repeated = any(e.batch == batch for e in self.entries())
            own = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/staging/{staging}")
            new = own.limit(0) if repeated else self.missing(own)
            n = new.count()
            if n < own.count():  # the cache holds some of them, as of now
                staging, old = self._staged(new), staging
                self.fs.delete(self._path(f"staging/{old}"), True)
            if not n:
                self.fs.delete(self._path(f"staging/{staging}"), True)
                return 0
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/staging/{staging}")
            version = self.seen + 1
            entry = Entry(version, batch, staging, [f for f in self._names(f"staging/{staging}") if f.endswith(".parquet")], n)
            keys = rows.select(bucket_of(F.col("seq_hash"), self.buckets).alias("bucket"), F.xxhash64("seq_hash", F.lit(1)).alias("h1"), F.xxhash64("seq_hash", F.lit(2)).alias("h2"))
            blooms = f"{self.root}/staging/{staging}/_blooms"
            keys.groupBy("bucket").applyInArrow(_bloom(version), BLOOM).coalesce(1).write.parquet(blooms)
            for name in [s.getPath().getName() for s in self.fs.listStatus(self._path(f"staging/{staging}/_blooms"))]:
                if name.endswith(".parquet"):  # filters come first; those of a batch that is not committed are of no version that is read
                    self.fs.rename(self._path(f"staging/{staging}/_blooms/{name}"), self._path(f"blooms/{staging}-{name}"))
            if self._claimed(f"log/{version:020d}", json.dumps(entry.__dict__)):
                self._placed(entry)
                self.refresh()
                return n
            for name in self._names("blooms"):
                if name.startswith(staging):
                    self.fs.delete(self._path(f"blooms/{name}"), False)

    def _staged(self, vectors: DataFrame) -> str:
        """Writes vectors in the bucket layout to a new folder below staging; a file a bucket."""
        name = uuid.uuid4().hex
        rows = vectors.select("seq_hash", F.col("embedding").cast("array<float>").alias("embedding")).repartition(self.buckets, "seq_hash")
        table = f"staged_{name}"
        rows.write.format("parquet").bucketBy(self.buckets, "seq_hash").sortBy("seq_hash").option("path", f"{self.root}/staging/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return name

