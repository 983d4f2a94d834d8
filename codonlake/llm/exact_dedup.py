"""Exact dedup by Grace hashing: records are partitioned by hash until a bucket fits an open-addressing table.

First level: Spark's shuffle by the hash of the normalised text, after each task has collapsed its rows to their
distinct texts (in tables of at most `memory_bytes`), so that a text held by a third of all rows reaches its bucket about
once a task and not once a row.
Further levels: a bucket whose texts exceed `memory_bytes` is split by other bits of the hash into unnamed spill files,
again and again, until each part fits. Those files belong to the running task alone (they have no name and go with
the task's process, and a task that is run anew writes its own), as Spark's own spill files do.
The table compares complete contents: two texts with equal hashes stay two classes.

Defined results: null text counts as empty; empty texts are equal to each other; doc_id null is smaller than any other;
an empty table gives an empty result; columns other than those named are ignored by `classes` and kept by `dedup`,
whatever their names; `label` leaves out those that bear a name of its result. Rows that repeat both doc_id and text are members of one class; `dedup` keeps one row of them.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonlake.llm.common import ascii_lower, by_place, skew_lookup, small_batches, written

MEMORY_BYTES = 48 << 20
FANOUT_BITS = 3
LEAST = -(2**63)


class OpenTable:
    """Linear probing over int32 slots; entries compare by hash and then by complete content."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int32)
        self.entries: list[list] = []  # [hash, content, largest id, rows, rows with that id]
        self.bytes = 0

    def _slot(self, h: int, content: bytes | None) -> int:
        mask = len(self.slots) - 1
        at = (h * 0x9E3779B97F4A7C15 >> 20) & mask
        while (e := self.slots[at]) >= 0:
            if content is not None and self.entries[e][0] == h and self.entries[e][1] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes, largest: int, rows: int, ties: int) -> None:
        at = self._slot(h, content)
        e = self.slots[at]
        if e >= 0:
            entry = self.entries[e]
            entry[3] += rows
            if largest >= entry[2]:
                entry[4] = ties + entry[4] * (largest == entry[2])
                entry[2] = largest
            return
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, largest, rows, ties])
        self.bytes += len(content) + 200
        if len(self.entries) * 2 > len(self.slots):
            self.slots = np.full(len(self.slots) * 2, -1, np.int32)
            for i, entry in enumerate(self.entries):
                self.slots[self._slot(entry[0], None)] = i


HEAD = struct.Struct("<qqqqi")


def _spilled(file) -> Iterator[tuple[int, bytes, int, int, int]]:
    file.seek(0)
    while head := file.read(HEAD.size):
        h, largest, rows, ties, n = HEAD.unpack(head)
        yield h, file.read(n), largest, rows, ties


def grace(records: Iterator[tuple[int, bytes, int, int, int]], memory_bytes: int = MEMORY_BYTES, depth: int = 0) -> Iterator[list]:
    """One [hash, content, largest id, rows, rows with that id] for each distinct content of such records."""
    table, files = OpenTable(), None
    shift = 61 - FANOUT_BITS * depth  # the low bits have dealt the rows to this task; take the high ones
    for h, content, largest, rows, ties in records:
        if files is None:
            table.add(h, content, largest, rows, ties)
            if table.bytes > memory_bytes and len(table.entries) > 1 and shift >= 0:
                files = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
                for e in table.entries:
                    f = files[(e[0] >> shift) & ((1 << FANOUT_BITS) - 1)]
                    f.write(HEAD.pack(e[0], e[2], e[3], e[4], len(e[1])) + e[1])
                table = OpenTable()
        else:
            f = files[(h >> shift) & ((1 << FANOUT_BITS) - 1)]
            f.write(HEAD.pack(h, largest, rows, ties, len(content)) + content)
    if files is None:
        yield from table.entries
        return
    for f in files:
        yield from grace(_spilled(f), memory_bytes, depth + 1)
        f.close()


LOCAL = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("largest", pa.int64()), ("rows", pa.int64()), ("ties", pa.int64())])


def _collapse(memory_bytes: int):
    """A task's distinct contents, in tables of at most memory_bytes."""

    def emitted(table: OpenTable) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for e in table.entries:
            held.append(e)
            size += len(e[1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], LOCAL.field(i).type) for i in range(5)], schema=LOCAL)
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], LOCAL.field(i).type) for i in range(5)], schema=LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for b in batches:
            for h, content, doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                table.add(h, content, LEAST if doc is None else doc, 1, 1)
            if table.bytes > memory_bytes:
                yield from emitted(table)
                table = OpenTable()
        yield from emitted(table)

    return run


CLASSES = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])


def _bucket(memory_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)

        out: list[tuple] = []
        for _, content, largest, rows, ties in grace(records(), memory_bytes):
            out.append((hashlib.sha256(content).hexdigest(), None if largest == LEAST else largest, rows, ties))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], CLASSES.field(i).type) for i in range(4)], schema=CLASSES)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], CLASSES.field(i).type) for i in range(4)], schema=CLASSES)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row for each distinct normalised text: text_sha256, keep_id (largest id), group_size, ties (rows with that id)."""
    text = ascii_lower(F.col(text_col)).cast("binary")
    rows = small_batches(docs).select(F.xxhash64(text).alias("h"), text.alias("content"), F.col(id_col).cast("long").alias("id"))
    local = rows.mapInArrow(_collapse(memory_bytes), "h long, content binary, largest long, rows long, ties long")
    return local.repartition("h").mapInArrow(_bucket(memory_bytes), "text_sha256 string, keep_id long, group_size long, ties long")


RESULT = ("keep_id", "group_size", "kept", "text_sha256", "ties")


def _classed(docs: DataFrame, id_col: str, text_col: str, memory_bytes: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns by place and RESULT beside them, and the columns' places.

    Only classes of two or more rows are joined back, heavy ones by a broadcast of bounded size; a class of one row is
    its own answer.
    """
    found = classes(docs, id_col, text_col, memory_bytes)
    several = written(found.filter("group_size > 1"), "exact-classes").withColumn("members", F.col("group_size"))
    total = docs.count()
    plain, place = by_place(docs)
    rows = plain.withColumn("text_sha256", F.sha2(ascii_lower(F.col(place[text_col])).cast("binary"), 256))
    table = several.select("text_sha256", F.col("keep_id").alias("largest"), F.col("group_size").alias("held"), F.col("ties").alias("tied"), "members")
    out = skew_lookup(rows, table, "text_sha256", "members", total, place[id_col])
    own, one = F.col(place[id_col]).cast("long"), F.lit(1).cast("long")
    out = out.withColumn("keep_id", F.when(F.col("held").isNull(), own).otherwise(F.col("largest")))
    out = out.withColumn("group_size", F.coalesce("held", one)).withColumn("ties", F.coalesce("tied", one)).withColumn("kept", own.eqNullSafe(F.col("keep_id")))
    return out.select(*place.values(), *RESULT), place


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """docs with keep_id, group_size, kept, text_sha256 and ties (rows of the class with the id that stays)."""
    out, place = _classed(docs, id_col, text_col, memory_bytes)
    return out.select(*[F.col(p).alias(c) for c, p in place.items() if c not in RESULT], *RESULT)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """docs without the rows whose text another row with a larger id has; columns as they were."""
    out, place = _classed(docs, id_col, text_col, memory_bytes)
    kept = out.filter("kept")
    tied = kept.filter("ties > 1")
    if not tied.isEmpty():
        kept = kept.filter("ties = 1").unionByName(tied.dropDuplicates([place[id_col], "text_sha256"]))
    return kept.select(*[F.col(p).alias(c) for c, p in place.items()])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return label(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
