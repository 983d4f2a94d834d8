"""FASTA as a data source: `spark.read.format("fasta").load(path)` after `register(spark)`.

A file is planned as ranges of `split` bytes (option, SPLIT by default), so its size bounds no task. A range owns the
records whose `>` stands in it, at the file's beginning or after a line end; its task begins one byte early, goes to the
first such `>`, and reads on beyond the range's end until its last record is complete. What stands before a file's first
record is left out, `>` inside a line splits nothing, lines may end in CR LF. Compressed files are one range each.

Columns: header (without `>`, trimmed), seq (without white space), path, start (the byte of the `>`, among unpacked bytes);
with `.schema(...)` only those that are asked for are built. An empty file has no rows; a record without lines has an
empty seq. Only a single record must fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from codonlake.sources import files

SPLIT = 64 << 20
BLOCK = 1 << 20
#: Bytes of records in an Arrow batch.
BATCH = 8 << 20
COLUMNS = {"header": pa.string(), "seq": pa.string(), "path": pa.string(), "start": pa.int64()}
WHITE = b" \t\r\n\x0b\x0c"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None


def records(file: pa.NativeFile, start: int, end: int | None, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place of its `>`, text after it) of the records that begin in [start, end)."""
    if start:
        file.seek(start - 1)
    base, rest = start - 1, b"" if start else b"\n"  # base: the place of rest's first byte
    own: list[bytes] | None = None
    place = 0
    while True:
        new = file.read(block)
        data, at = rest + new, 0
        while (mark := data.find(b"\n>", at)) >= 0:
            if own is not None:
                yield place, b"".join([*own, data[at:mark]])
            place, at, own = base + mark + 1, mark + 2, []
            if end is not None and place >= end:
                return
        keep = 1 if new and data.endswith(b"\n", at) else 0  # the `>` may follow
        if own is not None:
            own.append(data[at : len(data) - keep])
        base, rest = base + len(data) - keep, data[len(data) - keep :]
        if not new:
            if own is not None:
                yield place, b"".join(own)
            return


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        unknown = set(schema.names) - set(COLUMNS)
        if unknown:
            raise ValueError(f"FASTA has no columns {', '.join(sorted(unknown))}; known: {', '.join(COLUMNS)}")
        self.names = schema.names
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in files.listed(self.path):
            if files.compressed(path):
                out.append(Range(path, 0, None))
            else:
                out += [Range(path, a, min(a + self.split, size)) for a in range(0, size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        with (files.streamed if partition.end is None else files.opened)(partition.path) as file:
            for start, text in records(file, partition.start, partition.end):
                head, _, body = text.partition(b"\n")
                made = {"header": lambda h=head: h.decode(errors="replace").strip(), "seq": lambda b=body: b.translate(None, WHITE).decode(errors="replace"), "path": lambda: partition.path, "start": lambda s=start: s}
                held.append(tuple(made[c]() for c in self.names))
                size += len(text)
                if size >= BATCH:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, COLUMNS[n]) for n, c in zip(self.names, zip(*rows, strict=True), strict=True)], names=self.names)


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "header string, seq string, path string, start long"

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)


def register(spark: SparkSession) -> SparkSession:
    return files.registered(spark, Fasta)
