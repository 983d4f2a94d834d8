"""Reports as one file of a given name: `rows.write.format("report").mode("overwrite").save("…/eval_results.csv")`.

Every task writes its rows to a file of its own in a hidden folder beside the report and tells the driver which. When all
tasks have succeeded, the driver puts the parts together in the order of the partitions, below one header, and moves the
whole over the report: a reader sees the old file or the new one, never a part. When a task fails, or the job is
stopped, the hidden folder goes and the old file stays as it was; attempts that were repeated leave nothing behind.

Rows come in the order that they are given (sort them first). Options: sep (`,`), header (true). Null and NaN are empty
fields; numbers are written in their shortest exact form. Modes: overwrite replaces; append and existing files are refused.
"""

from __future__ import annotations

import csv
import io
import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from codonlake.sources import files

BLOCK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    paths: list[str]


class Staged(DataSourceWriter):
    """A writer whose tasks leave files in a hidden folder, which commit() or abort() removes."""

    def __init__(self, path: str):
        self.path = path
        _, own = files.placed(path)
        self.folder = posixpath.join(posixpath.dirname(own), f".{posixpath.basename(own)}-{uuid.uuid4().hex}")

    def part(self, suffix: str = "") -> str:
        system, _ = files.placed(self.path)
        system.create_dir(self.folder, recursive=True)
        return f"{self.folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{suffix}"

    def parts(self, messages: list[Part | None]) -> list[str]:
        return [p for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for p in m.paths]

    def removed(self) -> None:
        system, _ = files.placed(self.path)
        system.create_dir(self.folder, recursive=True)  # tasks without rows may not have made it
        system.delete_dir(self.folder)

    def abort(self, messages: list[Part | None]) -> None:
        self.removed()


class Writer(Staged):
    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(options["path"])
        self.names, self.sep, self.header = schema.names, options.get("sep", ","), options.get("header", "true").lower() == "true"

    def _lines(self, rows: Iterator) -> bytes:
        out = io.StringIO()
        csv.writer(out, delimiter=self.sep, lineterminator="\n").writerows(["" if v is None or isinstance(v, float) and math.isnan(v) else v for v in r] for r in rows)
        return out.getvalue().encode()

    def write(self, iterator: Iterator[Row]) -> Part:
        system, _ = files.placed(self.path)
        path = self.part()
        with system.open_output_stream(path) as out:
            for row in iterator:
                out.write(self._lines([row]))
        return Part(TaskContext.get().partitionId(), [path])

    def commit(self, messages: list[Part | None]) -> None:
        system, own = files.placed(self.path)
        system.create_dir(self.folder, recursive=True)
        whole = f"{self.folder}/whole"
        with system.open_output_stream(whole) as out:
            if self.header:
                out.write(self._lines([self.names]))
            for path in self.parts(messages):
                with system.open_input_stream(path) as part:
                    while block := part.read(BLOCK):
                        out.write(block)
        if system.get_file_info(own).type == pa.fs.FileType.Directory:
            system.delete_dir(own)  # a folder of the same name, as older versions left it
        system.move(whole, own)
        self.removed()


class Report(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        own = Writer(schema, self.options)
        system, path = files.placed(own.path)
        if not overwrite and system.get_file_info(path).type != pa.fs.FileType.NotFound:
            raise FileExistsError(f"{own.path} is there; a report is replaced as a whole, with mode overwrite")
        return own


def register(spark: SparkSession) -> SparkSession:
    return files.registered(spark, Report)
