"""Workbooks (.xlsx) as a data source and a sink, with the standard library's zip and XML readers.

`spark.read.format("workbook").load(path)` after `register(spark)`; path is a workbook or a folder of workbooks of one
layout, each a task of its own (a sheet is one compressed stream and has at most 1,048,576 rows). A sheet is streamed: a
first pass finds which shared strings the wanted columns name, then those alone are read, then rows are made in
batches. With `.schema(...)` cells of other columns are neither converted nor looked up.

Without a schema the types are inferred from all rows of the first workbook: long, double, boolean, timestamp_ntz (cells
with a date format), string for text and for mixtures. Options: sheet (name, or number from 0; the first by default), header
(true). Empty and error cells are null, and so is what does not fit a column's type; numbers in a string column keep the
text that the file has. Unnamed columns are called _c0, _c1, ... by place, repeated names get the place appended.

`rows.write.format("workbook").mode("overwrite").save(folder)` writes each task's rows as workbooks of at most MOST_ROWS rows,
which appear in the folder when all tasks have succeeded.
"""

from __future__ import annotations

import datetime
import itertools
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codonlake.sources import files
from codonlake.sources.report import Part, Staged

MOST_ROWS = 1_048_575
BATCH_ROWS = 2000
#: Bytes of XML that are parsed at a time.
BLOCK = 1 << 18

#: Numbers of the built-in formats that show dates or times, and the day that serial number 0 stands for.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCHS = {False: datetime.datetime(1899, 12, 30), True: datetime.datetime(1904, 1, 1)}
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
WHOLE = re.compile(r"[+-]?\d+$")
#: Digits of the longest numbers that are inferred to be long.
DIGITS = 18


def parsed(stream, start: Callable[[str, dict], None], end: Callable[[str], None], text: Callable[[str], None]) -> Iterator[None]:
    """Feeds an XML stream to the handlers, a block a step; names come without their prefixes."""
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda name, attributes: start(name.rpartition(":")[2], attributes)
    p.EndElementHandler = lambda name: end(name.rpartition(":")[2])
    p.CharacterDataHandler = text
    while block := stream.read(BLOCK):
        p.Parse(block, False)
        yield
    p.Parse(b"", True)
    yield


def elements(stream) -> list[tuple[str, dict]]:
    """(name, attributes) of all elements of a small part."""
    out: list[tuple[str, dict]] = []
    for _ in parsed(stream, lambda n, a: out.append((n, a)), lambda n: None, lambda t: None):
        pass
    return out


def column_of(reference: str) -> int:
    """The column, from 0, of a reference such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


@dataclass
class Cell:
    column: int
    kind: str  # n, s (shared), b, e, d, or str (inline or computed)
    date: bool
    raw: str


class Workbook:
    """One open workbook and the sheet that is read."""

    def __init__(self, path: str, sheet: str = "0"):
        self.zip = zipfile.ZipFile(files.opened(path))
        book = elements(self.zip.open("xl/workbook.xml"))
        sheets = [a for n, a in book if n == "sheet"]
        named = [a for a in sheets if a["name"] == sheet] or ([sheets[int(sheet)]] if sheet.isdigit() and int(sheet) < len(sheets) else [])
        if not named:
            raise ValueError(f"{path} has no sheet {sheet!r}; it has {', '.join(a['name'] for a in sheets)}")
        wanted = next(v for k, v in named[0].items() if k.rpartition(":")[2] == "id")
        target = next(a["Target"] for n, a in elements(self.zip.open("xl/_rels/workbook.xml.rels")) if n == "Relationship" and a["Id"] == wanted)
        self.sheet = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        self.epoch = EPOCHS[any(n == "workbookPr" and a.get("date1904") in ("1", "true") for n, a in book)]
        self.dates = self._date_styles()

    def _date_styles(self) -> list[bool]:
        """Whether each cell style shows dates."""
        if "xl/styles.xml" not in self.zip.namelist():
            return []
        own, shown, inside = set(DATE_FORMATS), [], False
        for name, a in elements(self.zip.open("xl/styles.xml")):
            if name == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", a["formatCode"].lower())):
                own.add(int(a["numFmtId"]))
            inside = True if name == "cellXfs" else False if name in ("cellStyles", "dxfs") else inside
            if inside and name == "xf":
                shown.append(int(a.get("numFmtId", 0)) in own)
        return shown

    def rows(self, wanted: set[int] | None = None) -> Iterator[list[Cell]]:
        """The cells of each row, of the wanted columns alone if given."""
        done: list[list[Cell]] = []
        row: list[Cell] = []
        state = {"column": -1, "cell": None, "text": None, "phonetic": False}

        def start(name: str, a: dict) -> None:
            if name == "row":
                row.clear()
                state["column"] = -1
            elif name == "c":
                state["column"] = column_of(a["r"]) if "r" in a else state["column"] + 1
                if wanted is None or state["column"] in wanted:
                    style = int(a.get("s", 0))
                    state["cell"] = Cell(state["column"], a.get("t", "n"), style < len(self.dates) and self.dates[style], "")
            elif state["cell"] is not None:
                if name == "rPh":
                    state["phonetic"] = True
                elif name in ("v", "t") and not state["phonetic"]:
                    state["text"] = []

        def text(piece: str) -> None:
            if state["text"] is not None:
                state["text"].append(piece)

        def end(name: str) -> None:
            cell = state["cell"]
            if name in ("v", "t") and state["text"] is not None:
                cell.raw += "".join(state["text"])
                state["text"] = None
            elif name == "rPh":
                state["phonetic"] = False
            elif name == "c" and cell is not None:
                if cell.kind == "inlineStr":
                    cell.kind = "str"
                if cell.raw or cell.kind == "str":
                    row.append(cell)
                state["cell"] = None
            elif name == "row":
                done.append(list(row))

        for _ in parsed(self.zip.open(self.sheet), start, end, text):
            yield from done
            done.clear()

    def shared(self, wanted: set[int]) -> dict[int, str]:
        """The shared strings of the given numbers."""
        out: dict[int, str] = {}
        if not wanted or "xl/sharedStrings.xml" not in self.zip.namelist():
            return out
        state = {"n": -1, "text": None, "phonetic": False}

        def start(name: str, a: dict) -> None:
            if name == "si":
                state["n"] += 1
            elif name == "rPh":
                state["phonetic"] = True
            elif name == "t" and state["n"] in wanted and not state["phonetic"]:
                state["text"] = []

        def text(piece: str) -> None:
            if state["text"] is not None:
                state["text"].append(piece)

        def end(name: str) -> None:
            if name == "t" and state["text"] is not None:
                out[state["n"]] = out.get(state["n"], "") + "".join(state["text"])
                state["text"] = None
            elif name == "rPh":
                state["phonetic"] = False

        for _ in parsed(self.zip.open("xl/sharedStrings.xml"), start, end, text):
            pass
        return out

    def names(self, header: bool) -> list[str]:
        """Column names, by place."""
        first = next(self.rows(), [])
        strings = self.shared({int(c.raw) for c in first if c.kind == "s"} if header else set())
        width = max((c.column for c in first), default=-1) + 1
        own = {c.column: (strings.get(int(c.raw), "") if c.kind == "s" else c.raw) for c in first} if header else {}
        out: list[str] = []
        for i in range(width):
            name = unescaped(own.get(i, "")).strip()
            out.append(f"_c{i}" if not name else f"{name}_{i}" if name in out else name)
        return out

    def inferred(self, header: bool) -> T.StructType:
        names = self.names(header)
        kinds: list[set[str]] = [set() for _ in names]
        for row in itertools.islice(self.rows(), 1 if header else 0, None):
            for c in row:
                if c.column < len(kinds) and c.kind != "e":
                    kinds[c.column].add({"s": "text", "str": "text", "b": "boolean", "d": "date"}.get(c.kind) or ("date" if c.date else "long" if WHOLE.match(c.raw) and len(c.raw) <= DIGITS else "double"))
        one = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampNTZType()}
        return T.StructType([T.StructField(n, one[k.copy().pop()] if len(k) == 1 and k != {"text"} else T.DoubleType() if k and k <= {"long", "double", "date"} else T.StringType()) for n, k in zip(names, kinds, strict=True)])

    def value(self, cell: Cell, kind: T.DataType, strings: dict[int, str]):
        """A cell as a value of a column's type; None where it does not fit."""
        raw, text = cell.raw, None
        if cell.kind == "e":
            return None
        if cell.kind in ("s", "str"):
            text = unescaped(strings.get(int(raw), "") if cell.kind == "s" else raw)
        try:
            if isinstance(kind, T.StringType):
                return text if text is not None else ("TRUE" if raw == "1" else "FALSE") if cell.kind == "b" else str(self.date(cell)) if cell.date or cell.kind == "d" else raw
            if isinstance(kind, T.BooleanType):
                return {"1": True, "0": False, "true": True, "false": False}.get((text if text is not None else raw).lower())
            if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
                return datetime.datetime.fromisoformat(text) if text is not None else self.date(cell)
            own = text if text is not None else raw
            if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
                n = int(own) if WHOLE.match(own) else float(own)
                bits = {T.LongType: 63, T.IntegerType: 31, T.ShortType: 15, T.ByteType: 7}[type(kind)]
                return int(n) if n == int(n) and -(1 << bits) <= n < 1 << bits else None
            return float(own)
        except (ValueError, OverflowError):
            return None

    def date(self, cell: Cell) -> datetime.datetime:
        return datetime.datetime.fromisoformat(cell.raw) if cell.kind == "d" else self.epoch + datetime.timedelta(milliseconds=round(float(cell.raw) * 86_400_000))


@dataclass
class Book(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.path, self.sheet, self.header = schema, options["path"], options.get("sheet", "0"), options.get("header", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [Book(p) for p, _ in books(self.path)]

    def read(self, partition: Book) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        book = Workbook(partition.path, self.sheet)
        place = {n: i for i, n in enumerate(book.names(self.header))}
        wanted = {place[f.name]: (i, f.dataType) for i, f in enumerate(self.schema.fields) if f.name in place}
        below = itertools.islice(book.rows(set(wanted)), 1 if self.header else 0, None)
        strings = book.shared({int(c.raw) for row in below for c in row if c.kind == "s"})
        arrow, held = to_arrow_schema(self.schema), []

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if self.schema.fields else []
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for row in itertools.islice(book.rows(set(wanted)), 1 if self.header else 0, None):
            values: list = [None] * len(self.schema.fields)
            for c in row:
                at, kind = wanted[c.column]
                values[at] = book.value(c, kind, strings)
            held.append(values)
            if len(held) >= BATCH_ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


def books(path: str) -> list[tuple[str, int]]:
    found = files.listed(path)
    out = found if len(found) == 1 and found[0][0] == path else [f for f in found if f[0].endswith(".xlsx")]
    if not out:
        raise FileNotFoundError(f"{path} holds no workbooks")
    return out


# ---- sink
def letters(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def shown(text: str) -> str:
    """Text as XML; characters that XML has not as _xHHHH_, and what looks like that as well."""
    safe = ESCAPED.sub(lambda m: f"_x005F{m[0]}", text)
    return escape(UNFIT.sub(lambda m: f"_x{ord(m[0]):04X}_", safe), {"\r": "_x000D_"})


def cell_xml(reference: str, value) -> str:
    match value:
        case None:
            return ""
        case bool():
            return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
        case datetime.datetime():
            return f'<c r="{reference}" s="1"><v>{(value.replace(tzinfo=None) - EPOCHS[False]) / datetime.timedelta(days=1)!r}</v></c>'
        case int() | float() if value == value and abs(value) != float("inf"):
            return f'<c r="{reference}"><v>{value!r}</v></c>'
        case int() | float():
            return f'<c r="{reference}" t="e"><v>#NUM!</v></c>'
        case _:
            return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{shown(str(value))}</t></is></c>'


#: The parts that every workbook has; one sheet, a plain style and one for dates.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
FRAME = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name=@NAME@ sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


class Writer(Staged):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        super().__init__(options["path"].rstrip("/"))
        self.names, self.sheet, self.most, self.overwrite = schema.names, options.get("sheet", "Sheet1"), int(options.get("rows", MOST_ROWS)), overwrite

    def _book(self, rows: Iterator, first: Row) -> str:
        """Writes one workbook of at most `most` rows."""
        system, _ = files.placed(self.path)
        path = self.part(".xlsx")
        with system.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            for name, xml in FRAME.items():
                book.writestr(name, HEAD + xml.replace("@NAME@", quoteattr(self.sheet)))
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(f'{HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                row, n = self.names, 1
                while row is not None:
                    sheet.write(f'<row r="{n}">{"".join(cell_xml(f"{letters(i)}{n}", v) for i, v in enumerate(row))}</row>'.encode())
                    row = first if n == 1 else next(rows, None) if n <= self.most - 1 else None
                    n += 1
                sheet.write(b"</sheetData></worksheet>")
        return path

    def write(self, iterator: Iterator[Row]) -> Part:
        paths = []
        while (first := next(iterator, None)) is not None:
            paths.append(self._book(iterator, first))
        return Part(TaskContext.get().partitionId(), paths)

    def commit(self, messages: list[Part | None]) -> None:
        system, own = files.placed(self.path)
        old = [f.path for f in system.get_file_info(pa.fs.FileSelector(own, allow_not_found=True))] if self.overwrite else []
        system.create_dir(own, recursive=True)
        for path in self.parts(messages):
            system.move(path, f"{own}/{posixpath.basename(path)}")
        for path in old:
            if path.endswith(".xlsx"):
                system.delete_file(path)
        self.removed()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return Workbook(books(self.options["path"])[0][0], self.options.get("sheet", "0")).inferred(self.options.get("header", "true").lower() == "true")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    return files.registered(spark, WorkbookSource)
