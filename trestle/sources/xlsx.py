"""XLSX workbooks as a Spark data source: spark.read.format("xlsx_cells").load(path) gives doc, sheet, row_idx, col_idx, value.

A workbook is a zip of XML. Each sheet is a partition of its own; its rows are parsed as a stream, so a task holds one row and the
workbook's shared strings, which it reads once. Shared and inline strings, numbers, booleans and dates by style come as text
(dates as yyyy-mm-dd). Rows without values are left out before rows are numbered. With option("filters", "true"),
in sessions with spark.sql.python.filterPushdown.enabled, filters on doc, sheet and col_idx reach the source: sheets that they
rule out are not read.

What cannot be read is a value, not a crash: one row with a null sheet and a code, UNSUPPORTED_FORMAT (by extension; the older .xls
too) or BROKEN_WORKBOOK with the reason.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "doc string, sheet string, row_idx int, col_idx int, value string"
EXTENSIONS = (".xlsx", ".xlsm")
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that are dates. Fixed values of the file format.
DATE_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57}
_ERRORS = (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError)
Cell = tuple[str, "str | None", "int | None", "int | None", str]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
    formats = root.find(f"{_NS}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _ended(file: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag as they end; what lies before them is dropped from memory."""
    path = []
    for event, e in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            path.append(e)
        else:
            path.pop()
            if e.tag == f"{_NS}{tag}":
                yield e
                path[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{_NS}t"))


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets and of the files that hold them."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return [(s.get("name"), "xl/" + targets[s.get(_REL)].lstrip("/").removeprefix("xl/")) for s in root.iter(f"{_NS}sheet")]


def _sheet_cells(book: zipfile.ZipFile, member: str) -> Iterator[tuple[int, int, str]]:
    """row_idx, col_idx and value of the filled cells of a sheet, row by row."""
    strings: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            strings = [_text(s) for s in _ended(f, "si")]
    dates, row_idx = _date_styles(book), 0
    with book.open(member) as f:
        for row in _ended(f, "row"):
            filled = False
            for at, c in enumerate(row.iter(f"{_NS}c")):
                v, kind = c.find(f"{_NS}v"), c.get("t")
                text = _text(c) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                if kind == "s" and text:
                    text = strings[int(text)]
                elif kind is None and text and int(c.get("s", 0)) in dates:
                    text = (datetime.date(1899, 12, 30) + datetime.timedelta(days=round(float(text)))).isoformat()
                if text.strip():
                    filled = True
                    yield row_idx, _column(c.get("r")) if c.get("r") else at, text
            row_idx += filled


def cells_of(name: str, file: IO[bytes], sheet: str | None = None) -> Iterator[Cell]:
    """The cells of one workbook, or of one of its sheets."""
    if not name.lower().endswith(EXTENSIONS):
        yield name, None, None, None, "UNSUPPORTED_FORMAT: " + name
        return
    try:
        with zipfile.ZipFile(file) as book:
            for title, member in sheets_of(book):
                if sheet is None or title == sheet:
                    for cell in _sheet_cells(book, member):
                        yield name, title, *cell
    except _ERRORS as e:
        yield name, None, None, None, f"BROKEN_WORKBOOK: {type(e).__name__}: {e}"


class _Sheet(InputPartition):
    """A sheet of a file, or the whole file (null) where its sheets cannot be told."""

    def __init__(self, path: str, sheet: str | None):
        self.path, self.sheet = path, sheet


class XlsxReader(DataSourceReader):
    """Plans a partition for each sheet from the workbooks' directories, which are all that the driver reads."""

    def __init__(self, path: str):
        self.path, self.only = path, {}

    def _files(self) -> tuple[pafs.FileSystem, list[str]]:
        folder, _, pattern = self.path.rpartition("/") if re.search("[*?[]", self.path) else (self.path, "", "")
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + (folder if folder.startswith("/") else "/" + folder))
        if fs.get_file_info(root).type == pafs.FileType.File:
            return fs, [root]
        found = [x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.type == pafs.FileType.File]
        return fs, sorted(p for p in found if not pattern or fnmatch(p.rsplit("/", 1)[-1], pattern))

    def _wanted(self, column: str, value) -> bool:
        return column not in self.only or value in self.only[column]

    def partitions(self):
        self.fs, files = self._files()
        out = []
        for path in files:
            if not self._wanted("doc", path.rsplit("/", 1)[-1]):
                continue
            try:
                with self.fs.open_input_file(path) as f, zipfile.ZipFile(f) as book:
                    out += [_Sheet(path, s) for s, _ in sheets_of(book) if self._wanted("sheet", s)]
            except _ERRORS:
                out.append(_Sheet(path, None))
        return out or [_Sheet("", None)]

    def read(self, partition):
        if not partition.path:
            return
        fs = self._files()[0]
        with fs.open_input_file(partition.path) as f:
            for cell in cells_of(partition.path.rsplit("/", 1)[-1], f, partition.sheet):
                if self._wanted("sheet", cell[1]) and self._wanted("col_idx", cell[3]):
                    yield cell


class FilteredXlsxReader(XlsxReader):
    """Takes equalities and lists of doc, sheet and col_idx out of a query's filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("doc",), ("sheet",), ("col_idx",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f


class XlsxSource(DataSource):
    """For workbooks in any folder that pyarrow's file systems reach (a file, a folder or a pattern of file names); see read_xlsx() for others."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        kind = FilteredXlsxReader if self.options.get("filters", "").lower() == "true" else XlsxReader
        return kind(self.options["path"])


def read_xlsx(spark: SparkSession, path: str, batch_cells: int = 50_000) -> DataFrame:
    """Cells of the workbooks under a path that Spark can read, a task for each file; cells go on in batches."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = ["doc", "sheet", "row_idx", "col_idx", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Cell] = []
        told = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                for cell in cells_of(name, io.BytesIO(content.as_buffer())):
                    held.append(cell)
                    if len(held) >= batch_cells:
                        yield told()
                        held = []
        if held:
            yield told()

    return files.mapInArrow(run, SCHEMA)
