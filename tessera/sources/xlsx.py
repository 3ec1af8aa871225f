"""Excel workbooks (.xlsx) as a PySpark data source: one sheet, header row first, cells as text."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree.ElementTree import iterparse, parse

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# Namespaces of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def opened(path: str) -> io.BufferedReader:
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return io.BufferedReader(store.open_input_file(inner))


def _sheet(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The file of a sheet by name, or of the first one."""
    sheets = parse(book.open("xl/workbook.xml")).getroot().find(f"{MAIN}sheets")
    links = {x.get("Id"): x.get("Target") for x in parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    for found in sheets:
        if sheet is None or found.get("name") == sheet:
            return posixpath.normpath(posixpath.join("xl", links[found.get(f"{LINK}id")].replace("/xl/", "")))
    raise ValueError(f"no sheet {sheet!r}")


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet, read as a stream."""
    with opened(path) as file, zipfile.ZipFile(file) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in parse(book.open("xl/sharedStrings.xml")).getroot()]
        for _, node in iterparse(book.open(_sheet(book, sheet))):
            if node.tag != f"{MAIN}row":
                continue
            row: list[str | None] = []
            for k, cell in enumerate(node):
                at = _column(cell.get("r")) if cell.get("r") else k
                row += [None] * (at + 1 - len(row))
                value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    row[at] = _text(cell)
                elif value is not None and value.text is not None:
                    row[at] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}[value.text] if kind == "b" else value.text
            node.clear()
            yield row


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, width: int, rows: Callable[..., Iterator[list[str | None]]]):
        self.options, self.width, self.rows = options, width, rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.options["path"])]  # a sheet is one stream

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found = self.rows(partition.value, self.options.get("sheet"))
        next(found, None)
        for row in found:
            yield tuple((row + [None] * self.width)[: self.width])


class XlsxDataSource(DataSource):
    """format("xlsx"): options path and sheet (its name; else the first)."""

    rows = staticmethod(rows)

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        head = next(self.rows(self.options["path"], self.options.get("sheet")), [])
        names, seen = [], set()
        for k, h in enumerate(head):
            label = h or f"column_{k + 1}"
            while label in seen:
                label += "_"
            seen.add(label)
            names.append(label)
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(dict(self.options), len(schema), self.rows)
