"""Excel workbooks of the binary kind (.xls, 97 and later) as a PySpark data source: one sheet, header row first, cells as text.

Such a file is a compound file, in which streams are chains of sectors; the
stream "Workbook" is a series of records. A sheet has at most 65,536 rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from struct import pack, unpack, unpack_from

import numpy as np

from tessera.sources.xlsx import XlsxDataSource, opened

# Fixed values of the file format: the file's first bytes, the least of the marks that are no sector numbers, kinds of
# records, and codes of errors.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
MARKS = 0xFFFFFFFA
START, END, CONTINUE, LOCKED, SHEET, STRINGS = 0x0809, 0x000A, 0x003C, 0x002F, 0x0085, 0x00FC
SHARED, NUMBER, PACKED, MANY_PACKED, LABEL, RICH_LABEL, TRUTH, FORMULA, RESULT = 0x00FD, 0x0203, 0x027E, 0x00BD, 0x0204, 0x00D6, 0x0205, 0x0006, 0x0207
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def _chain(following: np.ndarray, start: int) -> list[int]:
    found: list[int] = []
    while start < MARKS:
        if start >= len(following) or len(found) >= len(following):
            raise ValueError("broken chain of sectors")
        found.append(start)
        start = int(following[start])
    return found


def stream(data: bytes, wanted: str) -> bytes | None:
    """A stream of a compound file by name, or None if there is none of that name."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    version, size, small = unpack_from("<H", data, 26)[0], *(1 << k for k in unpack_from("<HH", data, 30))
    directory, _, least, small_table, _, more = unpack_from("<6I", data, 48)

    def sector(k: int) -> bytes:
        return data[(k + 1) * size : (k + 2) * size].ljust(size, b"\0")

    tables = list(unpack_from("<109I", data, 76))
    while more < MARKS:
        if len(tables) > len(data) // size + size:
            raise ValueError("broken chain of sectors")
        *held, more = unpack(f"<{size // 4}I", sector(more))
        tables += held
    following = np.frombuffer(b"".join(sector(k) for k in tables if k < MARKS), "<u4")

    def read(start: int) -> bytes:
        return b"".join(map(sector, _chain(following, start)))

    entries = read(directory)
    root = unpack_from("<I", entries, 116)[0]
    for at in range(0, len(entries), 128):
        length = unpack_from("<H", entries, at + 64)[0]
        if entries[at + 66] != 2 or entries[at : at + max(0, length - 2)].decode("utf-16-le", "replace") != wanted:
            continue
        start, n = unpack_from("<IQ", entries, at + 116)
        n = n & 0xFFFFFFFF if version < 4 else n
        if n >= least:
            return read(start)[:n]
        held = read(root)
        parts = _chain(np.frombuffer(read(small_table), "<u4"), start if n else MARKS)
        return b"".join(held[k * small : (k + 1) * small] for k in parts)[:n]
    return None


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(kind, parts): records from a place on, each with those that continue it."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(book):
        kind, size = unpack_from("<HH", book, at)
        data = book[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == CONTINUE and held:
            held[1].append(data)
            continue
        if held:
            yield held
        held = kind, [data]
    if held:
        yield held


class _Parts:
    """Reads on over the ends of a record and those that continue it."""

    def __init__(self, parts: list[bytes], at: int):
        self.parts, self.k, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        found: list[bytes] = []
        while True:
            piece = self.parts[self.k][self.at : self.at + n]
            found.append(piece)
            self.at += len(piece)
            n -= len(piece)
            if not n:
                return b"".join(found)
            self._next()

    def _next(self) -> None:
        self.k, self.at = self.k + 1, 0
        if self.k == len(self.parts):
            raise ValueError("a record ends too early")

    def text(self) -> str:
        """A string: its length, a mark, then characters of one or two bytes; where it is continued, a new mark stands first."""
        n, mark = unpack("<HB", self.take(3))
        runs = unpack("<H", self.take(2))[0] if mark & 8 else 0
        extra = unpack("<I", self.take(4))[0] if mark & 4 else 0
        found: list[bytes] = []
        while True:
            wide = mark & 1
            here = min(n, (len(self.parts[self.k]) - self.at) >> wide)
            piece = self.take(here << wide)
            found.append(piece if wide else piece.decode("latin-1").encode("utf-16-le"))
            n -= here
            if not n:
                break
            self._next()
            mark = self.take(1)[0]
        self.take(4 * runs + extra)
        return b"".join(found).decode("utf-16-le", "replace")


def _number(x: float) -> str:
    return str(int(x)) if x.is_integer() else repr(x)


def _packed(bits: int) -> str:
    """A number in 32 bits: a whole one or the upper part of a double, perhaps to be divided by 100."""
    x = float((bits - ((bits & 0x80000000) << 1)) >> 2) if bits & 2 else unpack("<d", pack("<Q", (bits & 0xFFFFFFFC) << 32))[0]
    return _number(x / 100 if bits & 1 else x)


def _truth(value: int, error: int) -> str | None:
    return ERRORS.get(value) if error else "true" if value else "false"


def _cells(book: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, str | None]]:
    """(row, column, text) of the cells with a value in the sheet that starts at a place."""
    depth, waits = 0, None
    for kind, parts in records(book, at):
        data = parts[0]
        depth += (kind == START) - (kind == END)
        if depth == 0:
            return
        if depth > 1 or len(data) < 6:  # charts within a sheet have records of their own
            if kind != RESULT or not waits or depth > 1:
                continue
        row, column = unpack_from("<HH", data) if kind != RESULT else waits or (0, 0)
        if kind == SHARED:
            yield row, column, shared[unpack_from("<I", data, 6)[0]]
        elif kind == NUMBER:
            yield row, column, _number(unpack_from("<d", data, 6)[0])
        elif kind == PACKED:
            yield row, column, _packed(unpack_from("<I", data, 6)[0])
        elif kind == MANY_PACKED:
            for k in range((len(data) - 6) // 6):
                yield row, column + k, _packed(unpack_from("<I", data, 6 + 6 * k)[0])
        elif kind in (LABEL, RICH_LABEL):
            yield row, column, _Parts(parts, 6).text()
        elif kind == TRUTH:
            yield row, column, _truth(data[6], data[7])
        elif kind == FORMULA and data[12:14] != b"\xff\xff":
            yield row, column, _number(unpack_from("<d", data, 6)[0])
        elif kind == FORMULA and data[6] == 0:
            waits = row, column  # the text follows in a record of its own
        elif kind == FORMULA and data[6] in (1, 2):
            yield row, column, _truth(data[8], data[6] == 2)
        elif kind == RESULT and waits:
            yield row, column, _Parts(parts, 0).text()
            waits = None


def rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows that have cells of a sheet by name, or of the first one. Locked and older workbooks are refused."""
    with opened(path) as file:
        book = stream(file.read(), "Workbook")
    if book is None:
        raise ValueError("no workbook of Excel 97 or later")
    start, shared = None, []
    for kind, parts in records(book):
        data = parts[0]
        if kind == LOCKED:
            raise ValueError("the workbook is locked by a password")
        if kind == SHEET and data[5] == 0 and start is None:
            label = data[8 : 8 + (data[6] << (data[7] & 1))].decode("utf-16-le" if data[7] & 1 else "latin-1")
            start = unpack_from("<I", data)[0] if sheet in (None, label) else None
        elif kind == STRINGS:
            texts = _Parts(parts, 8)
            shared = [texts.text() for _ in range(unpack_from("<I", data, 4)[0])]
        elif kind == END:
            break
    if start is None:
        raise ValueError(f"no sheet {sheet!r}")
    for _, cells in groupby(_cells(book, start, shared), key=itemgetter(0)):
        row: list[str | None] = []
        for _, column, value in cells:
            row += [None] * (column + 1 - len(row))
            row[column] = value
        yield row


class XlsDataSource(XlsxDataSource):
    """format("xls"): options path and sheet (its name; else the first)."""

    rows = staticmethod(rows)

    @classmethod
    def name(cls) -> str:
        return "xls"
