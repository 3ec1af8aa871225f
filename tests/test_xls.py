import random
from struct import pack

import pytest

from tessera.sources import files, xls

FREE, LAST, TABLE, MORE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC


def compound(content: bytes, name: str = "Workbook") -> bytes:
    """A compound file of one stream, in sectors of 512 bytes, or of 64 if it is under 4096 bytes long."""
    padded = lambda b, n: b + b"\0" * (-len(b) % n)
    small = len(content) < 4096
    chains = [b"", padded(content, 64 if small else 512)]
    if small:
        pieces = len(chains[1]) // 64
        chains.append(padded(b"".join(pack("<I", k + 1 if k + 1 < pieces else LAST) for k in range(pieces)), 512))
        chains[1] = padded(chains[1], 512)
    entry = lambda label, kind, start, size: label.encode("utf-16-le").ljust(64, b"\0") + pack("<HBB", 2 * len(label) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + pack("<IQ", start, size)
    sectors = lambda b: len(b) // 512
    start = 1 if chains[1] else LAST
    chains[0] = entry("Root Entry", 5, start if small else LAST, len(chains[1])) + entry(name, 2, (0 if content else LAST) if small else start, len(content)) + bytes(256)
    table, at, starts = [], 0, []
    for c in chains:
        starts.append(at if c else LAST)
        table += [at + k + 1 for k in range(sectors(c))]
        at += sectors(c)
        if c:
            table[-1] = LAST
    n = more = 0
    while 128 * n < len(table) + n + more:
        n += 1
        more = -(-max(0, n - 109) // 127)
    places = [at + k for k in range(n)]
    table += [TABLE] * n + [MORE] * more
    table += [FREE] * (128 * n - len(table))
    extra = b""
    for k in range(more):
        held = places[109 + 127 * k : 236 + 127 * k]
        extra += pack("<128I", *held, *[FREE] * (127 - len(held)), at + n + k + 1 if k + 1 < more else LAST)
    head = xls.MAGIC + bytes(16) + pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += pack("<8I", n, 0, 0, 4096, starts[2] if small else LAST, int(small), at + n if more else LAST, more)
    head += pack("<109I", *places[:109], *[FREE] * (109 - len(places[:109])))
    return head + b"".join(chains) + pack(f"<{len(table)}I", *table) + extra


def record(kind, data=b""):
    return pack("<HH", kind, len(data)) + data


def wide(text):
    return pack("<HB", len(text), 1) + text.encode("utf-16-le")


def narrow(text):
    return pack("<HB", len(text), 0) + text.encode("latin-1")


def cell(kind, row, column, data):
    return record(kind, pack("<HHH", row, column, 0) + data)


def book(strings: list[bytes], sheets: dict[str, bytes], before: bytes = b"") -> bytes:
    """The records of a workbook; strings are the parts of the table of shared strings."""
    shared = b"".join(record(xls.CONTINUE if k else xls.STRINGS, s) for k, s in enumerate(strings))
    labels = [narrow(label)[0:1] + narrow(label)[2:] for label in sheets]
    begin = record(xls.START, pack("<HH", 0x600, 5) + bytes(12)) + before
    at = len(begin) + sum(10 + len(x) for x in labels) + len(shared) + 4
    held = begin
    bodies = [record(xls.START, pack("<HH", 0x600, 16) + bytes(12)) + s + record(xls.END) for s in sheets.values()]
    for k, label in enumerate(labels):
        held += record(xls.SHEET, pack("<IBB", at + sum(map(len, bodies[:k])), 0, 0) + label)
    return held + shared + record(xls.END) + b"".join(bodies)


STRINGS = [
    # "name" | a text with runs and extra bytes | one that goes on as wide, then as narrow characters | one that starts in a record of its own
    pack("<II", 4, 4) + narrow("name") + pack("<HBHI", 2, 12, 1, 3) + b"ab" + bytes(7) + pack("<HB", 9, 0) + b"abc",
    b"\1" + "dé😀".encode("utf-16-le"),
    b"\0" + b"xy",
    wide("ü"),
]


def sheet() -> bytes:
    found = cell(xls.SHARED, 0, 0, pack("<I", 0)) + cell(xls.LABEL, 0, 1, narrow("n")) + cell(xls.LABEL, 0, 2, wide("x")) + cell(xls.LABEL, 0, 3, narrow("yes"))
    found += cell(xls.LABEL, 0, 4, narrow("f"))
    found += cell(xls.SHARED, 1, 0, pack("<I", 1)) + cell(xls.NUMBER, 1, 1, pack("<d", 3)) + cell(xls.NUMBER, 1, 2, pack("<d", 0.1)) + cell(xls.TRUTH, 1, 3, b"\1\0")
    found += cell(xls.FORMULA, 1, 4, bytes(6) + b"\xff\xff" + bytes(8)) + record(xls.RESULT, wide("sum"))
    chart = record(xls.START, bytes(16)) + cell(xls.NUMBER, 9, 9, pack("<d", 9)) + record(xls.END)
    found += chart + cell(xls.SHARED, 3, 0, pack("<I", 2)) + record(xls.MANY_PACKED, pack("<HHHIHIH", 3, 1, 0, (-7 << 2 & 0xFFFFFFFF) | 2, 0, (1250 << 2) | 3, 2))
    found += cell(xls.TRUTH, 3, 3, b"\0\0") + cell(xls.FORMULA, 3, 4, pack("<d", 2.5) + bytes(8))
    found += cell(xls.SHARED, 4, 0, pack("<I", 3)) + cell(xls.PACKED, 4, 2, pack("<d", 1.5)[4:]) + cell(xls.FORMULA, 4, 4, b"\2\0\x07\0\0\0\xff\xff" + bytes(8))
    return found


def test_streams_of_every_size():
    rng = random.Random(3)
    for size in (0, 1, 64, 100, 4095, 4096, 70_000, 7_400_000, 16_000_000):
        content = rng.randbytes(size)
        assert xls.stream(compound(content), "Workbook") == content
        assert xls.stream(compound(content), "Book") is None


def test_a_sheet_is_typed_as_other_workbooks(spark, tmp_path):
    path = str(tmp_path / "w.xls")
    (tmp_path / "w.xls").write_bytes(compound(book(STRINGS, {"One": sheet(), "Two": cell(xls.LABEL, 0, 0, narrow("k")) + cell(xls.NUMBER, 1, 0, pack("<d", 8))})))
    df = files.read(spark, path)
    assert df.dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("yes", "boolean"), ("f", "string")]
    assert sorted(map(tuple, df.collect())) == [("ab", 3, 0.1, True, "sum"), ("abcdé😀xy", -7, 12.5, False, "2.5"), ("ü", None, 1.5, None, "#DIV/0!")]
    assert [tuple(r) for r in files.read(spark, path, "application/vnd.ms-excel").select("n").filter("n = 3").collect()] == [(3,)]
    assert [tuple(r) for r in spark.read.format("xls").option("sheet", "Two").load(path).collect()] == [("8",)]
    assert list(xls.rows(path, "Two")) == [["k"], ["8"]]


def test_many_rows_equal_those_written(tmp_path):
    values = [[str(k), f"text {k % 7}"] for k in range(30_000)]
    cells = b"".join(cell(xls.NUMBER, k, 0, pack("<d", k)) + cell(xls.LABEL, k, 1, narrow(v[1])) for k, v in enumerate(values))
    (tmp_path / "m.xls").write_bytes(compound(book([pack("<II", 0, 0)], {"S": cells})))
    assert list(xls.rows(str(tmp_path / "m.xls"))) == values


def test_what_is_refused(tmp_path):
    at = tmp_path / "r.xls"
    for content, why in (
        (b"PK", "not a compound file"),
        (compound(b"x" * 5000, "Book"), "97 or later"),
        (compound(book([pack("<II", 0, 0)], {"S": b""}, record(xls.LOCKED, bytes(6)))), "locked"),
        (compound(book([pack("<II", 2, 2) + narrow("a")], {"S": b""})), "too early"),
        (compound(book([pack("<II", 0, 0)], {})), "no sheet"),
    ):
        at.write_bytes(content)
        with pytest.raises(ValueError, match=why):
            list(xls.rows(str(at)))
    at.write_bytes(compound(book([pack("<II", 0, 0)], {"S": b""})))
    assert list(xls.rows(str(at))) == []
    looped = bytearray(compound(b"x" * 5000))
    start = 512 * (1 + 1 + 10)  # the table of sectors stands after the directory and ten sectors of the stream
    looped[start + 4 : start + 8] = pack("<I", 1)
    with pytest.raises(ValueError, match="broken chain"):
        xls.stream(bytes(looped), "Workbook")
