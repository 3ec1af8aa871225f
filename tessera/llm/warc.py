"""WARC archives as a PySpark data source, and writing pages with revisit records.

Reading plans partitions of whole files. A record's headers are parsed first;
predicates on its type and header columns are pushed down, and a record that
fails them is stepped over without decoding its block: records written here say
their compressed length in the gzip member's "sl" field, plain files are sought.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from tessera.functions.session import name, shared_folder, small_batches, written

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
HEAD = 1 << 16  # bytes read at a time while looking for the end of the headers
SMALLEST = 100  # payloads below this many bytes are never revisits

#: Columns and the WARC headers that they show.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri",
    "date": "warc-date", "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_length long, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_length", pa.int64()), ("payload", pa.binary())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _member(record: bytes) -> bytes:
    """One gzip member, with its compressed and plain lengths in an "sl" field."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body), len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _record(row: dict, date: str) -> bytes:
    """A response, or a revisit with the response's HTTP headers only."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    clean = lambda x: "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in x)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{clean(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{clean(row['refers_to'])}>")
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http;msgtype=response"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(head: bytes) -> dict[str, str]:
    """Headers by lower-case name, without the angle brackets of ids and the digest's label."""
    found: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if colon:
            found.setdefault(key.strip().lower(), value.strip())
    for key in ("warc-record-id", "warc-refers-to"):
        if key in found:
            found[key] = found[key].strip("<>")
    if "warc-payload-digest" in found:
        found["warc-payload-digest"] = found["warc-payload-digest"].rpartition(":")[2]
    return found


class _Plain:
    """The bytes of an uncompressed file."""

    def __init__(self, stream):
        self.stream = stream

    def read(self) -> bytes:
        return self.stream.read(HEAD)

    def skip(self, n: int) -> None:
        self.stream.seek(self.stream.tell() + n)

    def member(self) -> tuple[int, int] | None:
        return None


class _Zipped:
    """The plain bytes of a file of gzip members, whatever each of them holds."""

    def __init__(self, stream):
        self.stream, self.unzip, self.raw, self.plain = stream, None, b"", b""

    def read(self) -> bytes:
        """Some more bytes; none at the end."""
        if self.plain:
            found, self.plain = self.plain, b""
            return found
        while True:
            if self.unzip is None or self.unzip.eof:
                if self.unzip is not None:
                    self.raw, self.unzip = self.unzip.unused_data, None
                self.raw = self.raw or self.stream.read(HEAD)
                if not self.raw.lstrip(b"\0"):  # the end, or what tapes are filled up with
                    return b""
                self.unzip = zlib.decompressobj(31)
            chunk = self.raw or self.unzip.unconsumed_tail or self.stream.read(HEAD)
            self.raw = b""
            if not chunk:
                return b""
            found = self.unzip.decompress(chunk, HEAD)
            if found:
                return found

    def skip(self, n: int) -> None:
        while n > 0 and (found := self.read()):
            self.plain = found[n:]
            n -= len(found)

    def member(self) -> tuple[int, int] | None:
        """Where the member that comes next begins and ends, if that is known."""
        if self.unzip is not None and not self.unzip.eof:
            self.plain += self.unzip.decompress(self.unzip.unconsumed_tail, HEAD)
        if self.plain or self.unzip is not None and not self.unzip.eof:
            return None
        if self.unzip is not None:
            self.raw, self.unzip = self.unzip.unused_data, None
        if len(self.raw) < 20:
            self.raw += self.stream.read(HEAD)
        if len(self.raw) < 20 or self.raw[3] != 4 or self.raw[12:14] != b"sl":
            return None
        (extra,), (packed,) = struct.unpack("<H", self.raw[10:12]), struct.unpack("<I", self.raw[16:20])
        start = self.stream.tell() - len(self.raw)
        return start, start + 12 + extra + packed + 8

    def jump(self, to: int) -> None:
        self.stream.seek(to)
        self.unzip, self.raw, self.plain = None, b"", b""


def _records(source: _Plain | _Zipped, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of the wanted records; the blocks of others are stepped over.

    A member that says its length and holds an unwanted record is not decoded; one
    without such a field may hold any number of records, or a part of one. Without a length that can be read
    the block is None, and what follows is looked through for the next record.
    """
    buffer = b""
    while True:
        member = None if buffer else source.member()
        while (end := buffer.find(b"\r\n\r\n")) < 0 or not buffer[:end].strip():
            if end >= 0:  # blank lines between records
                buffer = buffer.lstrip(b"\r\n")
                continue
            more = source.read()
            if not more:
                return
            buffer += more
        buffer = buffer.lstrip(b"\r\n")
        end = buffer.find(b"\r\n\r\n")
        headers = _parse(buffer[:end])
        start = end + 4
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            if wanted(headers):
                yield headers, None
            buffer = buffer[start:]
            while (at := buffer.find(b"WARC/")) < 0 or at and buffer[at - 1 : at] != b"\n":
                buffer = buffer[at + 1 if at >= 0 else max(0, len(buffer) - 5) :]
                if at >= 0:
                    continue
                more = source.read()
                if not more:
                    return
                buffer += more
            buffer = buffer[at:]
            continue
        length = int(length)
        take = wanted(headers)
        if not take and member:
            source.jump(member[1])
            buffer = b""
            continue
        if take:
            parts, held = [buffer[start : start + length]], len(buffer) - start
            rest = buffer[start + length :]
            while held < length and (more := source.read()):
                parts.append(more[: length - held])
                rest = more[length - held :]
                held += len(more)
            yield headers, b"".join(parts)
            buffer = rest
        elif len(buffer) >= start + length:
            buffer = buffer[start + length :]
        else:
            source.skip(start + length - len(buffer))
            buffer = b""
        # the two line ends that close a record, so that the next one may begin its own member
        while len(buffer) < 4 and (more := source.read()):
            buffer += more
        buffer = buffer.removeprefix(b"\r\n\r\n")


@dataclass
class Files(InputPartition):
    """Whole files that one task reads."""

    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", 64 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        """Take over equality, IN, prefix and presence tests on header columns; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                kind = type(f).__name__
                self.tests.append((HEADERS[column], kind, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for key, kind, value in self.tests:
            have = headers.get(key)
            if have is None:
                return False
            if kind == "EqualTo" and have != value or kind == "In" and have not in value or kind == "StringStartsWith" and not have.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_"))), key=lambda f: (-f.size, f.path))
        if not files:
            return [Files([])]
        groups: list[tuple[int, list[str]]] = []
        for f in files:  # largest first; small ones fill up the last group
            if groups and groups[-1][0] + f.size <= self.bytes:
                groups[-1] = (groups[-1][0] + f.size, [*groups[-1][1], f.path])
            else:
                groups.append((f.size, [f.path]))
        return [Files(paths) for _, paths in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        rows: list[list] = []
        held = 0
        for path in partition.paths:
            with store.open_input_file(path) as stream:
                first = stream.read(2)
                stream.seek(0)
                source = (_Zipped if first == b"\x1f\x8b" else _Plain)(stream)
                for headers, block in _records(source, self.wanted):
                    length, payload = None if block is None else len(block), block
                    if block is not None and block.startswith(b"HTTP/"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        said = _parse(head).get("content-length", "")
                        length = int(said) if said.isascii() and said.isdigit() else len(payload)
                    if headers.get("warc-type") == "revisit" or not self.payload:
                        payload = None
                    rows.append([*(headers.get(h) for h in HEADERS.values()), length, payload])
                    held += len(payload or b"") + 500
                    if held > 4 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class WrittenFile(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes hidden files of its own, which the commit gives their names."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.most = int(options.get("filebytes", 256 << 20))
        self.overwrite = overwrite
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        store, path = _open(self.path)
        names: list[str] = []
        stream, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if stream is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    stream, size = store.open_output_stream(f"{path}/.{names[-1]}", compression=None), 0
                member = _member(_record(row, self.date))
                stream.write(member)
                size += len(member)
                if size >= self.most:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()
        return WrittenFile(names)

    def commit(self, messages: list[WrittenFile | None]) -> None:
        """Give the files their names; only now what was there before goes, if it is overwritten."""
        store, path = _open(self.path)
        new = {f".{file}" for message in messages if message for file in message.names}
        for info in store.get_file_info(fs.FileSelector(path)) if self.overwrite else ():
            if info.type == fs.FileType.Directory:
                store.delete_dir(info.path)
            elif info.base_name not in new:
                store.delete_file(info.path)
        for message in messages:
            for file in message.names if message else []:
                store.move(f"{path}/.{file}", f"{path}/{file}")

    def abort(self, messages: list[WrittenFile | None]) -> None:
        store, path = _open(self.path)
        for message in messages:
            for file in message.names if message else []:
                store.delete_file(f"{path}/.{file}")


class WarcDataSource(DataSource):
    """format("warc"): reads and writes .warc and .warc.gz files.

    Options: path; payload (false: no payloads), partitionBytes; for writing
    date and fileBytes. Rows to write have record_id, record_type (response or
    revisit), refers_to, target_uri, payload_digest, payload_length, payload.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in dict(self.options).items()}

    def reader(self, schema) -> WarcReader:
        return WarcReader(self._options())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self._options(), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of pages: a response, or a revisit of the response with the same payload.

    Of the rows with equal payloads of at least 100 bytes the one with the
    smallest id is the response; null ids come last, and of rows that share an id
    one is it. A null html is an empty payload. Record ids are
    urn:page:<row>:<id>, the id empty if null, the row a number that tells rows
    of one id apart. Other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    payload = F.coalesce(name(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        name(id_col).alias("id"), name(url_col).cast("string").alias("target_uri"), payload.alias("payload"), F.lit(0).cast("long").alias("row")
    )
    mark = lambda df: df.withColumns({"payload_digest": F.sha2("payload", 256), "payload_length": F.length("payload").cast("long")})
    keys = written(mark(rows).select("id", "payload_digest", "payload_length", "row"), "payloads")
    if not keys.groupBy("payload_digest", "id").count().filter("count > 1").isEmpty():
        # rows that share id and payload: number them, in a table so that the numbers stay
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
        keys = mark(rows).select("id", "payload_digest", "payload_length", "row")
    first = keys.filter(F.col("payload_length") >= SMALLEST).groupBy("payload_digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f"), F.count("*").alias("n")
    )
    first = written(first.filter("n > 1").select(F.col("payload_digest").alias("key"), F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row")), "responses")
    # small payloads join nothing; their keys are spread
    key = F.when(F.col("payload_length") >= SMALLEST, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.pmod(F.xxhash64("id", "target_uri"), F.lit(4096))))
    joined = mark(rows).withColumn("key", key).join(first, "key", "left")
    revisit = F.col("first_row").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("row") == F.col("first_row")))
    urn = lambda i, r: F.concat(F.lit("urn:page:"), r.cast("string"), F.lit(":"), F.coalesce(i.cast("string"), F.lit("")))
    joined.select(
        urn(F.col("id"), F.col("row")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, urn(F.col("first_id"), F.col("first_row"))).alias("refers_to"),
        "target_uri",
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def archived(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back (the data source's columns)."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}-warc"
    write_pages(pages, path, **columns)
    return read_warc(spark, path)
