"""Substring dedup by difference-cover anchors.

A window is WINDOW adjacent words; a window that an earlier document has too is
taken out. Only stretches of ANCHOR words at cover positions are hashed first:
positions whose number modulo PERIOD lies in COVER. The cover's differences give
every residue, so that of two equal windows, wherever they stand in their
documents, one offset below PERIOD puts both on a cover position, and the stretch from
there on lies within both. So a window that has no anchor in common with another document
occurs once, and only windows around common anchors are extended to their full
length and compared.

Documents are dealt to parts, ranges of the id, in a bucketed table, so that texts
are shuffled once and what is found for a part comes to its texts. A part sends each
distinct hash once, packed by range of the hash; the answer is one bit for each.
A passage that a third of all documents has is thus one hash of each part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import batches_of, delete, name, scratch, shared_folder, written

WINDOW = 13
# A perfect difference set: every residue modulo 7 other than 0 is one difference of two of them, so three of seven
# positions do. The anchor is as long as the window allows: PERIOD - 1 + ANCHOR = WINDOW.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1

PART = 8 << 20  # bytes of text in a part, about; a part's texts are in one task
TAIL = 6  # bytes of a hash that are sent besides its range


class _Hashes(dict):
    """The hash of each word seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    # fixed values: the finalizer of the public 64-bit generator splitmix
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """The hash of the `width` words from each position on; positions less than width from the end have none."""
    n = max(0, len(h) - width + 1)
    found = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        found = found * np.uint64(factor) + h[k : k + n]
    return _mixed(found)


class Part:
    """The words of a part's documents, one after the other, as hashes."""

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        counts, hashes = [], []
        for text in texts:
            words = text.split()  # on bytes: the six kinds of ASCII white space
            counts.append(len(words))
            hashes.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))
        self.h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.at = np.arange(len(self.h))

    def fits(self, width: int) -> np.ndarray:
        """Which positions have `width` words from there on in their document."""
        n = max(0, len(self.h) - width + 1)
        return self.at[:n] + width <= self.ends[self.doc[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the anchors."""
        width = self.window - PERIOD + 1
        fits = self.fits(width)
        place = (self.at[: len(fits)] - self.starts[self.doc[: len(fits)]]) % PERIOD
        here = np.nonzero(fits & np.isin(place, COVER))[0]
        return here, _stretches(self.h, width, 0x9E3779B97F4A7C15)[here]

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, hashes, second hashes) of the windows that hold an anchor at one of the shared positions."""
        fits = self.fits(self.window)
        near = np.zeros(len(self.h) + PERIOD, dtype=bool)
        for k in range(PERIOD):  # a window may hold it at any offset below the period
            near[np.maximum(shared - k, 0)] |= shared >= k
        here = np.nonzero(fits & near[: len(fits)])[0]
        both = (_stretches(self.h, self.window, f)[here] for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        return here, *both


def _distinct(first: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the distinct hashes, rising; which of them each hash is)."""
    if second is None:
        _, at, which = np.unique(first, return_index=True, return_inverse=True)
        return at, which
    order = np.lexsort((second, first))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    which = np.empty(len(order), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _packed(hashes: np.ndarray, skip: int) -> np.ndarray:
    """The TAIL bytes of each hash after its first `skip` bits."""
    return (hashes << np.uint64(skip)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TAIL]


def _slices(part: int, first: np.ndarray, second: np.ndarray | None, bits: int) -> pa.Table:
    """(bucket, part, n, keys): a part's distinct hashes, rising, cut by their first `bits` bits."""
    keys = _packed(first, bits)
    if second is not None:
        keys = np.concatenate([keys, _packed(second, 0)], axis=1)
    buckets = (first >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), dtype=np.int64)
    held, start = np.unique(buckets, return_index=True)
    ends = np.append(start[1:], len(first)).astype(int)[: len(held)]  # a part may have none
    cut = [keys[a:b].tobytes() for a, b in zip(start, ends, strict=True)]
    return pa.table({
        "bucket": pa.array(held, pa.int32()), "part": pa.array(np.full(len(held), part), pa.int32()),
        "n": pa.array(ends - start, pa.int32()), "keys": pa.array(cut, pa.binary()),
    })


def _answers(group: pa.Table, width: int, earlier: bool) -> pa.Table:
    """(bucket, part, n, bits) for the slices of one bucket: which hashes another part (or an earlier one) has too."""
    parts, counts = group["part"].to_numpy(), group["n"].to_numpy()
    raw = np.frombuffer(b"".join(group["keys"].to_pylist()), dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8 * (width // TAIL)), dtype=np.uint8)
    for k in range(width // TAIL):
        wide[:, 8 * k : 8 * k + TAIL] = raw[:, TAIL * k : TAIL * (k + 1)]
    numbers = wide.view(">u8").astype(np.uint64)
    at, which = _distinct(numbers[:, 0], numbers[:, 1] if width > TAIL else None)
    of = np.repeat(parts, counts)
    if earlier:
        least = np.full(len(at), np.iinfo(np.int32).max)
        np.minimum.at(least, which, of)
        found = least[which] < of
    else:  # a part sends a hash once
        found = np.bincount(which, minlength=len(at))[which] > 1
    ends = np.cumsum(counts)
    bits = [np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
    return group.select(["bucket", "part", "n"]).append_column("bits", pa.array(bits, pa.binary()))


def _bits(answers: pa.Table) -> np.ndarray:
    """The answers to all hashes of one part, in their order."""
    rows = answers.sort_by("bucket")
    found = [
        np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n)
        for b, n in zip(rows["bits"].to_pylist(), rows["n"].to_pylist(), strict=True)
    ]
    return np.concatenate(found).astype(bool) if found else np.empty(0, dtype=bool)


def _shared(part: Part, answers: pa.Table) -> np.ndarray:
    """Positions of the part's anchors that stand elsewhere too, in this part or another."""
    at, hashes = part.anchors()
    first, which = _distinct(hashes)
    common = _bits(answers) | (np.bincount(which, minlength=len(first)) > 1) if len(first) else np.empty(0, dtype=bool)
    return at[common[which]]


def _removed(part: Part, ids: np.ndarray, shared: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Which words a window covers that a document of a smaller id (ids: rising numbers) has too."""
    at, one, two = part.windows(shared)
    mask = np.zeros(len(part.h) + 1, dtype=np.int64)
    if len(at):
        first, which = _distinct(one, two)
        owner = ids[part.doc[at]]
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, owner)
        gone = at[_bits(answers)[which] | (least[which] < owner)]
        mask[gone] += 1
        mask[gone + part.window] -= 1
    return np.cumsum(mask[:-1]) > 0


def _result(texts: list[bytes], part: Part | None, removed: np.ndarray | None) -> list[pa.Array]:
    """n_words, n_removed and the kept words of each text."""
    n_words, n_removed, kept = [], [], []
    for k, text in enumerate(texts):
        words = text.split()
        n_words.append(len(words))
        gone = removed[part.starts[k] : part.ends[k]] if part is not None else np.empty(0, dtype=bool)
        n_removed.append(int(gone.sum()))
        kept.append(b" ".join(compress(words, (~gone).tolist()) if n_removed[-1] else words))
    return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]


@contextmanager
def _parts(docs: DataFrame, n: int, buckets: int) -> Iterator[DataFrame]:
    """docs (doc_id, text) with part, the number of its range of ids, in a table that is bucketed by it."""
    spark, table = docs.sparkSession, f"parts_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tessera/{table}"
    dealt = docs.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id())
    try:
        dealt.write.bucketBy(buckets, "part").option("path", path).option("compression", "zstd").saveAsTable(table)
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(spark, path)


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART, with_text: bool = True,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): one row for each row of docs.

    Words are what ASCII white space parts, compared as they are. Each word is removed
    that a window of `window` words covers whose words also stand, in this order, in a document of a
    smaller id; windows are those of the input, not of what is left. kept is the
    other words, joined by one space, and kept_sha256 the digest of that.

    Null and empty texts have no words. Rows with a null id lose nothing and take
    nothing from others, as do rows of one id among themselves; repeated rows come back as
    often as they went in. Rows of one id are in one part. Other columns are ignored. Equality
    goes by 96 bits of hashes and those that name the range.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    digest = lambda kept: pa.array([hashlib.sha256(x).hexdigest() for x in kept.to_pylist()])
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def row(ids: pa.Array, found: list[pa.Array]) -> list:
        return [ids, *found[:2], digest(found[2]), *([found[2].cast(pa.string())] if with_text else [])]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(row(batch.column(0), _result(batch.column(1).to_pylist(), None, None)), names)

    text = F.coalesce(name(text_col).cast("binary"), F.unhex(F.lit("")))
    rows = docs.select(name(id_col).alias("doc_id"), text.alias("text"))
    named = rows.filter("doc_id IS NOT NULL")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    # as many ranges of hashes as make about a million anchors or fewer each
    bits = max(0, int(n // 2).bit_length())
    held = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    flat = lambda table, c: [x if x is not None else b"" for x in table[c].to_pylist()]

    def send_anchors(table: pa.Table) -> pa.Table:
        hashes = Part(flat(table, "text"), window).anchors()[1]
        return _slices(table["part"][0].as_py(), hashes[_distinct(hashes)[0]], None, bits)

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        part = Part(flat(table, "text"), window)
        _, one, two = part.windows(_shared(part, answers))
        at, _ = _distinct(one, two)
        return _slices(table["part"][0].as_py() if len(table) else 0, one[at], two[at], bits)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = flat(table, "text")
        part = Part(texts, window)
        ids = pc.rank(table["doc_id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        which = answers["which"].to_numpy()
        anchors, windows = (answers.filter(pa.array(which == k)) for k in (0, 1))
        removed = _removed(part, ids, _shared(part, anchors), windows)
        return pa.Table.from_arrays(row(table["doc_id"].combine_chunks(), _result(texts, part, removed)), names)

    sent, answered = "bucket int, part int, n int, keys binary", "bucket int, part int, n int, bits binary"
    with scratch(spark) as keep, batches_of(spark, 256), _parts(named, n, held) as parts:
        by_part = parts.groupBy("part")
        anchors = by_part.applyInArrow(send_anchors, sent).groupBy("bucket")
        anchors = written(anchors.applyInArrow(lambda g: _answers(g, TAIL, earlier=False), answered), "anchors")
        windows = by_part.cogroup(anchors.groupBy("part")).applyInArrow(send_windows, sent).groupBy("bucket")
        windows = written(windows.applyInArrow(lambda g: _answers(g, 2 * TAIL, earlier=True), answered), "windows")
        both = anchors.withColumn("which", F.lit(0)).union(windows.withColumn("which", F.lit(1)))
        found = keep(by_part.cogroup(both.groupBy("part")).applyInArrow(finish, schema), "deduped")
    return found.union(rows.filter("doc_id IS NULL").mapInArrow(alone, schema))
