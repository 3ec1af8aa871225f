"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Fingerprints that differ in at most `radius` bits are linked. Distinct
fingerprints are routed to buckets by blocks of bits that a linked pair must
share, so that most of the comparison matrix is never formed; inside a bucket
the fingerprints are ordered by population count and cut into tiles, tile pairs
whose population counts differ beyond the radius are skipped, and the others are
compared exactly with numpy's exclusive-or and bit counts. A bucket too large
for one task is dealt out as pairs of tiles, so that no task holds more than two
tiles and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.components import components
from tessera.functions.session import name, small_batches, written

BUCKET = 2048  # fingerprints that one task compares at once; larger buckets become tile pairs
TILE = 256  # side of a numpy tile


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text: bit k is set if over half the shingle hashes have it."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(doc_id, fp): one row per row of docs, fp as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_py(), width, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(name(id_col).alias("doc_id"), name(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id {ids}, fp long")


def _near(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near pairs of two arrays ordered by population count, tile by tile."""
    pl, pr = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    rows, cols = [], []
    for i in range(0, len(left), TILE):
        a, low, high = left[i : i + TILE], pl[i], pl[min(i + TILE, len(left)) - 1]
        for j in range(0, len(right), TILE):
            if pr[j] - high > radius or low - pr[min(j + TILE, len(right)) - 1] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ right[None, j : j + TILE]) <= radius)
            rows.append(x + i)
            cols.append(y + j)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all near pairs do, at most one per fingerprint.

    right None: pairs within left. A group of n near copies gives n - 1 links
    to its first member, not n squared.
    """
    order = lambda x: x[np.argsort(np.bitwise_count(x), kind="stable")]
    left = order(np.unique(left))
    if right is None:
        nodes = left
        i, j = _near(left, left, radius)
    else:
        right = order(np.unique(right))
        nodes = np.concatenate([left, right])
        i, j = _near(left, right, radius)
        j = j + len(left)
    label = np.arange(len(nodes))
    while len(i):
        least = label.copy()
        both = np.minimum(label[i], label[j])
        np.minimum.at(least, i, both)
        np.minimum.at(least, j, both)
        least = np.minimum(least, least[least])
        if np.array_equal(least, label):
            break
        label = least
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[moved], nodes[label[moved]]


def _compare(groups: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) of rows (l, r): two arrays to compare, r empty for l with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r in zip(batch.column(0), batch.column(1), strict=True):  # noqa: E741
                left = l.values.to_numpy(zero_copy_only=False).view(np.uint64)
                right = r.values.to_numpy(zero_copy_only=False).view(np.uint64)
                a, b = tile_links(left, right if len(right) else None, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return groups.select("l", "r").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (fp) within the radius, none lost."""
    # radius + 2 blocks: a pair that differs in at most radius bits agrees on two blocks at least
    n = radius + 2
    ends = [64 * k // n for k in range(n + 1)]
    block = [
        F.shiftrightunsigned("fp", ends[k]).bitwiseAND((1 << (ends[k + 1] - ends[k])) - 1) for k in range(n)
    ]
    keys = [F.xxhash64(F.lit(k), block[i], block[j]) for k, (i, j) in enumerate(combinations(range(n), 2))]
    keyed = distinct.select("fp", F.bit_count("fp").alias("pc"), F.explode(F.array(*keys)).alias("key"))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = written(keyed.join(many, "key"), "routed")

    none = F.array().cast("array<long>")
    whole = keyed.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("l"))
    # larger buckets: tiles of one population count each, salted by hash to at most about `bucket` rows
    large = keyed.filter(F.col("n") > bucket)
    tiles = large.groupBy("key", "pc").agg(F.ceil(F.count("*") / bucket).cast("int").alias("s"))
    tiles = tiles.select("key", "pc", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("t"), "s")
    plan = tiles.alias("x").join(
        tiles.alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.abs(F.col("x.pc") - F.col("y.pc")) <= radius)
        & (F.struct("x.pc", "x.t") <= F.struct("y.pc", "y.t")),
    ).select(
        F.col("x.key").alias("key"),
        F.struct("x.pc", "x.t", "y.pc", "y.t").alias("pair"),
        F.explode(
            F.array(
                F.struct(F.col("x.pc").alias("pc"), F.col("x.t").alias("t"), F.col("x.s").alias("s"), F.lit(0).alias("side")),
                F.struct(F.col("y.pc").alias("pc"), F.col("y.t").alias("t"), F.col("y.s").alias("s"), F.lit(1).alias("side")),
            )
        ).alias("of"),
    ).select("key", "pair", "of.*").distinct()
    placed = large.join(tiles.select("key", "pc", "s").distinct(), ["key", "pc"]).select(
        "key", "pc", "fp", F.pmod(F.hash("fp"), F.col("s")).alias("t")
    )
    dealt = placed.join(plan, ["key", "pc", "t"]).groupBy("key", "pair").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("fp"))).alias("l"),
        F.collect_list(F.when(F.col("side") == 1, F.col("fp"))).alias("r"),
    )
    # a tile against itself has the same rows on both sides, which the comparison takes as they are
    pairs = whole.select("l", none.alias("r")).union(dealt.select("l", "r"))
    return _compare(pairs, radius)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 2,
    width: int = 3,
    seed: int = 42,
    bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): one row per row of docs.

    Fingerprint: 16 hex digits. component_id: the smallest id reachable over
    fingerprints that differ in at most `radius` bits, its own included.
    n_links: how many links its component's tree has (0: it stands alone).

    Null, empty and blank texts have the zero fingerprint, linked like any
    other. Rows with a null id are kept and never give a component its name
    unless no other id is there (then it is null). Repeated rows come back as
    often as they went in. Other columns of docs are ignored.
    """
    found = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, bucket))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), (F.count("*") - 1).alias("n_links")
    )
    named = rooted.join(least, "root").select("fp", "component_id", "n_links")
    return found.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )
