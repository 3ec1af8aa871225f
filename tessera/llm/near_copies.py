"""SimHash near-dedup of whole texts, confirmed by the exact similarity of their shingle sets.

Wide SimHash fingerprints of 5-word shingle sets are compared by tiles of exact
exclusive-or and bit counts, as in `simhash`; pairs within the radius are then
confirmed by the Jaccard similarity of their sets. Fingerprints meet in crowds:
with all shingles in one order, two sets of similarity 0.8 share one of the first
n - ceil(0.8 n) + 1 of each (prefix filter), so no similar pair is left out of
the tiles. A crowd too large for one task is dealt out as pairs of tiles.

The least spanning forest of each crowd comes first, so that a group of n copies
gives n - 1 pairs and these are its nearest; what their components leave apart is
compared again and every pair within the radius is confirmed. Frequent shingles stand last in
the order, which keeps them out of most prefixes; any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.components import components
from tessera.functions.session import batches_of, fresh, name, scratch, written
from tessera.llm.simhash import BUCKET, TILE

SAMPLE, OFTEN, MOST = 20_000, 20, 100_000  # for the order only: sampled texts, how many make a shingle frequent, how many are kept
LANES = 32  # 64-bit words of a fingerprint

# Two large sets of Jaccard similarity 0.8 have a cosine of 8/9, so that each bit differs with a probability of
# arccos(8/9) / pi = 0.1515. In small sets ties and the steps of their sizes add to it: the exact probability, a
# sum over binomials for both sizes, is under 0.1515 + 0.15 / n for every n up to 600, n being the smaller size (summed
# up once for all of these; the tests do it for those up to 60 and some others). The radius is five standard deviations above that, so that a pair beyond it is similar with
# a probability under 1e-6.
DIFFERS, MORE = 0.1515, 0.15


def radius_of(n: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """How many bits the fingerprints of similar sets may differ in, the smaller one having n shingles."""
    p = DIFFERS + MORE / np.maximum(n, 1)
    return np.ceil(64 * lanes * p + 5 * np.sqrt(64 * lanes * p * (1 - p))).astype(np.int64)


def shingle_set(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles, rising; fewer words than `width` are one shingle."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII only
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, seed) for s in shingles), dtype="<u8").view("<i8"))


def wide_simhash(hashes: np.ndarray, lanes: int = LANES) -> bytes:
    """The fingerprint of a set of hashes: a bit is 1 if over half of the hashes, mixed anew for each lane, have it."""
    ones = np.zeros(64 * lanes, dtype=np.int64)
    with np.errstate(over="ignore"):
        steps = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for at in range(0, len(hashes), 1024):
            x = hashes[at : at + 1024, None].view("<u8") + steps
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - 2**63


def _frequent(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that many of the sampled texts have, rising."""
    sampled = texts.select("text").sample(min(1.0, SAMPLE / max(1, texts.count())), 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), width))], ["x"])

    counts = sampled.mapInArrow(run, "x long").groupBy("x").count().filter(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "x").limit(MOST).collect()
    return np.array(sorted(r["x"] for r in rows), dtype="<i8")


def _prefixes(texts: DataFrame, width: int, tenths: int) -> DataFrame:
    """(id, mark, node, n, fp, keys) of each row: node names the set, n is its size, fp its fingerprint, keys its prefix."""
    frequent = _frequent(texts, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            keys = []
            for found in sets:
                n = len(found)
                last = np.isin(found, frequent)
                ordered = np.concatenate([found[~last], found[last]])
                keys.append(ordered[: n + 1 + -tenths * n // 10 if n else 0])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2], pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int32()),
                    pa.array(map(wide_simhash, sets), pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "mark", "node", "n", "fp", "keys"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "mark", "text").mapInArrow(run, f"id {kind}, mark binary, node long, n int, fp binary, keys array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, s): the set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

    return texts.select("text").mapInArrow(run, "node long, s array<long>")


def _crowds(nodes: DataFrame, bucket: int) -> DataFrame:
    """(crowd, side, node): groups of nodes to compare within one task (side 0), or (sides 1 and 2) with each other.

    Nodes that share a key meet in a crowd; equal crowds stand once. A key of
    more than `bucket` nodes is dealt out as pairs of tiles.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key")).repartition("key")  # once, for the counts and for the join
    counts = keyed.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    keyed = written(keyed.join(counts, "key"), "keyed")
    whole = keyed.filter(F.col("many") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("l"))
    tiles = F.ceil(F.col("many") / bucket).cast("int")
    placed = keyed.filter(F.col("many") > bucket).withColumn("t", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    # each tile goes to all others: (smaller, greater), and on which side of the pair it stands
    pairs = placed.select(
        "key", "node", "t", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    ).select("key", "node", F.least("t", "other").alias("x"), F.greatest("t", "other").alias("y"), (F.col("t") > F.col("other")).alias("right"))
    dealt = pairs.groupBy("key", "x", "y").agg(
        F.sort_array(F.collect_list(F.when(~F.col("right"), F.col("node")))).alias("l"),
        F.sort_array(F.collect_list(F.when(F.col("right"), F.col("node")))).alias("r"),
    )
    none = F.array().cast("array<bigint>")
    lists = whole.select("l", none.alias("r")).union(dealt.select("l", "r")).distinct()
    listed = written(lists.select(F.monotonically_increasing_id().alias("crowd"), "l", "r"), "crowds")
    alone = F.size("r") == 0
    left = listed.select("crowd", F.when(alone, 0).otherwise(1).alias("side"), F.explode("l").alias("node"))
    return left.union(listed.select("crowd", F.lit(2).alias("side"), F.explode("r").alias("node")))


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Positions of the pairs (i, j) that make a spanning forest of all of them over n nodes, of the first ones that can."""
    label, kept = np.arange(n), []
    left = np.arange(len(i))
    while len(left):
        a, b = label[i[left]], label[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        # each component takes its first pair to another one; of both ends' choices the first pair has one at most
        first = np.full(n, len(i))
        np.minimum.at(first, a, left)
        np.minimum.at(first, b, left)
        chosen = np.unique(first[first < len(i)])
        kept.append(chosen)
        while True:  # joined components take their least label
            a, b = label[i[chosen]], label[j[chosen]]
            if (a == b).all():
                break
            to = np.arange(n)
            np.minimum.at(to, a, b)
            np.minimum.at(to, b, a)
            label = to[label]
    return np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)


def _tiles(left: tuple, right: tuple | None, tenths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and differing bits of pairs within their radius, of sizes that allow the similarity and with different roots, tile by tile.

    A side is (fingerprints as rows of lanes, sizes, roots), ordered by population count.
    """
    other = left if right is None else right
    counts = [np.bitwise_count(side[0]).sum(axis=1, dtype=np.int64) for side in (left, other)]
    radii = [radius_of(side[1]) for side in (left, other)]
    rows, cols, far = [], [], []
    for i in range(0, len(left[0]), TILE):
        a, low, high = left[0][i : i + TILE], counts[0][i], counts[0][min(i + TILE, len(left[0])) - 1]
        for j in range(i if right is None else 0, len(other[0]), TILE):
            near_by = np.maximum(radii[0][i : i + TILE][:, None], radii[1][j : j + TILE][None, :])  # that of the smaller set
            radius = near_by.max()
            if counts[1][j] - high > radius or low - counts[1][min(j + TILE, len(other[0])) - 1] > radius:
                continue
            b = other[0][j : j + TILE]
            bits = np.zeros((len(a), len(b)), dtype=np.int16)
            for lane in range(a.shape[1]):
                bits += np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
            m, n = left[1][i : i + TILE][:, None], other[1][j : j + TILE][None, :]
            near = (bits <= near_by) & (10 * m >= tenths * n) & (10 * n >= tenths * m)
            near &= left[2][i : i + TILE][:, None] != other[2][j : j + TILE][None, :]
            if right is None and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            rows.append(x + i)
            cols.append(y + j)
            far.append(bits[x, y])
    empty = np.empty(0, dtype=np.int64)
    return tuple(map(np.concatenate, (rows, cols, far))) if rows else (empty, empty, empty)


def _within(members: DataFrame, tenths: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of nodes of members within the radius, or their least spanning forest.

    members: (crowd, side, node, n, root, fp, before), before being the crowds in
    which a node was met already: a pair that has one in common is not made again.
    """
    of = F.struct("node", "n", "root", "fp", "before")
    sides = members.groupBy("crowd").agg(
        F.collect_list(F.when(F.col("side") < 2, of)).alias("l"), F.collect_list(F.when(F.col("side") == 2, of)).alias("r")
    )

    def side(rows: pa.StructArray) -> tuple:
        node, n, root = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("node", "n", "root"))
        fp = np.frombuffer(b"".join(rows.field("fp").to_pylist()), dtype="<u8").reshape(len(node), -1)
        order = np.argsort(np.bitwise_count(fp).sum(axis=1, dtype=np.int64), kind="stable")
        met = rows.field("before").to_pylist()
        return node[order], (fp[order], n.astype(np.int64)[order], root[order]), [frozenset(met[k]) for k in order.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, r in zip(batch.column(0), batch.column(1), strict=True):  # noqa: E741
                if not len(l.values):
                    continue
                left, ours, met = side(l.values)
                right, theirs, also = side(r.values) if len(r.values) else (left, None, met)
                i, j, bits = _tiles(ours, theirs, tenths)
                if forest and len(i):
                    order = np.argsort(bits, kind="stable")
                    i, j = i[order], j[order]
                    kept = spanning(i, j if theirs is None else j + len(left), len(left) + len(right))
                    i, j = i[kept], j[kept]
                if not forest:
                    new = [met[x].isdisjoint(also[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    i, j = i[new], j[new]
                if len(i):
                    ends = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, ends)), ["a", "b"])

    return sides.select("l", "r").mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, tenths: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; sets are made anew for the nodes of the pairs only.

    nodes: (node, mark), mark being that of a text with this set.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    marks = written(nodes.join(asked, "node").select("mark"), "asked")
    picked = texts.join(marks, "mark", "left_semi").dropDuplicates(["mark"])
    sets = written(_sets(picked, width), "sets")
    left, right = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both * (10 + tenths) >= tenths * (F.size("sa") + F.size("sb"))
    return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b")


def _links(found: DataFrame, texts: DataFrame, width: int, tenths: int, bucket: int) -> DataFrame:
    """Edges (a, b) that connect all nodes that pairs of similar sets connect."""
    nodes = written(found.groupBy("node").agg(F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("fp").alias("fp")), "nodes")
    crowds = _crowds(found.groupBy("node").agg(F.first("keys").alias("keys")), bucket)
    prints, none = nodes.select("node", "n", "fp"), F.array().cast("array<bigint>")
    # crowds are sifted by the nodes' names; fingerprints join them last, on the way to the tiles
    alone = crowds.withColumns({"root": F.col("node"), "before": none}).join(prints, "node")
    first = written(_within(alone, tenths, forest=True), "pairs")
    edges = written(_confirmed(first, nodes.select("node", "mark"), texts, width, tenths), "similar")

    rooted = crowds.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    unlike = rooted.groupBy("crowd").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    mixed = written(rooted.join(unlike.select("crowd"), "crowd"), "mixed")
    met = mixed.filter("side = 0").groupBy("node").agg(F.collect_list("crowd").alias("met"))
    earlier = F.filter(F.coalesce("met", none), lambda c: c < F.col("crowd"))
    rest = mixed.join(met, "node", "left").withColumn("before", earlier).drop("met").join(prints, "node")
    rest = written(_within(rest, tenths, forest=False), "pairs")
    return edges.union(_confirmed(rest, nodes.select("node", "mark"), texts, width, tenths))


def one_of_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, tenths: int = 8,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row of docs for each component of similar texts, with its columns as they are: that of the smallest id.

    Texts are similar if their fingerprints are within the radius and their sets
    of `width`-word shingles have a Jaccard similarity of at least `tenths`
    tenths; words are compared without ASCII case. Texts without words are similar to each
    other. Rows that share an id are one document, of which one row stays (the
    one with the least digest of its text, then of its other columns); rows with null ids
    stay only in components that have no other id. The radius is for tenths of 8
    and 2048 bits. Sets are named by 64 bits of their digest: texts of one name count as
    having the same set.
    """
    spark = docs.sparkSession
    key, digest = fresh(docs, "id", "mark")
    mark = F.coalesce(F.unhex(F.md5(name(text_col).cast("binary"))), F.unhex(F.lit("")))
    texts = docs.select(name(id_col).alias("id"), mark.alias("mark"), name(text_col).cast("binary").alias("text"))
    with scratch(spark) as keep, batches_of(spark, 256):
        found = written(_prefixes(texts, width, tenths), "prefixes")
        roots = components(_links(found, texts, width, tenths, bucket))
        rows = found.groupBy("id", "mark", "node").agg(F.count("*").alias("times")).join(roots, "node", "left")
        rows = written(rows.select("id", "mark", "times", F.coalesce("root", "node").alias("root")), "rows")
        order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
        stays = rows.groupBy("root").agg(F.min(order).alias("m")).select("m.id", "m.mark")
        named = stays.filter("id IS NOT NULL").groupBy("id").agg(F.min("mark").alias("mark"))
        stays = written(named.union(stays.filter("id IS NULL")), "representatives")
        same = F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.mark") == F.col("s.mark"))
        goes = rows.alias("r").join(stays.alias("s"), same, "left_anti")
        goes = keep(goes.select(F.col("id").alias(key), F.col("mark").alias(digest)), "dropped")
        repeated = rows.filter("times > 1").select(F.col("id").alias(key), F.col("mark").alias(digest))
        repeated = keep(repeated, "repeated")
    # most rows stay: where those that go are few, they are sent to the rows and no text is shuffled
    kept = docs.join(goes, name(id_col).eqNullSafe(F.col(key)) & (mark == F.col(digest)), "left_anti")
    if repeated.isEmpty():
        return kept
    again = name(id_col).eqNullSafe(F.col(key)) & (mark == F.col(digest))
    once = kept.join(repeated, again, "left_anti")
    whole = F.struct(*(name(c) for c in docs.columns))
    twice = kept.join(repeated, again, "left_semi").select(name(id_col).alias(key), mark.alias(digest), whole.alias("row"))
    one = twice.groupBy(key, digest).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.union(one.select(*(F.col("row")[c].alias(c) for c in docs.columns)))

