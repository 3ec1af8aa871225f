"""Vectors in cells around pivots, so that cells too far from each other are never compared.

A vector's cell is that of its nearest pivot. What is known of a cell is its
radius and, for some pivots, the least and greatest distance of its vectors to them; by the
triangle inequality each of these bounds the distance of two vectors from below.
Everything is exact: a pair of cells is left out only if the bound says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import batches_of, scratch, written

MOST = 1024  # pivots; more vectors make cells of several blocks
REFERENCES = 64  # pivots that every cell keeps its least and greatest distance to
SLACK = 1e-6  # what rounding may add to a distance


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1 if len(column) else 0)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def distances(x: np.ndarray, y: np.ndarray, angular: bool) -> np.ndarray:
    """Euclidean distances of the rows of x and y, or angles of unit vectors."""
    if angular:
        return np.arccos(np.clip(x @ y.T, -1, 1))
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


@dataclass
class Cells:
    """Vectors with their cell, and what is known of the cells: one number or REFERENCES numbers for each of at most MOST."""

    rows: DataFrame  # (id, v, cell)
    pivots: np.ndarray
    angular: bool
    sizes: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def apart(self, other: Cells | None = None) -> np.ndarray:
        """What any two vectors of two cells are apart at least, of these or of these and other ones with the same references."""
        other = self if other is None else other
        found = distances(self.pivots, other.pivots, self.angular) - self.radius[:, None] - other.radius[None, :]
        for k in range(self.low.shape[1]):
            found = np.maximum(found, self.low[:, k][:, None] - other.high[:, k][None, :])
            found = np.maximum(found, other.low[:, k][None, :] - self.high[:, k][:, None])
        return np.maximum(found, 0) - SLACK

    def near(self, bound: float, other: Cells | None = None) -> np.ndarray:
        """Whether two cells, as for apart, may hold vectors within the bound."""
        if other is not None:
            return (self.apart(other) <= bound) & (self.sizes > 0)[:, None] & (other.sizes > 0)[None, :]
        found = (self.apart() <= bound) & (self.sizes > 0)[:, None] & (self.sizes > 0)[None, :]
        np.fill_diagonal(found, self.sizes > 0)
        return found

    def from_points(self, x: np.ndarray) -> np.ndarray:
        """What each row of x is apart at least from the vectors of each cell."""
        far = distances(x, self.pivots, self.angular)
        found = far - self.radius[None, :]
        for k in range(self.low.shape[1]):
            found = np.maximum(found, np.maximum(self.low[None, :, k] - far[:, k : k + 1], far[:, k : k + 1] - self.high[None, :, k]))
        return np.maximum(found, 0) - SLACK

    def parts(self, block: int) -> np.ndarray:
        """How many blocks each cell is cut into."""
        return np.maximum(1, -(-self.sizes // block))


def cells(vectors: DataFrame, block: int, angular: bool = False, seed: int = 42, references: np.ndarray | None = None) -> Cells:
    """The vectors (id, v) in cells of about `block`; pivots are vectors that a seeded hash of the id picks.

    references: those of other cells, if the two are to be compared by apart (from_points has only own ones).
    """
    spark = vectors.sparkSession
    n = vectors.count()
    m = int(min(MOST, max(1, -(-n // block))))
    picked = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(m).select("v").collect()  # MOST rows at most
    pivots = np.array([r["v"] for r in picked], dtype=float).reshape(len(picked), -1 if picked else 0)
    pivots = unit(pivots) if angular else pivots
    kind = vectors.schema["id"].dataType.simpleString()
    references = pivots[:REFERENCES] if references is None else references
    refs = len(references)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            far = distances(unit(x) if angular else x, pivots, angular)
            cell = far.argmin(axis=1)
            own = far[np.arange(len(x)), cell]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(own)], ["id", "v", "cell", "own"])

    sizes, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    low, high = np.zeros((len(pivots), refs)), np.zeros((len(pivots), refs))
    with batches_of(spark, 2048):
        placed = written(vectors.select("id", "v").mapInArrow(place, f"id {kind}, v array<double>, cell int, own double"), "cells")
        for row in _bounds(placed, references, angular).collect():  # MOST rows at most
            c = row["cell"]
            sizes[c], radius[c], low[c], high[c] = row["n"], row["r"], row["lo"], row["hi"]
    return Cells(placed.select("id", "v", "cell"), pivots, angular, sizes, radius, low, high)


def _bounds(placed: DataFrame, references: np.ndarray, angular: bool) -> DataFrame:
    """(cell, n, r, lo, hi): vectors of a cell, the farthest from its pivot, and the least and greatest distance to each reference.

    Distances to the references are taken as the cells are read, and only those of a task's cells leave it.
    """
    names = ["cell", "n", "r", "lo", "hi"]

    def joined(cell: np.ndarray, n: np.ndarray, r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple:
        order = np.argsort(cell, kind="stable")
        seen, first = np.unique(cell[order], return_index=True)
        return seen, np.add.reduceat(n[order], first), np.maximum.reduceat(r[order], first), np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)

    def rows(cell: np.ndarray, n: np.ndarray, r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
        at = np.arange(len(cell) + 1, dtype=np.int32) * lo.shape[1]
        return [pa.array(cell, pa.int32()), pa.array(n, pa.int64()), pa.array(r), *(pa.ListArray.from_arrays(at, x.ravel()) for x in (lo, hi))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            far = distances(unit(x) if angular else x, references, angular)
            cell, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            new = joined(cell, np.ones(len(x), dtype=np.int64), own, far, far)
            held = new if held is None else joined(*(np.concatenate(z) for z in zip(held, new, strict=True)))
        if held is not None:
            yield pa.RecordBatch.from_arrays(rows(*held), names)

    def gather(parts: pa.Table) -> pa.Table:
        parts = parts.combine_chunks()
        cell, n, r = (parts[c].to_numpy() for c in names[:3])
        return pa.Table.from_arrays(rows(*joined(cell, n, r, *(matrix(parts[c].combine_chunks()) for c in names[3:]))), names)

    schema = "cell int, n long, r double, lo array<double>, hi array<double>"
    return placed.select("v", "cell", "own").mapInArrow(run, schema).groupBy("cell").applyInArrow(gather, schema)


def pairs_of_blocks(found: Cells, bound: float, block: int) -> tuple[list[list[int]], int, int]:
    """(for each cell the cells that may hold a vector within the bound, pairs of blocks to compare, pairs of blocks in all)."""
    near = found.near(bound)
    parts = np.where(found.sizes > 0, found.parts(block), 0)
    total = int(parts.sum())
    compared = (int(parts @ near @ parts) + total) // 2
    return [np.nonzero(r)[0].tolist() for r in near], compared, total * (total + 1) // 2


def packed(found: Cells, block: int) -> DataFrame:
    """(k, c, ids, x): the vectors in numbered blocks of a cell c, by rising id; x holds a block's vectors as bytes of doubles."""
    spark, kind = found.rows.sparkSession, found.rows.schema["id"].dataType.simpleString()
    parts = found.parts(block).tolist()
    first = np.cumsum([0, *parts]).tolist()
    plan = spark.createDataFrame([(c, first[c], n) for c, n in enumerate(parts)], "cell int, first int, parts int")  # MOST rows at most
    at = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    rows = found.rows.join(F.broadcast(plan), "cell").select(at.alias("k"), F.col("cell").alias("c"), "id", "v")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["id"])).combine_chunks()
        ids, x = rows["id"].combine_chunks(), matrix(rows["v"].combine_chunks())
        return pa.table({"k": rows["k"][:1], "c": rows["c"][:1], "ids": pa.array([ids.to_pylist()], pa.list_(ids.type)), "x": pa.array([x.tobytes()], pa.binary())})

    files = max(2 * spark.sparkContext.defaultParallelism, sum(parts) // 64)
    return written(rows.repartition(files, "k").groupBy("k").applyInArrow(pack, f"k int, c int, ids array<{kind}>, x binary"), "blocks")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """The vectors (id, v) in packed blocks, all of one cell."""
    none, n = np.zeros((1, 0)), rows.count()
    return packed(Cells(rows.withColumn("cell", F.lit(0)), none, False, np.array([n]), np.zeros(1), none, none), block)


def _with_others(blocks: DataFrame, near: np.ndarray) -> DataFrame:
    """(lk, lc, li, lx, others): packed blocks with the cells that are near theirs (a table of truths)."""
    known = [(c, np.nonzero(r)[0].tolist()) for c, r in enumerate(near) if r.any()]
    plan = blocks.sparkSession.createDataFrame(known, "lc int, others array<int>")  # MOST rows at most
    return blocks.toDF("lk", "lc", "li", "lx").join(F.broadcast(plan), "lc").select("lk", "lc", "li", "lx", "others")


def block_met(blocks: DataFrame, near: np.ndarray) -> DataFrame:
    """Every pair of packed blocks whose cells are near (a symmetric table of truths), once, and each block with itself: (lk, lc, li, lx, rk, rc, ri, rx).

    Blocks meet as they are read, so none of them is shuffled or written for it, however many others it meets.
    """
    # of two blocks the one or the other is on the left, so that all tasks have as many pairs
    even = (F.col("lk") + F.col("rk")) % 2 == 0
    once = (F.col("lk") == F.col("rk")) | ((F.col("lk") < F.col("rk")) == even)
    left = _with_others(blocks, near).hint("shuffle_replicate_nl")
    return left.join(blocks.toDF("rk", "rc", "ri", "rx"), once & F.array_contains("others", F.col("rc"))).drop("others")


def all_met(left: DataFrame, right: DataFrame, near: np.ndarray | None = None) -> DataFrame:
    """As block_met, for every block of one packed table with every one of another, or with those of near cells."""
    right = right.toDF("rk", "rc", "ri", "rx")
    if near is None:
        return left.toDF("lk", "lc", "li", "lx").hint("shuffle_replicate_nl").crossJoin(right)
    return _with_others(left, near).hint("shuffle_replicate_nl").join(right, F.array_contains("others", F.col("rc"))).drop("others")


def block_pairs(found: Cells, bound: float, block: int) -> DataFrame:
    """The pairs of blocks that may hold vectors within the bound, as block_met gives them."""
    return block_met(packed(found, block), found.near(bound))


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((k, c, ids, vectors), the same of the other block) of each row of block_met."""
    for batch in batches:
        for n in range(batch.num_rows):
            pair = []
            for at in (0, 4):
                k, c, ids, x = (batch.column(at + m)[n] for m in range(4))
                pair.append((k.as_py(), c.as_py(), ids.values, np.frombuffer(x.as_buffer()).reshape(len(ids.values), -1)))
            yield tuple(pair)


def sides(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, np.ndarray]:
    """ids and vectors of one side, a list column of (id, v), in a batch of one row, by rising id."""
    held = batch.column(k).flatten()
    held = held.take(pc.sort_indices(held.field("id")))
    return held.field("id"), matrix(held.field("v"))


def nearest_of(x: np.ndarray, y: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest of y for each row of x, without those that are the same; ties go to the first."""
    d = distances(x, y, False)
    d[same] = np.inf
    k = min(k, d.shape[1])
    top = np.argsort(d, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(d, top, 1)
    held = np.isfinite(far)
    return np.repeat(np.arange(len(x)), k)[held.ravel()], top[held], far[held]


def _searched(groups: DataFrame, k: int, kind: str, both: bool, others: str | None = None, apart: bool = True) -> DataFrame:
    """(i, j, d): for each row of (l, r) the k nearest in r of every one in l (both: and the other way); an empty r stands for l.

    apart: an id is not its own neighbour. others: the type of the ids in r, if it is another one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, x), (b, y) = sides(batch, 0), sides(batch, 1)
            if not len(a):
                continue
            if not len(b):
                b, y = a, x
            same = a.to_numpy(zero_copy_only=False)[:, None] == b.to_numpy(zero_copy_only=False)[None, :] if apart else np.zeros((len(a), len(b)), dtype=bool)
            i, j, d = nearest_of(x, y, same, k)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(i)), b.take(pa.array(j)), pa.array(d)], ["i", "j", "d"])
            if both and b is not a:
                j, i, d = nearest_of(y, x, same.T, k)
                yield pa.RecordBatch.from_arrays([b.take(pa.array(j)), a.take(pa.array(i)), pa.array(d)], ["i", "j", "d"])

    return groups.select("l", "r").mapInArrow(run, f"i {kind}, j {others or kind}, d double")


class Lists:
    """The k nearest of each vector of a block among those that it has met so far; ties go to the lesser id."""

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int, bound: float):
        self.kind, self.ids, self.x, self.k = ids.type, comparable(ids), x.copy(), k
        self.squares = (x * x).sum(axis=1)
        self.bound = np.full(len(x), bound)  # no one of the k nearest is farther
        self.far, self.near = np.full((len(x), k), np.inf), np.empty((len(x), k), dtype=self.ids.dtype)

    def meet(self, squared: np.ndarray, other: Lists) -> None:
        """Take in another block, by squared distances that may be off by rounding; the distances of those that may count are taken again."""
        slack = 1e-12 * (self.squares.max(initial=0) + other.squares.max(initial=0))
        limit = np.minimum(self.bound, self.far[:, -1]) ** 2 * (1 + 1e-12) + slack
        hits = squared <= limit[:, None]
        many = np.nonzero(hits.sum(axis=1) > 4 * self.k)[0]
        if len(many):
            some = squared[many]
            some[self.ids[many][:, None] == other.ids[None, :]] = np.inf
            limit[many] = np.minimum(limit[many], np.partition(some, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
            hits[many] = some <= limit[many][:, None]
        p, q = np.nonzero(hits)
        others = self.ids[p] != other.ids[q]
        p, q = p[others], q[others]
        if not len(p):
            return
        d = np.concatenate([np.sqrt(((self.x[p[s : s + 65536]] - other.x[q[s : s + 65536]]) ** 2).sum(axis=1)) for s in range(0, len(p), 65536)])
        rows, counts = np.unique(p, return_counts=True)
        row = np.concatenate([np.repeat(rows, self.k), p])
        far, near = np.concatenate([self.far[rows].ravel(), d]), np.concatenate([self.near[rows].ravel(), other.ids[q]])
        start = np.concatenate([[0], np.cumsum(counts + self.k)[:-1]])
        top = np.lexsort((near, far, row))[start[:, None] + np.arange(self.k)]
        self.far[rows], self.near[rows] = far[top], near[top]

    def rows(self) -> pa.RecordBatch:
        i, held = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays([pa.array(c[i] if c.ndim == 1 else c[i, held], t) for c, t in ((self.ids, self.kind), (self.near, self.kind), (self.far, pa.float64()))], ["i", "j", "d"])


def comparable(ids: pa.Array) -> np.ndarray:
    found = ids.to_numpy(zero_copy_only=False)
    return found.astype(str) if found.dtype == object else found


def listed(pairs: DataFrame, k: int, kind: str, reach: np.ndarray) -> DataFrame:
    """(i, j, d): for each vector the k nearest of those that it meets in a task, if they may be among its k nearest of all.

    A task holds the lists of the blocks of its two parts of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Lists] = {}
        for left, right in met(batches):
            a, b = (held.get(n) or held.setdefault(n, Lists(ids, x, k, reach[c])) for n, c, ids, x in (left, right))
            squared = np.column_stack([-2 * a.x, a.squares, np.ones(len(a.x))]) @ np.column_stack([b.x, np.ones(len(b.x)), b.squares]).T
            a.meet(squared, b)
            if a is not b:
                b.meet(squared.T, a)
        for lists in held.values():
            yield lists.rows()

    return pairs.mapInArrow(run, f"i {kind}, j {kind}, d double")


def best(found: DataFrame, k: int) -> DataFrame:
    """(i, j, d, rank): the k least of (i, j, d) for each i, ties to the lesser j; one shuffle by i."""
    once = found.repartition("i").groupBy("i", "j").agg(F.min("d").alias("d"))
    order = Window.partitionBy("i").orderBy("d", "j")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def within_cells(placed: Cells, blocks: DataFrame, k: int) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each vector within its own cell."""
    kind = placed.rows.schema["id"].dataType.simpleString()
    own = block_met(blocks, np.diag(placed.sizes > 0))
    with batches_of(placed.rows.sparkSession, 4):  # a row is two blocks
        return written(best(listed(own, k, kind, np.full(len(placed.sizes), np.inf)), k), "own")


def visits(asked: DataFrame, placed: Cells, first: int | None = None) -> DataFrame:
    """(id, v, cell): the cells that each row of asked (id, v, bound, done) has to visit.

    These are the cells but for those in done that may hold a vector within the bound, all of them if it is null; or (first) so many
    cells whose pivots are nearest.
    """
    kind = asked.schema["id"].dataType.simpleString()
    shape = Cells(None, placed.pivots, placed.angular, placed.sizes, placed.radius, placed.low, placed.high)
    some = placed.sizes > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            if not some.any():
                lists = [[]] * len(x)
            elif first is None:
                bound = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                near = (shape.from_points(x) <= np.where(np.isnan(bound), np.inf, bound)[:, None]) & some[None, :]
                done = batch.column(3).to_pylist()
                lists = [np.setdiff1d(np.nonzero(r)[0], d or []) for r, d in zip(near, done, strict=True)]
            else:
                far = np.where(some[None, :], distances(x, shape.pivots, shape.angular), np.inf)
                lists = list(np.argsort(far, axis=1, kind="stable")[:, : min(first, int(some.sum()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "to"])

    with batches_of(asked.sparkSession, 2048):
        found = asked.select("id", "v", "bound", "done").mapInArrow(run, f"id {kind}, v array<double>, to array<int>")
        return written(found.select("id", "v", F.explode("to").alias("cell")), "visits")


def answers(asked: DataFrame, placed: Cells, k: int, block: int, apart: bool = True) -> DataFrame:
    """(i, j, d): for each row of asked (id, v, cell) the k nearest vectors in that cell; a task holds two blocks."""
    spark = asked.sparkSession
    kind, others = (df.schema["id"].dataType.simpleString() for df in (asked, placed.rows))
    counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # MOST rows at most
    parts = placed.parts(block).tolist()
    plan = spark.createDataFrame([(c, parts[c], -(-n // block)) for c, n in counts.items()], "cell int, parts int, groups int")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    side = lambda df, g, p, as_: df.join(F.broadcast(plan), "cell").select("cell", g.alias("g"), p.alias("p"), F.struct("id", "v").alias(as_))
    ask = side(asked, part("groups"), F.explode(every("parts")), "l").withColumn("r", F.lit(None).cast(f"struct<id: {others}, v: array<double>>"))
    held = side(placed.rows, F.explode(every("groups")), part("parts"), "r").withColumn("l", F.lit(None).cast(f"struct<id: {kind}, v: array<double>>"))
    groups = ask.unionByName(held).groupBy("cell", "g", "p").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))
    with batches_of(spark, 1):  # a row is two blocks
        return written(_searched(groups.filter(F.size("r") > 0), k, kind, both=False, others=others, apart=apart), "answers")


def _nearest(placed: Cells, blocks: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """The k nearest others, given those within the own cell: these bound how far the others can be."""
    kind = placed.rows.schema["id"].dataType.simpleString()
    bound = own.groupBy(F.col("i").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).alias("bound"))
    far = placed.rows.select("id", "cell").join(bound, "id", "left").groupBy("cell").agg(F.max(F.coalesce("bound", F.lit(np.inf))).alias("reach"))
    reach = np.zeros(len(placed.sizes))
    for row in far.collect():  # MOST rows at most
        reach[row["cell"]] = row["reach"]
    some = placed.sizes > 0
    near = (placed.apart() <= np.maximum(reach[:, None], reach[None, :])) & some[:, None] & some[None, :]
    np.fill_diagonal(near, False)
    with batches_of(placed.rows.sparkSession, 4):  # a row is two blocks
        return written(best(own.select("i", "j", "d").union(listed(block_met(blocks, near), k, kind, reach)), k), "near")


def nearest(vectors: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each vector (id, v), exactly; ties go to the lesser id.

    Neighbours within the own cell bound how far the others can be; a cell then meets
    those cells only that may hold a nearer one. Where vectors have no groups that is
    most of them, and the products taken grow with the square of the vectors; what is shuffled and written does not.
    """
    with scratch(vectors.sparkSession) as keep:
        placed = cells(vectors, block)
        blocks = packed(placed, block)
        return keep(_nearest(placed, blocks, within_cells(placed, blocks, k), k), "neighbours")


def descended(vectors: DataFrame, k: int, recall: float = 0.9, block: int = 1000, rounds: int = 0, asked: int = 200) -> DataFrame:
    """(i, j, d, rank): k near others of each vector (id, v): those of its own cell, or the exact ones.

    The recall of the lists within the own cells is measured for `asked` vectors against
    all others; if it is below `recall`, the exact neighbours are given. `rounds` has no effect: rounds of
    neighbours of neighbours start from lists that are exact within a cell, never leave it, and so find nothing.
    """
    with scratch(vectors.sparkSession) as keep:
        placed = cells(vectors, block)
        blocks = packed(placed, block)
        lists = within_cells(placed, blocks, k)
        if measured(placed.rows.select("id", "v"), lists, k, asked) < recall:
            lists = _nearest(placed, blocks, lists, k)
        return keep(lists, "neighbours")


def measured(vectors: DataFrame, lists: DataFrame, k: int, asked: int = 200, seed: int = 7) -> float:
    """The share of the k exact neighbours that the lists hold, for `asked` vectors that a seeded hash picks; ties count by distance."""
    picked = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(asked).collect()
    if not picked:
        return 1.0
    ids, x = [r["id"] for r in picked], np.array([r["v"] for r in picked], dtype=float)
    kind = vectors.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                other = batch.column(0).to_numpy(zero_copy_only=False)
                i, _, d = nearest_of(x, matrix(batch.column(1)), np.array(ids)[:, None] == other[None, :], k)
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in i], batch.column(0).type), pa.array(d)], ["i", "d"])

    order = Window.partitionBy("i").orderBy("d")
    exact = vectors.select("id", "v").mapInArrow(search, f"i {kind}, d double").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    limit = exact.groupBy("i").agg(F.max("d").alias("limit"), F.count("*").alias("n"))
    near: Column = F.col("d") <= F.col("limit") + 1e-9
    row = limit.join(lists.select("i", "d"), "i", "left").groupBy("i", "n").agg(F.count(F.when(near, 1)).alias("held")).agg(F.sum("held"), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 1.0
