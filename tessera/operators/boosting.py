"""Gradient boosting of trees for several classes at once, by softmax and histograms of gradients.

Rows are category codes; equal rows are counted first, so that passes go over
distinct rows with their numbers. A round grows one tree for each class, level by
level: tasks add up gradients and curvatures of their rows by class, node, feature
and code, Spark sums these, and the driver, which holds the sums and the trees only, picks the splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import batches_of, scratch, written

REFRESH = 10  # rounds after which the scores of the rows are written anew


@dataclass
class Tree:
    """Nodes as arrays; a node without a feature (-1) is a leaf. Codes up to the split go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    split: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, feature: int, split: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.split[node], self.left[node] = feature, split, at
        for held, new in ((self.feature, -1), (self.split, 0), (self.left, 0), (self.value, 0.0)):
            held += [new, new]
        return at, at + 1

    def leaves(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node where each row ends."""
        feature, split, left = np.array(self.feature), np.array(self.split), np.array(self.left)
        at = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        for _ in range(depth):
            inner = feature[at] >= 0
            right = codes[rows, np.where(inner, feature[at], 0)] > split[at]
            at = np.where(inner, left[at] + right, at)
        return at


@dataclass
class Boosted:
    """Rounds of one tree for each class, and the gains of their splits by feature."""

    classes: int
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: dict[int, list[float]] = field(default_factory=dict)

    def scores(self, codes: np.ndarray, since: int = 0) -> np.ndarray:
        found = np.zeros((len(codes), self.classes))
        for trees in self.rounds[since:]:
            for k, tree in enumerate(trees):
                found[:, k] += np.array(tree.value)[tree.leaves(codes, self.depth)]
        return found

    def mean_gains(self, features: int) -> list[float]:
        """The mean gain of the splits on each feature; 0 for one that none is on."""
        return [float(np.mean(self.gains[f])) if f in self.gains else 0.0 for f in range(features)]


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1 if len(column) else 0)


def slopes(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the softmax loss of each row and class."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return g, np.maximum(2 * p * (1 - p), 1e-16)


def best_split(g: np.ndarray, h: np.ndarray, starts: np.ndarray, penalty: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, code) of the best split of a node from its sums by feature and code, of all features' codes on end.

    Equal gains, up to rounding, go to the first feature and least code; no split has gain 0.
    """
    found = (0.0, -1, 0)
    for f, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - all_g**2 / (all_h + penalty)
        gain = np.where((left_h >= least) & (right_h >= least), np.round(gain, 9), 0.0)
        if len(gain) and gain.max() > max(found[0], 1e-6):
            found = (float(gain.max()), f, int(gain.argmax()))
    return found


def fit(
    rows: DataFrame, classes: int, codes: list[int], rounds: int = 100, depth: int = 6, step: float = 0.3, penalty: float = 1.0, least: float = 1.0
) -> Boosted:
    """The model of rows (x array<int>, y int): x has code 0 .. codes[f] - 1 for each feature f, y is 0 .. classes - 1.

    As many rounds as asked for, trees up to the depth; a leaf is worth -step g / (h + penalty),
    and each side of a split has a curvature of `least` at least.
    """
    starts = np.concatenate([[0], np.cumsum(codes)])
    total, model = int(starts[-1]), Boosted(classes, depth)
    spark = rows.sparkSession
    with scratch(spark), batches_of(spark, 10_000):
        held = rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
        held = written(held.withColumn("s", F.array_repeat(F.lit(0.0), classes)), "rows")
        since = 0

        def sums(trees: list[Tree], slots: list[dict[int, int]], width: int) -> np.ndarray:
            """(class, open node, code of a feature, gradient or curvature) summed over the rows."""
            shape = (classes, width, total)
            known = Boosted(classes, depth, model.rounds[since:])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found = np.zeros((2, classes, width * total))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x, y = matrix(batch.column(0), np.int64), batch.column(1).to_numpy().astype(np.int64)
                    n, scores = batch.column(2).to_numpy(), matrix(batch.column(3), float) + known.scores(x)
                    both = slopes(scores, y)
                    for k in range(classes):
                        at = trees[k].leaves(x, depth)
                        place = np.full(len(trees[k].feature), -1)
                        place[list(slots[k])] = list(slots[k].values())
                        place = place[at]
                        inside = place >= 0
                        for f in range(x.shape[1]):
                            slot = place[inside] * total + starts[f] + x[inside, f]
                            for side in (0, 1):
                                found[side, k] += np.bincount(slot, weights=(both[side][:, k] * n)[inside], minlength=width * total)
                g, h = found[0].ravel(), found[1].ravel()
                some = np.nonzero(h)[0]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some]), pa.array(h[some])], ["slot", "g", "h"])

            parts = held.select("x", "y", "n", "s").mapInArrow(run, "slot long, g double, h double")
            found = np.zeros((2, classes * width * total))
            # a number for each class, open node and code: what the driver needs to split
            for row in parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                found[:, row["slot"]] = row["g"], row["h"]
            return found.reshape(2, *shape)

        for turn in range(rounds):
            trees = [Tree() for _ in range(classes)]
            slots = [{0: 0} for _ in range(classes)]
            for level in range(depth + 1):
                width = max(len(s) for s in slots)
                if not width:
                    break
                g, h = sums(trees, slots, width)
                grown: list[dict[int, int]] = [{} for _ in range(classes)]
                for k, tree in enumerate(trees):
                    for node, slot in slots[k].items():
                        first = slice(0, int(starts[1]))  # any one feature's codes hold all rows of the node
                        tree.value[node] = -step * float(g[k, slot, first].sum()) / (float(h[k, slot, first].sum()) + penalty)
                        if level == depth:
                            continue
                        gain, feature, split = best_split(g[k, slot], h[k, slot], starts, penalty, least)
                        if feature >= 0:
                            model.gains.setdefault(feature, []).append(gain)
                            for child in tree.grow(node, feature, split):
                                grown[k][child] = len(grown[k])
                slots = grown
            model.rounds.append(trees)
            if (turn + 1) % REFRESH == 0 and turn + 1 < rounds:
                held, since = written(_scored(held, Boosted(classes, depth, model.rounds[since:])), "rows"), turn + 1
    return model


def _scored(held: DataFrame, known: Boosted) -> DataFrame:
    """The rows with the scores of these rounds added to theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = matrix(batch.column(3), float) + known.scores(matrix(batch.column(0), np.int64))
            flat = pa.ListArray.from_arrays(np.arange(len(scores) + 1, dtype=np.int32) * known.classes, scores.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], flat], ["x", "y", "n", "s"])

    return held.select("x", "y", "n", "s").mapInArrow(run, "x array<int>, y int, n double, s array<double>")


def predict(rows: DataFrame, model: Boosted, to: str = "prediction") -> DataFrame:
    """rows (with x array<int>) and the class of the greatest score, the first of equal ones, as a double."""
    at, names = rows.columns.index("x"), [*rows.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = np.round(model.scores(matrix(batch.column(at), np.int64)), 9).argmax(axis=1).astype(float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {to} double")
