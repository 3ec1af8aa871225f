"""Whitening of embeddings on their principal components.

A randomised range finder: an orthonormal basis with a few more columns than
components is wanted is multiplied by the covariance, in passes over all centred
rows, and made orthonormal again. Rayleigh-Ritz on what it spans gives components
and residuals. Where the residuals are not small after the passes, which is the rule
when eigenvalues lie close to each other, the basis grows to the full dimension, and the
same step then gives the components to double precision.

The driver holds matrices of the dimension squared at most; rows stay in tasks,
which send one partial sum each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import batches_of, name, scratch, written

SCALE, SHIFT = 64, 1_000_000  # entries become whole numbers: floor(SCALE * c) + SHIFT
TOLERANCE = 1e-13  # of the residuals, in parts of the first eigenvalue


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): rows whose vector has finite entries only, as whole numbers."""
    entry = F.transform(name(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(name(id_col).alias("vec_id"), entry.alias("v")).filter("v IS NOT NULL")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.filter(F.forall("v", finite)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def summed(rows: DataFrame, column: str, part: Callable[[np.ndarray], np.ndarray], size: int, kind: type) -> np.ndarray:
    """The sum over all rows of what part gives for each batch of vectors, as one flat array.

    Each task adds up its own batches and sends `size` numbers.
    """
    dtype = np.int64 if kind is int else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size, dtype=dtype), False
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0), dtype)).ravel()
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "s"])

    found = np.zeros(size, dtype=dtype)
    sums = rows.select(column).mapInArrow(run, f"k long, s {'long' if kind is int else 'double'}")
    for row in sums.groupBy("k").agg(F.sum("s").alias("s")).collect():  # `size` rows: the dimension squared at most
        found[row["k"]] = row["s"]
    return found


class Centre:
    """Takes the exact mean S / n from whole numbers: its whole part as integers, the rest in doubles."""

    def __init__(self, total: np.ndarray, n: int):
        self.n = n
        self.base = np.array([int(s) // n for s in total], dtype=np.int64)
        self.left = np.array([int(s) - n * int(b) for s, b in zip(total, self.base, strict=True)], dtype=np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - S)^2, exactly; None where that is no 64-bit number."""
        off = x - self.base
        widest = (self.n * (float(np.abs(off).max(initial=0)) + 1)) ** 2 * max(1, x.shape[1])
        if widest < 2**62:
            return ((self.n * off - self.left) ** 2).sum(axis=1).tolist()
        exact = ((self.n * off.astype(object) - self.left.astype(object)) ** 2).sum(axis=1)
        return [int(s) if s < 2**63 else None for s in exact]


def components(
    rows: DataFrame, centre: Centre, k: int, oversample: int = 10, passes: int = 3, seed: int = 42, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors as columns, trace) of the covariance, at most k and only those above rounding."""
    d, n = len(centre.base), centre.n

    def times(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times the basis, and the covariance's trace."""

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.append(c.T @ (c @ basis), (c * c).sum())

        found = summed(rows, "x", part, d * basis.shape[1] + 1, float) / n
        return found[:-1].reshape(d, -1), float(found[-1])

    width = min(d, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0] if width < d else np.eye(d)
    while True:
        full = basis.shape[1] == d
        for turn in range(1 if full else passes):
            image, trace = times(basis)
            if not full and turn + 1 < passes:
                basis = np.linalg.qr(image)[0]
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:k]
        values, turned = values[order], turned[:, order]
        residual = np.linalg.norm(image @ turned - basis @ turned * values, axis=0)
        if full or residual.max(initial=0) <= tolerance * max(values.max(initial=0), 0):
            held = values > d * np.finfo(float).eps * max(values.max(initial=0), 0)
            return values[held], (basis @ turned)[:, held], trace
        basis = np.eye(d)  # the full dimension


def whiten(
    vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", oversample: int = 10, passes: int = 3,
    seed: int = 42, tolerance: float = TOLERANCE,
) -> DataFrame:
    """(vec_id, deviation, white, n, explained, identity_error): one row for each row of vectors that has a sound vector.

    Entries c count as the whole numbers floor(64 c) + 1,000,000. white holds the
    centred vector on each component over the root of its eigenvalue, by falling
    eigenvalue; explained the components' shares of the variance; identity_error how far
    the covariance of white is from the identity, at most; deviation the sum of
    (n x - S)^2, exactly (null beyond 64 bits).

    Null vectors and such with null or non-finite entries are dropped, as are those
    whose length is not the most common one (of equally common ones the greatest). Directions without variance give no component: a single row, or rows
    that are all equal, have empty arrays. Ids may be null or repeat, repeated rows count
    as often as they are there; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    with scratch(spark) as keep, batches_of(spark, 4096):
        rows = written(whole_numbers(vectors, id_col, vector_col), "vectors")
        sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        d, n = (sizes["d"], sizes["n"]) if sizes else (0, 0)
        if not d:
            none = "deviation long, white array<double>, n long, explained array<double>, identity_error double"
            return spark.createDataFrame([], f"vec_id {kind}, {none}")
        rows = rows.filter(F.size("x") == d)
        centre = Centre(summed(rows, "x", lambda x: x.sum(axis=0), d, int), n)
        values, vectors_, trace = components(rows, centre, k, oversample, passes, seed, tolerance)
        onto = vectors_ / np.sqrt(values)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), np.int64)
                white = centre(x) @ onto
                held = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], white.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(x), pa.int64()), held], ["vec_id", "deviation", "white"])

        white = keep(rows.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, deviation long, white array<double>"), "white")
        m, error = len(values), 0.0
        if m:
            mean = summed(white, "white", lambda w: w.sum(axis=0), m, float) / n
            spread = summed(white, "white", lambda w: (w - mean).T @ (w - mean), m * m, float).reshape(m, m) / n
            error = float(np.abs(spread - np.eye(m)).max())
    shares = F.array(*(F.lit(float(e / trace)) for e in values)) if m else F.array().cast("array<double>")
    return white.select("vec_id", "deviation", "white", F.lit(n).cast("long").alias("n"), shares.alias("explained"), F.lit(error).alias("identity_error"))
