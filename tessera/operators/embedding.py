"""Vectors of texts: from a model that the caller brings, or trained on the texts themselves.

Trained ones take words that stand near each other as alike: co-occurrence counts
within a window become positive pointwise mutual information, and a randomised range finder gives the
leading directions of that matrix. It is held by Spark as entries; the driver holds the vectors of the
vocabulary only, whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import batches_of, scratch, written
from tessera.operators.text import TOKEN

Client = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


def client_vectors(texts: DataFrame, client: Client, batch: int = 64) -> DataFrame:
    """(id, v) of texts (id, text) by a model: client() is called once in each task and gives a function of a list of texts.

    Null texts are left out.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = client()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                found = [[float(x) for x in v] for v in embed(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], ["id", "v"])

    return texts.select("id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").mapInArrow(run, f"id {kind}, v array<double>")


def _numbered_words(texts: DataFrame, vocabulary: int, least: int) -> tuple[DataFrame, list[str]]:
    """((id, w): the numbers of each text's known words in their order, the words by number)."""
    words = texts.select("id", F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(TOKEN), F.lit(0)).alias("words"))
    words = written(words.filter("words IS NOT NULL"), "words")
    counts = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    known = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]  # `vocabulary` rows at most
    number = {w: k for k, w in enumerate(known)}
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[number[w] for w in row if w in number] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "w"])

    return written(words.mapInArrow(run, f"id {kind}, w array<int>"), "numbers"), known


def mutual_information(numbers: DataFrame, window: int = 4) -> DataFrame:
    """(a, b, n, p): how often two words stand within the window, either way round, and their positive information; p > 0 only."""
    at = numbers.select("w", F.posexplode("w").alias("k", "a"))
    pairs = at.select("a", F.explode(F.slice("w", F.col("k") + 2, F.lit(window))).alias("b"))
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = written(both, "pairs")
    one = both.groupBy("a").agg(F.sum("n").alias("na"))
    total = one.agg(F.sum("na").alias("total"))
    found = both.join(one, "a").join(one.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").join(F.broadcast(total))  # one row
    p = F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))
    return written(found.select("a", "b", "n", p.alias("p")).filter("p > 0"), "information")


def _product(entries: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The matrix of entries (a, b, p) times a basis; a task sends one partial product."""
    shape = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            a, b, p = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(total, a, p[:, None] * basis[b])
        some = np.nonzero(total.ravel())[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], ["k", "s"])

    found = np.zeros(shape[0] * shape[1])
    for row in entries.select("a", "b", "p").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():
        found[row["k"]] = row["s"]  # as many numbers as the basis has
    return found.reshape(shape)


def leading(entries: DataFrame, n: int, dims: int, oversample: int = 10, passes: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the symmetric n x n matrix of entries, by falling absolute value."""
    width = min(n, dims + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(_product(entries, basis))[0]
    small = basis.T @ _product(entries, basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[: min(dims, n)]
    vectors = basis @ turned[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * np.where(sign == 0, 1, sign)


def trained_vectors(texts: DataFrame, dims: int = 64, window: int = 4, vocabulary: int = 2000, least: int = 2, seed: int = 42) -> DataFrame:
    """(id, v) of texts (id, text), trained on them: the sum of their words' vectors, rare words weighing more, of length 1.

    Words are those of tokens(); of these the `vocabulary` most frequent that occur `least` times. Texts without
    a known word have zeros; null texts are left out.
    """
    kind = texts.schema["id"].dataType.simpleString()
    with scratch(texts.sparkSession) as keep, batches_of(texts.sparkSession, 1024):
        numbers, known = _numbered_words(texts, vocabulary, least)
        n = len(known)
        words = np.zeros((n, dims))
        if n:
            values, vectors = leading(mutual_information(numbers, window), n, dims, seed=seed)
            words[:, : vectors.shape[1]] = vectors * np.sqrt(np.abs(values))
        df = np.zeros(n)
        for row in numbers.select(F.explode(F.array_distinct("w")).alias("a")).groupBy("a").agg(F.count("*").alias("df")).collect():
            df[row["a"]] = row["df"]  # `vocabulary` rows at most
        weight = np.log((1 + numbers.count()) / (1 + df)) + 1
        words = words * weight[:, None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.array([words[w].sum(axis=0) if w else np.zeros(dims) for w in batch.column(1).to_pylist()]).reshape(-1, dims)
                found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)
                flat = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * dims, found.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "v"])

        return keep(numbers.mapInArrow(run, f"id {kind}, v array<double>"), "vectors")
