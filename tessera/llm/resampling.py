"""Importance resampling of documents towards a target distribution.

Texts are taken as bags of hashed runs of one to three words. The gain of a
bucket is the logarithm of how much more often the target texts have it than the
corpus does; a text's weight is the sum of the gains of its runs, and adding
Gumbel noise to the weights and taking the greatest draws without replacement.

Identical texts are grouped by the full text first, so that each is parsed once
for the counts (multiplied by its copies) and once for its weight; weights are
then joined back to the documents, whose noise is their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import numbered
from tessera.functions.session import batches_of, name, scratch, written

BUCKETS, RUN, LEAST_WORDS, SEED = 10_000, 3, 20, 42

# ASCII other than letters and digits parts words, capitals become small, all bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def run_buckets(text: bytes | None, buckets: int = BUCKETS, run: int = RUN) -> tuple[int, np.ndarray]:
    """The number of a text's words, and the bucket of each run of 1 to `run` adjacent words."""
    words = (text or b"").translate(_FOLD).split()
    spaced = [b" " + w for w in words]
    sums = [list(map(crc32, words))]
    for k in range(1, min(run, len(words))):
        sums.append(list(map(crc32, spaced[k:], sums[-1])))  # the checksum goes on from that of the shorter run
    n = sum(map(len, sums))
    return len(words), np.fromiter(chain.from_iterable(sums), dtype=np.uint32, count=n) % np.uint32(buckets)


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """(text, copies): each distinct text, null ones as empty; copies are counted before the shuffle."""
    return docs.groupBy(F.coalesce(name(text_col), F.lit("")).alias("text")).agg(F.count("*").alias("copies"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many runs each bucket holds over all texts and their copies; one row a task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text, copies in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total += copies * np.bincount(run_buckets(text.as_py(), buckets, run)[1], minlength=buckets)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary"), "copies").mapInArrow(count, "bucket long, n long")
    found = np.zeros(buckets, dtype=np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        found[row["bucket"]] = row["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the corpus, rounded down."""
    k = len(corpus)
    ratio = lambda t, s: (t + 1.0) * (corpus.sum() + float(k)) / ((s + 1.0) * (target.sum() + float(k)))
    return np.array([math.floor(1000 * math.log(ratio(float(t), float(s)))) for t, s in zip(target, corpus, strict=True)], dtype=np.int64)


def text_weights(texts: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """(key, n_words, n_features, weight) of each distinct text; key is its SHA-256."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                words, at = run_buckets(text.as_py(), len(gain), run)
                found.append((words, len(at), int(gain[at].sum())))
            n, features, weight = (pa.array([x[k] for x in found], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, features, weight], ["key", "n_words", "n_features", "weight"])

    keyed = texts.select(_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    return keyed.mapInArrow(weigh, "key binary, n_words long, n_features long, weight long")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that the id and the seed decide, rounded down; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): one row per row of docs.

    Of the rows with at least `least_words` words, `percent` in a hundred are
    drawn (rounded down): those with the greatest scores, ties to the smaller id,
    null ids last; rank numbers them from 1 and is null for all others. Null and
    empty texts have no features, a weight of 0 and are never drawn. Rows of equal
    id and text have equal scores and come one after the other. An empty target or
    corpus leaves the smoothed counts. Other columns of both tables are ignored.

    A text that many rows share is one row of each table until the last join,
    whose larger side Spark can split.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep, batches_of(spark, 256):
        texts = written(distinct_texts(docs, text_col), "texts")
        gain = gains(bucket_counts(texts, buckets), bucket_counts(distinct_texts(target, target_text_col), buckets))
        weights = written(text_weights(texts, gain), "weights")
        picked = docs.select(name(id_col).alias("doc_id"), _key(F.coalesce(name(text_col), F.lit(""))).alias("key"))
        scored = picked.join(weights, "key").select(
            "doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
            (F.col("n_words") >= least_words).alias("able"), F.monotonically_increasing_id().alias("row"),
        )
        scored = written(scored, "scored")
        most = percent * scored.filter("able").count() // 100
        # the row's own number tells rows of one id and score apart, so that no value of the order is heavy
        order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
        placed = numbered(scored, order, "place", first=1)
        rank = F.when(F.col("able") & (F.col("place") <= most), F.col("place"))
        return keep(placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank")), "resampled")
