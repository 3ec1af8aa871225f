"""Quality rules: base limits, then boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import name, small_batches
from tessera.llm.trees import Forest, fit

SAMPLE = 20_000  # labelled documents that the trees are fitted on at most

# The counted symbols and the white space that parts words.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"

#: Statistics that the trees see, and whether keeping may only rise (+1) or fall (-1) with one.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": 0, "digits": 0,
    "marks": -1, "quotes": 0, "braces": -1, "distinct": 0, "top_word": -1, "line_words": 0, "short_lines": 0,
    "beyond_ascii": 0, "stops": 0,
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ONE = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {
    "symbols": SYMBOLS, "blanks": BLANKS, "digits": b"0123456789", "marks": b"!?=_^~\\@", "quotes": b"\"'",
    "braces": b"{}[]();/", "stops": b".,", "capitals": bytes(range(65, 91)),
}.items()}
_STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def repeated_words(ids: np.ndarray, kinds: int, window: int = 8) -> int:
    """Words that lie in a window of eight which occurs twice or more; window is a power of two.

    Windows are compared exactly: pairs of ranks are ranked again, doubling the width.
    """
    n = len(ids)
    if n <= window:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < window:
        rank = rank[:-width] * kinds + rank[width:]
        width *= 2
        if width < window and kinds**4 < 2**62:
            kinds = kinds * kinds  # still fits, no need to rank
        elif width < window:
            found, rank = np.unique(rank, return_inverse=True)
            kinds = len(found)
    _, inverse, times = np.unique(rank, return_inverse=True, return_counts=True)
    hit = times[inverse] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    return int((edge[:n].cumsum() > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the features of one UTF-8 text."""
    words = text.split()
    n = len(words)
    tally = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = {name: int(tally[hit].sum()) for name, hit in _ONE.items()}
    chars = int(tally[_STARTS].sum()) - of["blanks"]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    repeats = repeated_words(ids, max(1, len(index)))
    per_word, per_char = max(1, n), max(1, chars)
    counts = [n, chars, of["symbols"], dup_lines, repeats]
    features = [
        np.log1p(n), chars / per_word, of["symbols"] / per_word, dup_lines / max(1, len(lines)), repeats / per_word,
        of["capitals"] / per_char, of["digits"] / per_char, of["marks"] / per_word, of["quotes"] / per_word,
        of["braces"] / per_word, len(index) / per_word, int(np.bincount(ids).max(initial=0)) / per_word if n else 0.0,
        n / max(1, len(lines)), sum(len(x) < 40 for x in lines) / max(1, len(lines)),
        int(tally[128:].sum()) / per_char, of["stops"] / per_word,
    ]
    return counts, features


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), forest: Forest | None = None
) -> DataFrame:
    """(doc_id, counts, features, score[, __0, __1, ...: the kept columns of docs]), one row per row of docs.

    score is the forest's, or 1 without one.
    """
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rest = [f"__{k}" for k in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py() or b"") for t in batch.column(1)]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
            values = np.array([x for _, x in found], dtype=float).reshape(-1, len(FEATURES))
            scores = np.ones(len(values)) if forest is None else forest.score(values)
            features = pa.array(list(values), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts.T), features, pa.array(scores), *batch.columns[2:]],
                ["doc_id", *COUNTS, "features", "score", *rest],
            )

    schema = [f"doc_id {kinds[id_col]}", *(f"{c} long" for c in COUNTS), "features array<double>", "score double"]
    schema += [f"{new} {kinds[c]}" for new, c in zip(rest, keep, strict=True)]
    picked = docs.select(
        name(id_col).alias("__id"),
        name(text_col).cast("binary").alias("__text"),
        *(name(c).alias(new) for new, c in zip(rest, keep, strict=True)),
    )
    return picked.mapInArrow(run, ", ".join(schema))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 5
) -> Forest | None:
    """Trees fitted on at most `sample` labelled documents, drawn by a seeded hash of the id.

    labels: (doc_id, quality 0 or 1); other columns, null labels and null ids are
    ignored, and of rows that share an id the one with the least text counts.
    None if no label or only one kind is there.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    known = known.agg(F.min("quality").cast("double").alias("y"))
    picked = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)  # so its broadcast is bounded
    texts = docs.select(name(id_col).alias("id"), name(text_col).alias("text")).join(F.broadcast(picked), "id")
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = measured(texts, "id", "text", keep=("y",)).toPandas().sort_values("doc_id", ignore_index=True)
    if rows["__0"].nunique() < 2:
        return None
    values = np.array(rows["features"].tolist(), dtype=float)
    return fit(values, rows["__0"].to_numpy(), np.array(list(FEATURES.values())))


def judged(stats: DataFrame, least: float = 0.5) -> DataFrame:
    """stats with base_failed and kept."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, score, kept), one row per row of docs.

    Base limits: fewer than 20 words, or over 30 % of the words in repeated
    windows of eight. Null and empty texts have no words and fail. Ids may be
    null or repeat; such rows are judged by their own text.
    """
    found = judged(measured(docs, id_col, text_col, forest=train(docs, labels, id_col, text_col)))
    return found.select("doc_id", *COUNTS, "base_failed", "score", "kept")


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality() keeps, with their columns as they are."""
    forest = train(docs, labels, id_col, text_col)
    found = judged(measured(docs, id_col, text_col, tuple(docs.columns), forest)).filter("kept")
    return found.select(*(F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)))
