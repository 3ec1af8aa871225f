"""Token counts of a byte-level BPE by heap-and-linked-list merging, no ids emitted.

A text is cut at special strings and then into pre-tokens as the vocabulary's
library does; in each pre-token the adjacent pair of lowest rank is merged until
none is left. Its count is its initial symbols minus the merges made.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import name, small_batches
from tessera.llm.recall import Recall

CACHE = 300_000  # words, and pre-tokens, whose counts a worker remembers in each of two generations

# Unicode White_Space, which the pre-tokenizer's \s stands for, and its pattern.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Cuts that the pattern makes too: no pre-token crosses them.
WORDS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


def merged_count(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when the lowest-rank adjacent pair is merged again and again.

    Of equal ranks the leftmost goes first. O(n log n) for n symbols.
    """
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    symbols = list(symbols)
    while heap:
        r, i = heappop(heap)
        if not symbols[i] or (j := after[i]) >= n or rank.get((symbols[i], symbols[j])) != r:
            continue  # an end of this pair has been merged since
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := rank.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r, i))
        if (k := before[i]) >= 0 and (r := rank.get((symbols[k], symbols[i]))) is not None:
            heappush(heap, (r, k))
    return left


class _Merger(Recall):
    """Counts by pre-token."""

    def __init__(self, rank: dict[tuple[str, str], int]):
        super().__init__(CACHE)
        self.rank, self.symbol = rank, byte_symbols()

    def work(self, piece: str) -> int:
        return merged_count([self.symbol[b] for b in piece.encode()], self.rank)


class _Counts(Recall):
    """Counts by word: a word's pre-tokens, each counted once while it is remembered."""

    def __init__(self, path: str):
        super().__init__(CACHE)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"])
        self.pieces = _Merger({pair: k for k, pair in enumerate(pairs)})
        special = sorted((t["content"] for t in model["added_tokens"] if t["content"]), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.pattern = regex.compile(PATTERN)

    def work(self, word: str) -> int:
        return sum(map(self.pieces.__getitem__, self.pattern.findall(word)))

    def of(self, text: str) -> int:
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, WORDS.findall(part))) for part in parts)


@cache
def _counts(path: str) -> _Counts:
    """One for all tasks of a Python worker."""
    return _Counts(path)


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs, in one pass and without a shuffle.

    vocabulary: path of a tokenizers .json file with a byte-level BPE, the same
    on every executor. Strings of its added tokens count one token each.
    A null text counts as empty: no bytes, no tokens. Ids may be null or repeat.
    """
    small_batches(docs.sparkSession)
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(vocabulary)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            found = [counts.of(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(found, pa.int64()),
                    pa.array([n > limit for n in found], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(name(id_col).alias("doc_id"), name(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")
