"""Best-fit packing of tokenised documents by patterns fitted with non-negative least squares.

The lengths of all pieces make a histogram of at most `capacity` bins, which is
all that the driver sees. Patterns of a few coarse lengths that fill a sequence
are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded down, and what they leave over is packed best-fit,
longest first, into their gaps and new sequences. Both steps move whole runs of
equal lengths, so the plan's size depends on the capacity, not on the corpus.
Pieces then find their place by their rank among those of their length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import name, small_batches, written
from tessera.llm.recall import Recall

CACHE = 300_000  # words, and pieces, whose ids a worker remembers in each of two generations
PARTS = 64  # coarse lengths that the patterns are made of


# The vocabulary's pre-token pattern; every piece it cuts ends in a token with this suffix.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
ENDS = "</w>"

#: Parts the ids of words; no id has these bytes, nor do two in a row.
BETWEEN = b"\xff\xff\xff\xff"


class _WordIds:
    """Ids by space-delimited word, as little-endian bytes.

    The vocabulary drops white space and joins nothing across it, so a text's
    ids are its words' ids one after the other. New words are cut into lower-case
    pieces, and new pieces are encoded by the library many at a time; words with
    rarer characters or with special strings go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        ends = [(self.tokenizer.id_to_token(k) or "").endswith(ENDS) for k in range(size)]
        self.ends = np.array(ends)
        self.pattern = regex.compile(r"\n|" + PATTERN)
        self.words, self.parts = Recall(CACHE), Recall(CACHE)

    def _whole(self, some: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def of(self, texts: list[bytes]) -> list[bytes]:
        # ASCII letters are lower-cased by the library as well, but special strings only count as they are written
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        found = [list(map(self.words.get, words)) for words in split]
        # places of words that are not known yet, filled in once all of them are
        open_at = [[k for k, ids in enumerate(row) if ids is None] for row in found]
        asked = {words[k] for words, at in zip(split, open_at, strict=True) for k in at}
        if asked:
            known = self._words(asked)
            for words, row, at in zip(split, found, open_at, strict=True):
                for k in at:
                    row[k] = known[words[k]]
        return [b"".join(row) for row in found]

    def _words(self, asked: set[bytes]) -> dict[bytes, bytes]:
        known = {w: self.words.old[w] for w in self.words.old.keys() & asked}
        new = asked.difference(known)
        # two-byte characters up to U+024F are lower-cased here as by the library
        odd = [w for w in new if b"<|" in w or max(w) > 0xC9]
        known.update(zip(odd, self._whole([w.decode("utf-8", "replace") for w in odd]), strict=True))
        plain = list(new.difference(odd))
        if plain:
            text = unicodedata.normalize("NFC", b"\n".join(plain).decode()).lower()
            parts = self.pattern.findall(text)
            self._learn(set(parts))
            ids = b"".join(map(self.parts.__getitem__, parts))
            known.update(zip(plain, ids.split(BETWEEN), strict=True))
        self.words.keep(known)
        return known

    def _learn(self, parts: set[str]) -> None:
        new = list(self.parts.lacks(parts) - {"\n"})
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.nonzero(self.ends[ids])[0] + 1
            if len(last) == len(some):
                raw, stops = ids.tobytes(), (4 * last).tolist()
                self.parts.update((p, raw[i:j]) for p, i, j in zip(some, [0, *stops], stops, strict=False))
            else:
                self.parts.update(zip(some, self._whole(some), strict=True))
        self.parts["\n"] = BETWEEN


@cache
def _word_ids(path: str) -> _WordIds:
    """One for all tasks of a Python worker."""
    return _WordIds(path)


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): whole documents, and those over the capacity in pieces."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(vocabulary)
        for batch in batches:
            rows = []
            found = ids.of([t.as_py() or b"" for t in batch.column(1)])
            for doc, of_text in zip(batch.column(0).to_pylist(), found, strict=True):
                whole = of_text + tail
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column, kind)
                    for column, kind in zip(
                        zip(*rows, strict=True),
                        (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()),
                        strict=True,
                    )
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    picked = docs.select(name(id_col).alias("doc_id"), name(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def patterns(total: int, most: int) -> list[tuple[int, ...]]:
    """All ways to write total as a sum of at most `most` positive parts, largest first."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            found.append(head)
        elif len(head) < most:
            left = most - len(head)
            for part in range(min(rest, head[-1] if head else rest), (rest + left - 1) // left - 1, -1):
                extend((*head, part), rest - part)

    extend((), total)
    return found


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by an active set: columns enter one at a time while they reduce the residual."""
    gram, project = matrix.T @ matrix, matrix.T @ target
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(project).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(active, -np.inf, project - gram @ x)
        if not len(slope) or slope.max() <= tolerance:
            break
        active[np.argmax(slope)] = True
        while True:
            at = np.nonzero(active)[0]
            trial = np.zeros_like(x)
            trial[at] = np.linalg.lstsq(gram[np.ix_(at, at)], project[at], rcond=None)[0]
            if trial[at].min(initial=0) >= 0:
                x = trial
                break
            low = at[trial[at] < 0]
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            active &= x > tolerance * 1e-3
            x[~active] = 0
    return x


def plan(
    histogram: np.ndarray, capacity: int, parts: int = PARTS, most: int = 4
) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Sequences as (lengths, how many), histogram[n] pieces of n tokens placed once each; and the tokens that patterns placed.

    A pattern takes the longest lengths left in its coarse bins, and last the
    length that fills the rest or the nearest shorter one. Residual pieces join
    the fullest sequence that still has room for them.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    unit = max(1, -(-capacity // parts))
    top = -(-capacity // unit)
    coarse = np.zeros(top + 1)
    np.add.at(coarse, -(-np.arange(len(left)) // unit), left)
    shapes = [p for p in patterns(top, most) if all(coarse[k] for k in p[:-1])]
    groups: list[tuple[tuple[int, ...], int]] = []
    if shapes and left.sum():
        matrix = np.zeros((top + 1, len(shapes)))
        for j, shape in enumerate(shapes):
            for k in shape:
                matrix[k, j] += 1
        weight = np.sqrt(np.arange(top + 1))
        fitted = nnls(matrix * weight[:, None], coarse * weight)
        here = np.nonzero(left)[0]
        for j in sorted(np.nonzero(fitted >= 0.5)[0], key=lambda j: shapes[j], reverse=True):
            repeats = int(fitted[j] + 0.5)
            while repeats:
                taken: list[int] = []
                for at, k in enumerate(shapes[j]):
                    room = capacity - sum(taken)
                    high = room if at == len(shapes[j]) - 1 else min(k * unit, room)
                    n = bisect_left(here, high + 1) - 1
                    while n >= 0 and left[here[n]] <= taken.count(here[n]):
                        n -= 1
                    if n < 0 or here[n] <= (k - 1) * unit:
                        break
                    taken.append(int(here[n]))
                else:
                    times = min([repeats, *(int(left[n]) // taken.count(n) for n in set(taken))])
                    for n in taken:
                        left[n] -= times
                    groups.append((tuple(taken), times))
                    repeats -= times
                    here = np.nonzero(left)[0]
                    continue
                break
    by_patterns = sum(sum(lengths) * times for lengths, times in groups)
    # residuals, longest first, into the smallest gap that takes them
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def offer(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((lengths, times))

    for lengths, times in groups:
        offer(lengths, times)
    for n in np.nonzero(left)[0][::-1].tolist():
        rest = int(left[n])
        while rest:
            at = bisect_left(order, n)
            if at == len(order):
                per = capacity // n
                if rest >= per:
                    offer((n,) * per, rest // per)
                if rest % per:
                    offer((n,) * (rest % per), 1)
                break
            gap = order[at]
            lengths, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            # several of this length go into one gap at once when there are enough of them
            per = min(gap // n, max(1, rest // times))
            used = min(times, rest // per)
            offer((*lengths, *(n,) * per), used)
            if times > used:
                offer(lengths, times - used)
            rest -= per * used
    return [x for found in gaps.values() for x in found], by_patterns


def best_plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with the fewest sequences among those with patterns of up to two, three and four pieces; of equal ones that whose patterns place most."""
    plans = [plan(histogram, capacity, most=most) for most in (2, 3, 4)]
    return min(plans, key=lambda found: (sum(times for _, times in found[0]), -found[1]))[0]


def places(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered: where the pieces of each length go by rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack_pieces(cut: DataFrame, capacity: int) -> DataFrame:
    """cut (doc_id, piece, length, ...) with sequence_id and offset; cut must be a written table."""
    spark = cut.sparkSession
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in counts:
        histogram[row["length"]] = row["n"]
    where = places(best_plan(histogram, capacity))
    # ranks: numbered within (length, salt) and shifted by the salts before, so that no length meets in one task
    salts = max(8, int(histogram.sum()) // 2_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(inside)).join(shift, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("place") - 1 + F.col("shift")).alias("rank"))
    held = spark.sparkContext.broadcast(where)  # bounded by the capacity, see the module's docstring
    names = cut.columns
    length_at, rank_at = names.index("length"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            lengths = batch.column(length_at).to_numpy(zero_copy_only=False)
            ranks = batch.column(rank_at).to_numpy(zero_copy_only=False)
            low = np.searchsorted(table[:, 0], lengths, "left")
            high = np.searchsorted(table[:, 0], lengths, "right")
            while (wide := high - low > 1).any():  # bisect the ranks of each row's length
                mid = (low + high) // 2
                up = wide & (table[np.minimum(mid, len(table) - 1), 1] <= ranks)
                low, high = np.where(up, mid, low), np.where(wide & ~up, mid, high)
            hit = table[low]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:rank_at],
                    pa.array(hit[:, 2] + ranks - hit[:, 1], pa.int64()),
                    pa.array(hit[:, 3], pa.int64()),
                ],
                [*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{_ddl(cut)}, sequence_id long, offset long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece.

    A document is its ids and then end_id; only longer ones than the capacity
    are cut, into pieces of the capacity and a last one. Null and empty texts
    are pieces of one token. Ids may be null or repeat: every row is placed.
    ids holds little-endian unsigned 32-bit ids. vocabulary: path of a tokenizers
    .json file whose tokens never cross ASCII white space, the same on every executor.
    """
    cut = pieces(docs, vocabulary, id_col, text_col, capacity, end_id)
    return pack_pieces(written(cut if with_ids else cut.drop("ids"), "pieces"), capacity)
