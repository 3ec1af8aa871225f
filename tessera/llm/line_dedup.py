"""Line dedup by pairwise alignment of overlapping documents.

Keys are the shortest runs of adjacent lines with enough words, from each line
on and up to each line; a long line is a run of its own. Any common block with
enough words has such a run around each of its lines. A run that several
documents share points from each later one to the first that has it, so a run in
n documents gives n - 1 pairs, rare or frequent alike, and none is dropped. Each
pair is aligned with patience diff; blocks of aligned lines with enough words are
deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import fresh, name, scratch, small_batches, written

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 8  # alignments of moved or repeated blocks; what is left after them is looked up exactly, run by run


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by their first number, whose second number rises."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back.append(last[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[at], last[at] = j, k
    found, k = [], last[-1] if last else -1
    while k >= 0:
        found.append(pairs[k])
        k = back[k]
    return found[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, both rising.

    Lines that occur once in each stretch anchor it by the longest rising
    sequence; equal lines next to an anchor or an end join it, and the stretches
    between are aligned in the same way. A stretch without such a line is
    anchored by the first, second, ... occurrences of its common lines.
    """
    found: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        low_a, high_a, low_b, high_b = work.pop()
        while low_a < high_a and low_b < high_b and a[low_a] == b[low_b]:
            found.append((low_a, low_b))
            low_a, low_b = low_a + 1, low_b + 1
        while low_a < high_a and low_b < high_b and a[high_a - 1] == b[high_b - 1]:
            high_a, high_b = high_a - 1, high_b - 1
            found.append((high_a, high_b))
        if low_a >= high_a or low_b >= high_b:
            continue
        in_a, in_b = Counter(a[low_a:high_a]), Counter(b[low_b:high_b])
        at = {b[j]: j for j in range(low_b, high_b) if in_b[b[j]] == 1}
        pairs = [(i, at[a[i]]) for i in range(low_a, high_a) if in_a[a[i]] == 1 and a[i] in at]
        if not pairs:
            seen: Counter = Counter()
            at = {}
            for j in range(low_b, high_b):
                seen[b[j]] += 1
                at[b[j], seen[b[j]]] = j
            seen = Counter()
            for i in range(low_a, high_a):
                seen[a[i]] += 1
                if (j := at.get((a[i], seen[a[i]]))) is not None:
                    pairs.append((i, j))
            found += _increasing(pairs)
            continue
        anchors = _increasing(pairs)
        found += anchors
        edges = [(low_a - 1, low_b - 1), *anchors, (high_a, high_b)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def shortest_runs(words: list[int], least: int) -> set[tuple[int, int]]:
    """Shortest stretches (start, end) of lines with `least` words, from each line with words on and up to each."""
    full = [(k, n) for k, n in enumerate(words) if n]
    found = set()
    end = total = 0
    for at, (start, n) in enumerate(full):  # from each line on
        while total < least and end < len(full):
            total += full[end][1]
            end += 1
        if total < least:
            break
        found.add((start, full[end - 1][0] + 1))
        total -= n
    at = total = 0
    for end, n in full:  # up to each line
        total += n
        while total - full[at][1] >= least:
            total -= full[at][1]
            at += 1
        if total >= least:
            found.add((full[at][0], end + 1))
    return found


def run_keys(hashes: list[int], words: list[int], least: int) -> list[int]:
    """Distinct keys of a document's shortest runs; that of a single line is its hash."""
    all_of = np.array(hashes, dtype="<i8")
    digest = lambda a, b: xxhash.xxh64_intdigest(all_of[a:b].tobytes()) - 2**63
    return list({hashes[a] if b == a + 1 else digest(a, b) for a, b in shortest_runs(words, least)})


def _common_runs(later: list, words: list[int], earlier: list, least: int) -> set[int]:
    """Positions of later's lines with words in runs of `least` words that earlier has too, wherever they stand."""
    known = dict(zip(later, words, strict=True))
    there, start = set(), 0
    for end in range(len(earlier) + 1):
        if end == len(earlier) or earlier[end] not in known:
            part = earlier[start:end]
            there.update(tuple(part[a:b]) for a, b in shortest_runs([known[x] for x in part], least))
            start = end + 1
    runs = (range(a, b) for a, b in shortest_runs(words, least) if tuple(later[a:b]) in there)
    return {i for run in runs for i in run}


def deleted(later: list, words: list[int], earlier: list, least: int) -> list[int]:
    """Positions of later's lines in aligned blocks of at least `least` words.

    Blocks that moved or repeat align in further passes, over the lines that
    are left; what the passes leave of the common lines is then looked up by its
    runs, so that every common block with enough words goes, however often it is there.
    """
    there, gone = set(earlier), set()
    rest = [i for i in range(len(later)) if later[i] in there]
    common = [i for i in rest if words[i]]
    for _ in range(PASSES):
        if not rest:
            break
        pairs = patience([later[i] for i in rest], earlier)
        block: list[tuple[int, int]] = []
        done = set()
        for i, j in [(rest[k], j) for k, j in pairs] + [(-9, -9)]:
            if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                if sum(words[x] for x, _ in block) >= least:
                    gone.update(x for x, _ in block)
                done.update(x for x, _ in block)
                block = []
            block.append((i, j))
        rest = [i for i in rest if i not in done]
    if not gone.issuperset(common):
        gone |= _common_runs(later, words, earlier, least)
    return sorted(gone)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """(id, version, gone): positions of the lines to delete, for documents that lose any."""
    small_batches(docs.sparkSession)
    text = F.coalesce(name(text_col), F.lit(""))
    lines = F.split(text, "\n")
    hashed = F.transform(lines, lambda x: F.xxhash64(x))
    checks = F.transform(lines, lambda x: F.xxhash64(F.lit(1), x))  # with the first, 128 bits
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD)).cast("int"))
    sequences = docs.select(
        name(id_col).alias("id"), F.xxhash64(text).alias("v"), hashed.alias("h"), checks.alias("c"), words.alias("n")
    )
    sequences = written(sequences, "sequences").dropDuplicates(["id", "v"])
    sequences = written(sequences, "versions")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "v")
    kind = sequences.schema["id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = (batch.column(k).to_pylist() for k in (2, 3))
            keys = [run_keys(x, y, least_words) for x, y in zip(h, n, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.list_(pa.int64()))], ["id", "v", "keys"])

    shared = sequences.select("id", "v", "h", "n").mapInArrow(keyed, f"id {kind}, v long, keys array<long>")
    shared = written(shared, "keys").select("id", "v", F.explode("keys").alias("h"))
    first = shared.groupBy("h").agg(F.min(order).alias("f"), F.count("*").alias("docs")).filter("docs > 1")
    first = written(first.select("h", F.col("f.id").alias("first_id"), F.col("f.v").alias("first_v")), "first")
    later = F.col("first_id").isNotNull() & (F.col("id").isNull() | (F.col("first_id") < F.col("id")))
    pairs = shared.join(first, "h").filter(later).select("id", "v", "first_id", "first_v").distinct()
    pairs = written(pairs, "pairs")
    right = sequences.select(
        F.col("id").alias("first_id"), F.col("v").alias("first_v"), F.col("h").alias("fh"), F.col("c").alias("fc")
    )
    left = sequences.select("id", "v", "h", "c", "n")
    joined = pairs.join(right, ["first_id", "first_v"]).alias("p").join(
        left.alias("s"), F.col("p.id").eqNullSafe(F.col("s.id")) & (F.col("p.v") == F.col("s.v"))
    )
    joined = joined.select("s.id", "s.v", "s.h", "s.c", "s.n", "p.fh", "p.fc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for h, c, n, fh, fc in zip(*(column.to_pylist() for column in batch.columns[2:]), strict=True):
                gone.append(deleted(list(zip(h, c, strict=True)), n, list(zip(fh, fc, strict=True)), least_words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(gone, pa.list_(pa.int32()))], ["id", "v", "gone"])

    found = joined.mapInArrow(run, f"id {kind}, v long, gone array<int>").filter(F.size("gone") > 0)
    return found.groupBy("id", "v").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, drop_emptied: bool = False
) -> DataFrame:
    """docs with the text less its deleted lines, and n_lines and n_deleted (replacing columns of these names).

    "Later" goes by id, null ids last; rows of one id are versions of one
    document, which lose nothing to each other and the same each if their texts
    are equal. Rows with null ids never lose to each other. Lines are parted by \\n
    and compared exactly, by 128 bits of hashes; blank lines and blocks of fewer
    than `least_words` words stay. A null text stays null and has one line.
    drop_emptied: leave out documents that lost lines and have no word left.
    """
    with scratch(docs.sparkSession) as keep:
        gone = keep(removals(docs, id_col, text_col, least_words), "removals")
    others = [c for c in docs.columns if c != text_col and c not in ("n_lines", "n_deleted")]
    lines, version, of_id, of_version, deleted_at = fresh(docs, "lines", "version", "of_id", "of_version", "gone")
    # the lines stand in for the text while rows are shuffled
    cut = docs.select(
        *map(name, others), F.split(name(text_col), "\n").alias(lines), F.xxhash64(F.coalesce(name(text_col), F.lit(""))).alias(version)
    )
    gone = gone.select(F.col("id").alias(of_id), F.col("v").alias(of_version), F.col("gone").alias(deleted_at))
    joined = cut.join(gone, name(id_col).eqNullSafe(F.col(of_id)) & (F.col(version) == F.col(of_version)), "left")
    size = F.when(F.col(lines).isNull(), 1).otherwise(F.size(lines))
    left = F.array_except(F.sequence(F.lit(0), size - 1), deleted_at)
    stays = F.when(F.col(deleted_at).isNull(), F.col(lines)).otherwise(F.transform(left, lambda k: F.get(lines, k)))
    text = F.array_join(stays, "\n")
    if drop_emptied:
        joined = joined.filter(F.col(deleted_at).isNull() | text.rlike(WORD))
    columns = [text.alias(c) if c == text_col else name(c) for c in docs.columns if c not in ("n_lines", "n_deleted")]
    n_deleted = F.when(F.col(deleted_at).isNull(), 0).otherwise(F.size(deleted_at))
    return joined.select(*columns, size.alias("n_lines"), n_deleted.alias("n_deleted"))
