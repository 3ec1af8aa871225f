import math
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog
from tessera.llm.resampling import gains, resample, run_buckets

from .helpers import clashing, docs, records, sample_rows


def plain_runs(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(rows, targets, percent=5):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) by the definition."""
    def counts(texts):
        found = [0] * 10_000
        for t in texts:
            for b in plain_runs(t)[1]:
                found[b] += 1
        return found

    s, t = counts([r[1] for r in rows]), counts(targets)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    found = []
    for i, text in rows:
        words, buckets = plain_runs(text)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        found.append((len(words), i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in found if x[0] >= 20), key=lambda x: (-x[4], x[1] is None, x[1] or 0))
    drawn = [x[1:] for x in able[: percent * len(able) // 100]]
    left = [x[1:] for x in found]
    for x in drawn:
        left.remove(x)
    return sorted([(*x, k) for k, x in enumerate(drawn, 1)] + [(*x, None) for x in left], key=repr)


TARGETS = ["what the bench asks for, in words", "MIXED case and Ünïcödé 42", None, "", "what the bench asks for, in words"]
COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAzZ09 \n\t-_~\x7f\x85\xa0éß漢İ", max_size=60))
def test_runs(text):
    words, buckets = run_buckets(text.encode())
    want_words, want = plain_runs(text)
    assert words == len(want_words) and sorted(buckets.tolist()) == sorted(want)


def test_equals_brute_force(spark):
    rows = sample_rows(120)
    rows += [(200 + k, "what the bench asks for " * 6 + f"number {k}", "s") for k in range(30)] + [(300 + k, rows[4][1], "s") for k in range(200)]
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TARGETS)], "item_id long, text string, copies string")
    found = resample(clashing(docs(spark, rows)), clashing(benchmark))
    assert found.columns == list(COLUMNS)
    assert records(found, *COLUMNS) == plain([r[:2] for r in rows], TARGETS)
    assert records(found, *COLUMNS) == records(resample(docs(spark, rows[::-1]), benchmark), *COLUMNS)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    assert records(catalog.op11_resampling(spark, folder), *COLUMNS) == plain(rows, targets)


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_shares(spark, percent):
    rows = sample_rows()
    found = resample(docs(spark, rows), spark.createDataFrame([("a b c",)], "text string"), percent=percent)
    assert records(found, *COLUMNS) == plain([r[:2] for r in rows], ["a b c"], percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(docs(spark, []), none).count() == 0
    rows = sample_rows(30)
    assert records(resample(docs(spark, rows), none), *COLUMNS) == plain([r[:2] for r in rows], [])
    blank = [(1, None, "s"), (2, "", "s"), (3, " \n-- ", "s")]
    assert [r[1:3] + r[4:] for r in records(resample(docs(spark, blank), none), *COLUMNS)] == [(0, 0, None)] * 3


def test_target_texts_are_drawn_first(spark):
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 90}" for j in range(40)), "s") for k in range(100)]
    rows += [(100 + k, " ".join(f"t{(k * 5 + j * j) % 60}" for j in range(40)), "s") for k in range(5)]
    target = spark.createDataFrame([(" ".join(f"t{j % 60}" for j in range(k, k + 50)),) for k in range(20)], "text string")
    assert {r[0] for r in records(resample(docs(spark, rows), target).filter("rank IS NOT NULL"), "doc_id")} == set(range(100, 105))


def test_gains_are_smoothed():
    zero = np.zeros(4, dtype=np.int64)
    assert gains(zero, zero).tolist() == [0] * 4
    assert gains(np.array([3, 1, 0, 0]), np.array([0, 0, 3, 1])).tolist() == [math.floor(1000 * math.log(x)) for x in (0.25, 0.5, 4.0, 2.0)]
