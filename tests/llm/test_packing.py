import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import best_plan, nnls, pack, patterns, places, plan

from .helpers import clashing, docs, sample_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(histogram, capacity):
    placed = Counter()
    for lengths, times in best_plan(histogram, capacity):
        assert sum(lengths) <= capacity and times > 0
        for n in lengths:
            placed[n] += times
    assert placed == {n: c for n, c in enumerate(histogram.tolist()) if c and n}


@pytest.mark.parametrize("kind", ["log", "flat", "few", "large"])
def test_plan_places_all_in_few_sequences(kind):
    rng = np.random.default_rng(2)
    lengths = {
        "log": np.clip(rng.lognormal(6.5, 1, 5000).astype(int), 1, 4096), "flat": rng.integers(1, 4097, 3000),
        "few": np.array([4096, 1, 1, 4000, 96]), "large": rng.integers(1, 900, 10**6),
    }[kind]
    histogram = np.bincount(lengths, minlength=4097)
    check_plan(histogram, 4096)
    used, least = sum(t for _, t in best_plan(histogram, 4096)), -(-int(lengths.sum()) // 4096)
    assert used <= {"log": 1.01, "flat": 1.03, "few": 1.0, "large": 1.001}[kind] * least + 1


def test_patterns_place_most_tokens():
    rng = np.random.default_rng(4)
    histogram = np.bincount(np.clip(rng.lognormal(6, 1.2, 200_000).astype(int), 1, 4096), minlength=4097)
    tokens = int((histogram * np.arange(4097)).sum())
    least = -(-tokens // 4096)
    plans = [plan(histogram, 4096, most=most) for most in (2, 3, 4)]
    assert plans[2][1] > 0.7 * tokens and plans[1][1] > 0.5 * tokens
    assert sum(times for _, times in best_plan(histogram, 4096)) <= 1.001 * least


def test_small_parts():
    assert patterns(5, 2) == [(5,), (4, 1), (3, 2)]
    rng = np.random.default_rng(5)
    matrix = rng.random((8, 5))
    want = np.array([0.0, 2.0, 0.0, 1.5, 3.0])
    assert np.allclose(nnls(matrix, matrix @ want), want, atol=1e-6)
    assert best_plan(np.zeros(4097, dtype=int), 4096) == [] and places([]).shape == (0, 4)


def test_pieces_equal_the_library_and_fit(spark):
    rows = sample_rows() + [(500, "don't <|endoftext|> I'LL Σίσυφος İ x <|ENDOFTEXT|> E\u0301 É." * 3, "s"), (501, "<|EndOfText|> SHOUT!! <| A", "s")]
    found = [r.asDict() for r in pack(clashing(docs(spark, rows)), PATH).collect()]
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in found)
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= 4096


def test_empty_table(spark):
    assert pack(docs(spark, []), PATH).count() == 0
