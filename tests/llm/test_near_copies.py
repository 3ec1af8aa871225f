import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tessera.llm.near_copies import DIFFERS, MORE, one_of_similar, radius_of, shingle_set, spanning, wide_simhash

from .helpers import clashing, docs, records, sample_rows


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def plain_heads(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    heads = {}
    for k, (i, _, _) in enumerate(rows):
        order = (i is None, i if i is not None else 0)
        heads[top(k)] = min(order, heads.get(top(k), order))
    return sorted((None if none else i for none, i in heads.values()), key=repr)


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies():
    rng = random.Random(5)
    rows = sample_rows()
    for g in range(12):  # from J near 1 to below 0.8, with chains and a shared frequent passage
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 300))]
        for k in range(8):
            rows.append((1000 + 10 * g + k, edited(rng, words, rng.randint(0, max(1, len(words) // 35))), "n"))
    passage = " ".join(f"p{k}" for k in range(12))
    rows += [(2000 + k, passage + " " + " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 90))), "p") for k in range(60)]
    return rows


@pytest.mark.parametrize("bucket", [2048, 5])
def test_equals_brute_force(spark, bucket):
    rows = near_copies()
    kept = one_of_similar(clashing(docs(spark, rows)), bucket=bucket)
    assert [r[0] for r in records(kept, "doc_id")] == plain_heads(rows)
    assert kept.columns == clashing(docs(spark, rows)).columns


def test_stage_drops_copies_with_an_edited_word(spark):
    words = [f"word{k}" for k in range(100)]
    rows = [(k, edited(random.Random(k), words, 1), "s") for k in range(1, 6)] + [(9, "another text of its own", "s")]
    assert [r[0] for r in records(corpus_pipeline.near_dedup(spark, docs(spark, rows), ""), "doc_id")] == [1, 9]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=40))
def test_a_forest_connects_what_all_pairs_connect(pairs):
    i, j = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    kept = spanning(i, j, 12)

    def roots(at):
        root = list(range(12))
        joined = 0
        for a, b in zip(i[at].tolist(), j[at].tolist()):
            ra, rb = root[a], root[b]
            joined += ra != rb
            root = [ra if r == rb else r for r in root]
        return joined, {frozenset(x for x in range(12) if root[x] == r) for r in root}

    assert roots(kept) == (len(kept), roots(np.arange(len(i)))[1])


def over(n, limit):
    """The probability of more than `limit` heads in n throws, for each limit."""
    heads = np.array([math.comb(n, k) for k in range(n + 1)], dtype=float) / 2.0**n
    below = np.concatenate([[0.0], np.cumsum(heads)])
    return 1 - below[np.clip(np.floor(limit).astype(int) + 1, 0, n + 1)]


def test_radius_is_above_the_exact_probability():
    for a in [*range(1, 61), 100, 101, 150, 300]:
        for b in range(a, 5 * a // 4 + 1):
            common = -(-8 * (a + b) // 18)  # the least that is similar enough
            x = np.arange(common + 1)
            heads = np.array([math.comb(common, k) for k in x], dtype=float) / 2.0**common
            one, two = over(a - common, a / 2 - x), over(b - common, b / 2 - x)
            p = float((heads * (one * (1 - two) + two * (1 - one))).sum())
            assert p <= DIFFERS + MORE / a, (a, b)


def test_radius_holds_what_is_similar():
    rng = random.Random(8)
    beyond = 0
    for k in range(1200):
        n = 1 + k % 60 if k < 900 else rng.randint(61, 300)
        both = rng.sample(range(2**62), n)
        swapped = n // 9 if k % 2 else rng.randint(0, n // 3)
        other = both[swapped:] + rng.sample(range(2**62), swapped)
        a, b = (np.sort(np.array(x, dtype="<i8")) for x in (both, other))
        bits = sum((x ^ y).bit_count() for x, y in zip(wide_simhash(a), wide_simhash(b), strict=True))
        similar = 10 * (n - swapped) >= 8 * (n + swapped)
        beyond += similar and bits > radius_of(n)
    assert beyond == 0
    assert wide_simhash(shingle_set(None)) == bytes(256)


def test_short_texts_meet(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):  # 4 and 5 shingles, a similarity of 0.8
        words = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * k, " ".join(words[:8]), "s"), (2 * k + 1, " ".join(words), "s")]
    assert [r[0] for r in records(one_of_similar(docs(spark, rows)), "doc_id")] == sorted(range(0, 400, 2), key=repr)
    small = [(k, " ".join(f"x{c}" for c in range(k % 12)), "s") for k in range(40)]
    assert [r[0] for r in records(one_of_similar(docs(spark, small)), "doc_id")] == plain_heads(small)


def test_rows_of_one_id_and_text(spark):
    text = "the very same words stand here in each of these rows"
    rows = [(1, text, "b"), (1, text, "a"), (2, text, "c"), (None, text, "d"), (None, "nobody else has these words at all", "x"), (None, "nobody else has these words at all", "y"), (7, None, "z"), (7, "", "z")]
    found = [records(one_of_similar(clashing(docs(spark, part))), "doc_id", "text", "source") for part in (rows, rows[::-1])]
    assert found[0] == found[1] and [(r[0], r[1]) for r in found[0]] == sorted([(1, text), (7, None), (None, rows[4][1])], key=repr)


def test_empty_table(spark):
    assert one_of_similar(docs(spark, [])).count() == 0
