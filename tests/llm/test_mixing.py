import hashlib
import math
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tessera.llm.mixing import mix, mixed

from .helpers import clashing, docs, records, sample_rows


def plain_mix(rows, weights=(3, 1, 2), share=1.5, epochs=2.0, seed=17):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    clamped = set()
    while True:
        rest = share * sum(total.values()) - sum(epochs * total[s] for s in clamped)
        left = sum(weight[s] for s in order if s not in clamped)
        new = {s for s in order if s not in clamped and epochs * total[s] < rest * weight[s] / left}
        if not new:
            break
        clamped |= new
    target = {s: epochs * total[s] if s in clamped else rest * weight[s] / left for s in order}
    key = [hashlib.md5((f"{seed}:{i}" if i is not None else str(seed)).encode()).hexdigest() for i, _, _ in rows]
    out = []
    for (i, _, s), n, k in zip(rows, size, key):
        whole = int(target[s] // total[s]) if total[s] else 0
        need = math.floor(target[s] - whole * total[s])
        before = sum(m for (_, _, x), m, j in zip(rows, size, key) if x == s and j < k)
        same = sum(m for (_, _, x), m, j in zip(rows, size, key) if x == s and j == k)
        extra = n if before + same <= need else math.floor(n * (need - before) / same) if before < need else 0
        out.append((i, n, total[s], round(min(target[s], epochs * total[s]), 6), whole * n + extra))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = sample_rows(seed=seed)
    found = mixed(clashing(docs(spark, rows)).drop("size", "taken")).collect()
    got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in found), key=repr)
    assert got == plain_mix(rows)


def test_taken_words_meet_targets(spark):
    rows = [r for r in sample_rows(80) if r[0] is not None and r[0] != 5]
    found = [r.asDict() for r in mixed(docs(spark, rows)).collect()]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 1.001
        assert own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6


def test_rows_of_the_mix(spark):
    rows = [r for r in sample_rows(80) if r[0] is not None and r[0] != 5]
    df = docs(spark, rows)
    drawn = mix(df)
    assert drawn.columns == df.columns
    texts, words = defaultdict(list), defaultdict(int)
    for r in drawn.collect():
        texts[r["doc_id"]].append(r["text"])
        words[r["doc_id"]] += len((r["text"] or "").split())
    for r in mixed(df).collect():
        assert words[r["doc_id"]] == r["taken"]
        assert all(t is None or (r["text"] or "").startswith(t) for t in texts[r["doc_id"]])
    assert records(mix(df), "doc_id", "text") == records(drawn, "doc_id", "text")


def test_empty_table_and_sources_without_words(spark):
    assert mixed(docs(spark, [])).count() == 0
    rows = [(1, "", "a"), (2, None, "b"), (3, "some words here", "c")]
    assert records(mixed(docs(spark, rows)), "doc_id", "target", "taken") == [(1, 0.0, 0), (2, 0.0, 0), (3, 4.5, 4)]


def test_stage_takes_whole_documents(spark):
    rows = sample_rows(80) + [(None, f"null id number {k} " * 5, "src0") for k in range(60)] + [(300, "same row " * 4, "src1")] * 50
    df = docs(spark, rows)
    given = {(i, t) for i, t, _ in rows}
    drawn = records(corpus_pipeline.mix_sources(spark, df, ""), "doc_id", "text", "source")
    assert all((i, t) in given for i, t, _ in drawn)
    assert drawn == records(corpus_pipeline.mix_sources(spark, df, ""), "doc_id", "text", "source")
    for r in mixed(df).select("source", "source_size", "target").distinct().collect():
        largest = max(len((t or "").split()) for _, t, s in rows if s == r["source"])
        words = sum(len((t or "").split()) for _, t, s in drawn if s == r["source"])
        assert abs(words - r["target"]) <= largest / 2 + 1
    found = mixed(df, whole_documents=True).collect()
    assert len(found) == len(rows) and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in found)
