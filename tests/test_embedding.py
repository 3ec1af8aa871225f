import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embedding


def texts():
    """Three topics with words of their own; each text has a copy with two words changed."""
    rng = random.Random(1)
    topics = [[f"{t}{k}" for k in range(25)] for t in ("sea", "hill", "town")]
    found = []
    for k in range(45):
        words = rng.choices(topics[k % 3], k=30) + rng.choices(["so", "than", "while"], k=5)
        rng.shuffle(words)
        copy = list(words)
        for at in rng.sample(range(35), 2):
            copy[at] = rng.choice(topics[k % 3])
        found += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return [*found, (200, None), (201, ""), (202, "unheard of")]


def vectors(df):
    return {r["id"]: np.array(r["v"]) for r in df.collect()}


def test_near_copies_are_nearer_than_others(spark):
    df = spark.createDataFrame(texts(), "id long, text string")
    found = vectors(embedding.trained_vectors(df, dims=8, vocabulary=70))
    again = vectors(embedding.trained_vectors(df.repartition(5).orderBy(F.desc("id")), dims=8, vocabulary=70))
    assert set(found) == {*range(90), 201, 202} and all(np.allclose(found[i], again[i], atol=1e-8) for i in found)
    assert not found[201].any() and not found[202].any()
    cos = lambda i, j: float(found[i] @ found[j])
    copies = [cos(2 * k, 2 * k + 1) for k in range(45)]
    same = [cos(2 * k, 2 * k + 6) for k in range(42)]
    other = [cos(2 * k, 2 * k + 2) for k in range(44)]
    assert min(copies) > 0.9 and np.mean(copies) > np.mean(same) > np.mean(other) + 0.3


def test_information_by_hand(spark):
    rows = [[0, 1, 2, 1], [2, 2, 0], [], [1]]
    numbers = spark.createDataFrame(list(enumerate(rows)), "id long, w array<int>")
    pairs = Counter()
    for w in rows:
        for i in range(len(w)):
            for j in range(i + 1, min(i + 3, len(w))):
                pairs[w[i], w[j]] += 1
                pairs[w[j], w[i]] += 1
    one = Counter()
    for (a, _), n in pairs.items():
        one[a] += n
    want = {(a, b): math.log(n * sum(one.values()) / (one[a] * one[b])) for (a, b), n in pairs.items()}
    found = {(r["a"], r["b"]): (r["n"], r["p"]) for r in embedding.mutual_information(numbers, 2).collect()}
    assert set(found) == {k for k, p in want.items() if p > 0}
    assert all(found[k][0] == pairs[k] and math.isclose(found[k][1], want[k]) for k in found)


def test_leading_directions(spark):
    rng = np.random.default_rng(2)
    half = rng.normal(size=(30, 4))
    m = half @ np.diag([9.0, -6.0, 4.0, 2.0]) @ half.T
    entries = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(30)], "a int, b int, p double")
    values, found = embedding.leading(entries, 30, 4)
    want = np.linalg.eigvalsh(m)
    assert np.allclose(sorted(values), sorted(want[np.argsort(-np.abs(want))[:4]]))
    assert np.allclose(m @ found, found * values, atol=1e-6)


def test_a_model_of_the_caller(spark):
    df = spark.createDataFrame([(k, "x" * k) for k in range(20)] + [(99, None)], "id long, text string")
    client = lambda: lambda batch: [[float(len(t)), float(len(batch) <= 4)] for t in batch]
    assert {k: v.tolist() for k, v in vectors(embedding.client_vectors(df, client, batch=4)).items()} == {k: [float(k), 1.0] for k in range(20)}


def test_no_words(spark):
    assert embedding.trained_vectors(spark.createDataFrame([], "id long, text string")).count() == 0
    found = vectors(embedding.trained_vectors(spark.createDataFrame([("a", "x y"), ("b", "?")], "id string, text string"), dims=3))
    assert {k: v.tolist() for k, v in found.items()} == {"a": [0.0] * 3, "b": [0.0] * 3}
