import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import boosting, model


def rows(n, seed, noise=0.1):
    """Three classes by two of four features, with noise."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, c, n) for c in (4, 3, 5, 2)], axis=1)
    y = np.where(x[:, 0] >= 2, 0, np.where(x[:, 1] == 1, 1, 2))
    y = np.where(rng.random(n) < noise, rng.integers(0, 3, n), y)
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<int>, y int")


def plain_tree(x, g, h, depth, codes, penalty=1.0, least=1.0):
    """Leaf values of a tree by trying every split of every node."""
    value = np.full(len(x), -0.3 * g.sum() / (h.sum() + penalty))
    if not depth:
        return value
    best = (1e-6, None)
    for f, size in enumerate(codes):
        for s in range(size - 1):
            left = x[:, f] <= s
            if h[left].sum() < least or h[~left].sum() < least:
                continue
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + penalty) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + penalty)
            if round(gain, 9) > best[0]:
                best = (round(gain, 9), left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            value[side] = plain_tree(x[side], g[side], h[side], depth - 1, codes, penalty, least)
    return value


def test_trees_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y = rows(300, 1)
    codes = [4, 3, 5, 2]
    found = boosting.fit(table(spark, x, y), 3, codes, rounds=3, depth=3)
    scores = np.zeros((len(x), 3))
    for _ in range(3):
        g, h = boosting.slopes(scores, y)
        scores = scores + np.stack([plain_tree(x, g[:, k], h[:, k], 3, codes) for k in range(3)], axis=1)
    assert np.allclose(found.scores(x), scores, atol=1e-9)
    gains = found.mean_gains(4)
    assert min(gains[:2]) > 5 * max(gains[2:])


def test_held_out_accuracy_is_that_of_one_against_the_rest_or_more(spark):
    x, y = rows(600, 2, 0.2)
    u, v = rows(300, 3, 0.0)
    mine = boosting.predict(table(spark, u, v), boosting.fit(table(spark, x, y), 3, [4, 3, 5, 2], rounds=8, depth=3))
    right = np.mean([r["prediction"] == r["y"] for r in mine.collect()])
    vector = lambda df: df.select(array_to_vector(F.transform("x", lambda c: c.cast("double"))).alias("v"), "y")
    other = OneVsRest(classifier=GBTClassifier(maxDepth=3, maxIter=8, stepSize=0.3), featuresCol="v", labelCol="y").fit(vector(table(spark, x, y)))
    theirs = np.mean([r["prediction"] == r["y"] for r in other.transform(vector(table(spark, u, v))).collect()])
    assert right >= theirs and right > 0.95


def test_one_class_and_no_rows(spark):
    x, _ = rows(20, 4)
    found = boosting.fit(table(spark, x, np.zeros(20, dtype=int)), 1, [4, 3, 5, 2], rounds=2)
    assert {r["prediction"] for r in boosting.predict(table(spark, x, np.zeros(20)), found).collect()} == {0.0} and not found.gains
    assert boosting.fit(table(spark, x[:0], []), 2, [4, 3, 5, 2], rounds=1).scores(x).tolist() == [[0.0, 0.0]] * 20


def test_model_by_names(spark):
    data = [(k, "ab"[k % 2], "xyz"[k % 3], "pq"[(k // 2) % 2], "ab"[k % 2] + ("!" if k % 3 == 0 else "")) for k in range(300)]
    df = spark.createDataFrame(data, "k long, a string, b string, c string, y string")
    found = model.train(df, "y", ["a", "b", "c"], "k", model="boosted", rounds=5, depth=3)
    assert found.accuracy == 1.0 and [r["feature"] for r in found.importance.collect()][2] == "c"
    with pytest.raises(ValueError):
        model.train(df, "y", ["a"], "k", model="other")
