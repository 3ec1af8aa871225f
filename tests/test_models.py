import numpy as np
import pytest

from tessera.operators import chart, cluster, model, reduce


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(0, 0.3, 3) + 10 * np.eye(3)[k % 3]).tolist()) for k in range(60)]
    rows += [(100, [60.0, 60.0, 0.0]), (101, [-70.0, 0.0, 30.0]), (102, [0.0, -90.0, 50.0])]
    return spark.createDataFrame(rows, "id long, v array<double>")


def groups(found):
    by = {}
    for r in found.collect():
        by.setdefault(r["label"], set()).add(r["id"])
    return by


WANT = [{k for k in range(60) if k % 3 == c} for c in range(3)]


def test_density_finds_blobs_and_noise(blobs):
    found = groups(cluster.density(blobs, 8))
    assert found.pop(-1) == {100, 101, 102}
    assert sorted(found.values(), key=min) == WANT
    assert groups(cluster.cluster(blobs.orderBy("v"), min_cluster_size=8))[-1] == {100, 101, 102}


def test_kmeans(blobs):
    found = groups(cluster.kmeans(blobs.filter("id < 100"), 3))
    assert sorted(found.values(), key=min) == WANT
    with pytest.raises(ValueError):
        cluster.cluster(blobs, "other")


def test_neighbours_are_exact(blobs):
    rows = {r["id"]: np.array(r["v"]) for r in blobs.collect()}
    got = {}
    for r in reduce.neighbours(blobs, 4, block=20).collect():
        got.setdefault(r["i"], []).append((r["d"], r["j"]))
    for i, near in got.items():
        want = sorted((np.linalg.norm(rows[i] - v), j) for j, v in rows.items() if j != i)[:4]
        assert np.allclose([d for d, _ in sorted(near)], [d for d, _ in want], atol=1e-5)


def test_components(blobs):
    found = {r["id"]: r["reduced"] for r in reduce.pca(blobs, 2).collect()}
    x = np.array([r["v"] for r in blobs.collect()])
    _, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array(list(found.values()))
    assert np.allclose(np.linalg.norm(got, axis=0), s[:2]) and np.allclose(got.mean(0), 0, atol=1e-9)
    with pytest.raises(ValueError):
        reduce.reduce_dimensions(blobs, "other")


def test_layout_keeps_neighbours_together(blobs):
    found = {r["id"]: np.array(r["reduced"]) for r in reduce.layout(blobs.filter("id < 100"), 8, epochs=6).collect()}
    centres = [np.mean([found[k] for k in group], axis=0) for group in WANT]
    near = [np.argmin([np.linalg.norm(found[k] - c) for c in centres]) == k % 3 for k in found]
    assert np.mean(near) > 0.95


def test_importance_finds_the_cause(spark):
    rows = [(k, "ab"[k % 2], "xyz"[k % 3], "pq"[(k // 2) % 2]) for k in range(300)]
    df = spark.createDataFrame([(k, a, b, c, a + ("!" if b == "x" else "")) for k, a, b, c in rows], "k long, a string, b string, c string, y string")
    found = model.train(df, "y", ["a", "b", "c"], "k")
    assert found.accuracy == 1.0 and found.importance.collect()[-1]["feature"] == "c"
    tables = found.tables(df)
    assert tables["test"].first()["p_value"] < 1e-6 and tables["confusion"].count() == 4
    every = model.each_target(df, ["a", "c"], "k")
    assert [p.target for p in every] == ["a", "c"] and all(p.error is None for p in every)
    with pytest.raises(ValueError):
        model.each_target(df, ["a"], "k")


def test_chart_tables(spark):
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.0, 3.0)], "row_id long, x double, y double")
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, term string")
    texts = spark.createDataFrame([(1, "s"), (2, "t")], "row_id long, text string")
    assert [tuple(r) for r in chart.scatter(points, labels, texts, 1).collect()] == [("a", 1, 0.0, 1.0, "s", 1)]
    matrix = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "a", 1.0)], "col_a string, col_b string, v double")
    assert chart.triangle(matrix).count() == 1 and chart.triangle(matrix, diagonal=True).count() == 2
    assert [chart.accuracy_band(x) for x in (0.9, 0.7, 0.1, None)] == ["good", "fair", "weak", "weak"]
