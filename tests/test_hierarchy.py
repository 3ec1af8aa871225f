import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, hierarchy, metric


def plain_density(x, least, k):
    """Labels by the definition, from the top down: cut at each weight, split, compare."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d + np.diag([-1.0] * n), axis=1)[:, min(k, n - 1)]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])

    def parts(members, limit):
        left, found = set(members), []
        while left:
            todo, seen = [left.pop()], []
            while todo:
                i = todo.pop()
                seen.append(i)
                near = [j for j in left if w[i, j] < limit]
                left.difference_update(near)
                todo += near
            found.append(sorted(seen))
        return found

    def solve(members, born):
        """(worth, clusters chosen within or as members, own worth) of a cluster born at density `born`."""
        total, now = 0.0, members
        while True:
            inside = sorted({w[i, j] for i in now for j in now if i < j}, reverse=True)
            for limit in inside:
                split = parts(now, limit)
                if len(split) > 1:
                    break
            density = 1 / max(limit, 1e-12)
            big = [p for p in split if len(p) >= least]
            total += sum(len(p) for p in split if len(p) < least) * (density - born)
            if len(big) == 1:
                now = big[0]
                continue
            if not big:
                return total, [members]
            total += sum(map(len, big)) * (density - born)
            inner = [solve(p, density) for p in big]
            below = sum(v for v, _ in inner)
            return (total, [members]) if total >= below else (below, [c for _, cs in inner for c in cs])

    now = list(range(n))
    labels = [-1] * n
    while len(now) >= least:  # the root is never a cluster: go to its first split
        inside = sorted({w[i, j] for i in now for j in now if i < j}, reverse=True)
        split = next(p for p in (parts(now, limit) for limit in inside) if len(p) > 1)
        big = [p for p in split if len(p) >= least]
        if len(big) == 1:
            now = big[0]
            continue
        if big:
            density = 1 / next(limit for limit in inside if len(parts(now, limit)) > 1)
            chosen = [c for p in big for c in solve(p, density)[1]]
            for number, members in enumerate(sorted(chosen, key=min)):
                for i in members:
                    labels[i] = number
        break
    return labels


def clouds(seed):
    """Nested clusters of unlike densities, a bridge and far outliers."""
    rng = np.random.default_rng(seed)
    parts = [
        rng.normal([0, 0], 0.1, (18, 2)), rng.normal([1.2, 0], 0.1, (14, 2)),  # two dense ones within a loose one
        rng.normal([0.6, 0.5], 1.0, (16, 2)), rng.normal([12, 3], 1.5, (20, 2)), rng.normal([11, -9], 0.3, (12, 2)),
        np.array([[60.0, 60.0], [-90.0, 4.0], [5.0, 1e4]]),
    ]
    return np.concatenate(parts)


@pytest.mark.parametrize(("seed", "least", "k", "chunk"), [(1, 8, 8, 50_000), (2, 5, 3, 7), (3, 10, 4, 30)])
def test_labels_equal_the_definition(spark, monkeypatch, seed, least, k, chunk):
    monkeypatch.setattr(hierarchy.merged, "__defaults__", (chunk,))
    x = clouds(seed)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = {r["id"]: r["label"] for r in cluster.density(df, least, k).collect()}
    want = plain_density(x, least, k)
    assert [found[i] for i in range(len(x))] == want and len(set(want)) > 2


@pytest.mark.parametrize("block", [1000, 9])
def test_trees_hold_a_least_tree(spark, block):
    x = clouds(4)
    df = spark.createDataFrame([(i, v.tolist(), 0.3) for i, v in enumerate(x)], "id long, v array<double>, core double")
    edges = sorted((r["w"], r["a"], r["b"]) for r in hierarchy.tree_edges(df, block).collect())
    root = list(range(len(x)))
    total = 0.0
    for w, a, b in edges:
        if root[a] != root[b]:
            total += w
            root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root)) == 1
    assert np.isclose(total, hierarchy.least_tree(x, np.full(len(x), 0.3))[2].sum())


def test_little_and_repeated_data(spark):
    schema = "id long, v array<double>"
    assert cluster.density(spark.createDataFrame([], schema), 5).count() == 0
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, None)], schema)
    assert {(r[0], r[1]) for r in cluster.density(few, 5).collect()} == {(1, -1), (2, -1), (3, -1)}
    same = [(k, [float(k % 2), 0.0]) for k in range(30)]  # two points, fifteen times each
    found = {r[0]: r[1] for r in cluster.density(spark.createDataFrame(same, schema), 5).collect()}
    assert found == {k: k % 2 for k in range(30)}


def test_trees_are_no_more_edges_than_points(spark):
    x = np.random.default_rng(6).normal(size=(90, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = metric.nearest(df, 4, 20)
    points = df.join(near.groupBy(near["i"].alias("id")).agg(F.max("d").alias("core")), "id")
    core = {r["id"]: r["core"] for r in points.collect()}
    total = hierarchy.least_tree(x, np.array([core[i] for i in range(90)]))[2].sum()
    edges = hierarchy.tree_edges(points.withColumn("core", F.lit(0.0)), 9).collect()
    assert len(edges) == 89 and np.isclose(sum(r["w"] for r in edges), hierarchy.least_tree(x, np.zeros(90))[2].sum())
    root, found = list(range(90)), 0.0  # equal weights may give an edge more
    for w, a, b in sorted((r["w"], r["a"], r["b"]) for r in hierarchy.tree_edges(points, 9, near).collect()):
        if root[a] != root[b]:
            found, root = found + w, [root[a] if r == root[b] else r for r in root]
    assert np.isclose(found, total)
