import numpy as np
import pytest

from tessera.operators import metric, reduce, text

SCHEMA = "id long, v array<double>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def groups(seed, n=12, size=25, dims=6, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dims)) * 3
    return np.concatenate([c + rng.normal(0, spread, (size, dims)) for c in centres])


def plain_nearest(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) + np.diag([np.inf] * len(x))
    return np.sort(d, axis=1)[:, :k]


def lists(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["i"], []).append((r["rank"], r["d"], r["j"]))
    return {i: sorted(v) for i, v in got.items()}


@pytest.mark.parametrize(("x", "block"), [(groups(1), 20), (np.random.default_rng(2).normal(size=(200, 12)), 30), (groups(3, 3, 60), 7)])
def test_neighbours_are_exact(spark, x, block):
    got = lists(metric.nearest(table(spark, x), 6, block))
    want = plain_nearest(x, 6)
    assert set(got) == set(range(len(x)))
    for i, near in got.items():
        assert [r for r, _, _ in near] == [1, 2, 3, 4, 5, 6] and i not in {j for _, _, j in near}
        assert np.allclose([d for _, d, _ in near], want[i], atol=1e-6)
        assert np.allclose([np.linalg.norm(x[i] - x[j]) for _, _, j in near], want[i], atol=1e-6)


def test_fewer_vectors_than_neighbours(spark):
    assert lists(metric.nearest(table(spark, np.array([[0.0], [1.0], [5.0]])), 10))[0] == [(1, 1.0, 1), (2, 5.0, 2)]
    assert metric.nearest(table(spark, np.empty((0, 2))), 3).count() == 0
    same = lists(metric.nearest(table(spark, np.zeros((9, 2))), 2, 3))
    assert {i: [j for _, _, j in v] for i, v in same.items()} == {i: [j for j in range(9) if j != i][:2] for i in range(9)}


def test_descent_finds_most_and_measures_it(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(600, 16))
    df = table(spark, x)
    found = metric.descended(df, 8, block=64)
    want = plain_nearest(x, 8)
    got = lists(found)
    recall = np.mean([np.mean([d <= want[i][-1] + 1e-9 for _, d, _ in near]) for i, near in got.items()])
    assert recall >= 0.9 and all(len(v) == 8 for v in got.values())
    assert abs(metric.measured(df, found, 8, 600) - recall) < 1e-9
    # lists that are too poor are not given out
    monkeypatch.setattr(metric, "measured", lambda *a, **b: 0.2)
    exact = lists(metric.descended(df, 8, block=64, rounds=0))
    assert all(np.allclose([d for _, d, _ in near], want[i], atol=1e-6) for i, near in exact.items())


def plain_cosines(x, least):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if c[i, j] >= least - 1e-12}


@pytest.mark.parametrize("least", [0.99, 0.7, 0.0, -0.5])
def test_cosine_pairs_are_whole(spark, least):
    x = np.concatenate([groups(7), np.zeros((2, 6)), groups(7)[:3] * 5])
    found = [tuple(r) for r in text.cosine_pairs(table(spark, x), least, 25).select("i", "j").collect()]
    assert len(found) == len(set(found)) and set(found) == plain_cosines(x, least)


def test_blocks_that_are_too_far_are_never_paired(spark):
    x = groups(8, 20, 40, 8)
    placed = metric.cells(table(spark, x), 30, angular=True)
    _, compared, every = metric.pairs_of_blocks(placed, np.arccos(0.98), 30)
    assert compared < every / 3
    assert metric.block_pairs(placed, np.arccos(0.98), 30).count() == compared
    _, compared, every = metric.pairs_of_blocks(placed, np.inf, 30)
    assert compared == every


def test_vectors_meet_others_without_a_shuffle(spark):
    x = np.random.default_rng(11).normal(size=(120, 12))
    placed = metric.cells(table(spark, x), 10)
    blocks = metric.packed(placed, 10)
    seen = metric.block_met(blocks, np.ones((len(placed.sizes),) * 2, dtype=bool))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange hashpartitioning" not in plan
    pairs = [tuple(sorted((r["lk"], r["rk"]))) for r in seen.select("lk", "rk").collect()]
    n = blocks.count()
    assert len(pairs) == len(set(pairs)) == n * (n + 1) // 2
    assert blocks.selectExpr("sum(size(ids))", "sum(length(x))").first()[:] == (120, 120 * 12 * 8)


def test_ties_go_to_the_lesser_id_across_blocks(spark):
    x = np.repeat(np.random.default_rng(12).normal(size=(10, 3)) + 1e3, 12, axis=0)  # ten vectors, twelve times each
    got = lists(metric.nearest(table(spark, x), 5, 9))
    for i, near in got.items():
        same = [j for j in range(i // 12 * 12, i // 12 * 12 + 12) if j != i]
        assert [(d, j) for _, d, j in near] == [(0.0, j) for j in same[:5]]


@pytest.mark.parametrize("angular", [False, True])
def test_what_is_known_of_cells(spark, monkeypatch, angular):
    seen, kept = {}, metric.written
    monkeypatch.setattr(metric, "written", lambda df, what: kept(seen.setdefault(what, df), what))
    x = groups(14, 9, 30, 5)
    placed = metric.cells(table(spark, x), 30, angular)
    u = metric.unit(x) if angular else x
    far = metric.distances(u, placed.pivots, angular)
    own = far.argmin(axis=1)
    for c in range(len(placed.pivots)):
        of = own == c
        assert placed.sizes[c] == of.sum()
        if of.any():
            assert np.isclose(placed.radius[c], far[of, c].max(), atol=1e-7)
            assert np.allclose(placed.low[c], far[of].min(axis=0), atol=1e-7) and np.allclose(placed.high[c], far[of].max(axis=0), atol=1e-7)
    metric.packed(placed, 30)
    assert set(seen["cells"].columns) == {"id", "v", "cell", "own"}  # no distances to other pivots
    assert seen["blocks"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # vectors are shuffled once


def test_cells_of_some_are_compared_with_those_of_all(spark):
    x = groups(15, 10, 30, 8)
    placed = metric.cells(table(spark, x), 30, angular=True)
    some = metric.cells(table(spark, x[::7], 1000), 10, angular=True, references=placed.pivots)
    apart, u = some.apart(placed), metric.unit(x)
    angle = metric.distances(u[::7], u, True)
    left, right = (metric.distances(z, c.pivots, True).argmin(axis=1) for z, c in ((u[::7], some), (u, placed)))
    assert (apart[left][:, right] <= angle + 1e-9).all() and (apart > 0.5).any()


def plain_last(rows, least):
    ids = [r[0] for r in rows]
    u = metric.unit(np.array([r[1] for r in rows], dtype=float))
    near = u @ u.T >= least - 1e-12
    found = {}
    for j, label in enumerate(ids):
        before = [i for k, i in enumerate(ids) if near[j, k] and label is not None and i is not None and i < label]
        if before:
            found[label] = max([found[label], *before] if label in found else before)
    return found


@pytest.mark.parametrize("held", [64 << 20, 2000])  # with 2000 bytes a task looks back on one or two blocks only
@pytest.mark.parametrize("least", [0.999, 0.7, 0.0, -0.5])
def test_the_last_like_one_is_exact(spark, monkeypatch, least, held):
    monkeypatch.setattr(text, "HELD", held)
    x = np.concatenate([groups(7), np.zeros((2, 6)), groups(7)[:40] * 5, np.random.default_rng(3).normal(size=(150, 6))])
    order = np.random.default_rng(4).permutation(len(x))
    rows = [(int(k) * 3, v.tolist()) for k, v in zip(order, x, strict=True)]
    rows += [(rows[5][0], rows[9][1]), (None, rows[0][1])]  # an id twice, no id
    found = {r["label"]: r["to"] for r in text.last_like(spark.createDataFrame(rows, SCHEMA), least, 10).collect()}
    assert found == plain_last(rows, least)


def test_the_last_like_one_by_strings(spark):
    rows = [(f"k{k}", v.tolist()) for k, v in enumerate(groups(16, 6, 40))]
    found = {r["label"]: r["to"] for r in text.last_like(spark.createDataFrame(rows, "id string, v array<double>"), 0.99, 8).collect()}
    assert found == plain_last(rows, 0.99)


def test_layouts_have_any_number_of_components(spark):
    x = groups(9, 4, 20, 5, 0.3)
    df = table(spark, x)
    for n in (1, 3):
        found = {r["id"]: np.array(r["reduced"]) for r in reduce.reduce_dimensions(df, n_components=n, n_neighbors=6, epochs=2).collect()}
        assert {len(v) for v in found.values()} == {n} and len(found) == len(x)
    with pytest.raises(ValueError):
        reduce.reduce_dimensions(df, n_components=6)
