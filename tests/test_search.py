import numpy as np
import pytest

from tessera.operators import search


def table(spark, columns):
    rows = [(i, *(None if v is None else [float(c) for c in v] for v in row)) for i, row in enumerate(zip(*columns))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"v{k} array<double>" for k in range(len(columns))))


def plain(columns, queries, k, own=True):
    found = []
    for q, v in queries:
        scores = {}
        for column in columns:
            for i, u in enumerate(column):
                if u is not None and np.linalg.norm(u) and (own or i != q):
                    c = float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))
                    scores[i] = max(c, scores.get(i, -2))
        top = sorted(scores.items(), key=lambda t: (-round(t[1], 9), t[0]))[:k]
        found += [(q, i, round(c, 6), r) for r, (i, c) in enumerate(top, 1)]
    return found


def asked(spark, queries):
    return spark.createDataFrame([(q, [float(c) for c in v]) for q, v in queries], "query long, v array<double>")


def got(found):
    return [(r["query"], r["id"], round(r["cosine"], 6), r["rank"]) for r in found.orderBy("query", "rank").collect()]


@pytest.mark.parametrize("block", [1000, 20])
def test_exact_search_over_several_columns(spark, block):
    rng = np.random.default_rng(1)
    columns = [list(rng.normal(size=(150, 8))), list(rng.normal(size=(150, 8)))]
    columns[0][3] = columns[1][3] = np.zeros(8)
    columns[1][5] = None
    columns[0][7] = columns[0][6]
    queries = [(q, columns[0][q]) for q in (0, 6, 20)] + [(900, rng.normal(size=8))]
    index = search.index(table(spark, columns), "id", ["v0", "v1"], block)
    for own in (True, False):
        found = search.search(index, asked(spark, queries), 5, probes=2, others_only=not own)
        assert got(found) == plain(columns, queries, 5, own)
    assert set(r["column"] for r in found.collect()) == {"v0", "v1"}


def test_probes_alone_have_a_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 10)) * 2
    column = list(np.concatenate([c + rng.normal(0, 0.4, (40, 10)) for c in centres]))
    queries = [(q, column[q]) for q in range(0, 480, 40)]
    index = search.index(table(spark, [column]), "id", ["v0"], 40)
    found = {(q, i) for q, i, _, _ in got(search.search(index, asked(spark, queries), 10, probes=4, exact=False))}
    want = {(q, i) for q, i, _, _ in plain([column], queries, 10)}
    assert len(found & want) >= 0.9 * len(want)


def test_little_data(spark):
    index = search.index(table(spark, [[[1.0, 0.0], [0.0, 2.0]]]), "id", ["v0"])
    assert got(search.search(index, asked(spark, [(5, [3.0, 3.0]), (6, [0.0, 0.0])]), 9)) == [(5, 0, 0.707107, 1), (5, 1, 0.707107, 2)]
    none = search.index(table(spark, [[]]), "id", ["v0"])
    assert search.search(none, asked(spark, [(5, [3.0, 3.0])]), 9).count() == 0
    with pytest.raises(ValueError):
        search.index(spark.createDataFrame([("a", [1.0])], "id string, v array<double>"), "id", ["v"])


def test_searches_hold_two_blocks_at_a_time(spark, monkeypatch):
    from tessera.operators import metric, text

    x = np.round(np.random.default_rng(3).normal(size=(90, 4)), 1)
    x[60:] = x[:30]  # ties go to the lesser id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    plan = text.cosine_search(df.filter("id % 3 = 0"), df, 5, 7)
    u = metric.unit(x)
    c = np.round(u @ u.T, 9)
    want = {(q, i, r + 1) for q in range(0, 90, 3) for r, i in enumerate([i for i in np.lexsort((np.arange(90), -c[q])) if i != q][:5])}
    assert {(r["query"], r["id"], r["rank"]) for r in plan.collect()} == want
    blocks = metric.in_blocks(df, 7)
    assert blocks.count() >= 90 / 7 and blocks.selectExpr("max(size(ids))").first()[0] < 30
