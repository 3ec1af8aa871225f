import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog
from tessera.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, k=32):
    """(n, deviations, eigenvalue shares, whitened) of clean vectors by the definition."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    deviation = (off**2).sum(axis=1)
    c = off.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:k]
    e_, u_ = e[order], u[:, order]
    held = e_ > 1e-9
    return n, deviation.tolist(), e_[held] / e.sum(), c @ u_[:, held] / np.sqrt(e_[held])


def check(found, vectors, k=32):
    """found: rows (vec_id, deviation, white, ...) in the order of the vectors."""
    n, deviation, shares, white = plain(vectors, k)
    assert [r["deviation"] for r in found] == deviation
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-9
    got = np.array([r["white"] for r in found])
    assert got.shape == white.shape
    np.testing.assert_allclose(found[0]["explained"], shares, rtol=1e-9)
    signs = np.sign((got * white).sum(axis=0))
    np.testing.assert_allclose(got * signs, white, atol=1e-6)


def table(spark, vectors):
    return spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], SCHEMA)


def rows(df):
    return df.orderBy("vec_id").collect()


@pytest.mark.parametrize(("d", "n", "k"), [(64, 500, 32), (12, 300, 32), (50, 400, 5)])
def test_equals_the_definition(spark, d, n, k):
    vectors = np.random.default_rng(d).normal(size=(n, d)) * np.linspace(3, 1, d)
    check(rows(whiten(table(spark, vectors), k)), vectors, k)


def test_passes_do_where_eigenvalues_fall_fast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    vectors = np.round(rng.normal(size=(400, 40)) * 0.0 + (rng.normal(size=(400, 3)) * [900, 300, 90]) @ basis[:3] * 64) / 64
    widths = []
    eye = np.eye
    monkeypatch.setattr(np, "eye", lambda *a, **b: (widths.append(a[0]), eye(*a, **b))[1])
    found = rows(whiten(table(spark, vectors), 3, passes=40, tolerance=1e-11))
    assert 40 not in widths  # never the full dimension
    check(found, vectors, 3)


def test_full_dimension_where_eigenvalues_are_close(spark):
    vectors = np.random.default_rng(2).normal(size=(300, 30))
    check(rows(whiten(table(spark, vectors), 4, oversample=2, passes=1)), vectors, 4)


def test_query_equals_the_definition(spark):
    folder = "/root/testdata/sf0.001"
    found = catalog.op13_whitening(spark, folder)
    held = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    back = found.groupBy("vec_id").agg(
        F.first("deviation").alias("deviation"), F.first("n").alias("n"), F.first("identity_error").alias("identity_error"),
        F.expr("transform(array_sort(collect_list(struct(component, whitened))), x -> x.whitened)").alias("white"),
        F.expr("transform(array_sort(collect_list(struct(component, explained))), x -> x.explained)").alias("explained"),
    )
    assert [r["vec_id"] for r in rows(back)] == [r["vec_id"] for r in held]
    check(rows(back), [r["embedding"] for r in held])
    assert found.agg(F.min("component"), F.max("component")).first() == (1, 32)


def test_unsound_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(40, 6))]
    good += [good[0]] * 20 + [[1e3, -1e3, 0.0, 0.5, -0.5, 1e-9]]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [-float("inf")] * 6, [1.0] * 5, [1.0] * 7]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(good)] + [(500 + k, v) for k, v in enumerate(bad)], SCHEMA)
    for c in ("v", "x", "n", "white", "a.b", "k"):
        df = df.withColumn(c, F.lit("x"))
    check(rows(whiten(df)), good)
    nameless = whiten(df.withColumn("vec_id", F.lit(None).cast("long")))
    assert nameless.count() == len(good) and nameless.filter("vec_id IS NOT NULL").count() == 0


def test_little_data(spark):
    assert whiten(table(spark, [])).count() == 0
    one = rows(whiten(table(spark, [[1.0, 2.0]])))
    assert [(r["deviation"], r["white"], r["n"]) for r in one] == [(0, [], 1)]
    same = rows(whiten(table(spark, [[1.0, 2.0]] * 5)))
    assert [(r["deviation"], r["white"]) for r in same] == [(0, [])] * 5
    flat = [[float(k), 2.0 * k, 7.0] for k in range(10)]  # one direction only
    found = rows(whiten(table(spark, flat)))
    assert {len(r["white"]) for r in found} == {1}
    check(found, flat)


def test_deviations_beyond_64_bits_are_null(spark):
    wide = [[-1e12, 1.0], [1e12, 2.0], [5e11, 3.0]]
    assert [r["deviation"] for r in rows(whiten(table(spark, wide)))] == [None] * 3
