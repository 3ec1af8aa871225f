import math

import pytest

from tessera.operators import association as a


def table(spark, cells):
    rows = [(x, y) for (x, y), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


TWO = {("p", "x"): 10, ("p", "y"): 20, ("q", "x"): 30, ("q", "y"): 5}


def test_two_by_two_is_corrected(spark):
    found = a.cramers_v(a.pair_counts(table(spark, TWO), ["a", "b"])).first()
    e = [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip((10, 20, 30, 5), e))
    assert math.isclose(found["chi2"], want, rel_tol=1e-12) and found["dof"] == 1
    phi = max(0, want / 65 - 1 / 64)
    assert math.isclose(found["v"], math.sqrt(phi / (2 - 1 / 64 - 1)), rel_tol=1e-12)
    assert math.isclose(found["p_value"], math.erfc(math.sqrt(want / 2)), rel_tol=1e-9)


def test_missing_cells_count_zero(spark):
    df = table(spark, {("p", "x"): 4, ("q", "y"): 6, ("r", "x"): 2, ("r", "y"): 3})
    grid = {(r["a"], r["b"]): r["n"] for r in a.contingency(df, "a", "b").collect()}
    assert grid == {("p", "x"): 4, ("p", "y"): 0, ("q", "x"): 0, ("q", "y"): 6, ("r", "x"): 2, ("r", "y"): 3}
    cell = a.residuals(df, "a", "b").filter("a = 'p' AND b = 'y'").first()
    assert math.isclose(cell["residual"], -math.sqrt(4 * 9 / 15))


@pytest.mark.parametrize(("x", "dof", "want"), [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 3, 1.0), (2.0, 2, math.exp(-1)), (400.0, 100, math.exp(-200) * sum(200.0**k / math.factorial(k) for k in range(50)))])
def test_tail(x, dof, want):
    assert math.isclose(a.chi_square_tail(x, dof), want, rel_tol=1e-9)


def test_one_label_and_nulls(spark):
    df = spark.createDataFrame([("k", None), ("k", "x"), ("k", "y")], "a string, b string")
    assert a.cramers_v(a.pair_counts(df, ["a", "b"])).first()["v"] == 0
    assert {r["b"] for r in a.pair_counts(df, ["a", "b"]).collect()} == {"null", "x", "y"}
    assert a.pair_counts(df, ["a", "b"], null_as=None).count() == 2
    assert [tuple(r) for r in a.code_correlation(df, "b", ["a"]).collect()] == [("a", 0.0)]


def test_matrix_is_symmetric_and_gated(spark):
    df = table(spark, TWO)
    whole = {(r["col_a"], r["col_b"]): r["v"] for r in a.cramers_matrix(df, ["a", "b"]).collect()}
    assert whole["a", "b"] == whole["b", "a"] > 0.4 and whole["a", "a"] == 1
    gated = {(r["col_a"], r["col_b"]): r["v"] for r in a.cramers_matrix(df, ["a", "b"], significance=1e-9).collect()}
    assert gated["a", "b"] == 0
    assert a.code_correlation(df, "b", ["a"]).first()["importance"] > 0.4


def test_confusion(spark):
    df = table(spark, {("p", "p"): 3, ("p", "q"): 1})
    assert a.accuracy(df, "a", "b").first()[0] == 0.75
    assert sorted(map(tuple, a.confusion(df, "a", "b").collect())) == [("p", "p", 3), ("p", "q", 1)]
