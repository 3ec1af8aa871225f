"""Association of categorical columns: contingency tables, chi-square, Cramer's V, residuals, correlation."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.session import name
from tessera.operators.counts import category_codes


def _label(column: str, null_as: str | None) -> Column:
    label = name(column).cast("string")
    return label if null_as is None else F.coalesce(label, F.lit(null_as))


def pair_counts(df: DataFrame, columns: list[str], null_as: str | None = "null") -> DataFrame:
    """(col_a, col_b, a, b, n) of every pair of columns, in one pass and one shuffle of partial counts.

    null_as None: rows in which either is null are left out of the pair.
    """
    pairs = [
        F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), _label(x, null_as).alias("a"), _label(y, null_as).alias("b"))
        for x, y in combinations(columns, 2)
    ]
    long = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").filter("a IS NOT NULL AND b IS NOT NULL")
    return long.groupBy("col_a", "col_b", "a", "b").agg(F.count("*").alias("n"))


def dense(counts: DataFrame) -> DataFrame:
    """pair counts with every label of a against every label of b, and margins: row_n, col_n, total, rows, cols.

    The grid has a row for each pair of labels of a pair of columns, which is what a
    contingency table is; keep to columns of few labels.
    """
    key = ["col_a", "col_b"]
    rows = counts.groupBy(*key, "a").agg(F.sum("n").alias("row_n"))
    cols = counts.groupBy(*key, "b").agg(F.sum("n").alias("col_n"))
    sizes = rows.groupBy(*key).agg(F.sum("row_n").alias("total"), F.count("*").alias("rows"))
    sizes = sizes.join(cols.groupBy(*key).agg(F.count("*").alias("cols")), key)
    grid = rows.join(cols, key).join(sizes, key).join(counts, [*key, "a", "b"], "left")
    return grid.select(*key, "a", "b", F.coalesce("n", F.lit(0)).alias("n"), "row_n", "col_n", "total", "rows", "cols")


def contingency(df: DataFrame, a: str, b: str, null_as: str | None = "null") -> DataFrame:
    """(a, b, n): the dense table of two columns."""
    return dense(pair_counts(df, [a, b], null_as)).select("a", "b", "n")


def residuals(df: DataFrame, a: str, b: str, null_as: str | None = "null") -> DataFrame:
    """(a, b, n, expected, residual): Pearson residuals, (n - expected) / sqrt(expected)."""
    expected = F.col("row_n") * F.col("col_n") / F.col("total")
    grid = dense(pair_counts(df, [a, b], null_as)).withColumn("expected", expected)
    return grid.select("a", "b", "n", "expected", ((F.col("n") - F.col("expected")) / F.sqrt("expected")).alias("residual"))


def chi_square(counts: DataFrame, correction: bool = True) -> DataFrame:
    """(col_a, col_b, chi2, dof, total, rows, cols) of pair counts; 2 x 2 tables have the continuity correction."""
    grid = dense(counts).withColumn("expected", F.col("row_n") * F.col("col_n") / F.col("total"))
    off = F.abs(F.col("n") - F.col("expected"))
    yates = (F.col("rows") == 2) & (F.col("cols") == 2) & F.lit(correction)
    off = F.when(yates, off - F.least(F.lit(0.5), off)).otherwise(off)
    return grid.groupBy("col_a", "col_b").agg(
        F.sum(off * off / F.col("expected")).alias("chi2"), F.max((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"),
        F.max("total").alias("total"), F.max("rows").alias("rows"), F.max("cols").alias("cols"),
    )


def chi_square_tail(x: float, dof: int) -> float:
    """P(chi-square with dof degrees >= x): the regularised upper incomplete gamma function."""
    if dof <= 0 or x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series of the lower function
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = z + 1 - a, 1e300  # continued fraction of the upper one
    d = h = 1 / b
    for k in range(1, 10_000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(T.DoubleType())
def p_value(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    """The tail of chi-square, for rows that are one per pair of columns."""
    return pd.Series([chi_square_tail(x, int(d)) for x, d in zip(chi2, dof, strict=True)])


def cramers_v(counts: DataFrame) -> DataFrame:
    """chi_square() with p_value and v, the bias-corrected Cramer's V; 0 where a column has one label."""
    found = chi_square(counts)
    n, r, k = F.col("total"), F.col("rows"), F.col("cols")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - F.try_divide((k - 1) * (r - 1), n - 1))
    fixed_r, fixed_k = r - F.try_divide((r - 1) * (r - 1), n - 1), k - F.try_divide((k - 1) * (k - 1), n - 1)
    base = F.least(fixed_k - 1, fixed_r - 1)
    v = F.when(base > 0, F.sqrt(phi / base)).otherwise(F.lit(0.0))
    return found.withColumn("v", F.coalesce(v, F.lit(0.0))).withColumn("p_value", p_value("chi2", F.col("dof")))


def cramers_matrix(df: DataFrame, columns: list[str], significance: float | None = None, null_as: str | None = "null") -> DataFrame:
    """(col_a, col_b, v): the full matrix, 1 on the diagonal; values without significance are 0."""
    pairs = cramers_v(pair_counts(df, columns, null_as))
    if significance is not None:
        pairs = pairs.withColumn("v", F.when(F.col("p_value") < significance, F.col("v")).otherwise(F.lit(0.0)))
    half = pairs.select("col_a", "col_b", F.round("v", 3).alias("v"))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "col_a string, col_b string, v double")
    return half.union(half.select("col_b", "col_a", "v")).union(diagonal)


def code_correlation(df: DataFrame, target: str, features: list[str], null_as: str = "null") -> DataFrame:
    """(feature, importance): absolute correlation of category codes with the target's, rounded to 3 digits.

    Codes are counted by pair of labels first, so that codes join a few rows; a constant column has 0.
    """
    codes = {c: category_codes(df, c, null_as) for c in {target, *features}}
    found = None
    for f in features:
        pairs = df.groupBy(_label(f, null_as).alias("a"), _label(target, null_as).alias("b")).agg(F.count("*").alias("n"))
        x = codes[f].select(F.col("label").alias("a"), F.col("code").cast("double").alias("x"))
        y = codes[target].select(F.col("label").alias("b"), F.col("code").cast("double").alias("y"))
        m = pairs.join(x, "a").join(y, "b").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("x"), F.sum(F.col("n") * F.col("y")).alias("y"),
            F.sum(F.col("n") * F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("xx"),
            F.sum(F.col("n") * F.col("y") * F.col("y")).alias("yy"),
        )
        r = F.try_divide(
            F.col("n") * F.col("xy") - F.col("x") * F.col("y"),
            F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))),
        )
        row = m.select(F.lit(f).alias("feature"), F.round(F.coalesce(F.abs(r), F.lit(0.0)), 3).alias("importance"))
        found = row if found is None else found.union(row)
    return found.orderBy(F.desc("importance"), "feature")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(label, predicted, n)."""
    return df.groupBy(name(label).alias("label"), name(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(accuracy): the share of rows whose labels agree."""
    return df.agg(F.avg((name(label) == name(predicted)).cast("double")).alias("accuracy"))
