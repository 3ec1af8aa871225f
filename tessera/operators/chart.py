"""Data behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scatter(reduced: DataFrame, labels: DataFrame, texts: DataFrame, traces: int | None = 20) -> DataFrame:
    """(term, row_id, x, y, text, n): points by cluster in the order of terms, of the largest clusters only if traces is given.

    reduced (row_id, x, y), labels (row_id, term), texts (row_id, text).
    """
    points = reduced.join(labels, "row_id").join(texts, "row_id")
    sizes = labels.groupBy("term").agg(F.count("*").alias("n"))
    if traces is not None:
        sizes = sizes.orderBy(F.desc("n"), "term").limit(traces)
    return points.join(sizes, "term").select("term", "row_id", "x", "y", "text", "n").orderBy("term", "row_id")


def plain_label(column: str) -> str:
    """A column's name without the mark of analysed ones."""
    return column.replace("Analyzer_", "")


def accuracy_band(share: float | None) -> str:
    """good from 0.8, fair from 0.6, else weak."""
    return "good" if share and share >= 0.8 else "fair" if share and share >= 0.6 else "weak"


def triangle(matrix: DataFrame, diagonal: bool = False) -> DataFrame:
    """The lower half of an association matrix (col_a, col_b, v), by order of names."""
    return matrix.filter(F.col("col_a") >= F.col("col_b") if diagonal else F.col("col_a") > F.col("col_b"))


def scaled(importance: DataFrame) -> DataFrame:
    """importance with a share of the greatest, for colour."""
    top = F.greatest(F.max("importance").over(Window.partitionBy()), F.lit(0.001))
    return importance.withColumn("scale", F.col("importance") / top)
