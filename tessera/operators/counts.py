"""Value counts and what is built on them. Ties go to the lesser label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranks import numbered
from tessera.functions.session import fresh, name


def value_counts(df: DataFrame, column: str, limit: int | None = None, null_as: str | None = None) -> DataFrame:
    """(label, n) by count; nulls are left out, or counted under null_as."""
    label = name(column) if null_as is None else F.coalesce(name(column).cast("string"), F.lit(null_as))
    found = df.select(label.alias("label")).filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    found = found.orderBy(F.desc("n"), F.asc("label"))
    return found if limit is None else found.limit(limit)


def top_n_other(df: DataFrame, column: str, top_n: int = 32, other: str = "Other") -> DataFrame:
    """df with <column>_revised: the label if it is among the top_n, else other (nulls too)."""
    label, = fresh(df, "label")
    top = value_counts(df, column, top_n).select(F.col("label").alias(label))
    joined = df.join(F.broadcast(top), name(column) == F.col(label), "left")  # top_n rows at most
    return joined.withColumn(f"{column}_revised", F.coalesce(F.col(label).cast("string"), F.lit(other))).drop(label)


def top_n_counts(df: DataFrame, column: str, top_n: int = 32, other: str = "Other") -> DataFrame:
    """(label, n, share) of the top_n labels and the rest together; one pass over df."""
    counts = df.groupBy(name(column).alias("label")).agg(F.count("*").alias("n"))
    top = counts.filter("label IS NOT NULL").orderBy(F.desc("n"), "label").limit(top_n)
    kept = counts.join(F.broadcast(top.select(F.col("label").alias("t"))), F.col("label") == F.col("t"), "left")
    grouped = kept.groupBy(F.coalesce(F.col("t").cast("string"), F.lit(other)).alias("label")).agg(F.sum("n").alias("n"))
    return grouped.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "label")


def treemap(df: DataFrame, column: str, top_n: int = 32) -> DataFrame:
    """(label, n, share, caption) for a treemap."""
    pct = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1)
    return top_n_counts(df, column, top_n).withColumn("caption", F.format_string("%s\n %.1f%%", "label", pct))


def distribution(df: DataFrame, column: str, limit: int = 20, cap: int = 32) -> DataFrame:
    """(label, n, cluster_count, total): the top labels, nulls as '', with totals over all rows."""
    counts = df.groupBy(F.coalesce(name(column).cast("string"), F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.least(F.lit(cap), F.count("*")).cast("long").alias("cluster_count"), F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "label").limit(limit)
    return top.join(F.broadcast(totals)).select("label", "n", "cluster_count", "total").orderBy(F.desc("n"), "label")  # one row


def rank_clusters(df: DataFrame, column: str, top: int = 32, other: str = "Other") -> DataFrame:
    """df with cluster (rank of its label by count, -1 beyond the top) and term (the label or other)."""
    label, place = fresh(df, "label", "place")
    ranked = value_counts(df, column, top, null_as="")  # `top` rows at most
    ranked = ranked.select(F.col("label").alias(label), (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).alias(place))
    joined = df.join(F.broadcast(ranked), F.coalesce(name(column).cast("string"), F.lit("")) == F.col(label), "left")
    return joined.withColumns({"term": F.coalesce(label, F.lit(other)), "cluster": F.coalesce(place, F.lit(-1))}).drop(label, place)


def category_codes(df: DataFrame, column: str, null_as: str = "null") -> DataFrame:
    """(label, code): labels in order, nulls as a label, codes from 0."""
    labels = df.select(F.coalesce(name(column).cast("string"), F.lit(null_as)).alias("label")).distinct()
    return numbered(labels, [F.asc("label")], "code").withColumn("code", F.col("code").cast("int"))


def lookup(df: DataFrame, key: str, pairs: DataFrame, default: str) -> DataFrame:
    """df with term: the term of pairs (key, term) for its key, else the default."""
    of, found = fresh(df, "key", "term")
    known = pairs.select(name(pairs.columns[0]).alias(of), name(pairs.columns[1]).alias(found))
    joined = df.join(known, name(key).eqNullSafe(F.col(of)), "left")
    return joined.withColumn("term", F.coalesce(found, F.lit(default))).drop(of, found)


def clipped(column: Column, width: int = 15) -> Column:
    """A label cut for display."""
    return F.substring(column.cast("string"), 1, width)


def bar_width(n: Column, non_null: Column) -> Column:
    """Width of a value's bar in percent of the values that are there, 100 at most."""
    return F.least(F.lit(100.0), F.try_divide(n * F.lit(100.0), non_null))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts in equal bins of [low, high]; values outside are left out."""
    value = name(column).cast("double")
    at = F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.filter(value.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def split_mark(df: DataFrame, key: str, seed: int = 42, train: int = 8, of: int = 10) -> DataFrame:
    """df with is_train: a seeded hash of the key decides, so that reruns and partitions agree."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(name(key), F.lit(seed)), F.lit(of)) < train)
