"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import scratch, written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the least node it reaches.

    Each round shortens every path by about half, so a few rounds do for any
    shape; each round's edges are a written table, so that lineage stays short
    and a lost executor costs a reread, and go when the result is written. A hub's edges meet in plain joins that
    Spark can split; minima are pre-aggregated before they are shuffled.
    """
    with scratch(edges.sparkSession) as keep:
        now = written(edges.filter("a <> b").distinct(), "edges")
        seen = _digest(now)
        while seen[0]:
            now = written(_small_star(_large_star(now)), "edges")
            seen, before = _digest(now), seen
            if seen == before:
                break
        return keep(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
