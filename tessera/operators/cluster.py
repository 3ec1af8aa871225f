"""Clusters of vectors: k-means, and density clusters of any density with noise."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import numbered
from tessera.functions.session import scratch, written
from tessera.operators.hierarchy import highest_chosen, merged, tree_edges
from tessera.operators.reduce import neighbours


def kmeans(vectors: DataFrame, k: int = 8, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """(id, label) of vectors (id, v)."""
    data = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    fitted = KMeans(k=k, seed=seed, maxIter=max_iter).fit(data)
    return fitted.transform(data).select("id", F.col("prediction").alias("label"))


def density(vectors: DataFrame, min_cluster_size: int = 15, min_samples: int | None = None) -> DataFrame:
    """(id, label) of vectors (id, v): hierarchical density clusters, -1 is noise.

    Two points are tied at their mutual reachability: the greatest of their
    distance and both ends' distances to their min_samples-th neighbour (default: min_cluster_size; the farthest where there are fewer).
    As that distance grows, groups of min_cluster_size points and more appear as clusters and
    merge; of each branch of that tree the clusters are kept that are most stable: the sum
    over their points of 1/distance where the point joins, less 1/distance where the cluster merges. A cluster
    that holds all points is never one. Labels follow each cluster's least id.

    Every merge counts. Exact distances to all others are taken, whose products grow with the
    square of the rows; what is shuffled and written does not. Points of null vectors are noise.
    """
    k = min_samples or min_cluster_size
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        # rows go by numbers, whatever the ids are
        given = numbered(vectors.select(F.col("id").alias("key"), "v"), [F.asc("key")], "id")
        rows = written(given.filter("v IS NOT NULL").select("id", "v"), "points")
        near = neighbours(rows, k)
        core = near.groupBy("i").agg(F.max("d").alias("core"))
        points = written(rows.join(core, F.col("id") == F.col("i"), "left").select("id", "v", F.coalesce("core", F.lit(0.0)).alias("core")), "cores")
        homes, clusters = merged(points.select("id"), tree_edges(points, near=near), min_cluster_size)
        chosen = highest_chosen(clusters)
        kept = written(homes.join(chosen, F.col("cluster") == F.col("node")).select("id", "best"), "kept")
        first = kept.groupBy("best").agg(F.min("id").alias("first"))
        labels = numbered(first, [F.asc("first")], "label").select("best", F.col("label").cast("int").alias("label"))
        found = given.select("key", "id").join(kept.join(labels, "best").select("id", "label"), "id", "left")
        return keep(found.select(F.col("key").alias("id"), F.coalesce("label", F.lit(-1)).alias("label")), "labels")


def cluster(vectors: DataFrame, method: str = "hdbscan", **options) -> DataFrame:
    """(id, label) by hdbscan (density) or kmeans."""
    if method == "hdbscan":
        return density(vectors, **options)
    if method == "kmeans":
        return kmeans(vectors, **options)
    raise ValueError(f"unknown method {method!r}")
