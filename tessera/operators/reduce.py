"""Dimensionality reduction: principal components, and a neighbour-graph layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import written
from tessera.operators import metric

CELLS = 1089  # that repulsion is summed over


def pca(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(id, reduced) of vectors (id, v): centred, and each component's largest loading is positive."""
    data = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("f"))
    fitted = PCA(k=k, inputCol="f", outputCol="p").fit(data)
    mean = data.agg(Summarizer.mean(F.col("f"))).first()[0].toArray()
    load = fitted.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    shift = (mean @ load) * sign
    columns = [F.get("p", k) * F.lit(float(s)) - F.lit(float(m)) for k, (s, m) in enumerate(zip(sign, shift, strict=True))]
    return fitted.transform(data).select("id", vector_to_array("p").alias("p")).select("id", F.array(*columns).alias("reduced"))


def neighbours(vectors: DataFrame, k: int, block: int = 1000, exact: bool = True) -> DataFrame:
    """(i, j, d, rank): the k nearest others of each vector, exactly, or with a measured recall of 0.9 and more."""
    return metric.nearest(vectors, k, block) if exact else metric.descended(vectors, k)


def layout(vectors: DataFrame, n_neighbors: int = 15, min_dist: float = 0.1, epochs: int = 12, n_components: int = 2, exact: bool = False) -> DataFrame:
    """(id, reduced): n_components coordinates that keep neighbours together, from a fuzzy neighbour graph.

    The graph comes from lists with a measured recall of 0.9 and more, or exact ones.
    Edges attract; repulsion is summed over the occupied cells of a grid of at most CELLS in place
    of sampled points, so that reruns agree. Starts from the principal components.
    """
    near = neighbours(vectors, n_neighbors, exact=exact)
    target = float(np.log2(max(2, n_neighbors)))
    lists = near.groupBy("i").agg(F.min("d").alias("rho"), F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))
    fill = lambda s: F.aggregate("near", F.lit(0.0), lambda t, x: t + F.exp(-F.greatest(x["d"] - F.col("rho"), F.lit(0.0)) / s))

    def halve(state, _):
        mid = (state["lo"] + state["hi"]) / 2
        high = fill(mid) > target
        return F.struct(F.when(high, state["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(state["hi"]).alias("hi"))

    top = F.greatest(F.lit(1e-6), 20 * F.get("near", F.size("near") - 1)["d"])
    sigma = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(F.lit(1e-9).alias("lo"), top.alias("hi")), halve)["hi"]
    one = lists.withColumn("sigma", sigma).select("i", "rho", "sigma", F.explode("near").alias("x")).select(
        "i", F.col("x.j").alias("j"), F.exp(-F.greatest(F.col("x.d") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("p")
    )
    both = one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    edges = written(both.groupBy("i", "j").agg((F.sum("p") - F.when(F.count("*") > 1, F.product("p")).otherwise(0)).alias("p")), "edges")
    # the curve 1 / (1 + a d^2b) that falls off past min_dist, fitted on a grid
    xs = np.linspace(0.001, 3, 300)
    want = np.where(xs < min_dist, 1.0, np.exp(-(xs - min_dist)))
    a, b = min(((a, b) for a in np.linspace(0.4, 2.5, 43) for b in np.linspace(0.6, 1.4, 41)), key=lambda t: ((1 / (1 + t[0] * xs ** (2 * t[1])) - want) ** 2).sum())
    width = len(vectors.first()["v"]) if not vectors.isEmpty() else n_components
    if width < n_components:
        raise ValueError(f"vectors of length {width} have no {n_components} components")
    start = pca(vectors, n_components)
    axes = [f"x{c}" for c in range(n_components)]
    span = start.agg(F.max(F.array_max(F.transform("reduced", F.abs)))).first()[0] or 1.0
    at = written(start.select("id", *((F.get("reduced", c) * (10 / span)).alias(x) for c, x in enumerate(axes))), "places")
    bins = max(2, int(CELLS ** (1 / n_components) + 1e-9))
    binned = axes if bins**n_components <= CELLS else axes[: int(np.log2(CELLS))]  # many axes: the first ones, in halves
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        box = at.agg(*(f(x) for x in binned for f in (F.min, F.max))).first()
        sides = [(x, box[2 * c], max(box[2 * c + 1] - box[2 * c], 1e-9) / bins) for c, x in enumerate(binned)]
        # a coordinate at the upper end belongs to the last cell
        cell = [F.least(F.floor((F.col(x) - low) / wide), F.lit(bins - 1)) for x, low, wide in sides]
        cells = at.groupBy(*cell).agg(*(F.avg(x).alias(x) for x in axes), F.count("*").alias("n"))
        held = cells.select(*axes, "n").toPandas().to_numpy(dtype=float)  # CELLS rows at most

        def push(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total = held[:, -1].sum()
            for batch in batches:
                d = batch[axes].to_numpy()[:, None, :] - held[None, :, :-1]
                d2 = (d * d).sum(axis=2)
                force = 5 * n_neighbors * held[:, -1] / total * 2 * b / ((0.1 + d2) * (1 + a * d2**b))
                moves = np.clip((force[:, :, None] * d).sum(axis=1), -4, 4)
                yield batch.assign(**{f"d{x}": moves[:, c] for c, x in enumerate(axes)})

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.schema)
        pushed = at.mapInPandas(push, f"{kinds}, {', '.join(f'd{x} double' for x in axes)}")
        ends = edges.join(at.select(F.col("id").alias("i"), *(F.col(x).alias(f"i{x}") for x in axes)), "i").join(
            at.select(F.col("id").alias("j"), *(F.col(x).alias(f"j{x}") for x in axes)), "j"
        )
        d2 = sum((F.pow(F.col(f"j{x}") - F.col(f"i{x}"), 2) for x in axes), F.lit(0.0))
        force = F.col("p") * (2 * float(a) * float(b)) * F.pow(d2 + 1e-9, F.lit(float(b) - 1)) / (1 + float(a) * F.pow(d2 + 1e-9, F.lit(float(b))))
        pulled = ends.groupBy(F.col("i").alias("id")).agg(*(F.sum(force * (F.col(f"j{x}") - F.col(f"i{x}"))).alias(f"p{x}") for x in axes))
        clip = lambda c: F.least(F.greatest(c, F.lit(-4.0)), F.lit(4.0))
        moved = pushed.join(pulled, "id", "left")
        step = [(F.col(x) + rate * clip(F.col(f"d{x}") * 0.1 + 0.1 * F.coalesce(f"p{x}", F.lit(0.0)))).alias(x) for x in axes]
        at = written(moved.select("id", *step), "places")
    return at.select("id", F.array(*axes).alias("reduced"))


def reduce_dimensions(vectors: DataFrame, method: str = "umap", n_components: int = 2, **options) -> DataFrame:
    """(id, reduced) by pca or umap (the neighbour-graph layout)."""
    if method == "pca":
        return pca(vectors, n_components)
    if method == "umap":
        return layout(vectors, n_components=n_components, **options)
    raise ValueError(f"unknown method {method!r}")
