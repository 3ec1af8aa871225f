"""Density clusters from the whole merge tree of a spanning forest, in bounded tasks.

Points are tied by mutual reachability: the greatest of their distance and of both
ends' distances to their k-th neighbour. Components of points take their least edges to
others, round by round, until a tree spans all points.
Merging goes through the edges by weight, so many at a time as one task takes; the
components so far and what is known of them pass from turn to turn as tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.components import components
from tessera.functions.ranks import numbered
from tessera.functions.session import batches_of, scratch, written
from tessera.operators import metric

LEAST = 1e-12  # the distance that closer points count as
CHUNK = 50_000  # edges that one task merges in a turn

MERGED = (
    "kind string, node long, root long, size long, cluster long, leaving double, within double, parent long, worth double, chosen boolean"
)


def least_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, weight) of a least spanning tree of the rows of x under mutual reachability."""
    n = len(x)
    left = np.ones(n, dtype=bool)
    weight, near = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    squares = (x * x).sum(axis=1)
    found, at = [], 0
    for _ in range(n - 1):
        left[at] = False
        far = np.sqrt(np.maximum(squares + squares[at] - 2 * x @ x[at], 0))
        far = np.maximum(np.maximum(far, core), core[at])
        closer = left & (far < weight)
        weight[closer], near[closer] = far[closer], at
        at = int(np.where(left, weight, np.inf).argmin())
        found.append((near[at], at, weight[at]))
    i, j, w = zip(*found, strict=True) if found else ((), (), ())
    return np.array(i, dtype=np.int64), np.array(j, dtype=np.int64), np.array(w, dtype=float)


def _scanned(asked: DataFrame, points: DataFrame, block: int) -> DataFrame:
    """(root, w, a, b, other): for components the least edge to another one, below what is known, that a task finds.

    asked (id, v, core, root, least known weight) and points (id, v, core, root) are packed in blocks that meet as they are read.
    """
    spark = points.sparkSession

    def blocks(df: DataFrame, *more: str) -> DataFrame:
        return metric.in_blocks(df.select("id", F.concat("v", F.array("core", F.col("root").cast("double"), *more)).alias("v")), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # of the asked blocks: ids, roots, and for each row the least weight, its end and the end's root
        for (k, _, a, x), (_, _, b, y) in metric.met(batches):
            v, core, root, u, far, to = x[:, :-3], x[:, -3], x[:, -2], y[:, :-2], y[:, -2], y[:, -1]
            if k not in held:
                held[k] = (a.to_numpy(), root.copy(), x[:, -1].copy(), np.zeros(len(x), dtype=np.int64), np.full(len(x), -1.0))
            _, _, least, end, other = held[k]
            w = np.column_stack([-2 * v, (v * v).sum(axis=1), np.ones(len(v))]) @ np.column_stack([u, np.ones(len(u)), (u * u).sum(axis=1)]).T
            np.maximum(w, (far * far)[None, :], out=w)
            w[root[:, None] == to[None, :]] = np.inf
            j = w.argmin(axis=1)
            exact = np.maximum(np.maximum(np.sqrt(((v - u[j]) ** 2).sum(axis=1)), core), far[j])
            nearer = np.isfinite(w[np.arange(len(v)), j]) & (exact < least)
            j = j[nearer]
            least[nearer], end[nearer], other[nearer] = exact[nearer], b.to_numpy()[j], to[j]
        for ids, root, least, end, other in held.values():
            found = pd.DataFrame({"root": root.astype(np.int64), "w": least, "a": ids, "b": end, "other": other.astype(np.int64), "found": other >= 0})
            found = found[found["found"]].sort_values(["root", "w", "a", "b"]).drop_duplicates("root").drop(columns="found")
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    with batches_of(spark, 4):  # a row is two blocks
        met = metric.all_met(blocks(asked, "least"), blocks(points))
        return written(met.mapInArrow(run, "root long, w double, a long, b long, other long"), "scanned")


def tree_edges(points: DataFrame, block: int = 1000, near: DataFrame | None = None) -> DataFrame:
    """(a, b, w): edges that hold a least spanning tree of the points (id, v, core).

    In each round every component but the largest takes its least edge to another one, which
    a least spanning tree has; so there are at most half as many, and no more rounds than the logarithm of the points.
    near, each point's nearest others (i, j, d), spares most of the search: all that it leaves out is at
    least as far as the last of a list, so only points whose list ends below the least edge known of their component look at all others.
    """
    spark = points.sparkSession
    with scratch(spark) as keep:
        where = points.select("id", F.col("id").alias("root"))
        core = points.select(F.col("id").alias("of"), "core")
        bound = points.select("id", F.lit(0.0).alias("bound"))
        links = None
        if near is not None:
            full = near.agg(F.max("rank")).first()[0] or 0
            ends = near.groupBy(F.col("i").alias("id")).agg(F.when(F.count("*") >= full, F.max("d")).alias("bound"))
            bound = written(ends.select("id", F.coalesce("bound", F.lit(0.0)).alias("bound")), "bounds")
            weighed = near.select("i", "j", "d").join(core.toDF("i", "x"), "i").join(core.toDF("j", "y"), "j").select("i", "j", F.greatest("d", "x", "y").alias("w"))
            links = written(weighed.union(weighed.select("j", "i", "w")), "links")
        taken = None
        while True:
            sizes = where.groupBy("root").count().orderBy(F.desc("count"), "root").limit(2).collect()
            if len(sizes) < 2:
                break
            largest = sizes[0]["root"]
            known = None
            if links is not None:
                links = links.select("i", "j", "w").join(where.toDF("i", "root"), "i").join(where.toDF("j", "other"), "j").filter("root <> other")
                links = written(links, "links")
                known = links.groupBy("root").agg(F.min(F.struct("w", F.col("i").alias("a"), F.col("j").alias("b"), "other")).alias("e"))
                known = written(known.filter(F.col("root") != largest).select("root", "e.*"), "known")
            rows = points.join(where, "id")
            asked = rows.filter(F.col("root") != largest).join(bound, "id", "left")
            asked = asked.withColumn("least", F.lit(np.inf)) if known is None else asked.join(known.select("root", F.col("w").alias("least")), "root", "left")
            asked = asked.withColumn("least", F.coalesce("least", F.lit(np.inf))).filter(F.coalesce("bound", F.lit(0.0)) < F.col("least"))
            chosen = _scanned(asked, rows, block)
            chosen = chosen if known is None else chosen.unionByName(known)
            chosen = written(chosen.groupBy("root").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("root", "e.*"), "chosen")
            if chosen.isEmpty():  # distances that are no numbers
                break
            roots = components(chosen.select(F.col("root").alias("a"), F.col("other").alias("b")))
            moved = where.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            where = written(moved.select("id", F.coalesce("to", "root").alias("root")), "roots")
            taken = chosen if taken is None else taken.union(chosen)
        if taken is None:
            taken = spark.createDataFrame([], "a long, b long, w double")
        edges = taken.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "w")
        return keep(edges.groupBy("a", "b").agg(F.min("w").alias("w")), "trees")


def merge_turn(edges: pd.DataFrame, least: int, turn: int) -> pd.DataFrame:
    """What the edges (x, y, w, and the components at both ends) merge, by rising weight; those of one weight merge at once.

    Going up, a component becomes a cluster when it reaches `least` points; smaller
    ones that a cluster meets join it; where clusters meet they end, and a new one
    holds them and what else meets there. A cluster's worth is the sum over its points of 1/w where a
    point joins it, less 1/w where the cluster ends; it is chosen if that is at least what the
    chosen ones within it are worth.
    """
    top: dict[int, int] = {}
    state: dict[int, tuple] = {}  # of roots: size, cluster, leaving, within
    for side in "xy":
        columns = [edges[f"{c}_{side}"] if c else edges[side] for c in ("", "size", "cluster", "leaving", "within")]
        for node, size, cluster, leaving, within in zip(*columns, strict=True):
            top[node] = node
            state[node] = (size, None if pd.isna(cluster) else int(cluster), leaving, within)
    small = {node: [node] for node, s in state.items() if s[1] is None}  # the nodes of components that are no cluster
    rows: list[dict] = []
    made = 0

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    ordered = edges.sort_values(["w", "x", "y"], kind="stable")
    for w, same in groupby(zip(ordered["w"], ordered["x"], ordered["y"], strict=True), key=lambda e: e[0]):
        met: dict[int, list[int]] = {}  # of the new roots: the roots that they join
        for _, x, y in same:
            a, b = sorted((root(x), root(y)))
            if a != b:
                top[b] = a
                met[a] = met.pop(a, [a]) + met.pop(b, [b])
        density = 1 / max(w, LEAST)
        for head, parts in met.items():
            ended = [state[p] for p in parts if state[p][1] is not None]
            size = sum(state.pop(p)[0] for p in parts)
            loose = [node for p in parts for node in small.pop(p, ())]
            if not ended and size < least:
                small[head] = loose
                state[head] = (size, None, 0.0, 0.0)
                continue
            if len(ended) == 1:
                of, cluster, leaving, within = ended[0]
                leaving += (size - of) * density
            else:
                cluster, leaving, within = (turn << 32) + made, size * density, 0.0
                made += 1
                for n, of, left, inner in ended:
                    worth = left - n * density
                    within += max(worth, inner)
                    rows.append({"kind": "cluster", "node": of, "parent": cluster, "worth": worth, "chosen": worth >= inner})
            rows += ({"kind": "home", "node": node, "cluster": cluster} for node in loose)
            state[head] = (size, cluster, leaving, within)
    rows += ({"kind": "moved", "node": node, "root": root(node)} for node in list(top))
    for node, (size, cluster, leaving, within) in state.items():
        rows.append({"kind": "component", "root": node, "size": size, "cluster": cluster, "leaving": leaving, "within": within})
    found = pd.DataFrame(rows, columns=[c.split()[0] for c in MERGED.split(", ")])
    return found.astype({c: "Int64" for c in ("node", "root", "size", "cluster", "parent")} | {"chosen": "boolean"})


def _turn(least: int, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda edges: merge_turn(edges, least, turn)


def merge_level(ends: DataFrame, least: int, turn: int) -> DataFrame:
    """As merge_turn, for edges that all have one weight, of which there may be more than a task takes."""
    roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    held = ["size", "cluster", "leaving", "within"]
    sides = [ends.select("w", F.col(s).alias("node"), *(F.col(f"{c}_{s}").alias(c) for c in held)) for s in "xy"]
    parts = sides[0].union(sides[1]).dropDuplicates(["node"]).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    density = 1 / F.greatest(F.max("w"), F.lit(LEAST))
    worth = F.col("leaving") - F.col("size") / F.greatest("w", F.lit(LEAST))
    groups = parts.groupBy("root").agg(
        density.alias("density"), F.sum("size").alias("size"), F.count("cluster").alias("n"), F.max("cluster").alias("only"),
        F.sum(F.when(F.col("cluster").isNotNull(), F.col("size"))).alias("in_clusters"), F.max("leaving").alias("leaving"),
        F.max("within").alias("one_within"), F.sum(F.when(F.col("cluster").isNotNull(), F.greatest(worth, "within"))).alias("within"),
    )
    groups = numbered(groups, [F.asc("root")], "made", first=turn << 32)  # names for new clusters
    new = F.when(F.col("n") == 1, F.col("only")).when((F.col("n") > 1) | (F.col("size") >= least), F.col("made"))
    one = F.col("n") == 1
    groups = groups.select(
        "root", "size", "n", new.alias("new"),
        F.when(one, F.col("leaving") + (F.col("size") - F.col("in_clusters")) * F.col("density")).when(new.isNotNull(), F.col("size") * F.col("density")).otherwise(0.0).alias("leaving"),
        F.when(one, F.col("one_within")).otherwise(F.coalesce("within", F.lit(0.0))).alias("within"),
    )
    groups = written(groups, "groups")
    joined = parts.select("node", "root", F.col("cluster").alias("own"), worth.alias("worth"), F.col("within").alias("inner")).join(groups.select("root", "n", "new"), "root")
    kinds = {
        "cluster": joined.filter("own IS NOT NULL AND n > 1").select(F.col("own").alias("node"), F.col("new").alias("parent"), "worth", (F.col("worth") >= F.col("inner")).alias("chosen")),
        "home": joined.filter("own IS NULL AND new IS NOT NULL").select("node", F.col("new").alias("cluster")),
        "moved": joined.select("node", "root"),
        "component": groups.select("root", "size", F.col("new").alias("cluster"), "leaving", "within"),
    }
    found = None
    for kind, rows in kinds.items():
        columns = [F.lit(kind).alias("kind")]
        for column, of in (c.split() for c in MERGED.split(", ")[1:]):
            columns.append((F.col(column) if column in rows.columns else F.lit(None)).cast(of).alias(column))
        found = rows.select(*columns) if found is None else found.union(rows.select(*columns))
    return found


def merged(points: DataFrame, edges: DataFrame, least: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(homes (id, cluster), clusters (node, parent, worth, chosen)) of points (id) that edges (a, b, w) tie.

    A point's home is the first cluster that it joins; points that join none have no row. A cluster
    that nothing holds has no parent and is not chosen.
    """
    spark = points.sparkSession
    with scratch(spark) as keep:
        where = points.select("id", F.col("id").alias("root"), F.lit(None).cast("long").alias("cluster"))
        parts = points.select(F.col("id").alias("root"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"), F.lit(0.0).alias("leaving"), F.lit(0.0).alias("within"))
        live = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").filter("x <> y")
        clusters, turn = None, 0
        while not (now := written(live.orderBy("w").limit(chunk + 1), "turn")).isEmpty():
            low, high, n = now.agg(F.min("w"), F.max("w"), F.count("*")).first()
            # edges of one weight are not parted: the last weight waits, or fills the turn
            level = n > chunk and low == high
            ends = live.filter(F.col("w") == low) if level else now.filter(F.col("w") < high) if n > chunk else now
            for side in "xy":
                ends = ends.join(parts.select(F.col("root").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("size", "cluster", "leaving", "within"))), side)
            if level:
                found = merge_level(written(ends, "level"), least, turn)
            else:  # `chunk` rows at most
                found = ends.groupBy(F.lit("turn")).applyInPandas(_turn(least, turn), MERGED)
            found = written(found, "merged")
            moved = found.filter("kind = 'moved'").select(F.col("node").alias("was"), F.col("root").alias("to"))
            home = found.filter("kind = 'home'").select(F.col("node").alias("alone"), F.col("cluster").alias("joined"))
            at = where.join(moved, F.col("root") == F.col("was"), "left").join(home, F.col("root") == F.col("alone"), "left")
            where = written(at.select("id", F.coalesce("to", "root").alias("root"), F.coalesce("cluster", "joined").alias("cluster")), "places")
            stays = parts.join(moved, F.col("root") == F.col("was"), "left_anti")
            parts = written(stays.union(found.filter("kind = 'component'").select(*parts.columns)), "components")
            ended = found.filter("kind = 'cluster'").select("node", "parent", "worth", "chosen")
            clusters = ended if clusters is None else clusters.union(ended)
            for side in "xy":
                live = live.join(moved, F.col(side) == F.col("was"), "left").withColumn(side, F.coalesce("to", side)).drop("was", "to")
            pair = live.filter("x <> y").groupBy(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).agg(F.min("w").alias("w"))
            live = written(pair, "live")
            turn += 1
        heads = parts.filter("cluster IS NOT NULL").select(
            F.col("cluster").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("worth"), F.lit(False).alias("chosen")
        )
        clusters = heads if clusters is None else clusters.union(heads)
        return keep(where.filter("cluster IS NOT NULL").select("id", "cluster"), "homes"), keep(clusters, "tree")


def highest_chosen(clusters: DataFrame) -> DataFrame:
    """(node, best): the highest chosen cluster among each cluster and those that hold it; twice as far up in each round."""
    with scratch(clusters.sparkSession) as keep:
        up = written(clusters.select("node", F.col("parent").alias("jump"), F.when(F.col("chosen"), F.col("node")).alias("best")), "up")
        while not up.filter("jump IS NOT NULL").isEmpty():
            above = up.select(F.col("node").alias("jump"), F.col("jump").alias("further"), F.col("best").alias("higher"))
            up = written(up.join(above, "jump", "left").select("node", F.col("further").alias("jump"), F.coalesce("higher", "best").alias("best")), "up")
        return keep(up.filter("best IS NOT NULL").select("node", "best"), "chosen")
