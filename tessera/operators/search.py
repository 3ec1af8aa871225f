"""Search by meaning over the vectors of several columns, by an inverted file of cells.

A row has a vector for each column that is searched; its similarity to a query is
that of its best column. Vectors of length 1 lie in cells around pivots; a query
visits the nearest cells first, and, for an exact answer, every other one whose bound is below what
it has found. What comes out is ranked by the cosine itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import name, scratch
from tessera.operators import metric


def of_length_one(v: Column) -> Column:
    """The vector over its length; null for a vector of zeros."""
    entries = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(entries, lambda x: x / length))


@dataclass
class Index:
    """The cells of a table's vectors; parts: the columns searched."""

    placed: metric.Cells
    parts: list[str]
    block: int


def index(df: DataFrame, key: str, columns: list[str], block: int = 1000) -> Index:
    """An index of all rows by the vectors in these columns; null vectors and such of zeros are not found."""
    entries = F.array(*(F.struct(F.lit(k).alias("part"), of_length_one(name(c)).alias("v")) for k, c in enumerate(columns)))
    rows = df.select(name(key).alias("key"), F.explode(entries).alias("e")).select(F.struct("key", "e.part").alias("id"), F.col("e.v").alias("v"))
    # ids are numbers to the search: each row's own, with the column as the remainder
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"keys are whole numbers, not {kind}")
    rows = rows.filter("v IS NOT NULL AND id.key IS NOT NULL").select((F.col("id.key").cast("long") * len(columns) + F.col("id.part")).alias("id"), "v")
    return Index(metric.cells(rows, block), columns, block)


def search(found: Index, queries: DataFrame, k: int = 10, probes: int = 4, exact: bool = True, others_only: bool = False) -> DataFrame:
    """(query, id, column, cosine, rank): for each of queries (query, v) the k rows of the index most like it.

    The `probes` nearest cells are looked at, and if exact all others that may hold a better row. column is
    the row's best one. Ties, of cosines rounded to nine places, go to the lesser id. others_only: a
    row is not found by a query of its own number. Queries without a length find nothing.
    """
    many = len(found.parts)
    wanted = many * (k + others_only)  # a row may come by each of its columns
    asked = queries.select(F.col("query").alias("id"), of_length_one(F.col("v")).alias("v")).filter("v IS NOT NULL")
    asked = asked.select("id", "v", F.lit(None).cast("double").alias("bound"), F.array().cast("array<int>").alias("done"))
    with scratch(queries.sparkSession) as keep:
        first = metric.visits(asked, found.placed, first=probes)
        entries = metric.answers(first, found.placed, wanted, found.block, apart=False)
        if exact:
            near = metric.best(entries, wanted)
            bound = near.groupBy(F.col("i").alias("id")).agg(F.when(F.count("*") >= wanted, F.max("d")).alias("bound"))
            done = first.groupBy("id").agg(F.collect_list("cell").alias("done"))
            again = asked.select("id", "v").join(bound, "id", "left").join(done, "id", "left")
            entries = entries.union(metric.answers(metric.visits(again, found.placed), found.placed, wanted, found.block, apart=False))
        row = F.floor(F.col("j") / many).cast("long")
        hits = entries.select(F.col("i").alias("query"), row.alias("id"), F.pmod("j", F.lit(many)).cast("int").alias("part"), (1 - F.col("d") * F.col("d") / 2).alias("cosine"))
        if others_only:
            hits = hits.filter("query <> id")
        order = F.struct(F.round("cosine", 9).alias("c"), (-F.col("part")).alias("p"), "cosine")
        hits = hits.groupBy("query", "id").agg(F.max(order).alias("best")).select("query", "id", (-F.col("best.p")).alias("part"), "best.cosine", F.col("best.c").alias("c"))
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("c"), "id"))).filter(F.col("rank") <= k)
        column = F.element_at(F.array(*map(F.lit, found.parts)), F.col("part") + 1)
        return keep(ranked.select("query", "id", column.alias("column"), "cosine", "rank"), "hits")
