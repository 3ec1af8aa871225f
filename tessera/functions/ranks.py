"""Places of rows in an order over the whole table, without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import fresh, written


def numbered(df: DataFrame, order: list[Column], to: str, first: int = 0) -> DataFrame:
    """df with a long column `to`: each row's place in the order, counted from `first`.

    Rows are dealt to ranges of the order and sorted there; a row's place is its
    place within its range plus the rows of all ranges before, whose counts are
    one row a range. Rows that are equal in the order are numbered as they come;
    give a last key that tells them apart where that matters, or where one value of
    the order may hold much of the table.
    """
    part, at, before = fresh(df, "part", "at", "before")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that ranges and places within them are fixed for both passes
    held = written(
        dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranges"
    )
    counts = held.groupBy(part).agg(F.count("*").alias(before))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum(before).over(upto), F.lit(0)).alias(before))
    # one row for each range, as many as there are shuffle partitions
    return held.join(F.broadcast(starts), part).withColumn(to, F.col(before) + F.col(at) + first).drop(part, at, before)
