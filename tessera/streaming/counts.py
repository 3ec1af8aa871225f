"""Value counts of a stream by event-time window, an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.session import fresh, name


def windowed_counts(stream: DataFrame, time: str, column: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, label, n): counts by window and label; rows later than `late` are left out."""
    at, = fresh(stream, "time")
    stamped = stream.withColumn(at, name(time).cast("timestamp")).withWatermark(at, late)
    grouped = stamped.groupBy(F.window(at, width).alias("w"), name(column).alias("label")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "label", "n")


def run_available(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is available now to Parquet, finished windows only, and go on from there next time."""
    return counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
