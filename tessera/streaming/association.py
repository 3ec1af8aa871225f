"""Association of two columns of a stream, kept up to date for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.functions.session import fresh, name

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "key string, n long, pairs long, chi2 double, v double"


def measured(counts: dict[tuple[str, str], int]) -> tuple[int, float, float]:
    """(rows, chi-square, bias-corrected Cramer's V) of pair counts, as association.cramers_v gives them."""
    rows, cols = (sorted({pair[k] for pair in counts}) for k in (0, 1))
    grid = np.zeros((len(rows), len(cols)))
    at = [{label: k for k, label in enumerate(labels)} for labels in (rows, cols)]
    for (a, b), n in counts.items():
        grid[at[0][a], at[1][b]] = n
    n = grid.sum()
    expected = grid.sum(axis=1, keepdims=True) * grid.sum(axis=0, keepdims=True) / n
    off = np.abs(grid - expected)
    if grid.shape == (2, 2):  # the continuity correction
        off = off - np.minimum(0.5, off)
    chi2 = float((off * off / expected).sum())
    r, k = grid.shape
    if n <= 1:
        return int(n), chi2, 0.0
    phi = max(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
    base = min(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1
    return int(n), chi2, float(np.sqrt(phi / base)) if base > 0 else 0.0


class PairCounts(StatefulProcessor):
    """Holds the counts of a key's pairs of labels, and gives what they measure after each batch that has rows of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "a string, b string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for (a, b), n in part.groupby(["a", "b"]).size().items():
                known = self.counts.getValue((a, b)) if self.counts.containsKey((a, b)) else (0,)
                self.counts.updateValue((a, b), (known[0] + int(n),))
        counts = {(k[0], k[1]): v[0] for k, v in self.counts.iterator()}
        n, chi2, v = measured(counts)
        yield pd.DataFrame({"key": [key[0]], "n": [n], "pairs": [len(counts)], "chi2": [chi2], "v": [v]})

    def close(self) -> None:
        pass


def keyed_association(stream: DataFrame, key: str, a: str, b: str, null_as: str = "null") -> DataFrame:
    """(key, n, pairs, chi2, v) of a stream: for each key with new rows, what all its rows so far measure.

    State holds one number for each key and pair of labels, in the RocksDB store.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    text = lambda c: F.coalesce(name(c).cast("string"), F.lit(null_as))
    rows = stream.select(text(key).alias("key"), text(a).alias("a"), text(b).alias("b"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=PairCounts(), outputStructType=FOUND, outputMode="Update", timeMode="None")


def run_available(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take what is available now, add each batch's rows to a Parquet table, and go on from there next time."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")  # the same batch, done again, takes its own place

    return found.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The last batch's row of each key of what run_available has written."""
    place, = fresh(table, "place")
    newest = Window.partitionBy("key").orderBy(F.desc("batch"))
    return table.withColumn(place, F.row_number().over(newest)).filter(F.col(place) == 1).drop(place, "batch")
