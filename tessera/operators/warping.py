"""Series that are alike after warping in time: banded dynamic time warping with exact pruning.

Series lie in cells around pivots. A cell's envelope, its least and greatest value at
each place, widened by the band, bounds the warped distance of any of its series to those of
another cell from below, as does a series' own envelope for a pair; what neither rules out is aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import batches_of, name, scratch, written
from tessera.operators import metric

FIRST = 8  # places that are bounded for whole blocks at once
CHUNK = 65_536  # pairs that are aligned at once


def series_of(df: DataFrame, key: str, time: str, bins: int = 24, value: str | None = None) -> DataFrame:
    """(id, v): for each key the counts (or sums of a value) in equal parts of the table's whole time, less their mean and over their deviation.

    Keys whose parts are all equal have zeros; rows without a key or a time are left out.
    """
    at = F.unix_micros(name(time).cast("timestamp")).cast("double")
    rows = df.select(name(key).alias("id"), at.alias("at"), (F.lit(1.0) if value is None else name(value).cast("double")).alias("x")).filter("id IS NOT NULL AND at IS NOT NULL")
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    if low is None:
        return rows.select("id", F.array("x").alias("v"))
    part = F.least(F.floor((F.col("at") - low) * bins / max(high - low, 1.0)), F.lit(bins - 1)).cast("int")
    sums = rows.groupBy("id", part.alias("part")).agg(F.sum("x").alias("x")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "x"))).alias("m"))
    flat = sums.select("id", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("v"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    centred = flat.withColumn("mean", total(F.col("v")) / bins).select("id", F.transform("v", lambda x: x - F.col("mean")).alias("v"))
    spread = centred.withColumn("sd", F.sqrt(total(F.transform("v", lambda x: x * x)) / bins))
    return spread.select("id", F.transform("v", lambda x: F.when(F.col("sd") > 1e-12, x / F.col("sd")).otherwise(0.0)).alias("v"))


def widened(low: np.ndarray, high: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Envelopes (rows) that hold what stands up to `band` places away."""
    n = low.shape[1]
    lows, highs = low.copy(), high.copy()
    for shift in range(1, min(band, n - 1) + 1):
        for to, of in ((slice(shift, n), slice(0, n - shift)), (slice(0, n - shift), slice(shift, n))):
            lows[:, to] = np.minimum(lows[:, to], low[:, of])
            highs[:, to] = np.maximum(highs[:, to], high[:, of])
    return lows, highs


def warped(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """The warped distance of each row of a to the same row of b: the root of the least sum of squares over paths within the band."""
    pairs, n = a.shape
    before = np.full((pairs, n + 1), np.inf)
    before[:, 0] = 0
    for i in range(n):
        now = np.full((pairs, n + 1), np.inf)
        for j in range(max(0, i - band), min(n, i + band + 1)):
            step = np.minimum(np.minimum(before[:, j], before[:, j + 1]), now[:, j])
            now[:, j + 1] = (a[:, i] - b[:, j]) ** 2 + step
        before = now
    return np.sqrt(before[:, n])


def not_apart(x: np.ndarray, y: np.ndarray, band: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of x, of y) but for those whose squared warped distance is above `most`, by the envelopes of y and then of x.

    The first places are bounded for all pairs at once, the others for the pairs that are left.
    """
    low, high = widened(y, y, band)
    n, sums = x.shape[1], np.zeros((len(x), len(y)))
    for t in range(min(FIRST, n)):
        gap = np.maximum(x[:, t, None] - high[:, t], low[:, t] - x[:, t, None])
        np.maximum(gap, 0, out=gap)
        gap *= gap
        sums += gap
    p, q = np.nonzero(sums <= most)
    p, q = within(x, p, low, high, q, sums[p, q], range(FIRST, n), most)
    q, p = within(y, q, *widened(x, x, band), p, np.zeros(len(q)), range(n), most)
    return p, q


def within(x: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, total: np.ndarray, places: range, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (p, q) whose squared gaps of x[p] to the envelope q at these places, added to the total, do not pass `most`."""
    for t in places:
        gap = np.maximum(np.maximum(x[p, t] - high[q, t], low[q, t] - x[p, t]), 0)
        total = total + gap * gap
        held = total <= most
        p, q, total = p[held], q[held], total[held]
    return p, q


def _cells(series: DataFrame, band: int, block: int) -> tuple[metric.Cells, np.ndarray, int]:
    """(cells, what the series of two cells are apart at least, places)."""
    placed = metric.cells(series, block)
    n = placed.pivots.shape[1]
    cells = len(placed.pivots)
    low, high = np.full((cells, n), np.inf), np.full((cells, n), -np.inf)
    ends = placed.rows.select("cell", F.posexplode("v").alias("k", "x")).groupBy("cell", "k").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    for row in ends.collect():  # a row for each of the cells' places
        low[row["cell"], row["k"]], high[row["cell"], row["k"]] = row["low"], row["high"]
    wide = widened(low, high, band)
    apart = np.zeros((cells, cells))
    for c in range(cells):
        gap = np.maximum(np.maximum(low - wide[1][c], wide[0][c] - high), 0)
        apart[c] = np.sqrt((np.nan_to_num(gap, posinf=0.0) ** 2).sum(axis=1))
    return placed, np.maximum(apart, apart.T) - metric.SLACK, n


def warped_pairs(series: DataFrame, limit: float, band: int = 3, block: int = 500) -> tuple[DataFrame, dict[str, int]]:
    """((i, j, distance) with i < j within the limit, how many pairs there are, met in a task, and were aligned).

    series (id, v), all of one length.
    """
    spark, kind = series.sparkSession, series.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, _, a, x), (other, _, b, y) in metric.met(batches):
            alone = k == other
            p, q = not_apart(x, y, band, limit * limit + 1e-9)
            if alone:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), CHUNK):
                i, j = p[s : s + CHUNK], q[s : s + CHUNK]
                d = warped(x[i], y[j], band)
                kept = d <= limit + 1e-12
                none = pa.nulls(int(kept.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i[kept])), b.take(pa.array(j[kept])), pa.array(d[kept]), none, none], names)
            count = len(x) * (len(x) - 1) // 2 if alone else len(x) * len(y)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, a.type), pa.nulls(1, a.type), pa.nulls(1, pa.float64()), pa.array([count]), pa.array([len(p)])], names)

    names = ["i", "j", "distance", "met", "aligned"]
    with scratch(spark) as keep:
        placed, apart, _ = _cells(series, band, block)
        placed.apart = lambda: apart
        groups = metric.block_pairs(placed, limit, block)
        with batches_of(spark, 4):  # a row is two blocks
            found = written(groups.mapInArrow(run, f"i {kind}, j {kind}, distance double, met long, aligned long"), "warped")
        met, aligned = found.agg(F.sum("met"), F.sum("aligned")).first()
        n = int(placed.sizes.sum())
        pairs = keep(found.filter("distance IS NOT NULL").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "distance"), "pairs")
    return pairs, {"pairs": n * (n - 1) // 2, "met": met or 0, "aligned": aligned or 0}
