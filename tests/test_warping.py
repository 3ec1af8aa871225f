import datetime

import numpy as np
import pytest

from tessera.operators import warping


def plain(a, b, band):
    n = len(a)
    d = np.full((n + 1, n + 1), np.inf)
    d[0, 0] = 0
    for i in range(n):
        for j in range(n):
            if abs(i - j) <= band:
                d[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[n, n] ** 0.5


def curves(seed, n=60, places=16):
    """A few shapes, each shifted by up to three places, with noise."""
    rng = np.random.default_rng(seed)
    shapes = [np.sin(np.linspace(0, 6, places + 6)), np.linspace(-2, 2, places + 6) ** 2, 3 * (np.linspace(0, 1, places + 6) > 0.5), np.zeros(places + 6)]
    return np.array([shapes[k % 4][(s := rng.integers(0, 4)) : s + places] + rng.normal(0, 0.1, places) for k in range(n)])


@pytest.mark.parametrize(("band", "limit", "block"), [(3, 0.9, 500), (3, 0.9, 8), (0, 1.5, 8), (15, 2.0, 20)])
def test_pairs_equal_the_whole_matrix(spark, band, limit, block):
    x = curves(band)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found, counted = warping.warped_pairs(df, limit, band, block)
    want = {(i, j): d for i in range(len(x)) for j in range(i + 1, len(x)) if (d := plain(x[i], x[j], band)) <= limit}
    got = {(r["i"], r["j"]): r["distance"] for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and found.count() == len(want)
    assert counted["pairs"] == 60 * 59 // 2 >= counted["met"] >= counted["aligned"] >= len(want)
    if block == 8 and band == 3:
        assert counted["met"] < counted["pairs"] and counted["aligned"] < counted["pairs"] / 2


def test_series_of_events(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, day + datetime.timedelta(hours=h)) for h in (0, 1, 1, 3)] + [(2, day + datetime.timedelta(hours=h)) for h in (0, 1, 2, 3)] + [(None, day), (3, None), (4, day)]
    df = spark.createDataFrame(rows, "u long, t timestamp")
    found = {r["id"]: r["v"] for r in warping.series_of(df, "u", "t", 4).collect()}
    counts = np.array([1, 2, 0, 1.0])
    assert set(found) == {1, 2, 4} and np.allclose(found[1], (counts - 1) / counts.std()) and found[2] == [0.0] * 4
    assert warping.series_of(df.limit(0), "u", "t").count() == 0
    none = warping.warped_pairs(spark.createDataFrame([], "id long, v array<double>"), 1.0)
    assert none[0].count() == 0 and none[1] == {"pairs": 0, "met": 0, "aligned": 0}


def test_bounds_keep_what_is_near(spark):
    x, y = curves(7, 40), curves(8, 50)
    p, q = warping.not_apart(x, y, 3, 0.81)
    near = {(i, j) for i in range(40) for j in range(50) if plain(x[i], y[j], 3) <= 0.9}
    assert near and near <= set(zip(p.tolist(), q.tolist(), strict=True)) and len(p) < 40 * 50 / 2
