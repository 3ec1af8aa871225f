import random

from pyspark.sql import functions as F

from tessera.operators import association
from tessera.streaming.association import keyed_association, latest, measured, run_available

SCHEMA = "k string, a string, b int"


def rows(seed, n=200):
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        k, a = rng.choice(["x", "y", "z"]), rng.choice(["p", "q", None])
        found.append((k, a, rng.choice([1, 2]) if k == "x" else (1 if a == "p" else rng.choice([1, 2, 3]))))
    return found


def test_two_runs_equal_the_batch(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / c) for c in ("in", "out", "state"))
    done = []
    for turn in range(2):
        new = rows(turn)
        done += new + ([("w", "p", 1)] if turn else [])
        spark.createDataFrame(done[-len(new) - turn :], SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        run_available(keyed_association(stream, "k", "a", "b"), path, checkpoint).awaitTermination()
        found = {r["key"]: r for r in latest(spark.read.option("basePath", path).parquet(f"{path}/batch=*")).collect()}
        everything = spark.createDataFrame(done, SCHEMA)
        assert set(found) == {r[0] for r in done}
        for key, row in found.items():
            want = association.cramers_v(association.pair_counts(everything.filter(F.col("k") == key), ["a", "b"], "null")).first()
            assert row["n"] == sum(r[0] == key for r in done)
            assert abs(row["v"] - want["v"]) < 1e-9 and abs(row["chi2"] - want["chi2"]) < 1e-9


def test_a_run_without_news_changes_nothing(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / c) for c in ("in", "out", "state"))
    spark.createDataFrame(rows(5), SCHEMA).coalesce(1).write.json(source)
    for _ in range(2):
        run_available(keyed_association(spark.readStream.schema(SCHEMA).json(source), "k", "a", "b"), path, checkpoint).awaitTermination()
    assert spark.read.option("basePath", path).parquet(f"{path}/batch=*").count() == 3


def test_small_grids():
    assert measured({("a", "b"): 1}) == (1, 0.0, 0.0)
    assert measured({("a", "x"): 5, ("b", "y"): 5})[2] > 0.7
