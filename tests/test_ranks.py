from pyspark.sql import functions as F

from tessera.functions.ranks import numbered


def test_places_go_over_the_whole_table(spark):
    df = spark.range(0, 5000, 1, 16).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("_part"))
    found = numbered(df, [F.desc("k"), F.asc("id")], "place", first=1)
    assert found.columns == ["id", "k", "_part", "place"]
    want = sorted(((i % 7, i) for i in range(5000)), key=lambda t: (-t[0], t[1]))
    assert [(r["k"], r["id"]) for r in found.orderBy("place").collect()] == want
    assert [r["place"] for r in found.select("place").orderBy("place").collect()] == list(range(1, 5001))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]  # only the counts of ranges pass through one task
    assert numbered(df.limit(0), [F.asc("id")], "place").count() == 0
