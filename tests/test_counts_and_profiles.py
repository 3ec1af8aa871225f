import pytest

from tessera.operators import counts, profile


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(f"c{k:02d}",) for k in range(33) for _ in range(3 if k < 30 else 2)] + [(None,)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, c string")


def test_top_n_ties_go_to_the_lesser_label(labels):
    found = {r["label"]: r["n"] for r in counts.top_n_counts(labels, "c").collect()}
    assert len(found) == 33 and "c31" in found and "c32" not in found and found["Other"] == 3
    revised = counts.top_n_other(labels, "c").filter("c IS NULL OR c = 'c32'").collect()
    assert {r["c_revised"] for r in revised} == {"Other"} and len(revised) == 3
    assert abs(sum(r["share"] for r in counts.treemap(labels, "c").collect()) - 1) < 1e-9


def test_null_is_a_label_where_asked(labels):
    assert counts.value_counts(labels, "c").count() == 33
    assert counts.value_counts(labels, "c", null_as="").count() == 34
    found = counts.distribution(labels, "c").first()
    assert (found["cluster_count"], found["total"]) == (32, 97)
    ranked = {r["c"]: (r["cluster"], r["term"]) for r in counts.rank_clusters(labels, "c", 31).collect()}
    assert ranked["c00"] == (0, "c00") and ranked[None] == (-1, "Other") and ranked["c32"] == (-1, "Other")


def test_codes_lookup_histogram(spark, labels):
    codes = {r["label"]: r["code"] for r in counts.category_codes(labels, "c").collect()}
    assert codes["c00"] == 0 and codes["null"] == 33
    pairs = spark.createDataFrame([("c00", "first")], "k string, term string")
    assert counts.lookup(labels, "c", pairs, "none").filter("term = 'first'").count() == 3
    assert sorted(map(tuple, counts.histogram(labels, "row_id", 0, 10, 2).collect())) == [(0, 5), (1, 6)]
    assert [r[0] for r in labels.select(counts.clipped(labels["c"], 2)).limit(1).collect()] == ["c0"]


def test_split_does_not_depend_on_partitions(labels):
    a = counts.split_mark(labels, "row_id").filter("is_train").select("row_id")
    b = counts.split_mark(labels.repartition(7), "row_id").filter("is_train").select("row_id")
    assert sorted(a.collect()) == sorted(b.collect()) and 60 < a.count() < 95


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "a", None, True), (None, "b", None, False), (float("nan"), "a", None, True), (3.0, None, None, None)], "x double, `s.t` string, z double, b boolean")
    found = {r["name"]: r.asDict() for r in profile.columns(df).collect()}
    assert found["x"] == {"name": "x", "dtype": "double", "unique_count": 2, "non_null": 2, "min": 1.0, "max": 3.0, "mean": 2.0}
    assert (found["z"]["min"], found["z"]["mean"], found["z"]["non_null"]) == (None, None, 0)
    assert found["b"]["max"] == 1.0 and found["s.t"]["min"] is None
    stats = {s["name"]: s for s in profile.column_stats(df)}
    assert stats["s.t"]["top_values"] == [("a", 2), ("b", 1)] and "top_values" not in stats["x"]
    assert {r["name"]: r["nulls"] for r in profile.null_counts(df).collect()} == {"x": 2, "s.t": 1, "z": 4, "b": 1}
    assert profile.summary(None)["rows"] == 0 and profile.summary(df)["null_counts"]["z"] == 4
    assert profile.columns(df, approximate=True).count() == 4
