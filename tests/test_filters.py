import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import filters
from tessera.operators.filters import FilterSpec


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "a"), (2, "A "), (3, ""), (4, None), (5, "nan")], "row_id long, s string")


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, float("nan")), (5, 3.0)], "row_id long, x double")


def test_text(texts):
    assert ids(filters.apply_filters(texts, [FilterSpec("s", "text", pattern="a")])) == [1, 2, 5]
    assert ids(filters.apply_filters(texts, [FilterSpec("s", "text", pattern="a", case_sensitive=True)])) == [1, 5]
    assert ids(filters.apply_filters(texts, [FilterSpec("s", "text", pattern="")])) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception):
        filters.apply_filters(texts, [FilterSpec("s", "text", pattern="(")])


def test_categorical(texts):
    assert ids(filters.apply_filters(texts, [FilterSpec("s", "categorical", values=[])])) == []
    assert ids(filters.apply_filters(texts, [FilterSpec("s", "categorical", values=["a", None])])) == [1, 4]
    assert ids(filters.apply_filters(texts, [FilterSpec("row_id", "categorical", values=[2, "3"])])) == [2, 3]


def test_ranges_include_both_ends(numbers):
    assert ids(filters.apply_filters(numbers, [FilterSpec("x", "numeric", min_val=1, max_val=2)])) == [1, 2]
    assert ids(filters.apply_filters(numbers, [FilterSpec("x", "numeric", min_val=0, max_val=float("inf"))])) == [1, 2, 5]
    assert ids(filters.apply_filters(numbers, [FilterSpec("x", "numeric", min_val=2)])) == [1, 2, 3, 4, 5]


def test_unknown_and_none(numbers):
    assert filters.apply_filters(numbers, []) is numbers
    assert ids(filters.apply_filters(numbers, [FilterSpec("y", "numeric", min_val=0, max_val=1)])) == [1, 2, 3, 4, 5]


def test_midnight_is_the_end_of_a_range(spark):
    df = spark.sql("SELECT 1L row_id, timestamp_ntz'2024-01-02 00:00:00' t UNION ALL SELECT 2L, timestamp_ntz'2024-01-02 00:01:00'")
    spec = FilterSpec("t", "date", min_val=datetime.datetime(2024, 1, 1), max_val=datetime.datetime(2024, 1, 2))
    assert ids(filters.apply_filters(df, [spec])) == [1]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = filters.apply_filters(df, [FilterSpec("l_quantity", "numeric", min_val=10, max_val=20)]).select("l_orderkey")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_odd_names(spark):
    df = spark.createDataFrame([(1, "x", "y"), (2, "z", "y")], "row_id long, `a.b` string, `a b` string")
    assert ids(filters.apply_filters(df, [FilterSpec("a.b", "text", pattern="x"), FilterSpec("a b", "categorical", values=["y"])])) == [1]


def test_dates_are_promoted_only_if_all_read(spark):
    df = spark.createDataFrame([("2024-01-02", "01/02/2024", "2024-01-02", None), (None, "03/04/2024", "junk", None)], "a string, b string, c string, d string")
    assert [t for _, t in filters.promote_dates(df).dtypes] == ["timestamp_ntz", "timestamp_ntz", "string", "string"]


def test_kinds_sort_and_page(texts, numbers):
    assert [filters.filter_kind(texts, "row_id"), filters.filter_kind(texts, "s")] == ["numeric", "text"]
    assert filters.suggest_kind({"top_values": [("a", 1)]}) == "categorical" and filters.suggest_kind({"min": 0}) == "numeric" and filters.suggest_kind({}) == "text"
    assert [r["row_id"] for r in filters.sort_rows(texts, "s", "desc", "row_id").collect()][-1] == 4
    assert [r["row_id"] for r in filters.sort_rows(texts, "s", "asc", "row_id").collect()][-1] == 4
    assert [r["row_id"] for r in filters.page(filters.sort_rows(texts, "s", None, "row_id"), 1, 2).collect()] == [3, 4]
    assert filters.filtered_pct(texts, texts.limit(0)).first()["pct"] == 0 and filters.filtered_pct(texts.limit(0), texts.limit(0)).first()["pct"] == 0
    assert ids(filters.non_blank(texts, "s")) == [1, 2, 5] and ids(filters.non_empty(texts, "s")) == [1, 2, 5]
    with pytest.raises(ValueError):
        filters.head(numbers, "row_id", -1)
    assert filters.head(numbers.withColumn("embeddings", F.array(F.lit(1))), "row_id", 2).columns == ["row_id", "x"]
