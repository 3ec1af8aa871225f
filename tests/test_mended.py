"""Cases that went wrong once."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import counts, filters, metric, parse, reduce, text
from tessera.plans.session import Session


def flat(spark, texts, under):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, s string")
    found = parse.flatten(rows, "id", "s", under)
    return found.columns, sorted(tuple(r) for r in found.collect())


def test_flatten_keeps_names_of_fields(spark):
    assert flat(spark, ['{"info":{"AVOID":1,"OBJECT<x":"y"}}'], "info") == (["id", "AVOID", "OBJECT<x"], [(0, 1, "y")])
    assert flat(spark, ['{"info":{"VOID":null,"a b":{"c.d":2}}}'], "info") == (["id", "VOID", "a b.c.d"], [(0, None, 2)])


def test_flatten_under_a_key_with_a_dot_or_quote(spark):
    assert flat(spark, ['{"a.b":{"c":1}}'], "a.b") == (["id", "c"], [(0, 1)])
    assert flat(spark, ["{\"a'b\":{\"c\":1}}"], "a'b") == (["id", "c"], [(0, 1)])


def test_batches_are_as_before(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    vectors = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(9)], "id long, v array<double>")
    assert text.cosine_pairs(vectors, 0.999).count() == 9
    assert reduce.neighbours(vectors, 2).count() == 18
    assert spark.conf.get(key) == before


def test_too_many_queries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(text, "MOST_QUERIES", 2)
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "id long, v array<double>")
    with pytest.raises(ValueError, match="in parts"):
        text.cosine_search(vectors, vectors)
    assert text.cosine_search(vectors.limit(2), vectors, 1).count() == 2


def test_prompts_and_context(spark):
    assert text.prompt(" ", "c") == "Summarize the following data in relevant bullet points\nAnswer based on this context: c\n\n"
    assert text.prompt("why?", "c", "notebook") == "why?\n Answer based on this context: c\n\n"
    assert len(text.QUICK_PROMPTS) == 5
    rows = spark.createDataFrame([(1, "a"), (2, " "), (3, ""), (4, None)], "k long, s string")
    assert text.context(rows, "s", "k").first()["n"] == 1
    assert text.context(rows, "s", "k", None, blanks=True).first()["text"] == "a\n "


def test_slider_and_bars(spark):
    rows = spark.createDataFrame([(1.0,), (5.0,), (None,)], "x double")
    assert filters.slider(rows, "x") == {"min_val": 1.0, "max_val": 5.0, "step": 0.04}
    assert filters.slider(rows.filter("x IS NULL"), "x") == {"min_val": None, "max_val": None, "step": None}
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(counts.bar_width(F.lit(1), F.lit(4)), counts.bar_width(F.lit(9), F.lit(4))))).collect()] == [25.0, 100.0]


def test_analysed_columns_have_plain_labels(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "p string, q string").write.parquet(str(tmp_path / "t.parquet"))
    session = Session(spark)
    session.load(str(tmp_path / "t.parquet"))
    found = session.analyze(["p", "q"])
    assert {r["col_a"] for r in found["association"].collect()} <= {"p", "q"}
    assert not any("Analyzer_" in str(v) for r in found["importance"].collect() for v in r)


def test_flatten_tells_keys_apart_by_case(spark):
    texts = ['{"x":{"Color":1,"size":{"W":1.5}}}', '{"x":{"color":2,"size":{"w":"wide"}}}', '{"x":{"COLOR":[1,null]}}', '{"x":null}', '{"x":7}']
    columns, rows = flat(spark, texts[:3], "x")
    assert columns == ["id", "COLOR", "Color_2", "color_3", "size.W", "size.w_2"]
    assert [tuple(None if c is None else str(c) for c in r) for r in rows] == [
        ("0", None, "1", None, "1.5", None), ("1", None, None, "2", None, "wide"), ("2", "[1, None]", None, None, None, None),
    ]
    assert flat(spark, texts[3:], "x")[0] == ["id"]


def test_flatten_gives_every_column_a_name_of_its_own(spark):
    assert flat(spark, ['{"x":{"a":{"b":1},"a.b":2,"ID":3}}'], "x") == (["id", "ID_2", "a.b", "a.b_2"], [(0, 3, 1, 2)])


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7)], "n long, k string, place int")
    for c in ("__n", "__k", "__label", "_place", "_label", "_key", "_term", "label", "cluster_"):
        df = df.withColumn(c, F.lit(c))
    last = parse.dedupe_last(df, "k", "n")
    assert last.columns == df.columns and sorted((r["n"], r["__n"], r["place"]) for r in last.collect()) == [(2, "__n", 6), (3, "__n", 7)]
    pairs = spark.createDataFrame([("a", "x")], "k string, term string")
    assert sorted((r["n"], r["term"], r["_key"]) for r in counts.lookup(df, "k", pairs, "?").collect()) == [(1, "x", "_key"), (2, "x", "_key"), (3, "?", "_key")]
    top = counts.top_n_other(df, "k", 1)
    assert [r["k_revised"] for r in top.orderBy("n").collect()] == ["a", "a", "Other"] and set(df.columns) <= set(top.columns)
    ranked = counts.rank_clusters(df, "k", 1)
    assert [(r["cluster"], r["term"], r["__label"]) for r in ranked.orderBy("n").collect()] == [(0, "a", "__label")] * 2 + [(-1, "Other", "__label")]


def test_merging_by_cosine_writes_no_pairs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(text, "cosine_pairs", lambda *a, **b: seen.append(a))
    vectors = spark.createDataFrame([(k, [float(k % 3), 1.0]) for k in range(9)], "id long, v array<double>")
    terms = vectors.select(F.col("id").alias("label"), F.concat(F.lit("t"), F.col("id")).alias("term"))
    rows = vectors.select(F.col("id").alias("row_id"), F.col("id").alias("label"))
    found = text.merge_clusters(terms, rows, similarity=0.999, vectors=vectors)
    assert {(r["row_id"], r["term"]) for r in found.collect()} == {(k, f"t{k if k < 3 else k - 3}") for k in range(9)} and not seen


def test_copies_are_merged_without_pairs_of_cells(spark, monkeypatch):
    """Each is like the one before it, so that no table of blocks is written and none meets another."""

    def refused(*a, **b):
        raise AssertionError("blocks meet")

    for name in ("cells", "packed", "block_met", "all_met"):
        monkeypatch.setattr(metric, name, refused)
    vectors = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    terms = vectors.select(F.col("id").alias("label"), F.concat(F.lit("t"), F.col("id")).alias("term"))
    rows = vectors.select(F.col("id").alias("row_id"), F.col("id").alias("label"))
    found = text.merge_clusters(terms, rows, similarity=0.999, vectors=vectors)
    assert {(r["row_id"], r["term"]) for r in found.collect()} == {(k, f"t{max(0, k - 1)}") for k in range(3000)}
