import math

import pytest

from tessera.operators import parse, text


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "Été été the cat"), (2, "cat dog x"), (3, None)], "row_id long, s string")
    found = {(r["row_id"], r["term"]): r["tfidf"] for r in text.tfidf(df, "row_id", "s").collect()}
    cat, rare = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    assert math.isclose(found[1, "été"], 2 * rare / math.hypot(2 * rare, cat)) and (2, "x") not in found and (1, "the") not in found
    assert math.isclose(sum(v * v for (i, _), v in found.items() if i == 2), 1)
    assert {t for _, t in ((r["row_id"], r["term"]) for r in text.tfidf(df, "row_id", "s", max_features=1).collect())} == {"cat"}


def test_names_put_the_best_last_and_skip_noise(spark):
    weights = spark.createDataFrame([(1, "aa", 0.9), (1, "bb", 0.5), (2, "bb", 0.1), (3, "cc", 1.0)], "row_id long, term string, tfidf double")
    assigned = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "row_id long, label int")
    scores = text.cluster_terms(weights, assigned)
    assert {(r["term"], r["score"]) for r in scores.collect()} == {("aa", 0.45), ("bb", 0.3)}
    assert [tuple(r) for r in text.cluster_names(scores, 2).collect()] == [(0, "bb-aa")]


def test_merge_is_one_hop_to_the_largest(spark):
    terms = spark.createDataFrame([(0, "aaaa"), (1, "aaab"), (2, "aabb")], "label int, term string")
    assigned = spark.createDataFrame([(10, 0), (11, 1), (12, 2), (13, -1)], "row_id long, label int")
    merged = {r["row_id"]: r["term"] for r in text.merge_clusters(terms, assigned, "levenshtein", distance=1).collect()}
    assert merged == {10: "aaaa", 11: "aaaa", 12: "aaab", 13: "Noise"}
    same = text.merge_clusters(spark.createDataFrame([(0, "red cat"), (1, "red cats"), (2, "dog")], "label int, term string"), assigned, similarity=0.7)
    assert {r["row_id"]: r["term"] for r in same.collect()} == {10: "red cat", 11: "red cat", 12: "dog", 13: "Noise"}
    with pytest.raises(ValueError):
        text.merge_clusters(terms, assigned, "other")


@pytest.mark.parametrize("block", [1000, 3])
def test_cosine_blocks_equal_the_column_form(spark, block):
    rows = [(k, [float((k * 7 + j * 3) % 5) for j in range(4)]) for k in range(12)] + [(50, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = df.alias("a").join(df.alias("b"), text.F.col("a.id") < text.F.col("b.id"))
    want = pairs.select(text.F.col("a.id"), text.F.col("b.id"), text.cosine(text.F.col("a.v"), text.F.col("b.v")).alias("c")).filter("c >= 0.9 - 1e-12").collect()
    got = text.cosine_pairs(df, 0.9, block).collect()
    assert {(r[0], r[1]) for r in got} == {(r[0], r[1]) for r in want} and len(got) == len(want) > 0
    top = text.cosine_search(df.filter("id = 0"), df, 3).collect()
    assert len(top) == 3 and all(r["id"] != 0 for r in top)


def test_context_and_prompt(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, " "), (4, None), (5, "c")], "row_id long, s string")
    assert tuple(text.context(df, "s", "row_id", 2).first()) == (2, "a\nb")
    assert tuple(text.context(df, "s", "row_id", None).first()) == (3, "a\nb\nc")
    assert text.prompt("  ", "x").startswith(text.QUESTION) and text.prompt("Why?", "x") == "Why?\nAnswer based on this context: x\n\n"
    shown = df.limit(1).select(text.markdown_quote(text.F.lit("• a\nb")), text.last_part(text.F.lit("a.b.c"))).first()
    assert tuple(shown) == (">   * a\n> b", "c")


def test_lenient_json(spark):
    rows = [(1, '{"a": {"b": 1}}'), (2, "{'a': {'b': 2}}"), (3, '{"a": '), (4, ""), (5, None), (6, '{"a": 1} x')]
    df = spark.createDataFrame(rows, "row_id long, r string")
    assert {r["row_id"]: r["status"] for r in parse.lenient_json(df, "r").collect()} == {1: "strict", 2: "repaired", 3: "failed", 4: "failed", 5: "failed", 6: "failed"}


def test_flatten_unites_schemas(spark):
    rows = [(1, '{"x": {"a": {"b": 1}, "l": [1, 2]}}'), (2, '{"x": {"a": {"c": "z"}, "d": true}}'), (3, '{"y": 1}'), (4, "broken")]
    df = spark.createDataFrame(rows, "row_id long, r string")
    flat = parse.flatten(df, "row_id", "r", "x")
    assert set(flat.columns) == {"row_id", "a.b", "a.c", "l", "d"}
    found = {r["row_id"]: r for r in flat.collect()}
    assert found[1]["a.b"] == 1 and found[1]["l"] == [1, 2] and found[1]["a.c"] is None and found[2]["a.c"] == "z" and set(found) == {1, 2}


def test_last_answer_stays_and_retries(spark):
    df = spark.createDataFrame([("k", 1), ("k", 3), ("j", 2)], "d string, n int")
    assert sorted(map(tuple, parse.dedupe_last(df, "d", "n").collect())) == [("j", 2), ("k", 3)]
    waits, calls = [], []

    def flaky(t):
        calls.append(t)
        if len(calls) < 4:
            raise OSError
        return t.upper()

    assert parse.with_retry(flaky, sleep=waits.append)("x") == "X" and waits == [5.0, 10.0, 20.0]
    waits.clear()
    calls.clear()
    assert parse.with_retry(lambda t: 1 / 0, sleep=waits.append)("x") is None and waits == [5, 10, 20, 40, 80, 160, 320, 600, 600]
    answers = parse.ask(df, "d", lambda: lambda t: f'{{"x": "{t}"}}', parallel=2)
    assert sorted(map(tuple, answers.collect())) == [("j", '{"x": "j"}'), ("k", '{"x": "k"}')]
