"""Queries of the library's own operators, with SQL that gives the same rows."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.session import shared_folder, table
from tessera.operators import association, chart, cluster, counts, filters, model, parse, profile, reduce, search, text, warping
from tessera.operators.filters import FilterSpec
from tessera.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def r6(column: str | Column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


# scans, filters, order


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return filters.head(table(spark, d, "documents"), "doc_id", 100, drop=("text",))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_categorical(spark: SparkSession, d: str) -> DataFrame:
    spec = FilterSpec("c_mktsegment", "categorical", values=["BUILDING", "MACHINERY"])
    return filters.apply_filters(table(spark, d, "customer"), [spec]).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE false")
def filter_categorical_empty(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply_filters(table(spark, d, "customer"), [FilterSpec("c_mktsegment", "categorical", values=[])]).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000")
def filter_numeric_range(spark: SparkSession, d: str) -> DataFrame:
    spec = FilterSpec("o_totalprice", "numeric", min_val=1000.0, max_val=200000.0)
    return filters.apply_filters(table(spark, d, "orders"), [spec]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'A[a-z]*e', 'i')")
def filter_regex_ci(spark: SparkSession, d: str) -> DataFrame:
    return filters.apply_filters(table(spark, d, "part"), [FilterSpec("p_name", "text", pattern="A[a-z]*e")]).select("p_partkey", "p_name")


@query("SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, 'The [a-z]+ing')")
def filter_regex_cs(spark: SparkSession, d: str) -> DataFrame:
    spec = FilterSpec("text", "text", pattern="The [a-z]+ing", case_sensitive=True)
    return filters.apply_filters(table(spark, d, "documents"), [spec]).select("doc_id", "n_chars")


@query("SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-15'")
def filter_date_range(spark: SparkSession, d: str) -> DataFrame:
    spec = FilterSpec("ts", "date", min_val=datetime.datetime(2024, 1, 1), max_val=datetime.datetime(2024, 1, 15))
    return filters.apply_filters(table(spark, d, "events"), [spec]).select("event_id", "user_id")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND regexp_matches(l_linestatus, 'f', 'i')""")
def filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    specs = [
        FilterSpec("l_quantity", "numeric", min_val=10, max_val=20), FilterSpec("l_returnflag", "categorical", values=["A", "R"]),
        FilterSpec("l_linestatus", "text", pattern="f"), FilterSpec("unknown", "text", pattern="x"), FilterSpec("l_tax", "numeric", min_val=0),
    ]
    return filters.apply_filters(table(spark, d, "lineitem"), specs).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT count(*) AS n_before, count(*) FILTER (o_orderstatus = 'F') AS n_after,
round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 6)::DOUBLE AS pct FROM orders""")
def filtered_pct(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    kept = filters.apply_filters(orders, [FilterSpec("o_orderstatus", "categorical", values=["F"])])
    return filters.filtered_pct(orders, kept).withColumn("pct", r6("pct"))


NULLED = "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer"


def _nulled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))


@query(f"SELECT c_custkey, bal, row_number() OVER (ORDER BY bal DESC NULLS LAST, c_custkey) AS place FROM ({NULLED})")
def sort_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """The place of each row in the sorted table."""
    key = F.struct(F.col("bal").isNull().alias("n"), (-F.col("bal")).alias("b"), "c_custkey")
    ordered = filters.sort_rows(_nulled(spark, d), "bal", "desc", "c_custkey")
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(key)))


@query(f"SELECT c_custkey, bal FROM ({NULLED}) ORDER BY bal NULLS LAST, c_custkey LIMIT 100 OFFSET 100")
def page_2(spark: SparkSession, d: str) -> DataFrame:
    return filters.page(filters.sort_rows(_nulled(spark, d), "bal", "asc", "c_custkey"), 1)


SEGMENT = "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer"


@query(f"SELECT c_custkey, segment FROM ({SEGMENT}) WHERE segment IN ('BUILDING', 'FURNITURE') OR segment IS NULL")
def filter_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return filters.apply_filters(segments, [FilterSpec("segment", "categorical", values=["BUILDING", None, "FURNITURE"])])


@query("SELECT conv_id, turn FROM (SELECT *, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE text END AS said FROM conversations) WHERE said <> ''")
def non_empty(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, " ").otherwise(F.col("text"))
    return filters.non_empty(table(spark, d, "conversations").withColumn("said", said), "said").select("conv_id", "turn")


@query("SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS seen, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'none' END AS day FROM events")
def promoted_dates(spark: SparkSession, d: str) -> DataFrame:
    """A text column of which all values are dates becomes a timestamp, one of which some are stays text."""
    texts = table(spark, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("none").alias("day")
    )
    return filters.promote_dates(texts)


@query("SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal FROM customer")
def csv_read(spark: SparkSession, d: str) -> DataFrame:
    """The customers, written as CSV and read with types."""
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}.csv"
    table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal")).write.csv(path, header=True, escape='"')
    return files.read(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


# counts


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.value_counts(table(spark, d, "events"), "event_type")


@query("SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
def top10(spark: SparkSession, d: str) -> DataFrame:
    return counts.value_counts(table(spark, d, "part"), "p_name", 10)


OTHER = """WITH c AS (SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1),
t AS (SELECT label FROM c ORDER BY n DESC, label LIMIT 32),
g AS (SELECT CASE WHEN label IN (SELECT label FROM t) THEN label ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1) """


@query(OTHER + "SELECT label, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM g")
def top_n_other(spark: SparkSession, d: str) -> DataFrame:
    return counts.top_n_counts(table(spark, d, "part"), "p_name").withColumn("share", r6("share"))


@query(OTHER + ", x AS (SELECT p_partkey, p_name FROM part) SELECT p_partkey, CASE WHEN p_name IN (SELECT label FROM t) THEN p_name ELSE 'Other' END AS p_name_revised FROM x")
def top_n_rows(spark: SparkSession, d: str) -> DataFrame:
    return counts.top_n_other(table(spark, d, "part"), "p_name").select("p_partkey", "p_name_revised")


@query(OTHER + ", s AS (SELECT *, n / sum(n) OVER () AS share FROM g) SELECT label, n, round(share, 6)::DOUBLE AS share, format('{}\n {:.1f}%', label, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM g), 1)) AS caption FROM s")
def treemap(spark: SparkSession, d: str) -> DataFrame:
    return counts.treemap(table(spark, d, "part"), "p_name").withColumn("share", r6("share"))


@query("""SELECT coalesce(p_name, '') AS label, count(*) AS n, least(32, (SELECT count(DISTINCT coalesce(p_name, '')) FROM part)) AS cluster_count,
(SELECT count(*) FROM part) AS total FROM part GROUP BY 1 ORDER BY n DESC, label LIMIT 20""")
def distribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return counts.distribution(table(spark, d, "part"), "p_name")


@query("""WITH r AS (SELECT p_name, row_number() OVER (ORDER BY count(*) DESC, p_name) - 1 AS k FROM part GROUP BY p_name)
SELECT p_partkey, CAST(CASE WHEN k < 32 THEN k ELSE -1 END AS INTEGER) AS cluster, CASE WHEN k < 32 THEN p_name ELSE 'Other' END AS term FROM part JOIN r USING (p_name)""")
def rank_cluster_assign(spark: SparkSession, d: str) -> DataFrame:
    return counts.rank_clusters(table(spark, d, "part"), "p_name").select("p_partkey", "cluster", "term")


@query("SELECT o_orderpriority AS label, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    return counts.category_codes(table(spark, d, "orders"), "o_orderpriority")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'Noise' END AS term FROM orders""")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("F", "filled"), ("O", "open")], "k string, term string")
    return counts.lookup(table(spark, d, "orders"), "o_orderstatus", pairs, "Noise").select("o_orderkey", "term")


@query("""SELECT CAST(least(floor((l_quantity - 0) / (50.0::DOUBLE / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return counts.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 10)


@query()
def hash_split_count(spark: SparkSession, d: str) -> DataFrame:
    """Rows on either side of the seeded split."""
    return counts.split_mark(table(spark, d, "orders"), "o_orderkey").groupBy("is_train").agg(F.count("*").alias("n"))


# profiles

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean FROM lineitem" for c in LINE))
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    return profile.columns(table(spark, d, "lineitem"), LINE).select("name", *(r6(c).alias(c) for c in ("min", "max", "mean")))


ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS unique_count, count({c}) AS non_null FROM orders" for c in ORDER))
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.columns(table(spark, d, "orders"), ORDER).select("name", "unique_count", "non_null")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS nulls FROM ({NULLED})" for c in ("c_custkey", "bal")))
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.null_counts(_nulled(spark, d))


# association


def _grid(relation: str, a: str, b: str) -> str:
    return f"""WITH x AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {relation}),
n AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), r AS (SELECT a, CAST(sum(n) AS BIGINT) AS rn FROM n GROUP BY 1), c AS (SELECT b, CAST(sum(n) AS BIGINT) AS cn FROM n GROUP BY 1),
s AS (SELECT sum(n)::DOUBLE AS total, (SELECT count(*) FROM r) AS k, (SELECT count(*) FROM c) AS m FROM n),
g AS (SELECT a, b, coalesce(n.n, 0) AS n, rn * cn / total AS e, total, k, m FROM r CROSS JOIN c CROSS JOIN s LEFT JOIN n USING (a, b)),
y AS (SELECT *, CASE WHEN k = 2 AND m = 2 THEN abs(n - e) - least(0.5, abs(n - e)) ELSE abs(n - e) END AS o FROM g),
q AS (SELECT sum(o * o / e) AS chi2, max((k - 1) * (m - 1)) AS dof, max(total) AS total, max(k) AS k, max(m) AS m FROM y),
v AS (SELECT chi2, dof, total, k, m, greatest(0, chi2 / total - (k - 1) * (m - 1) / (total - 1)) AS phi,
  least(m - (m - 1) * (m - 1) / (total - 1), k - (k - 1) * (k - 1) / (total - 1)) - 1 AS base FROM q) """


def _tested(df: DataFrame, a: str, b: str) -> DataFrame:
    found = association.cramers_v(association.pair_counts(df, [a, b]))
    return found.select(r6("chi2").alias("chi2"), F.col("dof").cast("long").alias("dof"), r6("v").alias("v"))


V = "SELECT round(chi2, 6) AS chi2, CAST(dof AS BIGINT) AS dof, round(CASE WHEN base > 0 THEN sqrt(phi / base) ELSE 0 END, 6)::DOUBLE AS v FROM v"


@query(_grid("orders", "o_orderstatus", "o_orderpriority") + "SELECT a, b, n FROM g")
def contingency_dense(spark: SparkSession, d: str) -> DataFrame:
    return association.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(_grid("orders", "o_orderstatus", "o_orderpriority") + V)
def chi_square_rxk(spark: SparkSession, d: str) -> DataFrame:
    return _tested(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(_grid("labels", "quality", "toxic") + V)
def chi_square_2x2_yates(spark: SparkSession, d: str) -> DataFrame:
    return _tested(table(spark, d, "labels"), "quality", "toxic")


@query(_grid("(SELECT role, turn % 2 AS odd FROM conversations)", "role", "odd") + V)
def cramers_v_pair(spark: SparkSession, d: str) -> DataFrame:
    return _tested(table(spark, d, "conversations").withColumn("odd", F.col("turn") % 2), "role", "odd")


@query(_grid("(SELECT n_regionkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)", "n_regionkey", "c_nationkey") + V)
def cramers_v_nations(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return _tested(joined, "n_regionkey", "c_nationkey")


def _v(a: str, b: str) -> str:
    one = _grid("(SELECT role, turn % 2 AS odd, turn % 4 AS quarter FROM conversations)", a, b)
    return f"(SELECT round(CASE WHEN base > 0 THEN sqrt(phi / base) ELSE 0 END, 3)::DOUBLE AS v FROM ({one} SELECT * FROM v))"


@query(
    " UNION ALL ".join(
        f"SELECT '{x}' AS col_a, '{y}' AS col_b, v FROM {_v(a, b)}"
        for a, b in (("role", "odd"), ("role", "quarter"), ("odd", "quarter"))
        for x, y in ((a, b), (b, a))
    )
    + " UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES ('role'), ('odd'), ('quarter')) t(c)"
)
def cramers_v_matrix(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumns({"odd": F.col("turn") % 2, "quarter": F.col("turn") % 4})
    return association.cramers_matrix(turns, ["role", "odd", "quarter"])


# chi-square at 5 % by degrees of freedom
CRITICAL = "CASE dof WHEN 1 THEN 3.841458820694124 WHEN 2 THEN 5.991464547107979 WHEN 4 THEN 9.487729036781154 END"
THIRDS = "(SELECT role, turn % 2 AS odd, conv_id % 3 AS third FROM conversations)"


def _gated(a: str, b: str) -> str:
    return f"(SELECT round(CASE WHEN base > 0 AND chi2 > {CRITICAL} THEN sqrt(phi / base) ELSE 0 END, 3)::DOUBLE AS v FROM ({_grid(THIRDS, a, b)} SELECT * FROM v))"


def _thirds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumns({"odd": F.col("turn") % 2, "third": F.col("conv_id") % 3})


@query(
    " UNION ALL ".join(f"SELECT '{x}' AS col_a, '{y}' AS col_b, v FROM {_gated(a, b)}" for a, b in (("role", "odd"), ("role", "third"), ("odd", "third")) for x, y in ((a, b), (b, a)))
    + " UNION ALL SELECT c, c, 1.0::DOUBLE FROM (VALUES ('role'), ('odd'), ('third')) t(c)"
)
def cramers_significant(spark: SparkSession, d: str) -> DataFrame:
    return association.cramers_matrix(_thirds(spark, d), ["role", "odd", "third"], significance=0.05)


@query(" UNION ALL ".join(f"SELECT '{max(a, b)}' AS col_a, '{min(a, b)}' AS col_b, v FROM {_gated(a, b)}" for a, b in (("role", "odd"), ("role", "third"), ("odd", "third"))))
def cramers_triangle(spark: SparkSession, d: str) -> DataFrame:
    return chart.triangle(association.cramers_matrix(_thirds(spark, d), ["role", "odd", "third"], significance=0.05))


@query(_grid("orders", "o_orderstatus", "o_orderpriority") + "SELECT a, b, n, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS residual FROM g")
def pearson_residuals(spark: SparkSession, d: str) -> DataFrame:
    found = association.residuals(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return found.withColumns({"expected": r6("expected"), "residual": r6("residual")})


@query("""WITH x AS (SELECT dense_rank() OVER (ORDER BY role) AS r, dense_rank() OVER (ORDER BY CAST(turn % 2 AS VARCHAR)) AS o, 1 AS one FROM conversations)
SELECT 'odd' AS feature, round(coalesce(abs(corr(r, o)), 0), 3) AS importance FROM x UNION ALL SELECT 'one', 0.0::DOUBLE""")
def code_corr(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumns({"odd": F.col("turn") % 2, "one": F.lit(1)})
    return association.code_correlation(turns, "role", ["odd", "one"])


@query("SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return association.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM labels")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return association.accuracy(table(spark, d, "labels"), "quality", "toxic").withColumn("accuracy", r6("accuracy"))


# text


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' ORDER BY k LIMIT 500)
SELECT count(*) AS n, md5(string_agg(text, chr(10) ORDER BY k)) AS digest FROM t""")
def nonblank_context(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return text.context(turns, "text", "k").select("n", F.md5("text").alias("digest"))


NAMES = "WITH n AS (SELECT p_name AS term, row_number() OVER (ORDER BY p_name) - 1 AS label FROM (SELECT DISTINCT p_name FROM part))"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return counts.category_codes(table(spark, d, "part"), "p_name").select(F.col("code").alias("label"), F.col("label").alias("term"))


LEV = NAMES + ", p AS (SELECT a.label AS i, b.label AS j, levenshtein(a.term, b.term) AS distance FROM n a JOIN n b ON a.label < b.label AND levenshtein(a.term, b.term) <= 3)"


@query(LEV + " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(distance AS INTEGER) AS distance FROM p")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    return text.near_terms(_names(spark, d))


@query(LEV + """, m AS (SELECT j AS label, max(i) AS i FROM p GROUP BY 1), z AS (SELECT n.label, coalesce(m.i, n.label) AS merged FROM n LEFT JOIN m USING (label))
SELECT p_partkey, t.term FROM part JOIN n ON p_name = n.term JOIN z ON z.label = n.label JOIN n t ON t.label = z.merged""")
def merge_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    terms = _names(spark, d)
    assigned = table(spark, d, "part").join(terms, F.col("p_name") == F.col("term")).select(F.col("p_partkey").alias("row_id"), "label")
    return text.merge_clusters(terms, assigned, "levenshtein").select(F.col("row_id").alias("p_partkey"), "term")


@query("""SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return text.cosine_pairs(vectors, 0.4).withColumn("cosine", F.round("cosine", 4))


@query("""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c
FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s)
SELECT query, id, round(c, 4) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return text.cosine_search(vectors.filter("id % 50 = 0"), vectors).withColumn("cosine", F.round("cosine", 4))


@query("""WITH m AS (SELECT b.vec_id AS label, max(a.vec_id) AS i FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4 GROUP BY 1)
SELECT vec_id, 't' || coalesce(m.i, vec_id) AS term FROM embeddings LEFT JOIN m ON m.label = vec_id""")
def merge_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a cluster of its own, merged into the last one before it that is like it."""
    vectors = _vectors(spark, d)
    terms = vectors.select(F.col("id").alias("label"), F.concat(F.lit("t"), F.col("id")).alias("term"))
    assigned = vectors.select(F.col("id").alias("row_id"), F.col("id").alias("label"))
    return text.merge_clusters(terms, assigned, similarity=0.4, vectors=vectors).select(F.col("row_id").alias("vec_id"), "term")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reverse(embedding)::DOUBLE[] AS w FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(greatest(list_cosine_similarity(a.v, b.v), list_cosine_similarity(a.v, b.w)), 9) AS c,
  round(list_cosine_similarity(a.v, b.v), 9) >= round(list_cosine_similarity(a.v, b.w), 9) AS first FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s)
SELECT query, id, CASE WHEN first THEN 'v' ELSE 'w' END AS "column", round(c, 4) AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten rows nearest to each fiftieth vector by either of two columns, exactly."""
    rows = _vectors(spark, d).select("id", "v", F.reverse("v").alias("w"))
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query"), "v")
    return search.search(search.index(rows, "id", ["v", "w"]), asked, 10, others_only=True).withColumn("cosine", F.round("cosine", 4))


@query("SELECT c_custkey, split_part(replace(c_name, '#', '.'), '.', -1) AS last FROM customer")
def last_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.last_part(F.replace("c_name", F.lit("#"), F.lit("."))).alias("last"))


TFIDF = f"""WITH t AS (SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
f AS (SELECT row_id, term, count(*) AS tf FROM t WHERE term NOT IN ({STOPS}) GROUP BY 1, 2),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM f GROUP BY 1 ORDER BY total DESC, term LIMIT 1000),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM v),
w AS (SELECT row_id, term, tf * idf AS w FROM f JOIN i USING (term)), l AS (SELECT row_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1),
x AS (SELECT row_id, term, w / l AS tfidf FROM w JOIN l USING (row_id)) """


@query(TFIDF + "SELECT row_id, term, round(tfidf, 6) AS tfidf FROM x")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    return text.tfidf(table(spark, d, "documents"), "doc_id", "text").withColumn("tfidf", r6("tfidf"))


@query(TFIDF + """, z AS (SELECT source, count(*) AS size FROM documents GROUP BY 1),
c AS (SELECT source, term, round(sum(tfidf) / max(size), 9) AS s FROM x JOIN documents ON row_id = doc_id JOIN z USING (source) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, term) AS k FROM c)
SELECT source AS label, string_agg(term, '-' ORDER BY k DESC) AS name FROM k WHERE k <= 2 GROUP BY 1""")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    weights = text.tfidf(docs, "doc_id", "text")
    return text.cluster_names(text.cluster_terms(weights, docs.select(F.col("doc_id").alias("row_id"), F.col("source").alias("label")), noise="-1"))


# answers of language models


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", parse.field(F.col("props"), "$.k", "bigint").alias("k"))


BROKEN = "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN replace(props, '\"', '''') ELSE substr(props, 2) END"


@query(f"""WITH b AS (SELECT {BROKEN} AS s FROM events)
SELECT CASE WHEN json_valid(s) THEN 'strict' WHEN json_valid(replace(s, '''', '"')) THEN 'repaired' ELSE 'failed' END AS status, count(*) AS n FROM b GROUP BY 1""")
def json_lenient(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    shown = F.when(F.col("event_id") % 3 == 0, p).when(F.col("event_id") % 3 == 1, F.replace(p, F.lit('"'), F.lit("'"))).otherwise(F.substring(p, 2, 10**6))
    return parse.lenient_json(table(spark, d, "events").select(shown.alias("s")), "s").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    wrapped = table(spark, d, "events").select("event_id", F.concat(F.lit('{"info":'), F.col("props"), F.lit("}")).alias("response"))
    return parse.flatten(wrapped, "event_id", "response", "info").select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT role, max(conv_id * 1000 + turn) AS k FROM conversations GROUP BY 1")
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("k"))
    return parse.dedupe_last(turns, "role", "k")


# models: no SQL


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query()
def pca2(spark: SparkSession, d: str) -> DataFrame:
    """Two principal components of all embeddings."""
    return reduce.pca(_vectors(spark, d)).select("id", r6(F.get("reduced", 0)).alias("x"), r6(F.get("reduced", 1)).alias("y"))


@query()
def umap_layout(spark: SparkSession, d: str) -> DataFrame:
    """The neighbour-graph layout of all embeddings."""
    return reduce.layout(_vectors(spark, d)).select("id", F.get("reduced", 0).alias("x"), F.get("reduced", 1).alias("y"))


@query()
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Ten clusters of all embeddings."""
    return cluster.kmeans(_vectors(spark, d), 10)


@query()
def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of all embeddings."""
    return cluster.density(_vectors(spark, d), 10)


@query()
def warped_users(spark: SparkSession, d: str) -> DataFrame:
    """Users whose events come and go alike, up to a shift by one of eight parts of the time."""
    series = warping.series_of(table(spark, d, "events"), "user_id", "ts", 8)
    return warping.warped_pairs(series, 1.0, 1)[0].withColumn("distance", r6("distance"))


@query()
def boosted_importance(spark: SparkSession, d: str) -> DataFrame:
    """Which columns of the turns predict the role, by the gain of boosted trees."""
    turns = table(spark, d, "conversations").select("role", (F.col("turn") % 2).alias("odd"), F.least("turn", F.lit(5)).alias("turn"), F.xxhash64("conv_id", "turn").alias("k"))
    return chart.scaled(model.train(turns, "role", ["odd", "turn"], "k", model="boosted", rounds=5).importance)


@query()
def near_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten near neighbours of all embeddings, with a measured recall of 0.9 and more."""
    return reduce.neighbours(_vectors(spark, d), 10, exact=False).select("i", "j", r6("d").alias("d"), "rank")


@query()
def forest_importance(spark: SparkSession, d: str) -> DataFrame:
    """Which columns of the turns predict the role."""
    turns = table(spark, d, "conversations").select("role", (F.col("turn") % 2).alias("odd"), F.least("turn", F.lit(5)).alias("turn"), F.xxhash64("conv_id", "turn").alias("k"))
    found = model.train(turns, "role", ["odd", "turn"], "k")
    return chart.scaled(found.importance)
