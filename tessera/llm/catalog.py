"""Queries of the training-data operators, with SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.session import table
from tessera.llm.html_text import main_text
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mixed
from tessera.llm.packing import pack
from tessera.llm.pii import BASE, KINDS, counted, find, shown
from tessera.llm.quality import COUNTS, quality
from tessera.llm.resampling import resample
from tessera.llm.simhash import near_duplicates
from tessera.llm.substring_dedup import substring_dedup
from tessera.llm.token_counts import token_counts
from tessera.llm.warc import archived
from tessera.llm.weighted_sampling import fingerprints as sampled
from tessera.llm.whitening import whiten


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their texts less the lines that an earlier document has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), vocabulary, with_ids=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes from each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under a byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans and those that contexts add."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(counted(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS[:BASE]),
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("all")).alias("spans"),
        F.size("all").cast("long").alias("n_spans"),
        (F.size("all") > 0).alias("has_pii"),
        F.size("learned").cast("long").alias("n_learned"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back, equal payloads once."""
    records = archived(table(spark, sf_dir, "pages"))
    page = lambda urn: F.try_element_at(F.split(urn, ":"), F.lit(4)).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for all documents."""
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "score")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return sampled(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred of the documents, drawn by importance towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without the 13-word windows that earlier ones have."""
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound embeddings on up to 32 principal components, with unit variance: a row for each component."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    rows = found.select("vec_id", F.posexplode("white").alias("at", "whitened"), "n", "deviation", "explained", "identity_error")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_fingerprints": op9_fingerprints,
    "op10_html_text": op10_html_text,
    "op11_resampling": op11_resampling,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_whitening": op13_whitening,
}

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17' || coalesce(':' || CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM s2),
f AS (SELECT min(i) AS i FROM s3 WHERE cap >= (total - capped) * weight / w),
l AS (SELECT total - capped AS rest, w FROM s3 JOIN f USING (i)),
g AS (SELECT source, source_size, least(cap, rest * weight / l.w) AS target FROM s3 LEFT JOIN l ON true),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
n AS (SELECT *, CAST(floor(target - whole * source_size) AS BIGINT) AS need FROM h),
kk AS (SELECT source, k, sum(size) AS n FROM d GROUP BY source, k),
c AS (SELECT source, k, n, sum(n) OVER (PARTITION BY source ORDER BY k) - n AS done FROM kk)
SELECT d.doc_id, d.size, n.source_size, n.target,
  CAST(n.whole * d.size + CASE WHEN c.done + c.n <= n.need THEN d.size
       WHEN c.done < n.need THEN floor(d.size * (n.need - c.done) / c.n::DOUBLE) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN f IS NOT NULL AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f IS NOT NULL AND page_id <> f THEN f END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

# crc32 is taken byte by byte over the distinct runs, with its public table made by its rule
OP11_SQL = r"""
WITH tbl AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n::BIGINT)) AS t),
a AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a),
r AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) AS f FROM w),
u AS (SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM (SELECT DISTINCT f FROM r)),
c AS (SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM u, tbl),
n AS (SELECT bucket, count(*) FILTER (side = 0)::DOUBLE AS s, count(*) FILTER (side = 1)::DOUBLE AS t FROM r JOIN c USING (f) GROUP BY bucket),
z AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM n),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (big_s + 10000)) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM n, z),
x AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM r JOIN c USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
s AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN x ON x.id = w.id WHERE side = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS many FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * many // 100 THEN place END AS rank FROM k
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i+12], ' ')) AS s FROM d),
k AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM g),
m AS (SELECT s, min(doc_id) AS f FROM k GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM k JOIN m USING (s) WHERE f < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
l AS (SELECT doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_left, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""

SQL = {"op4_mixing": OP4_SQL, "op7_warc": OP7_SQL, "op11_resampling": OP11_SQL, "op12_substring_dedup": OP12_SQL}
