"""Small tables with the hard cases: nulls, empty and blank texts, repeated rows, long texts, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def sample_rows(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(80)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 25))).capitalize() + "." for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(lines), f"src{rng.randint(0, 3)}"))
    rows[7] = (7, rows[3][1], "src1")  # an exact copy
    rows[9] = (9, rows[3][1] + " Tail", "src2")
    rows += [(100, None, "src0"), (101, "", None), (102, " \t\n ", "src1"), (103, None, None), (None, "no id here at all", "src0"), (None, "other text without an id", "src2")]
    rows += [rows[5], rows[5]]  # repeated rows
    rows.append((104, " ".join(rng.choices(words, k=30_000)), "src3"))  # a very long text
    rows.append((105, "é ñ ß – … 漢字 Ünïcödé " * 5, "src3"))
    return rows


def clashing(df):
    """df with extra columns under names that the operators use inside."""
    for c in ("fp", "id", "key", "row", "size", "h", "n", "label", "features", "n_words", "score", "taken", "bucket", "payload", "n_lines", "a.b", "__id", "__text", "__lines", "__version", "__source", "__key", "__0", "_id", "_mark", "_text", "x y`z"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def records(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
