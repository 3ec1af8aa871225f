"""An analysis session: a dataset, its filtered view, and the results of analyses."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.session import name, written
from tessera.operators import association, chart, cluster, counts, embedding, filters, profile, reduce, text
from tessera.operators.filters import FilterSpec
from tessera.sources import files

KEY = "row_id"


class Session:
    """Holds DataFrames only; jobs run when a result is asked for."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.raw: DataFrame | None = None
        self.filtered: DataFrame | None = None
        self.key = KEY
        self.found: dict[str, Any] | None = None

    def health(self) -> dict[str, str]:
        return {"status": "ok", "spark": self.spark.version}

    def _hold(self, df: DataFrame, key: str | None) -> dict[str, Any]:
        # a new dataset makes earlier results void
        self.key = key or KEY
        # numbered once: what joins on the numbers reads them, whatever is evaluated again
        self.raw = df if key else written(df.withColumn(KEY, F.monotonically_increasing_id()), "rows")
        self.filtered, self.found = None, None
        return files.to_json(self.raw, self.key)

    def load(self, path: str, key: str | None = None, rows: int = 10_000) -> dict[str, Any]:
        """The first rows of a file, by key, without embeddings; rows may be up to 50000."""
        if not 0 <= rows <= 50_000:
            raise ValueError("rows must be from 0 to 50000")
        df = files.read(self.spark, path)
        return self._hold(filters.head(df, key, rows) if key else df.drop("embeddings").limit(rows), key)

    def upload(self, path: str, key: str | None = None) -> dict[str, Any]:
        """A whole file of a supported kind."""
        return self._hold(files.read(self.spark, path), key)

    def data(self) -> DataFrame:
        """The filtered rows, or all."""
        if self.raw is None:
            raise ValueError("no data loaded")
        return self.raw if self.filtered is None else self.filtered

    def filter(self, specs: Iterable[FilterSpec]) -> dict[str, Any]:
        """Filter the raw rows anew; no specs: all rows again."""
        if self.raw is None:
            raise ValueError("no data loaded")
        specs = list(specs)
        self.filtered = filters.apply_filters(self.raw, specs) if specs else None
        return files.to_json(self.data(), self.key) | {"stats": profile.column_stats(self.data())}

    def columns(self) -> list[dict[str, Any]]:
        return profile.column_stats(self.data())

    def summary(self) -> dict[str, Any]:
        found = profile.summary(self.raw, len(self.found["columns"]) if self.found else 0)
        return found | {"filtered": self.filtered is not None}

    def analyze(self, columns: list[str], top: int = 32) -> dict[str, Any]:
        """Distributions and clusters by value of the known columns; with two or more, association and importance."""
        df = self.data()
        known = [c for c in columns if c in df.columns]
        found: dict[str, Any] = {"columns": known, "distributions": {c: counts.distribution(df, c, cap=top) for c in known}}
        terms = df.select(name(self.key).alias(KEY))
        for c in known:
            ranked = counts.rank_clusters(df.select(name(self.key).alias(KEY), name(c)), c, top)
            terms = terms.join(ranked.select(KEY, F.col("term").alias(f"Analyzer_{c}")), KEY)
        found["terms"] = terms
        if len(known) > 1:
            analyzed = [f"Analyzer_{c}" for c in known]
            plain = lambda c: F.replace(c, F.lit("Analyzer_"), F.lit("")).alias(c)
            matrix = association.cramers_matrix(terms, analyzed)
            found["association"] = matrix.select(*(plain(c) if c in ("col_a", "col_b") else c for c in matrix.columns))
            rated = association.code_correlation(terms, analyzed[0], analyzed[1:])
            found["importance"] = rated.select(*(plain(f.name) if f.dataType.simpleString() == "string" else f.name for f in rated.schema))
        self.found = found
        return found

    def results(self) -> dict[str, Any] | None:
        """The last analysis."""
        return self.found

    def themes(
        self, column: str, vectors: DataFrame | None = None, min_cluster_size: int = 15, top_n: int = 1, similarity: float = 0.92,
        embed: str | embedding.Client = "ngrams", trim: int | None = None,
    ) -> dict[str, DataFrame]:
        """Embed, reduce, cluster, name and merge a text column; assigned rows, terms and scatter points.

        vectors (id, v): embeddings by key. Else embed gives them: "ngrams" (hashed character n-grams),
        "trained" (on the texts themselves), or a client of a model. trim: also "revised", the column with
        the labels that are not among so many most frequent ones as Other.
        """
        df = self.data()
        texts = df.select(name(self.key).alias(KEY), name(column).cast("string").alias("text"))
        if vectors is None:
            known = texts.filter("text IS NOT NULL")
            if embed == "ngrams":
                vectors = text.term_vectors(known.select(F.col(KEY).alias("label"), F.col("text").alias("term")))
            elif embed == "trained":
                vectors = embedding.trained_vectors(known.select(F.col(KEY).alias("id"), "text"))
            elif callable(embed):
                vectors = written(embedding.client_vectors(known.select(F.col(KEY).alias("id"), "text"), embed), "vectors")
            else:
                raise ValueError(f"unknown embedding {embed!r}")
        reduced = reduce.reduce_dimensions(vectors)
        labels = cluster.cluster(reduced.select("id", F.col("reduced").alias("v")), min_cluster_size=min_cluster_size)
        labels = labels.select(F.col("id").alias(KEY), "label")
        names = text.cluster_names(text.cluster_terms(text.tfidf(texts, KEY, "text"), labels), top_n).select("label", F.col("name").alias("term"))
        assigned = text.merge_clusters(names, labels, similarity=similarity)
        points = reduced.select(F.col("id").alias(KEY), F.get("reduced", 0).alias("x"), F.get("reduced", 1).alias("y"))
        found = {"assigned": assigned, "terms": names, "scatter": chart.scatter(points, assigned.select(KEY, "term"), texts)}
        if trim is not None:
            found["revised"] = counts.top_n_other(df.select(name(self.key), name(column)), column, trim)
        return found

    def ask(self, question: str | None, column: str, client: Callable[[str], str]) -> str:
        """A language model's answer about the first 500 texts of a column."""
        df = self.data()
        if column not in df.columns:
            raise ValueError(f"unknown column {column!r}")
        return client(text.prompt(question, text.context(df, column, self.key).first()["text"]))
