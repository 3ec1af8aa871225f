"""Which columns predict another: tree models over category codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import name
from tessera.operators import boosting
from tessera.operators.association import accuracy, confusion, contingency, cramers_v, pair_counts, residuals
from tessera.operators.counts import split_mark


@dataclass
class Predictor:
    """A target's model: scored test rows, accuracy and the gain of each feature."""

    target: str
    scored: DataFrame
    accuracy: float | None
    importance: DataFrame
    error: str | None = None

    def tables(self, df: DataFrame) -> dict[str, DataFrame]:
        """Importance, confusion, and the target against its best feature: counts, residuals and the test."""
        best = self.importance.first()
        found = {"importance": self.importance, "confusion": confusion(self.scored, "label", "predicted")}
        if best:
            found["contingency"] = contingency(df, best["feature"], self.target)
            found["residuals"] = residuals(df, best["feature"], self.target)
            found["test"] = cramers_v(pair_counts(df, [best["feature"], self.target]))
        return found


def train(df: DataFrame, target: str, features: list[str], key: str, model: str = "forest", depth: int = 6, seed: int = 42, rounds: int = 100) -> Predictor:
    """Fit on a seeded 80 % of rows by key. model: forest, or boosted (softmax trees of so many rounds, depth and a step of 0.3).

    Importances are Spark's shares for the forest, and the mean gain of a feature's splits for boosted trees.
    """
    if not features:
        raise ValueError("at least one feature is needed")
    text = lambda c: F.coalesce(name(c).cast("string"), F.lit("null"))
    rows = split_mark(df, key).select("is_train", text(target).alias("target"), *(text(c).alias(f"f{k}") for k, c in enumerate(features)))
    codes = [StringIndexer(inputCol=f"f{k}", outputCol=f"c{k}", stringOrderType="alphabetAsc", handleInvalid="keep") for k in range(len(features))]
    label = StringIndexer(inputCol="target", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=label.labels)
    known, unknown = rows.filter("is_train"), rows.filter(~F.col("is_train"))
    if model == "forest":
        join = VectorAssembler(inputCols=[f"c{k}" for k in range(len(features))], outputCol="x")
        bins = 2 + max(rows.agg(*(F.count_distinct(f"f{k}").alias(f"n{k}") for k in range(len(features)))).first())
        learner = RandomForestClassifier(featuresCol="x", labelCol="y", maxDepth=depth, seed=seed, numTrees=50, maxBins=max(32, bins))
        fitted = Pipeline(stages=[label, *codes, join, learner]).fit(known)
        predicted = fitted.transform(unknown)
        share = [float(g) for g in fitted.stages[-1].featureImportances.toArray()]
        share += [0.0] * (len(features) - len(share))
    elif model == "boosted":
        fitted = Pipeline(stages=[label, *codes]).fit(known)
        coded = lambda df: fitted.transform(df).select("target", F.col("y").cast("int").alias("y"), F.array(*(F.col(f"c{k}").cast("int") for k in range(len(features)))).alias("x"))
        sizes = [len(stage.labels) + 1 for stage in fitted.stages[1:]]  # and one for labels not seen
        boosted = boosting.fit(coded(known).select("x", "y"), len(label.labels), sizes, rounds, depth)
        predicted = boosting.predict(coded(unknown), boosted)
        share = boosted.mean_gains(len(features))
    else:
        raise ValueError(f"unknown model {model!r}")
    scored = named.transform(predicted).select(F.col("target").alias("label"), "predicted")
    importance = df.sparkSession.createDataFrame(list(zip(features, share, strict=True)), "feature string, importance double")
    found = accuracy(scored, "label", "predicted").first()["accuracy"]
    return Predictor(target, scored, found, importance.orderBy(F.desc("importance"), "feature"))


def each_target(df: DataFrame, columns: list[str], key: str, **options) -> list[Predictor]:
    """A predictor for each column from the others; one that can't be fitted says why."""
    if len(columns) < 2:
        raise ValueError("at least two columns are needed")
    found = []
    for target in columns:
        features = [c for c in columns if c != target]
        try:
            found.append(train(df, target, features, key, **options))
        except Exception as error:  # one target's failure leaves the others
            none = df.sparkSession.createDataFrame([], "feature string, importance double")
            found.append(Predictor(target, df.select(F.lit("").alias("label"), F.lit("").alias("predicted")).limit(0), None, none, str(error)))
    return found
