"""Classifiers behind one small surface: ``fit(df)`` gives a scorer, ``scorer.score(df, name)`` adds class probabilities.

Any ``pyspark.ml`` classifier with a probability column fits, and so does a SQL expression, which needs no training. Features
are a ``features`` column, an array of doubles or an ML vector (dense or sparse).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_vectors(df: DataFrame, features: str, name: str) -> DataFrame:
    """``df`` with the features as an ML vector."""
    kind = df.schema[features].dataType.typeName()
    column = F.col(features) if kind != "array" else array_to_vector(F.col(features))
    return df.withColumn(name, column)


def as_array(df: DataFrame, features: str) -> Column:
    kind = df.schema[features].dataType.typeName()
    return F.col(features) if kind == "array" else vector_to_array(F.col(features))


@dataclass
class SqlScorer:
    """Probabilities by an expression: ``probabilities`` is an array column, or SQL for one."""

    probabilities: Column | str
    n_classes: int

    def fit(self, df: DataFrame, label: str) -> SqlScorer:
        return self

    def score(self, df: DataFrame, name: str) -> DataFrame:
        p = F.expr(self.probabilities) if isinstance(self.probabilities, str) else self.probabilities
        return df.withColumn(name, p)


@dataclass
class MLClassifier:
    """A ``pyspark.ml`` classifier; ``folds`` > 1 also gives scores of rows that the scoring model did not see."""

    estimator: object
    features: str = "features"
    folds: int = 0
    model: object = None
    n_classes: int = 0

    def fit(self, df: DataFrame, label: str) -> MLClassifier:
        vectors = as_vectors(df, self.features, "x_").withColumn("y_", F.col(label).cast("double"))
        estimator = self.estimator.copy().setFeaturesCol("x_").setLabelCol("y_")
        model = estimator.fit(vectors)
        return MLClassifier(self.estimator, self.features, self.folds, model, model.numClasses)

    def score(self, df: DataFrame, name: str) -> DataFrame:
        if self.model is None:
            raise ValueError("fit the classifier first")
        model = self.model.copy()
        model = model.setFeaturesCol("x_").setProbabilityCol("p_").setRawPredictionCol("raw_").setPredictionCol("said_")
        scored = model.transform(as_vectors(df, self.features, "x_"))
        return scored.withColumn(name, vector_to_array("p_")).drop("x_", "p_", "raw_", "said_")

    def cross_scored(self, df: DataFrame, label: str, name: str, seed: int = 42) -> DataFrame:
        """Training rows with the scores of models of the other folds: what out-of-bag scores are to a bagged ensemble."""
        fold = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != self.features], F.hash(self.features), F.lit(seed)), F.lit(self.folds))
        rows, out = df.withColumn("fold_", fold), None
        for k in range(self.folds):
            part = self.fit(rows.where(F.col("fold_") != k), label).score(rows.where(F.col("fold_") == k), name).drop("fold_")
            out = part if out is None else out.unionByName(part)
        return out
