"""Feature transformations f: rows to histograms, without ever making one-hot rows.

A fitted transformer adds ``entries`` to a table, an array of (f, v): the feature numbers that a row counts for and by how much.
Summing entries by class gives the transfer matrix M, summing them by bag gives q.
"""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevspark.functions.expressions import bin_index, crisp, inner_edges, matrix
from prevspark.operators.classifiers import as_array, as_vectors

ENTRIES, LABEL = "entries_", "label_"


class Transformer(ABC):
    """What makes features of rows. One of one's own has ``n_features``, ``n_classes`` and ``n_blocks`` besides these.

    ``n_blocks`` is how many features each row counts for; a fitted transformer's ``transform`` adds the entries.
    """

    n_classes: int
    n_blocks: int

    @property
    @abstractmethod
    def n_features(self) -> int:
        """Length of the vectors that rows are counted in."""

    @abstractmethod
    def fit(self, df: DataFrame, label: str) -> tuple[Transformer, DataFrame]:
        """The fitted transformer, and the training rows with their entries and LABEL."""

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its entries."""


def labels(df: DataFrame, label: str, known: int = 0) -> tuple[DataFrame, int]:
    """``df`` with labels from 0 and the number of classes: the most of the labels' range and ``known``, the classifier's.

    Labels are whole numbers from 0 or 1 on. Gaps are warned of: a class without rows has no column in a transfer matrix.
    """
    low, high, n = df.agg(F.min(label), F.max(label), F.count_distinct(label)).first()
    if low not in (0, 1):
        raise ValueError(f"labels must start at 0 or 1, not at {low}")
    if n < high - low + 1:
        warnings.warn(f"{int(high - low) + 1 - n} classes have no rows", stacklevel=2)
    return df.withColumn(LABEL, (F.col(label) - low).cast("int")), max(int(high - low) + 1, known)


def entry(f: Column, v: Column) -> Column:
    return F.struct(f.cast("int").alias("f"), v.cast("double").alias("v"))


def finite(p: Column) -> Column:
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


@dataclass
class ClassTransformer(Transformer):
    """A classifier's prediction (the first of the largest probabilities) or, if ``is_probabilistic``, its probabilities.

    With ``oob_score`` training rows are scored by models that did not see them; rows whose scores are not finite are left out.
    """

    classifier: object
    is_probabilistic: bool = False
    fit_classifier: bool = True
    oob_score: bool | None = None
    n_classes: int = 0
    n_blocks: int = 1

    @property
    def n_features(self) -> int:
        return self.n_classes

    def fit(self, df: DataFrame, label: str) -> tuple[ClassTransformer, DataFrame]:
        """The fitted transformer, and the training rows with their entries and LABEL."""
        rows, n = labels(df, label)
        scorer = self.classifier.fit(rows, LABEL) if self.fit_classifier else self.classifier
        n = max(n, getattr(scorer, "n_classes", 0))
        oob = getattr(self.classifier, "folds", 0) > 1 if self.oob_score is None else self.oob_score
        fitted = ClassTransformer(scorer, self.is_probabilistic, self.fit_classifier, self.oob_score, n)
        scored = self.classifier.cross_scored(rows, LABEL, "p_entries_") if oob else scorer.score(rows, "p_entries_")
        return fitted, fitted.with_entries(scored, complete=True)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.with_entries(self.classifier.score(df, "p_entries_"))

    def probabilities(self, df: DataFrame, name: str) -> DataFrame:
        return self.classifier.score(df, name)

    def with_entries(self, scored: DataFrame, complete: bool = False) -> DataFrame:
        """``scored`` with entries; with ``complete`` rows whose scores are not all finite have none. A score is evaluated once."""

        def entries(p: Column) -> Column:
            found = F.transform(p, lambda x, i: entry(i, x)) if self.is_probabilistic else F.array(entry(crisp(p), F.lit(1.0)))
            return F.when(finite(p), found) if complete else found

        once = F.element_at(F.transform(F.array("p_entries_"), entries), 1)
        return scored.withColumn(ENTRIES, once).drop("p_entries_")


@dataclass
class HistogramTransformer(Transformer):
    """``n_bins`` equal-width bins of each feature, with (low, high] bounds; what lies outside counts for the outer bins.

    A ``preprocessor`` such as ``ClassTransformer(c, is_probabilistic=True)`` makes histograms of its probabilities instead.
    """

    n_bins: int
    preprocessor: ClassTransformer | None = None
    features: str = "features"
    edges: np.ndarray | None = None
    n_classes: int = 0

    @property
    def n_blocks(self) -> int:
        return len(self.edges)

    @property
    def n_features(self) -> int:
        return len(self.edges) * self.n_bins

    def fit(self, df: DataFrame, label: str) -> tuple[HistogramTransformer, DataFrame]:
        rows, n = labels(df, label)
        pre = self.preprocessor
        if pre is not None:
            pre, scored = pre.fit(df, label)
            rows = scored.withColumn("x_entries_", F.transform(F.sort_array(ENTRIES), lambda e: e["v"])).drop(ENTRIES)
        else:
            rows = rows.withColumn("x_entries_", as_array(rows, self.features))
        bounds = rows.select(F.posexplode("x_entries_").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        found = bounds.select("d", inner_edges(F.col("low"), F.col("high"), self.n_bins).alias("e")).orderBy("d").collect()
        fitted = HistogramTransformer(self.n_bins, pre, self.features, np.array([r.e for r in found]).reshape(len(found), -1), n)
        return fitted, fitted.with_entries(rows)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.preprocessor is not None:
            return self.with_entries(self.preprocessor.probabilities(df, "x_entries_"))
        return self.with_entries(df.withColumn("x_entries_", as_array(df, self.features)))

    def with_entries(self, df: DataFrame) -> DataFrame:
        edges = matrix(self.edges) if self.n_bins > 1 else F.array(*[F.array().cast("array<double>")] * len(self.edges))
        bins = F.zip_with("x_entries_", edges, lambda x, e: bin_index(x, e))
        entries = F.transform(bins, lambda b, d: entry(d * self.n_bins + b, F.lit(1.0)))
        return df.withColumn(ENTRIES, entries).drop("x_entries_")


@dataclass
class TreeTransformer(Transformer):
    """The leaf of a decision tree that a row falls into.

    ``fit_tree`` is the share of the rows, by class, that the tree is trained on; the rest gives M. At 1 all rows do both, at 0
    the tree is taken as it is. A fitted transformer keeps its rows, so that several methods can share one tree.
    """

    tree: object
    fit_tree: float = 1.0
    features: str = "features"
    seed: int = 42
    leaves: dict[int, int] = field(default_factory=dict)
    n_classes: int = 0
    held: DataFrame | None = None
    n_blocks: int = 1

    @property
    def n_features(self) -> int:
        return len(self.leaves)

    def fit(self, df: DataFrame, label: str) -> tuple[TreeTransformer, DataFrame]:
        if self.held is not None:
            return self, self.held
        rows, n = labels(df, label)
        rows = as_vectors(rows, self.features, "x_")
        train = rest = rows
        if 0 < self.fit_tree < 1:
            train, rest = self.split(rows, df.columns)
        model = self.tree
        if self.fit_tree > 0:
            estimator = self.tree.copy().setFeaturesCol("x_").setLabelCol("y_")
            model = estimator.fit(train.withColumn("y_", F.col(LABEL).cast("double")))
        fitted = type(self)(model, self.fit_tree, self.features, self.seed, {}, n)
        found = fitted.apply_tree(train).select("leaf_").distinct().orderBy("leaf_").collect()
        fitted.leaves = {int(r.leaf_): i for i, r in enumerate(found)}
        fitted.held = fitted.with_entries(rest).drop("x_")
        return fitted, fitted.held

    def split(self, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
        """Both parts by the rows' hashes; other hashes are tried until both have all classes.

        Only as many of the least hashes are sorted as the first part has rows.
        """
        n = rows.count()
        size = int(n * self.fit_tree)
        for attempt in range(5):
            known = F.xxhash64(*[c for c in columns if c != self.features], F.hash(self.features), F.lit(self.seed + attempt))
            place = F.pmod(known, F.lit(1 << 40))
            room = min(n, size + 6 * int(np.sqrt(size + 1)) + 10)
            near = rows.select(place.alias("h")).where(F.col("h") <= (1 << 40) * room // max(1, n))
            cut = near.orderBy("h").limit(size).agg(F.max("h")).first()[0]
            first = place <= F.lit(-1 if cut is None else cut)
            both = rows.groupBy(LABEL).agg(F.max(first).alias("a"), F.max(~first).alias("b")).agg(F.bool_and(F.col("a") & F.col("b"))).first()[0]
            if both:
                return rows.where(first), rows.where(~first)
        raise ValueError(f"a class is missing from one of the splits with fit_tree={self.fit_tree}")

    def apply_tree(self, df: DataFrame) -> DataFrame:
        """``df`` with ``leaf_``, the number of the leaf that each row falls into; override it for trees of one's own."""
        return self.with_leaf(df)

    def with_leaf(self, df: DataFrame) -> DataFrame:
        model = self.tree.copy().setFeaturesCol("x_").setLeafCol("leaf_")
        model = model.setProbabilityCol("p_").setRawPredictionCol("raw_").setPredictionCol("said_")
        return model.transform(df).drop("p_", "raw_", "said_")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.with_entries(as_vectors(df, self.features, "x_")).drop("x_")

    def with_entries(self, df: DataFrame) -> DataFrame:
        pairs = [F.lit(x) for leaf, i in self.leaves.items() for x in (float(leaf), i)]
        number = F.try_element_at(F.create_map(*pairs), F.col("leaf_").cast("double"))
        known = F.coalesce(number, F.raise_error(F.lit("a row falls into a leaf that no training row fell into")).cast("int"))
        return self.apply_tree(df).withColumn(ENTRIES, F.array(entry(known, F.lit(1.0)))).drop("leaf_")


def depth_for(n_leaves: int) -> int:
    """The least depth of a binary tree with ``n_leaves`` leaves."""
    return max(1, (n_leaves - 1).bit_length())


def tree_with_bins(n_bins: int, fit_tree: float = 1.0, features: str = "features", seed: int = 42) -> TreeTransformer:
    """A TreeTransformer whose decision tree has at least ``n_bins`` leaves where the data allow it."""
    from pyspark.ml.classification import DecisionTreeClassifier

    return TreeTransformer(DecisionTreeClassifier(maxDepth=depth_for(n_bins), seed=seed), fit_tree, features, seed)


