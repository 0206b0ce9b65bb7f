"""Quantification methods: ``fit`` makes a model from labelled rows, ``predict`` estimates the prevalences of bags.

Both are one grouped aggregation over the rows; a bag is a key, so that any number of bags is solved in one job. Closed forms
and expectation maximisation stay expressions; the other strategies run in an Arrow UDF over one row per bag.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prevspark.functions import expressions as E
from prevspark.operators import solvers as S
from prevspark.operators.transformers import ENTRIES, LABEL, ClassTransformer, HistogramTransformer, entry, labels

BAG = "bag_"
VECTOR = T.ArrayType(T.DoubleType())


def transfer_matrix(rows: DataFrame, n_features: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """M with columns that sum to one (NaN for a class without rows) and the classes' shares of all mass."""
    cells = rows.select(LABEL, F.explode(ENTRIES).alias("e")).groupBy(LABEL, "e.f").agg(F.sum("e.v").alias("v"))
    M = np.zeros((n_features, n_classes))
    for r in cells.collect():  # features times classes at most
        M[r.f, r[LABEL]] = r.v
    mass = M.sum(axis=0)
    with np.errstate(invalid="ignore"):
        return M / mass, mass / mass.sum()


def bag_vectors(rows: DataFrame, n_features: int, bag: str | None, background: str | None = None, alpha: float = 1.0) -> DataFrame:
    """(bag, n, q, b) of every bag: means of the features over its rows, and of its background rows alpha / n times their sum.

    One pass and one aggregation: a row's own count is one more entry. A bag with background rows alone has null q and b.
    """
    key = F.col(bag) if bag else F.lit(0)
    behind = F.col(background) if background else F.lit(False)
    held = F.concat(F.array(entry(F.lit(-1), F.lit(1.0))), F.coalesce(F.col(ENTRIES), F.array().cast("array<struct<f:int,v:double>>")))
    each = rows.select(key.alias(BAG), behind.alias("behind"), F.explode(held).alias("e"))
    cells = each.groupBy(BAG, "e.f").agg(
        F.sum(F.when(~F.col("behind"), F.col("e.v"))).alias("q"), F.sum(F.when(F.col("behind"), F.col("e.v"))).alias("b")
    )
    found = cells.groupBy(BAG).agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("q", "b")))).alias("m"))
    found = found.withColumn("n", F.coalesce(F.try_element_at("m", F.lit(-1))["q"], F.lit(0.0)).cast("long"))
    every = F.array(*[F.lit(i) for i in range(n_features)])
    mean = lambda name: F.when(
        F.col("n") > 0, F.transform(every, lambda f: F.coalesce(F.try_element_at("m", f)[name], F.lit(0.0)) / F.col("n"))
    )
    found = found.select(BAG, "n", mean("q").alias("q"), mean("b").alias("b"))
    return found.withColumn("b", F.transform("b", lambda x: x * alpha)) if background else found.drop("b")


#: Kinds that a status begins with, besides "ok"; what follows is the reason.
EMPTY, INVALID, SINGULAR, NOT_OPTIMAL = "empty", "invalid", "singular", "not optimal"


def reason(error: Exception) -> str:
    kind = NOT_OPTIMAL if isinstance(error, S.NonOptimalStatusError) else SINGULAR if isinstance(error, S.SingularMatrixError | np.linalg.LinAlgError) else INVALID
    return f"{kind}: {error}"


def by_solver(solve, q: str = "q", n: str = "n", b: str | None = None) -> Column:
    """``solve(q, N, b)`` of each bag as a struct (p, status); a bag without an acceptable solution has null and the reason."""

    @F.pandas_udf("p array<double>, status string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in zip(*batch):
                if row[0] is None:
                    out.append((None, f"{EMPTY}: the bag has no rows of its own"))
                    continue
                try:
                    back = np.asarray(row[2], dtype=float) if len(row) > 2 else None
                    out.append((solve(np.asarray(row[0], dtype=float), float(row[1]), back).tolist(), "ok"))
                except (ValueError, np.linalg.LinAlgError) as error:
                    out.append((None, reason(error)))
            yield pd.DataFrame(out, columns=["p", "status"])

    return run(*[F.col(c) for c in (q, n, b) if c])


def by_batch(solve, q: str = "q", n: str = "n") -> Column:
    """Like ``by_solver`` for a ``solve(Q, N)`` that takes the vectors of many bags, a row each, at once."""

    @F.pandas_udf("p array<double>, status string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for vectors, sizes in batches:
            held = vectors.notna().to_numpy()
            out = [(None, f"{EMPTY}: the bag has no rows of its own")] * len(held)
            if held.any():
                found = solve(np.stack([np.asarray(x, dtype=float) for x in vectors[held]]), sizes[held].to_numpy(dtype=float))
                for at, p in zip(np.flatnonzero(held).tolist(), found.tolist()):
                    out[at] = (p, "ok")
            yield pd.DataFrame(out, columns=["p", "status"])

    return run(F.col(q), F.col(n))


@dataclass
class Fitted:
    """A method with its transfer matrix, fitted transformer and training prevalences."""

    method: Method
    M: np.ndarray
    transformer: object
    p_trn: np.ndarray

    def vectors(self, df: DataFrame, bag: str | None = None, background: str | None = None, alpha: float = 1.0) -> DataFrame:
        """(bag_, n, q) of every bag of ``df``."""
        found = bag_vectors(self.transformer.transform(df), self.transformer.n_features, bag, background, alpha)
        parts = self.transformer.n_blocks
        if parts > 1 and not self.method.per_block:  # several histograms count each row as often; M's columns sum to 1
            found = found.withColumn("q", F.transform("q", lambda x: x / parts))
        return found

    def transform(self, df: DataFrame, bag: str | None = None, strict: bool = False) -> DataFrame:
        """(bag, n, p, status): the estimate of every bag, or of all rows as one bag. ``strict`` raises where a bag has none."""
        return self.finished(self.method.solved(self, self.vectors(df, bag)), bag, strict)

    def finished(self, solved: DataFrame, bag: str | None, strict: bool = False) -> DataFrame:
        held = ["n", "p", "status"]
        if strict:
            failed = F.raise_error(F.col("status")).cast("array<double>")
            solved = solved.withColumn("p", F.when(F.col("status") == "ok", F.col("p")).otherwise(failed))
        return solved.select(F.col(BAG).alias(bag), *held) if bag else solved.select(*held)

    def predict(self, df: DataFrame) -> np.ndarray:
        """The prevalences of all rows as one bag."""
        row = self.transform(df).first()
        if row.p is None:
            raise S.NonOptimalStatusError(row.status)
        return np.array(row.p)

    def predict_with_background(self, df: DataFrame, background: DataFrame, alpha: float = 1.0) -> np.ndarray:
        """The prevalences of all rows, of which ``background`` shows what ``alpha`` times as many other rows look like."""
        both = df.withColumn("behind_", F.lit(False)).unionByName(background.withColumn("behind_", F.lit(True)), allowMissingColumns=True)
        row = self.transform_with_background(both, "behind_", alpha).first()
        if row.p is None:
            raise S.NonOptimalStatusError(row.status)
        return np.array(row.p)

    def transform_with_background(self, df: DataFrame, background: str, alpha: float = 1.0, bag: str | None = None) -> DataFrame:
        """Like ``transform`` where the boolean column ``background`` marks the rows of the background."""
        if not self.method.takes_background:
            raise NotImplementedError(f"{type(self.method).__name__} does not take a background")
        return self.finished(self.method.solved(self, self.vectors(df, bag, background, float(alpha)), "b"), bag)


@dataclass
class FittedLater(Fitted):
    """A method whose estimates need no matrix: training rows are counted once someone asks for ``M`` or ``p_trn``."""

    rows: DataFrame

    def __getattribute__(self, name: str):
        if name in ("M", "p_trn") and object.__getattribute__(self, name) is None and "rows" in self.__dict__:
            transformer = self.transformer
            self.M, self.p_trn = transfer_matrix(self.rows, transformer.n_features, transformer.n_classes)
        return object.__getattribute__(self, name)


@dataclass
class Method:
    """What all methods share. A method of one's own gives a ``transformer()`` and ``solved(fitted, vectors)``."""

    takes_background = False
    per_block = False

    @property
    def needs_matrix(self) -> bool:
        """Whether an estimate depends on the training rows' histograms at all."""
        return True

    def transformer(self):
        raise NotImplementedError

    def solved(self, fitted: Fitted, vectors: DataFrame, b: str | None = None) -> DataFrame:
        raise NotImplementedError

    def fit(self, df: DataFrame, label: str = "label") -> Fitted:
        """A new model; the method itself stays as it is."""
        transformer, rows = self.transformer().fit(df, label)
        if not self.needs_matrix:
            return FittedLater(self, None, transformer, None, rows)
        M, p_trn = transfer_matrix(rows, transformer.n_features, transformer.n_classes)
        return Fitted(self, M, transformer, p_trn)


def spread(vectors: DataFrame, found: Column) -> DataFrame:
    return vectors.withColumn("found_", found).select("*", "found_.p", "found_.status").drop("found_")


def exact(vectors: DataFrame, p: Column) -> DataFrame:
    """Estimates by an expression; a bag without rows of its own has none."""
    status = F.when(F.col("q").isNull(), f"{EMPTY}: the bag has no rows of its own").otherwise("ok")
    return vectors.withColumn("p", F.when(F.col("q").isNotNull(), p)).withColumn("status", status)


def failed(vectors: DataFrame, why: str) -> DataFrame:
    return vectors.withColumn("p", F.lit(None).cast("array<double>")).withColumn("status", F.lit(why))


def factors(a) -> np.ndarray | None:
    return None if a is None or len(a) == 0 else np.asarray(a, dtype=float)


ADJUSTED = (*S.SOFTMAX, "constrained", "pinv", "inv", "ovr", "none")


@dataclass
class ACC(Method):
    """Adjusted classify-and-count; with ``tau`` > 0 regularised for ordered classes."""

    classifier: object
    strategy: str = "softmax"
    tau: float = 0.0
    a: object = None
    fit_classifier: bool = True
    oob_score: bool | None = None
    is_probabilistic = False

    def __post_init__(self):
        if self.strategy not in ADJUSTED:
            raise ValueError(f"there is no strategy {self.strategy!r}; one of {ADJUSTED} is needed")

    @property
    def needs_matrix(self) -> bool:
        return self.strategy != "none"

    def transformer(self) -> ClassTransformer:
        return ClassTransformer(self.classifier, self.is_probabilistic, self.fit_classifier, self.oob_score)

    def solved(self, fitted: Fitted, vectors: DataFrame, b: str | None = None) -> DataFrame:
        q = F.col("q")
        if self.strategy == "none":
            return exact(vectors, q)
        M, p_trn = fitted.M, fitted.p_trn
        if self.strategy in ("pinv", "inv", "ovr"):
            if not np.isfinite(M).all():  # a class without training rows
                return failed(vectors, f"{INVALID}: M must be finite")
            try:
                forms = {"pinv": lambda: E.pinv(M, q), "inv": lambda: E.inv(M, q), "ovr": lambda: E.ovr(M, p_trn, q)}
                return exact(vectors, forms[self.strategy]())
            except (S.SingularMatrixError, np.linalg.LinAlgError) as error:
                return failed(vectors, reason(error))
        tau, a, strategy = self.tau, factors(self.a), self.strategy
        return spread(vectors, by_solver(lambda q, n, _: S.solve_least_squares(M, q, n, tau=tau, a=a, strategy=strategy)))


@dataclass
class PACC(ACC):
    """Adjusted classify-and-count on posteriors."""

    is_probabilistic = True


@dataclass
class CC(ACC):
    """Classify and count."""

    strategy: str = "none"

    def __post_init__(self):
        self.strategy = "none"


@dataclass
class PCC(CC):
    """Average posteriors."""

    is_probabilistic = True


@dataclass
class RUN(Method):
    """Regularised maximum-likelihood unfolding over any transformer."""

    f: object
    tau: float = 1e-6
    n_df: int = -1
    a: object = None
    strategy: str = "softmax"
    strategies = ("original", *S.SOFTMAX, "constrained", "positive", "unconstrained")

    def __post_init__(self):
        if self.strategy not in self.strategies:
            raise ValueError(f"there is no strategy {self.strategy!r}; one of {self.strategies} is needed")

    def transformer(self):
        return self.f

    def arguments(self, fitted: Fitted) -> dict:
        n_df = self.n_df if self.n_df > 0 else fitted.M.shape[1]
        return {"tau": self.tau, "n_df": n_df, "a": factors(self.a), "strategy": self.strategy}

    def solved(self, fitted: Fitted, vectors: DataFrame, b: str | None = None) -> DataFrame:
        M, given = fitted.M, self.arguments(fitted)
        return spread(vectors, by_solver(lambda q, n, _: S.solve_maximum_likelihood(M, q, n, **given)))


@dataclass
class SVD(RUN):
    """Weighted least-squares unfolding; ``original`` (or ``svd``) is the closed form by singular values."""

    strategies = ("original", "svd", *S.SOFTMAX, "constrained")

    def solved(self, fitted: Fitted, vectors: DataFrame, b: str | None = None) -> DataFrame:
        M, given = fitted.M, self.arguments(fitted)
        if given["strategy"] == "original":
            given["strategy"] = "svd"
        return spread(vectors, by_solver(lambda q, n, _: S.solve_least_squares(M, q, n, w=S.svd_weights(q, n), **given)))


@dataclass
class HDx(Method):
    """Least Hellinger distance of the features' histograms."""

    n_bins: int
    tau: float = 0.0
    a: object = None
    strategy: str = "softmax"
    features: str = "features"
    n_trials: int = 10
    seed: int = 42
    takes_background = True
    per_block = True

    def __post_init__(self):
        if self.strategy not in (*S.SOFTMAX, "constrained"):
            raise ValueError(f"there is no strategy {self.strategy!r} for Hellinger distances")

    def transformer(self) -> HistogramTransformer:
        return HistogramTransformer(self.n_bins, features=self.features)

    def solved(self, fitted: Fitted, vectors: DataFrame, b: str | None = None) -> DataFrame:
        M, bins = fitted.M, self.n_bins
        given = {"tau": self.tau, "a": factors(self.a), "strategy": self.strategy, "n_trials": self.n_trials, "seed": self.seed}
        return spread(vectors, by_solver(lambda q, n, back: S.solve_hellinger(M, q, n, bins, back, **given), b=b))


@dataclass
class HDy(HDx):
    """Least Hellinger distance of the posteriors' histograms, one per class."""

    classifier: object = None
    fit_classifier: bool = True
    oob_score: bool | None = None

    def transformer(self) -> HistogramTransformer:
        pre = ClassTransformer(self.classifier, True, self.fit_classifier, self.oob_score)
        return HistogramTransformer(self.n_bins, pre, self.features)


@dataclass
class IBU(Method):
    """Iterative Bayesian unfolding: EM from uniform prevalences, with polynomial smoothing of order ``o`` and weight ``lam``."""

    f: object
    o: int = -1
    lam: float = 0.0
    a: object = None
    n_iterations: int = 100
    epsilon: float = 0.0

    def __post_init__(self):
        if self.lam > 0 and self.o < 0:
            raise ValueError("smoothing needs a polynomial order of 0 or more")

    def transformer(self):
        return self.f

    def solved(self, fitted: Fitted, vectors: DataFrame, b: str | None = None) -> DataFrame:
        M, a = fitted.M, factors(self.a)
        if not np.isfinite(M).all():
            return failed(vectors, f"{INVALID}: M must be finite")
        if a is None and self.epsilon == 0:
            given = {"order": self.o, "weight": self.lam, "n_iterations": self.n_iterations}
            return spread(vectors, by_batch(lambda q, n: S.expectation_maximization_of_many(M, q, **given)))
        start = np.full(M.shape[1], 1 / M.shape[1])
        given = {"order": self.o, "weight": self.lam, "a": a, "n_iterations": self.n_iterations, "epsilon": self.epsilon}
        return spread(vectors, by_solver(lambda q, n, _: S.solve_expectation_maximization(M, q, n, start, **given)))


@dataclass
class SLD(Method):
    """EM over the posteriors of a bag's rows, from the training prevalences.

    A row's share of a class needs the current prevalences alone, which are C numbers per bag.
    """

    classifier: object
    o: int = -1
    lam: float = 0.0
    a: object = None
    fit_classifier: bool = True
    n_iterations: int = 100

    def __post_init__(self):
        if self.lam > 0 and self.o < 0:
            raise ValueError("smoothing needs a polynomial order of 0 or more")

    def transformer(self) -> ClassTransformer:
        return ClassTransformer(self.classifier, True, self.fit_classifier, False)

    def fit(self, df: DataFrame, label: str = "label") -> SldFitted:
        transformer, _ = self.transformer().fit(df, label)
        rows, n = labels(df, label)
        counts = {r[LABEL]: r["count"] for r in rows.groupBy(LABEL).count().collect()}
        share = np.array([counts.get(c, 0) for c in range(n)], dtype=float)
        return SldFitted(self, np.zeros((0, 0)), transformer, share / share.sum())


#: Rows of a bag up to which one task takes the bag's steps.
TOGETHER = 1 << 20


@dataclass
class SldFitted(Fitted):
    """A fitted SLD has no transfer matrix; its rows are.

    Equal posteriors step alike, so that a bag is its distinct ratios and how often they occur. Bags of up to TOGETHER rows
    take all their steps in one task each; larger bags, of which there can only be few, step by aggregations over all tasks,
    between which C numbers of each such bag are on the driver. A class without training rows keeps the prevalence 0.
    """

    def transform(self, df: DataFrame, bag: str | None = None, strict: bool = False) -> DataFrame:
        key = F.col(bag) if bag else F.lit(0)
        scored = self.transformer.probabilities(df, "p_row_")
        ratio = F.zip_with("p_row_", E.vector(self.p_trn), lambda p, t: F.when(t > 0, p / F.nullif(t, F.lit(0.0))).otherwise(0.0))
        rows = scored.select(key.alias(BAG), ratio.alias("r")).groupBy(BAG, "r").agg(F.count("*").alias("k"))
        large = df.select(key.alias(BAG)).groupBy(BAG).count().where(F.col("count") > TOGETHER).select(BAG).collect()
        if not large:
            return self.finished(self.at_once(rows), bag, strict)
        names = df.sparkSession.createDataFrame(large, rows.select(BAG).schema).withColumnRenamed(BAG, "large_")
        same = rows[BAG].eqNullSafe(names["large_"])
        found = self.at_once(rows.join(F.broadcast(names), same, "left_anti"))
        return self.finished(found.unionByName(self.step_by_step(rows.join(F.broadcast(names), same, "left_semi"))), bag, strict)

    def at_once(self, rows: DataFrame) -> DataFrame:
        """(bag, n, p, status) from (bag, r, k): each bag's steps in one task."""
        p_trn, a = self.p_trn, factors(self.method.a)
        n_iterations, order, weight = self.method.n_iterations, self.method.o, self.method.lam

        def steps(frame: pd.DataFrame) -> pd.DataFrame:
            r, k = np.stack([np.asarray(x, dtype=float) for x in frame["r"]]), frame["k"].to_numpy(dtype=float)
            n, prior = k.sum(), p_trn
            for _ in range(n_iterations):
                mass = r * prior
                p = (k / mass.sum(axis=1)) @ mass / n
                prior = S.smoothed(p, n, order, weight, a) if weight > 0 else p
            return pd.DataFrame({BAG: frame[BAG].head(1), "n": [int(n)], "p": [p.tolist()], "status": ["ok"]})

        schema = rows.select(BAG).schema.add("n", "long").add("p", VECTOR).add("status", "string")
        return rows.groupBy(BAG).applyInPandas(steps, schema)

    def step_by_step(self, rows: DataFrame) -> DataFrame:
        """The same with an aggregation over all tasks for each step."""
        method, C, spark = self.method, len(self.p_trn), rows.sparkSession
        rows = rows.persist()
        names = rows.select(BAG).schema
        sizes = rows.groupBy(BAG).agg(F.sum("k").alias("n"))
        state = [(r[BAG], r.n, self.p_trn.tolist(), self.p_trn.tolist()) for r in sizes.collect()]
        a = factors(method.a)
        for _ in range(method.n_iterations):
            now = spark.createDataFrame([(x[0], x[2]) for x in state], rows.select(BAG).schema.add("prior", VECTOR))
            joined = rows.join(F.broadcast(now), rows[BAG].eqNullSafe(now[BAG])).select(rows[BAG], "r", "k", "prior")
            mass = F.zip_with("r", "prior", lambda r, p: r * p)
            shares = joined.withColumn("m", mass).withColumn("w", F.col("k") / E.total(F.col("m")))
            found = shares.groupBy(BAG).agg(F.array(*[F.sum(F.get("m", c) * F.col("w")) for c in range(C)]).alias("c"))
            step = {r[BAG]: np.array(r.c) for r in found.collect()}
            new = [(name, n, step[name] / n) for name, n, _, _ in state]
            state = [(name, n, (S.smoothed(p, n, method.o, method.lam, a) if method.lam > 0 else p).tolist(), p.tolist()) for name, n, p in new]
        rows.unpersist()
        out = spark.createDataFrame([(x[0], x[1], x[3]) for x in state], names.add("n", "long").add("p", VECTOR))
        return out.withColumn("status", F.lit("ok"))
