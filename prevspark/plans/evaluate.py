"""Evaluation: methods by bags of known prevalences, selection on validation bags, tables of the results."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevspark.functions import metrics
from prevspark.operators.methods import Fitted, Method
from prevspark.operators.protocols import ExhaustedClassException, numbered, round_counts


def bags(df: DataFrame, label: str, key: str, n: int, prevalences: np.ndarray, seed: int = 42) -> DataFrame:
    """Bags of ``n`` rows at each row of ``prevalences``: (..., bag, p_true). All bags are drawn by one join.

    A class's rows are numbered in hash order; a bag walks through them in a stride of its own that meets every row once
    before any repeats, as a class with too few rows has to.
    """
    rows, have = numbered(df.where(F.col(label).isNotNull()), label, key, seed)
    rng = np.random.default_rng(seed)
    draws = []
    for i, p in enumerate(prevalences):
        for c, need in enumerate(round_counts(n, p).tolist()):
            size = have.get(c, 0)
            if not size and need:
                raise ExhaustedClassException(f"class {c} has no rows, {need} are needed")
            stride = int(rng.integers(size)) + 1
            while math.gcd(stride, size) > 1:
                stride += 1
            draws.append((i, c, need, size, stride, int(rng.integers(size)), [float(x) for x in p]))
    # as many rows as bags times classes
    wanted = df.sparkSession.createDataFrame(draws, "bag int, c_ int, need_ long, size_ long, stride_ long, first_ long, p_true array<double>")
    wanted = wanted.withColumn("k_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need_") - 1)))
    wanted = wanted.withColumn("at_", (F.col("first_") + F.col("k_") * F.col("stride_")) % F.col("size_"))
    same = (rows[label] == wanted["c_"]) & (rows["number_"] == wanted["at_"])
    return rows.join(wanted, same).select(*[rows[c] for c in df.columns], "bag", "p_true")


def evaluate(fitted: dict[str, object], rows: DataFrame, n: int) -> DataFrame:
    """(bag, method, ae, rae, nmd, is_pdf, exception): one row for each method and bag; failures keep their reason.

    Methods that share a fitted transformer, as ``fit_together`` makes them, share its bags' vectors, so that the rows are
    scored once for all of them.
    """
    truth = rows.groupBy("bag").agg(F.first("p_true").alias("p_true"))
    out, held = None, {}
    for name, model in fitted.items():
        if type(model).vectors is Fitted.vectors and type(model).transform is Fitted.transform:
            parts = (id(model.transformer), model.method.per_block)
            if parts not in held:
                held[parts] = model.vectors(rows, "bag").persist()
            found = model.finished(model.method.solved(model, held[parts]), "bag")
        else:
            found = model.transform(rows, "bag")
        found = found.join(truth, "bag")
        p, q = F.col("p_true"), F.col("p")
        part = found.select(
            "bag", F.lit(name).alias("method"),
            metrics.absolute_error(p, q).alias("ae"), metrics.relative_absolute_error(p, q, F.lit(float(n))).alias("rae"),
            metrics.nmd(p, q).alias("nmd"), metrics.is_pdf(q).alias("is_pdf"),
            F.when(F.col("status") != "ok", F.col("status")).alias("exception"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def fit_together(methods: dict[str, Method], df: DataFrame, label: str = "label") -> dict[str, Fitted]:
    """Every method fitted; those whose transformers are equal share one, and its transfer matrix."""
    out, known = {}, []
    for name, method in methods.items():
        if type(method).fit is not Method.fit:
            out[name] = method.fit(df, label)
            continue
        wanted = method.transformer()
        shared = next((f for spec, f in known if type(spec) is type(wanted) and spec == wanted), None)
        if shared is None or (method.needs_matrix and not shared.method.needs_matrix):
            shared = method.fit(df, label) if shared is None else replace_matrix(method, shared, df, label)
            known.insert(0, (wanted, shared))
        out[name] = Fitted(method, shared.M, shared.transformer, shared.p_trn)
    return out


def replace_matrix(method: Method, shared: Fitted, df: DataFrame, label: str) -> Fitted:
    """A fit of ``method`` that keeps the transformer of ``shared``, which has no matrix yet."""
    again = method.fit(df, label)
    return Fitted(method, again.M, shared.transformer, again.p_trn)


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean errors, their spread and the numbers of failures by group; groups whose bags all failed keep null errors."""
    return results.groupBy(*by).agg(
        F.avg("ae").alias("ae"), F.avg("rae").alias("rae"), F.avg("nmd").alias("nmd"), F.stddev_samp("nmd").alias("nmd_std"),
        F.sum(F.when(~F.col("is_pdf"), 1).otherwise(0)).alias("n_pdf_failures"),
        F.sum(F.when(F.col("exception").isNotNull(), 1).otherwise(0)).alias("n_failures"),
    )


def best(table: DataFrame, by: list[str], metric: str, tie: list[str]) -> DataFrame:
    """The row of least ``metric`` in each group; nulls come last, ties by ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.col(metric).asc_nulls_last(), *tie)
    return table.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def select_and_test(validation: DataFrame, test: DataFrame, by: list[str], setting: list[str], metric: str) -> DataFrame:
    """Test results of the setting that was best in validation, per group."""
    chosen = best(validation, by, metric, setting).select(*by, *setting)
    return test.join(chosen, [*by, *setting])
