"""Closed forms and expectation maximisation as Catalyst expressions over array columns.

A transfer matrix is small model metadata and enters as a literal; the vectors q of all bags are a column. Nothing here
leaves the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values) -> Column:
    """An array literal."""
    return F.array(*[F.lit(float(v)) for v in values])


def matrix(rows) -> Column:
    return F.array(*[vector(r) for r in rows])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def times(M: np.ndarray, v: Column) -> Column:
    """M v for a literal matrix."""
    return F.transform(matrix(M), lambda row: dot(row, v))


def clip_and_normalize(p: Column) -> Column:
    """Entries clamped to [0, 1] and divided by their sum; NaN where nothing is left."""
    held = F.transform(p, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.transform(held, lambda x: F.when(total(held) > 0, x / F.nullif(total(held), F.lit(0.0))).otherwise(F.lit(float("nan"))))


def crisp(p: Column) -> Column:
    """Index of the largest entry, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def bin_index(x: Column, edges: Column) -> Column:
    """0-based bin with (low, high] bounds: the number of inner edges below x; NaN falls into the last bin."""
    return F.size(F.filter(edges, lambda e: (e < x) | F.isnan(x)))


def inner_edges(low: Column, high: Column, n_bins: int) -> Column:
    """The n_bins - 1 equally spaced edges between two bounds."""
    if n_bins < 2:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda k: low + k * (high - low) / n_bins)


def pinv(M: np.ndarray, q: Column) -> Column:
    """Clipped least-norm solution; rows without mass in M take no part."""
    kept = M.sum(axis=1) > 0
    inverse = np.zeros((M.shape[1], M.shape[0]))
    inverse[:, kept] = np.linalg.pinv(M[kept])
    return clip_and_normalize(times(inverse, q))


def inv(M: np.ndarray, q: Column) -> Column:
    from prevspark.operators.solvers import SingularMatrixError

    if M.shape[0] != M.shape[1] or np.linalg.matrix_rank(M) < M.shape[1]:
        raise SingularMatrixError("M cannot be inverted")
    return clip_and_normalize(times(np.linalg.inv(M), q))


def ovr(M: np.ndarray, p_trn: np.ndarray, q: Column) -> Column:
    """One-versus-rest adjustment by each class's true and false positive rate."""
    tpr = np.diag(M)
    fpr = (1 - tpr * p_trn) / (1 - p_trn)
    gap = F.zip_with(q, vector(fpr), lambda x, f: x - f)
    limit = lambda x: F.when(x == 0, float("nan")).otherwise(F.signum(x) * float("inf"))
    return clip_and_normalize(F.zip_with(gap, vector(tpr - fpr), lambda x, d: F.coalesce(F.try_divide(x, d), limit(x))))


def svd_weights(q: Column, n: Column) -> Column:
    """Statistical weights of the features of a bag with ``n`` items, divided by their mean."""
    raw = F.transform(q, lambda x: F.sqrt(1 + F.greatest(F.lit(1.0), n - F.size(q)) * x))
    return F.transform(raw, lambda w: w * F.size(q) / total(raw))


def smooth(p: Column, n_classes: int, order: int, weight: float) -> Column:
    """``p`` mixed with a polynomial fit of it over the class numbers, both normalised."""
    V = np.vander(np.arange(1.0, n_classes + 1), order + 1)
    fitted = F.transform(times(V @ np.linalg.pinv(V), p), lambda x: F.greatest(F.lit(0.0), x))
    mixed = F.zip_with(fitted, p, lambda f, x: weight * f / total(fitted) + (1 - weight) * x)
    return F.transform(mixed, lambda x: x / total(mixed))


def expectation_maximization(
    M: np.ndarray, q: Column, prior=None, n_iterations: int = 100, order: int = -1, weight: float = 0.0
) -> Column:
    """``n_iterations`` steps of EM for q = M p, from ``prior`` (uniform without one), with an optionally smoothed prior."""
    if weight > 0 and order < 0:
        raise ValueError("smoothing needs a polynomial order of 0 or more")
    C = M.shape[1]
    kept = np.flatnonzero(M.sum(axis=1) > 0)
    rows, held = matrix(M[kept]), F.transform(F.array(*[F.lit(int(i)) for i in kept]), lambda i: F.get(q, i))
    start = vector(np.full(C, 1 / C) if prior is None else prior)

    def step(state: Column, _: Column) -> Column:
        p0 = state["prior"]
        share = F.zip_with(rows, held, lambda row, x: F.struct(row.alias("row"), (x / dot(row, p0)).alias("x")))
        found = F.aggregate(share, vector(np.zeros(C)), lambda s, r: F.zip_with(s, r["row"], lambda a, m: a + m * r["x"]))
        p = F.zip_with(found, p0, lambda f, x: f * x)
        if weight > 0:
            return F.transform(F.array(p), lambda v: F.struct(v.alias("p"), smooth(v, C, order, weight).alias("prior")))[0]
        return F.transform(F.array(p), lambda v: F.struct(v.alias("p"), v.alias("prior")))[0]

    zero = F.struct(start.alias("p"), start.alias("prior"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_iterations)), zero, step, lambda s: s["p"])
