"""Sampling protocols: prevalences to evaluate at, and bags drawn from labelled rows at those prevalences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevspark.functions.metrics import curvature


class ExhaustedClassException(ValueError):
    """A class has fewer rows than a bag without repeats needs."""


def hash_order(key: Column, seed: int) -> Column:
    """A repeatable random order of rows: md5 of the key and the seed, the same in any engine."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def hash_share(key: Column, seed: int) -> Column:
    """Where a row comes in ``hash_order``, from 0 to 1."""
    return F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / 2.0**32


def least(df: DataFrame, key: str, n: int, seed: int, of: int) -> DataFrame:
    """The ``n`` first of the ``of`` rows of ``df`` in hash order; a threshold leaves few more to be sorted."""
    if n >= of:
        return df
    room = n
    while True:
        room = room + 6 * int(np.ceil(np.sqrt(room + 1))) + 10
        held = df.where(hash_share(F.col(key), seed) < min(1.0, room / of))
        if room >= of or held.count() >= n:
            return held.orderBy(hash_order(F.col(key), seed), key).limit(n)


def split(df: DataFrame, key: str, n_train: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``n_train`` rows to train on, and halves of the rest to validate and test with (the first half is rounded down).

    Rows come in hash order of ``key``, whose values differ; only rows near the two cuts are sorted.
    """
    n = df.count()
    n_train = min(n_train, n)
    n_validate = (n - n_train) // 2
    order = F.struct(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))

    def last(m: int):
        """The place of the m-th row."""
        found = least(df, key, m, seed, n).select(order.alias("o")) if m else None
        return found.agg(F.max("o")).first()[0] if m else None

    cuts = [last(n_train), last(n_train + n_validate)]
    upto = lambda c: F.lit(False) if c is None else order <= F.struct(F.lit(c["h"]).alias("h"), F.lit(c["k"]).alias("k"))
    first, second = upto(cuts[0]), upto(cuts[1])
    return df.where(first), df.where(~first & second), df.where(~second)


def round_counts(n: int, p: np.ndarray, least: int = 1) -> np.ndarray:
    """Whole numbers near n p that sum to ``n``, each at least ``least``: by largest remainders."""
    p = np.asarray(p, dtype=float)
    if n < least * len(p):
        raise ValueError(f"{n} items are fewer than {least} for each of {len(p)} classes")
    exact = np.maximum(n * p / p.sum(), least)
    counts = np.floor(exact).astype(int)
    while counts.sum() != n:
        if counts.sum() < n:
            counts[int(np.argmax(exact - counts))] += 1
        else:
            room = np.where(counts > least, exact - counts, np.inf)
            counts[int(np.argmin(room))] -= 1
    return counts


def subsample(
    df: DataFrame, label: str, key: str, n: int, p: np.ndarray, seed: int = 42, allow_duplicates: bool = True, least: int = 1
) -> DataFrame:
    """A bag of ``n`` rows whose class prevalences are ``p``; classes are the labels from 0 on.

    Rows are taken in a hashed order; a class with too few rows repeats them, or raises without ``allow_duplicates``.
    """
    counts = round_counts(n, p, least)
    have = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    for c, need in enumerate(counts):
        if need and not have.get(c) or need > have.get(c, 0) and not allow_duplicates:
            raise ExhaustedClassException(f"class {c} has {have.get(c, 0)} rows, {need} are needed")
    sizes = [have.get(c, 0) for c in range(len(counts))]
    wanted = [min(int(k), m) for k, m in zip(counts, sizes)]
    c = F.col(label).cast("int")
    named = lambda x: F.create_map(*[F.lit(v) for i, k in enumerate(x) for v in (i, k)])
    rows = df.where(F.col(label).between(0, len(counts) - 1))
    # a threshold on the hash leaves about as many rows as are needed, so that no class is sorted whole
    room = list(wanted)
    while True:
        room = [r + 6 * int(np.ceil(np.sqrt(r + 1))) + 10 for r in room]
        share = [1.0 if r >= m else r / m for r, m in zip(room, sizes)]
        near = rows.where(hash_share(F.col(key), seed) < named(share)[c])
        found = {r[label]: r["count"] for r in near.groupBy(label).count().collect()}
        if all(found.get(i, 0) >= k for i, k in enumerate(wanted)):
            break
    need, size = named([int(x) for x in counts]), named([max(1, m) for m in sizes])
    order = Window.partitionBy(label).orderBy(hash_order(F.col(key), seed), key)
    ranked = near.withColumn("rank_", F.row_number().over(order) - 1)
    times = F.floor((need[c] - F.col("rank_") - 1) / size[c]).cast("int") + 1
    repeats = F.explode(F.when(F.col("rank_") < need[c], F.sequence(F.lit(1), times)))
    return ranked.withColumn("repeat_", repeats).drop("rank_", "repeat_")


def numbered(df: DataFrame, label: str, key: str, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """``df`` with ``number_``, its rows' places from 0 in their class, in hash order; and the classes' sizes.

    Places add up over pieces of the hash, so that no task has to sort a class.
    """
    rows = df.withColumn("order_", hash_order(F.col(key), seed)).withColumn("piece_", F.substring("order_", 1, 3))
    sizes = rows.groupBy(label, "piece_").count()
    before = Window.partitionBy(label).orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col(label).alias("l_"), F.col("piece_").alias("p_"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base_"))
    inside = Window.partitionBy(label, "piece_").orderBy("order_", key)
    rows = rows.withColumn("in_", F.row_number().over(inside) - 1)
    # pieces times classes at most
    rows = rows.join(F.broadcast(base), (F.col(label) == F.col("l_")) & (F.col("piece_") == F.col("p_")))
    have = {r[label]: r["n"] for r in sizes.groupBy(label).agg(F.sum("count").alias("n")).collect()}
    return rows.withColumn("number_", F.col("base_") + F.col("in_")).drop("order_", "piece_", "in_", "l_", "p_", "base_"), have


def rounded(n: int, prevalences: np.ndarray) -> np.ndarray:
    """Each row of ``prevalences`` as shares of whole numbers of items that sum to ``n``, at least one each."""
    return np.array([round_counts(n, p) for p in prevalences]) / n


def app(n_classes: int, n_bags: int, seed: int = 42, n: int | None = None) -> np.ndarray:
    """Prevalences drawn evenly from the simplex; with ``n`` those that bags of so many items can have."""
    drawn = np.random.default_rng(seed).dirichlet(np.ones(n_classes), n_bags)
    return drawn if n is None else rounded(n, drawn)


def roughness(p: np.ndarray, log10: bool = True) -> np.ndarray:
    """Half the squared second differences of (the logarithms of) each row."""
    x = np.log10(np.maximum(p, 1e-300)) if log10 else p
    return np.sum(np.diff(x, 2, axis=1) ** 2, axis=1) / 2


def app_oq(n_classes: int, n_bags: int, keep: float = 0.2, seed: int = 42, n: int | None = None) -> np.ndarray:
    """The smoothest of evenly drawn prevalences: a share ``keep`` of them. With ``n`` they are ranked as bags of ``n`` items have them."""
    drawn = app(n_classes, int(np.ceil(n_bags / keep)), seed, n)
    return drawn[np.argsort(roughness(drawn), kind="stable")[:n_bags]]


def smoothest(df: DataFrame, p: Column, n: int, tie: list[str]) -> DataFrame:
    """The ``n`` rows of ``df`` whose prevalences ``p`` bend least; ties, to nine digits, by ``tie``."""
    return df.orderBy(F.round(curvature(p), 9), *tie).limit(n)


def poisson(n: int, p: np.ndarray, n_bags: int, seed: int = 42) -> np.ndarray:
    """Prevalences of Poisson counts around ``n`` items at ``p``."""
    p = np.asarray(p, dtype=float)
    counts = np.random.default_rng(seed).poisson(n * p / p.sum(), (n_bags, len(p)))
    return rounded(n, np.maximum(counts, 1e-9))


def npp(p: np.ndarray, n: int, n_bags: int = 1) -> np.ndarray:
    """Natural prevalences: each bag has ``p`` itself, in whole numbers of its ``n`` items."""
    return np.repeat(rounded(n, np.asarray(p, dtype=float)[None, :]), n_bags, axis=0)


def crab_prevalences(bin_centers: np.ndarray, a_eff: np.ndarray) -> np.ndarray:
    """What a detector with effective areas ``a_eff`` sees of the Crab Nebula's flux at energies in GeV."""
    x = np.asarray(bin_centers, dtype=float) / 1e3
    seen = 3.23e-10 * x ** (-2.47 - 0.24 * np.log10(x)) * np.asarray(a_eff, dtype=float)
    return seen / seen.sum()


def bootstrap(df: DataFrame, n_replicates: int, seed: int = 42) -> DataFrame:
    """Rows with a ``replicate`` number, each replicate a sample with replacement: Poisson weights, one pass, no shuffle."""
    rep = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n_replicates - 1))))
    u, e = F.rand(seed), float(np.exp(-1))
    cdf, term, steps = 0.0, e, F.lit(0)
    for k in range(12):
        cdf += term
        steps = steps + F.when(F.col("u_") >= cdf, 1).otherwise(0)
        term /= k + 1
    drawn = rep.withColumn("u_", u).withColumn("times_", steps).where("times_ > 0")
    return drawn.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_")))).drop("u_", "times_", "copy_")
