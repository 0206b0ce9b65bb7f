"""End-to-end studies: methods compared over bags, protocols, a bootstrapped spectrum, tables of results; and a command line.

    python -m prevspark.plans.drivers compare --data DIR --bags 20 --out results
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prevspark.functions import expressions as E
from prevspark.functions import metrics
from prevspark.operators import protocols as P
from prevspark.operators.methods import Method
from prevspark.plans import evaluate as V
from prevspark.sources import tables


def compare(
    settings: dict[float, Callable[[], dict[str, Method]]], train: DataFrame, pool: DataFrame, key: str, n: int, prevalences: np.ndarray, seed: int = 42
) -> DataFrame:
    """(setting, method, ae, rae, nmd, nmd_std, n_pdf_failures, n_failures): every method under every setting, over bags from ``pool``.

    ``settings`` gives the methods for each value of what is varied, such as a classifier's regularisation.
    """
    bags = V.bags(pool, "label", key, n, prevalences, seed)
    out = None
    for value, methods in settings.items():
        results = V.evaluate(V.fit_together(methods(), train), bags, n)
        part = V.summary(results, ["method"]).withColumn("setting", F.lit(float(value)))
        out = part if out is None else out.unionByName(part)
    return out.select("setting", "method", "ae", "rae", "nmd", "nmd_std", "n_pdf_failures", "n_failures")


def selected(validation: DataFrame, test: DataFrame, metric: str) -> DataFrame:
    """(method, setting, metric in validation, metric in the test): each method at the setting that was best in validation."""
    chosen = V.best(validation, ["method"], metric, ["setting"]).select("method", "setting", F.col(metric).alias("validation"))
    return chosen.join(test.select("method", "setting", F.col(metric).alias("test")), ["method", "setting"], "left")


def protocol_prevalences(n: int, m: int, natural: np.ndarray, seen: np.ndarray, seed: int = 876) -> dict[str, np.ndarray]:
    """Prevalences of ``m`` bags of ``n`` items by each protocol; ``natural`` are those of training, ``seen`` those of the source."""
    C = len(natural)
    return {
        "APP": P.app(C, m, seed, n),
        **{f"APP-OQ ({100 * keep:g}%)": P.app_oq(C, m, keep, seed + 1 + i, n) for i, keep in enumerate((0.2, 0.05, 0.01))},
        "NPP (Crab)": P.npp(seen, n, m),
        "NPP (simulation)": P.npp(natural, n, m),
        "Poisson": P.poisson(n, seen, m, seed + 4),
    }


def protocol_table(spark: SparkSession, sizes: list[int], m: int, natural: np.ndarray, seen: np.ndarray, a_eff: np.ndarray, seed: int = 876) -> DataFrame:
    """(n, protocol, measure, i, value, mean): percentiles of the bags' spectra's curvature and of their distance from training."""
    rows = [
        (n, name, [float(x) for x in p])
        for n in sizes
        for name, drawn in protocol_prevalences(n, m, natural, seen, seed).items()
        for p in drawn
    ]
    bags = spark.createDataFrame(rows, "n int, protocol string, p array<double>")
    spectrum = lambda p: metrics.log10_density(p, E.vector(a_eff), F.col("n"))
    bags = bags.select("n", "protocol", spectrum(F.col("p")).alias("s"), spectrum(E.vector(natural)).alias("t"))
    kinds = F.array(
        F.struct(F.lit("curvature").alias("measure"), metrics.curvature(F.col("s")).alias("x")),
        F.struct(F.lit("nmd").alias("measure"), metrics.nmd(F.col("s"), F.col("t")).alias("x")),
    )
    each = bags.select("n", "protocol", F.inline(kinds))
    found = each.groupBy("n", "protocol", "measure").agg(metrics.percentiles("x").alias("q"), F.avg("x").alias("mean"))
    return found.select("n", "protocol", "measure", F.posexplode("q").alias("i", "value"), "mean")


def bootstrapped_spectrum(
    method: Method, train: DataFrame, observed: DataFrame, background: str, alpha: float, a: np.ndarray, flux: Column, n_replicates: int, seed: int = 42
) -> DataFrame:
    """(class, i, value, mean): percentiles over replicates of the acceptance-corrected flux of ``observed``.

    Every replicate trains on a sample of ``train`` with replacement and estimates all rows, whose column ``background`` is
    true for rows off the source.
    """
    out = None
    drawn = P.bootstrap(train, n_replicates, seed)
    for r in range(n_replicates):
        fitted = method.fit(drawn.where(F.col("replicate") == r).drop("replicate"))
        part = fitted.transform_with_background(observed, background, alpha).select("p")
        out = part if out is None else out.unionByName(part)
    each = out.where("p is not null").select(F.posexplode(metrics.corrected_flux(F.col("p"), E.vector(a), flux)).alias("class", "flux"))
    found = each.groupBy("class").agg(metrics.percentiles("flux").alias("q"), F.avg("flux").alias("mean"))
    return found.select("class", F.posexplode("q").alias("i", "value"), "mean")


def prevalence_histogram(simulated: DataFrame, label: str, centers: DataFrame) -> DataFrame:
    """(class, simulated, seen): shares of the classes in simulation, and what the source's flux makes of ``centers`` (class, x, a_eff)."""
    n = simulated.agg(F.count(label)).first()[0]
    counts = simulated.groupBy(F.col(label).alias("class")).agg((F.count("*") / n).alias("simulated"))
    seen = centers.select("class", (metrics.crab_flux(F.col("x")) * F.col("a_eff")).alias("seen"))
    total = seen.agg(F.sum("seen")).first()[0]
    return seen.select("class", (F.col("seen") / total).alias("seen")).join(counts, "class", "left").select("class", F.coalesce("simulated", F.lit(0.0)).alias("simulated"), "seen")


#: Digits after the point at which sums of doubles count as equal, whatever the order of their terms.
EXACT = 12


def inspected(results: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(..., n, mean, rank): groups by their mean ``metric``, the best first; means that are equal at EXACT digits go by ``by``."""
    from pyspark.sql import Window

    found = results.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.round("mean", EXACT).asc_nulls_last(), *by)))


#: What methods are called in tables, by the strategy that ends their name.
LABELS = {
    "softmax": "soft-max", "softmax_reg": "regularised soft-max", "softmax_full_reg": "soft-max (all latents)", "constrained": "constrained",
    "pinv": "pseudo-inverse", "inv": "inverse", "ovr": "one-versus-rest", "none": "unadjusted",
}


def labelled(method: Column) -> Column:
    """A readable name of ``METHOD_strategy``; other names stay."""
    named = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    strategy = F.regexp_extract(method, r"^[A-Za-z]+_(.+)$", 1)
    name = F.upper(F.regexp_extract(method, r"^([A-Za-z]+)_", 1))
    return F.when(strategy != "", F.concat(name, F.lit(" "), F.coalesce(F.try_element_at(named, strategy), strategy))).otherwise(method)


def score(value: Column, spread: Column | None = None, digits: int = 4) -> Column:
    """A score as a table shows it, with its spread where it has one; empty where it is missing."""
    shown = F.format_string(f"%.{digits}f", value)
    if spread is not None:
        shown = F.concat(shown, F.when(spread.isNull(), "").otherwise(F.format_string(f" ± %.{digits}f", spread)))
    return F.when(value.isNull(), "").otherwise(shown)


def main(arguments: list[str] | None = None) -> None:
    """Compare the language methods over bags of a data folder's documents, and write CSV and LaTeX tables."""
    from prevspark.operators import methods as Q
    from prevspark.plans import catalog

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("study", choices=["compare", "protocols"])
    parser.add_argument("--data", default="/root/testdata/sf0.01")
    parser.add_argument("--out", default="results")
    parser.add_argument("--bags", type=int, default=20)
    parser.add_argument("--size", type=int, default=100)
    parser.add_argument("--seed", type=int, default=42)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if given.study == "protocols":
        natural = np.arange(1.0, 13) / 78
        found = protocol_table(spark, [1000, 10_000], given.bags, natural, natural[::-1], np.ones(12), given.seed)
    else:
        train, pool = catalog.languages(spark, given.data)
        methods = lambda: {"cc_none": Q.CC(catalog.LANG), **{f"acc_{s}": Q.ACC(catalog.LANG, strategy=s) for s in ("pinv", "constrained", "softmax")}}
        found = compare({0.0: methods}, train, pool, "doc_id", given.size, P.app(4, given.bags, given.seed), given.seed)
        found = found.withColumn("name", labelled(F.col("method")))
    tables.write_csv(found, given.out)
    tables.latex_table(found, f"{given.out}.tex")


if __name__ == "__main__":
    main()
