"""An extension: prevalences of event-time windows. q is a mean, so a window's state is F sums and a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevspark.operators.transformers import ENTRIES


def window_vectors(rows: DataFrame, transformer, ts: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window, n, q) of each event-time window, for streaming and batch tables alike; late rows are dropped by the watermark."""
    entries = transformer.transform(rows).withWatermark(ts, late)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    at = lambda f: F.aggregate(F.filter(ENTRIES, lambda e: e["f"] == f), F.lit(0.0), lambda s, e: s + e["v"])
    n_features = transformer.n_features
    sums = entries.groupBy(w.alias("window")).agg(F.count("*").alias("n"), *[F.sum(at(f)).alias(f"s{f}") for f in range(n_features)])
    return sums.select("window", "n", F.array(*[F.col(f"s{f}") / F.col("n") for f in range(n_features)]).alias("q"))


def window_prevalences(fitted, rows: DataFrame, ts: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window, n, p, status): the estimate of every window by a fitted method."""
    vectors = window_vectors(rows, fitted.transformer, ts, size, slide, late)
    return fitted.method.solved(fitted, vectors).select("window", "n", "p", "status")
