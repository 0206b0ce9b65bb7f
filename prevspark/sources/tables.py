"""Tables in and out: CSV and Parquet with schemas, acceptance tables, LaTeX."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an acceptance table, after its unnamed index.
ACCEPTANCE = "i int, bin int, a_eff double, bin_center double, bin_width double, conf_lower double, conf_upper double, e_min double, e_max double"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; give the schema where it is known."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_vectors(spark: SparkSession, path: str, label: str | None = None, first_label: int = 0) -> DataFrame:
    """Numeric CSV columns as ``features``; a label column counts from ``first_label`` and becomes ``label`` from 1."""
    df = read_csv(spark, path)
    features = [c for c in df.columns if c != label]
    out = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("features"), *([label] if label else []))
    return out.withColumn("label", F.col(label).cast("int") + 1 - first_label) if label else out


def acceptance(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Inner bins of an acceptance table: ``factors`` 1 / a_eff, ``a_eff``, ``centers`` and ``edges``; the outer bins go."""
    rows = read_csv(spark, path, ACCEPTANCE).orderBy("bin").collect()[1:-1]
    a = np.array([r.a_eff for r in rows])
    edges = np.array([rows[0].e_min, *[r.e_max for r in rows]])
    return {"factors": 1 / a, "a_eff": a, "centers": np.array([r.bin_center for r in rows]), "edges": edges}


def discretised(df: DataFrame, column: str, edges, name: str) -> DataFrame:
    """``name``: the class, from 0, whose [low, high) bounds hold the value; what lies outside belongs to the outer classes."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    return df.withColumn(name, F.size(F.filter(inner, lambda e: e <= F.col(column))))


def finite_rows(df: DataFrame) -> DataFrame:
    """Rows whose floating-point cells are all finite."""
    out = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out = out.where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf")))
    return out


def latex_table(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """A small table as a LaTeX tabular."""
    rows, formats = df.collect(), formats or {}
    cell = lambda c, x: "" if x is None else format(x, formats.get(c, "")) if c in formats else str(x)
    escaped = lambda s: s.replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"  \toprule", "  " + " & ".join(map(escaped, df.columns)) + r" \\", r"  \midrule"]
    lines += ["  " + " & ".join(escaped(cell(c, r[c])) for c in df.columns) + r" \\" for r in rows]
    Path(path).write_text("\n".join([*lines, r"  \bottomrule", r"\end{tabular}", ""]))
