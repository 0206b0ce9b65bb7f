"""What the training-data operators share: tables, shared scratch space and small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts count words.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries that a running sum adds up at a time.
STRIDE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="prevspark-")
    return f"{base.rstrip('/')}/prevspark/{uuid.uuid4().hex}/{name}"


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more, which it does as the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bloom_filters(df: DataFrame, column: str, which: str, wanted: range, most: int, most_bytes: int) -> dict:
    """Functions of a long column by number: that of k, of ``wanted``, is false only if no row of ``df`` whose ``which`` is k has such a value in ``column``.

    They are Spark's own filters for joins, which have no name in SQL. Each is made for ``most`` values, at eight bits a value up to ``most_bytes``
    (Spark allows 8 MB); with more values it says true more often, and is never wrong otherwise. The values are dealt to one task a filter, so that no
    task makes more than one; the filters are written to the shared folder and reach the tasks with the plan, and so pass through the driver.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    made, catalyst = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    of = lambda c: made.expression(c._jc)
    lit = lambda x: of(F.lit(x).cast("long"))
    held = catalyst.aggregate.BloomFilterAggregate(of(F.col(column)), lit(most), lit(8 * min(most, most_bytes)))
    dealt = df.repartition(len(wanted), which).groupBy(which).agg(Column(made.column(held.toAggregateExpression())).alias("held"))
    dealt = store(dealt, "filters")

    def known(k: int):
        one = dealt.where(F.col(which) == k).select(F.max("held")).scalar()
        return lambda value: F.coalesce(Column(made.column(catalyst.BloomFilterMightContain(of(one), of(value)))), F.lit(False))

    return {k: known(k) for k in wanted}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """Sums of an array's entries up to each place; in time near its length, as sums start anew from every block."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def sums(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(v) - 1) / STRIDE).cast("int"))
        each = F.transform(blocks, lambda i: total(F.slice(v, i * STRIDE + 1, F.lit(STRIDE))))
        bases = let(each, lambda e: F.transform(blocks, lambda i: total(F.slice(e, F.lit(1), i))))

        def place(base: Column) -> Column:
            block = lambda i: (i / STRIDE).cast("int")
            inside = lambda i: total(F.slice(v, block(i) * STRIDE + 1, F.pmod(i, F.lit(STRIDE)) + 1))
            return F.transform(v, lambda _, i: F.get(base, block(i)) + inside(i))

        return F.when(F.size(v) > 0, let(bases, place)).otherwise(F.array().cast("array<bigint>"))

    return let(values, sums)


def own_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_aside(keep: tuple[str, ...]):
    """Lets an operator from documents to documents see only the columns ``keep`` by name, so that no other can clash."""

    def around(operator):
        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            names = docs.columns
            inner = docs.toDF(*[c if c in keep else f"aside_{i}_" for i, c in enumerate(names)])
            return operator(inner, *args, **kwargs).toDF(*names)

        return run

    return around
