"""Exact top-k against brute force: ties, repeats, odd vectors, blocks of queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prevspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def plain(rows, k=5, step=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % step == 0}):
        own = min(v for i, v in good if i == q)
        ranked = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)]
    return out


def made(seed, n=400, dims=6):
    rng = random.Random(seed)
    value = lambda: rng.randrange(-512, 512) / 256
    rows = [(i, [value() for _ in range(dims)]) for i in range(n)]
    rows += [(i, [1.0] * dims) for i in range(n, n + 60)]  # ties
    rows += [(n + 60, None), (n + 61, []), (n + 62, [1.0, float("nan")]), (n + 63, [None]), (n + 64, [float("inf")]), (None, [1.0])]
    rows += [(50, rows[50][1]), (50, [0.5] * dims), (7, rows[7][1]), (n + 65, [2.0, 2.0]), (-50, [0.25] * (dims + 2))]
    return rows


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block", [3, 2048])
def test_against_brute_force(spark, seed, block):
    rows = made(seed)
    vectors = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0, block=block).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect())) == plain(rows)


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e15, 3.0]), (1, [1e15, -2.0]), (2, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = [(r.query_id, r.rank, r.vec_id) for r in topk.top_k(vectors.where("vec_id > 0"), F.col("vec_id") == 1).collect()]
    assert found == [(1, 1, 2)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []
