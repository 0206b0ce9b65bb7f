"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Queries are taken in blocks of bounded size against every row. A task turns each batch of rows into postings by
dimension; the query rows scatter their weights times the postings into a dense score array, a partition selection keeps
what can still be among the k best, and one window merges the tasks' survivors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevspark.llm.common import store

#: Bytes of the queries that are held in each task at once; each block of queries is one pass over the rows.
BLOCK_BYTES = 1 << 25
#: Queries and rows of one dense score array; small enough for a core's cache.
TILE_QUERIES, TILE_ROWS = 256, 512


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as a long; null where the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def dense(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of whole numbers as a matrix; shorter rows end in zeros, components beyond ``dims`` meet none."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = column < dims
    out[row[held], column[held]] = values[held]
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, a term at a time: each dimension's posting list is scattered into the rows of scores."""
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    kind = np.int32 if top < 2**31 else np.int64 if top < 2**63 else object
    queries, rows = queries.astype(kind), rows.astype(kind)
    scores = np.zeros((len(queries), len(rows)), dtype=kind)
    for term in range(queries.shape[1]):
        of_query, of_row = queries[:, term], rows[:, term]
        q, r = np.flatnonzero(of_query), np.flatnonzero(of_row)
        if len(q) == len(queries) and len(r) == len(rows):
            scores += of_query[:, None] * of_row[None, :]
        elif len(q) and len(r):
            scores[np.ix_(q, r)] += of_query[q, None] * of_row[None, r]
    return scores


class Best:
    """The k best rows of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, -(2**63), dtype=np.int64)
        self.rows = [np.empty(0, dtype=np.int64)] * 3
        self.waiting: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Take a tile's scores; ``own`` marks the pairs of a query with itself."""
        if scores.dtype == object:  # scores stop at the bounds of a long
            scores = np.clip(scores, 1 - 2**63, 2**63 - 1)
        scores = scores.astype(np.int64)
        floor = self.floor[first : first + len(scores)]
        if scores.shape[1] > self.k:
            masked = np.where(own, -(2**63), scores)
            kth = np.partition(masked, -self.k, axis=1)[:, -self.k]
            np.maximum(floor, kth, out=floor)
        q, r = np.nonzero((scores >= floor[:, None]) & ~own)
        if len(q):
            self.waiting.append([q + first, scores[q, r], ids[r]])
            self.size += len(q)
            if self.size > 500_000:
                self.settle()

    def settle(self) -> list[np.ndarray]:
        q, score, ids = (np.concatenate(x) for x in zip(self.rows, *self.waiting, strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        kept = rank < self.k
        self.rows = [q[kept], score[kept], ids[kept]]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.waiting, self.size = [], 0
        return self.rows


def search_block(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Each task's k best rows of ``rows`` (vec_id, q) for each of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        by_id = np.argsort(ids, kind="stable")
        for batch in batches:
            row_ids = batch.column(0).to_numpy(zero_copy_only=False)
            matrix = dense(batch.column(1), queries.shape[1])
            for r in range(0, len(row_ids), TILE_ROWS):
                tile, tile_ids = matrix[r : r + TILE_ROWS], row_ids[r : r + TILE_ROWS]
                at = np.searchsorted(ids, tile_ids, sorter=by_id)
                at = by_id[np.minimum(at, len(ids) - 1)]
                own_row = np.flatnonzero(ids[at] == tile_ids)
                for q in range(0, len(ids), TILE_QUERIES):
                    own = np.zeros((min(TILE_QUERIES, len(ids) - q), len(tile_ids)), dtype=bool)
                    here = own_row[(at[own_row] >= q) & (at[own_row] < q + TILE_QUERIES)]
                    own[at[here] - q, here] = True
                    best.add(q, accumulate(queries[q : q + TILE_QUERIES], tile), tile_ids, own)
        q, score, found = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"]
        )

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int | None = None,
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row that ``is_query`` holds for.

    Returns (query_id, rank, vec_id, score), ties to the smaller vec_id. Rows without an id, and vectors that are null or
    hold null or non-finite components, take no part. Vectors of unequal length meet on their common components. Rows that
    repeat an id are candidates each; as queries the least of their vectors stands for them, and none of them is a
    candidate of its own id. Components and scores stop at the bounds of a long. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("q"), is_query.alias("is_query")
    ).where("vec_id is not null and q is not null")
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("q").alias("q"))
    n, dims = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    block = block or max(1, BLOCK_BYTES // (8 * max(1, dims)))
    blocks = max(1, -(-n // block))
    found = []
    for b in range(blocks):
        # each block is of bounded size, as the hash deals the queries out evenly
        held = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        if not held.num_rows:
            continue
        ids = held.column("vec_id").to_numpy()
        lists = held.column("q").combine_chunks()
        part = search_block(rows.select("vec_id", "q"), ids, dense(lists, dims), k)
        found.append(store(part, "top") if blocks > 1 else part)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
