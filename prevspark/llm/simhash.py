"""SimHash near duplicates: fingerprints, a Gray-order hierarchical index for near pairs, and connected components.

Fingerprints that differ in at most k of 64 bits agree on some combination of blocks of bits (pigeonhole). Those
combinations deal the distinct fingerprints out to tasks. Inside a task, each bucket is indexed: codes sorted by Gray rank
form leaves, a node holds the bits that all codes below it share and that no node above it has, and a search carries the
differences that it has accumulated on the way down, leaving a whole group as soon as they exceed k. A bucket sends on only
a spanning forest of its links, so that a cluster of m fingerprints costs m rows and not m squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevspark.llm.common import columns_aside, store

BITS = 64
#: Codes of a leaf, and children of an upper node.
LEAF, FANOUT = 16, 8
#: Pairs of a query and a node that are held at once.
FRONTIER = 1_000_000
#: Rows that a task gathers before it indexes the buckets that are complete.
GATHER = 200_000
#: Fingerprints in a bucket, on average, beyond which longer keys are taken.
BUCKET = 512


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes themselves for print 0; for others, hashes that are as good as independent of them."""
    if not n:
        return hashes
    z = hashes + np.uint64((n * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(text: str | None, shingle: int = 4, prints: int = 1) -> list[int]:
    """Majority of the bits of the XXH64 (seed 42) of each word shingle, and of ``prints`` - 1 mixtures; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return [0] * prints
    line = b" ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    ends = starts[shingle : shingle + n] - 1 if len(words) >= shingle else np.array([len(line)])
    xxh = xxhash.xxh64_intdigest
    hashes = np.array([xxh(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())], dtype=np.uint64)
    out = []
    for p in range(prints):
        votes = np.zeros(BITS, dtype=np.int64)
        for at in range(0, n, 65_536):
            part = mixed(hashes[at : at + 65_536], p).astype(">u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big"))
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return fingerprints(text, shingle)[0]


def others(prints: int) -> list[str]:
    """Columns of the further fingerprints."""
    return [f"fp{i}" for i in range(1, prints)]


def with_fingerprint(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", prints: int = 1) -> DataFrame:
    """(doc_id, fp, fp1, ...) of every row; the fingerprints are signed longs."""
    names = ["fp", *others(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprints(t.as_py(), shingle, prints) for t in batch.column(1)], dtype=np.uint64).reshape(-1, prints)
            columns = [pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, ", ".join(["doc_id long", *[f"{n} long" for n in names]])
    )


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchical index over the codes of many buckets; every bucket has a root of its own."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.codes, self.bucket = codes[order], bucket[order]
        self.levels: list[dict[str, np.ndarray]] = []
        group, ones, zeros, fanout = self.bucket, self.codes, ~self.codes, LEAF
        while True:
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[first, len(group)])
            if self.levels and (sizes == 1).all():
                break
            within = np.arange(len(group)) - np.repeat(first, sizes)
            starts = np.flatnonzero(within % fanout == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            group = group[starts]
            ends = np.r_[starts[1:], len(within)]
            self.levels.append({"start": starts, "end": ends, "ones": ones, "shared": ones | zeros, "group": group})
            fanout = FANOUT
        above = None
        for level in reversed(self.levels):  # keep only the bits that no node above has
            level["own"] = level["shared"] if above is None else level["shared"] & ~above
            spread = level["end"] - level["start"]
            above = np.repeat(level["shared"], spread)
        root = self.levels[-1]["group"]
        self.root = np.searchsorted(root, self.bucket)
        last = np.arange(len(self.codes))
        for level in self.levels:  # the last code below each node
            last = last[level["end"] - 1]
            level["last"] = last

    def pairs(self, first: int, end: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j), first <= i < end, i < j, of one bucket whose codes differ in at most k bits."""
        query = np.arange(first, end)
        node, spent = self.root[query], np.zeros(len(query), dtype=np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            spent = spent + np.bitwise_count((self.codes[query] ^ level["ones"][node]) & level["own"][node])
            held = (spent <= k) & (level["last"][node] > query)
            query, node, spent = query[held], node[held], spent[held]
            spread = level["end"][node] - level["start"][node]
            offset = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
            query, spent = np.repeat(query, spread), np.repeat(spent, spread)
            node = np.repeat(level["start"][node], spread) + offset
        held = (node > query) & (np.bitwise_count(self.codes[query] ^ self.codes[node]) <= k)
        return query[held], node[held]

    def forest(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the codes that stand for their groups: links that join what links of at most k bits join."""
        n = len(self.codes)
        label = np.arange(n)
        first_of = np.searchsorted(self.bucket, self.bucket, side="left")
        width = (np.searchsorted(self.bucket, self.bucket, side="right") - first_of) // LEAF + 1
        cost = np.cumsum(width)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, side="right")))
            unite(label, *self.pairs(at, end, k))
            at = end
        linked = np.flatnonzero(label != np.arange(n))
        return self.codes[linked], self.codes[label[linked]]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; ``label`` holds the least place of each group, and stays flat."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def key_masks(n: int, k: int) -> list[int]:
    """Masks of bits, one of which any two fingerprints that differ in at most k bits agree on.

    More fingerprints take longer keys, so that buckets stay small.
    """
    for blocks in range(k + 1, 2 * k + 2):
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(parts, blocks - k)]
        if n <= BUCKET << min(m.bit_count() for m in masks):
            break
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, k: int = 4) -> DataFrame:
    """(kind, a, b) links of distinct (kind, fp): in each kind their components are those of all pairs within k bits."""
    masks = key_masks(prints.groupBy("kind").count().agg(F.max("count")).first()[0] or 0, k)
    keys = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(masks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def links(done: bool) -> Iterator[pa.RecordBatch]:
            kind, c, v, fp = (np.concatenate(x) for x in zip(*kept, strict=True))
            new = np.r_[True, (kind[1:] != kind[:-1]) | (c[1:] != c[:-1]) | (v[1:] != v[:-1])]
            bucket = np.cumsum(new)
            cut = len(fp) if done else int(np.flatnonzero(new)[-1])  # the last bucket may go on
            kept[:] = [] if done else [[kind[cut:], c[cut:], v[cut:], fp[cut:]]]
            # a kind's buckets follow one another
            edges = np.r_[0, np.flatnonzero(kind[1:cut] != kind[: max(0, cut - 1)]) + 1, cut] if cut else []
            for first, end in zip(edges[:-1], edges[1:]):
                a, b = GrayIndex(bucket[first:end], fp[first:end].view(np.uint64)).forest(k)
                of = np.full(len(a), kind[first], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

        fresh = 0
        for batch in batches:
            kept.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            fresh += batch.num_rows
            if fresh >= GATHER:
                yield from links(done=False)
                fresh = 0
        if kept:
            yield from links(done=True)

    dealt = prints.select("kind", "fp", F.explode(keys).alias("key")).select("kind", "key.c", "key.v", "fp")
    dealt = dealt.repartition("kind", "c", "v").sortWithinPartitions("kind", "c", "v")
    return dealt.mapInArrow(run, "kind int, a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node that is reachable.

    Alternates large-star and small-star steps, each written to the shared folder, until a step changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = store(edges, "links")
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark or not now.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = store(small.distinct(), "small_star")


def grouped(prints: DataFrame, k: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp, fp1, ...).

    Rows are linked if any of their fingerprints differ in at most ``k`` bits. All kinds of fingerprints are searched at once;
    a further one that is near another, or that rows with unlike first ones share, is a node that links these rows.
    """
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    first = distinct.select(F.lit(0).alias("kind"), "fp")
    more = [c for c in prints.columns if c not in ("doc_id", "fp")]
    if not more:
        links = near_links(first, k).select("a", "b")
    else:
        each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("kind"), F.col(c).alias("other")) for i, c in enumerate(more)]))
        held = prints.select("fp", each.alias("x")).select("fp", "x.kind", "x.other").distinct()
        held = store(held, "kinds")
        shared = store(held.groupBy("kind", "other").agg(F.min("fp").alias("low"), F.max("fp").alias("high")), "shared")
        near = store(near_links(first.unionByName(shared.select("kind", F.col("other").alias("fp"))), k), "near")
        node = lambda x: F.when(F.col("kind") == 0, F.col(x)).otherwise(F.xxhash64("kind", x))
        ends = near.where("kind > 0").select("kind", F.explode(F.array("a", "b")).alias("other"))
        wanted = ends.unionByName(shared.where("low < high").select("kind", "other")).distinct()
        ties = held.join(wanted, ["kind", "other"]).select(F.col("fp").alias("a"), node("other").alias("b"))
        links = near.select(node("a").alias("a"), node("b").alias("b")).unionByName(ties)
    found = components(links)
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    roots = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return named.join(roots, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, k: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Rows whose fingerprints differ in at most ``k`` bits are linked; component_id is the least doc_id that is reachable.
    Null, empty and blank texts have the fingerprint zero and are linked like any other. Rows with a null doc_id stay, but
    never name a component unless it has no other id. Repeated rows stay repeated; an empty table gives no rows.
    """
    prints = store(with_fingerprint(docs, shingle, id_col, text_col), "fingerprints")
    return prints.join(grouped(prints, k), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@columns_aside(("doc_id", "text"))
def one_of_each(docs: DataFrame, k: int = 4, shingle: int = 4, broadcast_rows: int = 500_000, prints: int = 1) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without near duplicates: of each group one row stays.

    Rows are near if any of ``prints`` fingerprints differ in at most ``k`` bits: more of them find more of the near copies.
    It is the row with the least doc_id; of rows that repeat that doc_id, or of a group without any, the least by text.
    Columns are those of ``docs``. Ids to drop are broadcast up to ``broadcast_rows`` of them, and shuffled beyond.
    """
    found = store(with_fingerprint(docs, shingle, prints=prints), "fingerprints")
    groups = store(found.select("doc_id", "fp").join(grouped(found, k), "fp"), "groups")
    again = groups.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("again_id"))
    gone = groups.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    again_n, gone_n = again.count(), gone.count()
    if again_n:
        gone = gone.unionByName(again.select(F.col("again_id").alias("gone_id")).where("gone_id is not null"))
    gone = store(gone.distinct(), "gone")
    gone = F.broadcast(gone) if gone_n + again_n <= broadcast_rows else gone
    held = docs.where(docs["doc_id"].isNotNull()).join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")
    if not again_n:
        return held
    fp = F.pandas_udf(lambda s: s.map(lambda t: signed(fingerprint(t, shingle))).astype("int64"), "long")
    repeated = docs.join(again, docs["doc_id"].eqNullSafe(F.col("again_id")), "left_semi")
    repeated = repeated.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), fp(docs["text"]).alias("fp"))
    names = groups.where("component_id is null or doc_id = component_id").groupBy("fp").agg(
        F.min("root").alias("root"), F.min("component_id").alias("component_id")
    )
    order = Window.partitionBy("root").orderBy(F.col("row.text"))
    repeated = repeated.join(names, "fp").where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    repeated = repeated.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")
    return held.unionByName(repeated)
