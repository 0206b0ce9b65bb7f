"""Token ids as wavelet-matrix shards: encode, write, read back.

Rows are dealt by ranges of doc_id and sorted, so that partitions follow one another; each task cuts its rows into shards of
about ``SHARD`` ids and hands each on as one binary value, which Spark's own Parquet writer commits: a lost task leaves no
half-written file, and any store that Spark writes to will do. Offsets come from the partitions' totals.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prevspark.llm.common import scratch
from prevspark.llm.wavelet import WaveletMatrix, from_bytes, to_bytes

#: Ids of a shard; documents are not split, so that the last one may exceed it.
SHARD = 1 << 20
#: Places of a worker's table of known pieces; characters that are cut at once.
PLACES, GROUP = 1 << 21, 1 << 19
SHARDS = "part int, seq int, first long, n_tokens long, n_docs long, shard binary"

#: Characters whose class is plain; a text with any other goes to the library whole.
SAFE = re.compile(r"[\t\n\x0b\x0c\r -~¡-©«-±´¶-·»¿-ɏ–—‘’“”…€]*")
#: What the tokenizer cuts off after an apostrophe.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: A piece that can stand on a line with others.
LINE = re.compile(r"[^\S\n\0]?[^\s\0]+")
STOP, LETTER, DIGIT, MARK, SPACE, OTHER_SPACE = range(6)


def classes() -> np.ndarray:
    """The class of each code point below 0x2100, as far as SAFE characters go."""
    kind = np.full(0x2100, MARK, dtype=np.uint8)
    for first, last in (("A", "Z"), ("a", "z"), ("À", "Ö"), ("Ø", "ö"), ("ø", "ɏ")):
        kind[ord(first) : ord(last) + 1] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[9:14] = OTHER_SPACE
    kind[32], kind[0] = SPACE, STOP
    return kind


def cuts(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level tokenizer begin; 0 ends a text and is a piece of its own.

    A piece is an ending after an apostrophe; or letters, digits or other marks, with one space before them; or white space,
    without its last character if anything but white space follows.
    """
    before, after = np.r_[np.uint8(STOP), kind[:-1]], np.r_[kind[1:], np.uint8(STOP)]
    space = kind >= SPACE
    solid = (kind != before) & (before != SPACE) | (kind == STOP)
    start = np.where(space, (before < SPACE) | (after < SPACE) & (after != STOP), solid)
    for at in np.flatnonzero((codes == 39) & start).tolist():
        follow = "".join(map(chr, codes[at + 1 : at + 3].tolist()))
        size = next((len(e) for e in ENDINGS if follow.startswith(e)), 0)
        if size:
            start[at + 1], start[at + 1 + size] = False, True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts, each followed by ``end``.

    The library encodes each piece once, as its byte-level model never merges across pieces. A piece is looked up by a 64-bit
    hash of its characters, and its characters are compared with those of the piece that the table holds: a text in which
    any differ goes to the library whole.
    """

    def __init__(self, path: str, end: int = 0):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.end, self.kind = end, classes()
        self.id_type = np.uint16 if max(self.model.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32
        mix = np.arange(1, 0x2101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mix = (mix ^ (mix >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        self.mixed = mix ^ (mix >> np.uint64(29))
        self.power = self.inverse = np.ones(0, dtype=np.uint64)
        self.line_break = self.plain(["\n"])[0]
        self.forget()

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.id_type) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.keys, self.values = np.zeros(PLACES, dtype=np.uint64), np.zeros(PLACES, dtype=np.int32)
        room = PLACES * 6 // 10 + 1
        self.offset, self.size = np.zeros(room, dtype=np.int32), np.zeros(room, dtype=np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 20, dtype=self.id_type), 0, 0
        self.spelt, self.letters = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int64)
        self.text, self.written = np.zeros(1 << 20, dtype=np.uint16), 0

    def hashes(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A polynomial over the characters of each piece, from a running sum over all."""
        if len(self.power) < len(codes):
            n = max(len(codes), GROUP + 1)
            base = np.uint64(0xD1342543DE82EF95)
            self.power = np.cumprod(np.full(n, base))
            self.inverse = np.cumprod(np.full(n, np.uint64(pow(int(base), -1, 1 << 64))))
        total = np.cumsum(self.mixed[codes] * self.power[: len(codes)])
        ends = np.r_[starts[1:], len(codes)] - 1
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        found = (total[ends] - before) * self.inverse[starts]
        found = (found ^ (found >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (found ^ (found >> np.uint64(29))) | np.uint64(1)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Where each hash stands in the table, or the free place where it would."""
        at = (wanted >> np.uint64(40)).astype(np.int64) % PLACES
        left = np.arange(len(wanted))
        while len(left):
            held = self.keys[at[left]]
            left = left[(held != wanted[left]) & (held != 0)]
            at[left] = (at[left] + 1) % PLACES
        return at

    def learn(self, wanted: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces; those without white space inside go to the library together, a line each."""
        if self.n + len(pieces) > len(self.size):
            self.forget()
        # a line each, unless a piece holds white space after its first character, or nothing else
        alone = np.array([LINE.fullmatch(p) is None for p in pieces], dtype=bool)
        order = np.argsort(alone, kind="stable")
        wanted, pieces = wanted[order], [pieces[k] for k in order.tolist()]
        n_lines = len(pieces) - int(alone.sum())
        new, sizes = np.zeros(0, dtype=self.id_type), np.zeros(0, dtype=np.int64)
        if n_lines:
            ids = self.plain(["\n".join(pieces[:n_lines]) + "\n"])[0]
            breaks = np.flatnonzero(ids == self.line_break[0])
            new, sizes = ids[ids != self.line_break[0]], np.diff(np.r_[-1, breaks]) - 1
            if len(self.line_break) != 1 or len(breaks) != n_lines:  # the ids of a piece hold a line's end
                found = self.plain(pieces[:n_lines])
                new, sizes = np.concatenate(found), np.array([len(x) for x in found])
        stop = np.array([self.end], dtype=self.id_type)
        rest = [stop if p == "\0" else x for p, x in zip(pieces[n_lines:], self.plain(pieces[n_lines:]))]
        new, sizes = np.concatenate([new, *rest]), np.r_[sizes, [len(x) for x in rest]].astype(np.int64)
        while self.used + len(new) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : self.used + len(new)] = new
        spelling = np.frombuffer("".join(pieces).encode("utf-16-le"), dtype=np.uint16)  # SAFE characters take one unit each
        while self.written + len(spelling) > len(self.text):
            self.text = np.r_[self.text, np.zeros_like(self.text)]
        self.text[self.written : self.written + len(spelling)] = spelling
        rows = slice(self.n, self.n + len(sizes))
        self.letters[rows] = [len(p) for p in pieces]
        self.spelt[rows] = self.written + np.cumsum(self.letters[rows]) - self.letters[rows]
        self.written += len(spelling)
        self.size[rows], self.offset[rows] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used, value = self.used + len(new), np.arange(self.n, self.n + len(sizes), dtype=np.int32)
        self.n += len(sizes)
        left = np.arange(len(wanted))
        while len(left):  # of several that want one free place, the last written has it
            at = self.places(wanted[left])
            self.keys[at], self.values[at] = wanted[left], value[left]
            left = left[self.keys[at] != wanted[left]]

    def strange(self, codes: np.ndarray, starts: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Which pieces are spelt otherwise than those that the table holds at ``value``."""
        lengths = np.diff(np.r_[starts, len(codes)])
        at = np.repeat(self.spelt[value] - starts, lengths) + np.arange(len(codes))
        unlike = self.text[np.minimum(at, len(self.text) - 1)] != codes
        return (self.letters[value] != lengths) | np.logical_or.reduceat(unlike, starts)

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with its end, and how many each has."""
        # the different pieces of a text of that length are fewer than the table holds; the library takes longer ones whole
        safe = [len(t) <= 4 * GROUP and SAFE.fullmatch(t) is not None for t in texts]
        joined = "\0".join(t if s else "" for t, s in zip(texts, safe)) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        starts = cuts(codes, self.kind[codes])
        wanted = self.hashes(codes, starts)
        at = self.places(wanted)
        unknown = np.flatnonzero(self.keys[at] != wanted)
        if len(unknown):
            distinct, first = np.unique(wanted[unknown], return_index=True)
            which = unknown[first]
            ends = np.r_[starts[1:], len(codes)]
            before = self.n
            self.learn(distinct, [joined[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())])
            if self.n < before + len(distinct):  # the table began anew
                return self.many(texts)
            at = self.places(wanted)
        value = self.values[at]
        strange = np.flatnonzero(self.strange(codes, starts, value))
        if len(strange):
            last = np.flatnonzero(codes[starts] == 0)  # the piece that ends each text
            for k in np.unique(np.searchsorted(last, strange)).tolist():
                safe[k] = False
        sizes = self.size[value].astype(np.int64)
        sums = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.offset[value] - (sums - sizes), sizes) + np.arange(sums[-1])]
        ends = sums[codes[starts] == 0]
        lengths = np.diff(np.r_[0, ends])
        if all(safe):
            return ids, lengths
        parts = np.split(ids, ends[:-1])
        for k, s in enumerate(safe):
            if not s:
                whole = self.model.encode(texts[k], add_special_tokens=False).ids
                parts[k] = np.array([*whole, self.end], dtype=self.id_type)
        return np.concatenate(parts), np.array([len(x) for x in parts])


@lru_cache(maxsize=1)
def encoder(path: str, end: int) -> Encoder:
    """A worker's encoder: kept from task to task, with the pieces that it knows."""
    return Encoder(path, end)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = 0, shard: int = SHARD) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in order of doc_id, write their shards below ``path`` and return that table.

    Each document's ids are followed by ``end``. Null texts count as empty; null ids come first; rows that repeat an id
    follow each other by text, whose beginning also parts them among tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part = encoder(tokenizer, end), TaskContext.get().partitionId()
        first = seq = held = 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(parts))
            row = [part, seq, first, held, len(doc_ids), to_bytes(matrix, doc_ids, np.concatenate(sizes))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds)], names=["part", "seq", "first", "n_tokens", "n_docs", "shard"]
            )

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) < min(GROUP, shard)):
                    chars += len(texts[stop]) + 1
                    stop += 1
                ids, lengths = encode.many(texts[at:stop])
                doc_ids += names[at:stop]
                parts.append(ids)
                sizes.append(lengths)
                held += len(ids)
                at = stop
                if held >= shard:
                    yield flush()
                    first, seq, held = first + held, seq + 1, 0
                    doc_ids, parts, sizes = [], [], []
        if parts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.substring("text", 1, 24).alias("head"))
    rows = rows.repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "text")
    rows.select("doc_id", "text").mapInArrow(run, SHARDS).write.parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, seq) of each document, from the shards alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, first, data in zip(*(batch.column(i) for i in range(4))):
                matrix, doc_ids, lengths = from_bytes(data.as_py())
                raw = matrix.all().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([seq.as_py()] * n, pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts + first.as_py(), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    # few shards at a time: each is unpacked in the worker
    found = shards.select("part", "seq", "first", "shard").mapInArrow(
        run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long"
    )
    # one row for each partition that wrote, not for each shard
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return found.join(offsets, "part").select(
        "doc_id", (F.col("within") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "seq"
    )


def encode_corpus(docs: DataFrame, tokenizer: str, end: int = 0, shard: int = SHARD) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read the documents' places and checksums back.

    One row for each row of ``docs``: null and empty texts have the end id alone, rows that repeat have a place each, and an
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    path = scratch(docs.sparkSession, "token_shards")
    return read_documents(write_shards(docs, path, tokenizer, end, shard))


def read_shard(spark: SparkSession, path: str, part: int, seq: int) -> WaveletMatrix:
    """One shard, for access, rank and select."""
    row = spark.read.schema(SHARDS).parquet(path).where((F.col("part") == part) & (F.col("seq") == seq)).first()
    return from_bytes(bytes(row.shard))[0]
