"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages around them.

A first pass counts in how many documents each word n-gram of the benchmark occurs. An item's seeds are its n-grams that are
rare in that count, and at least the rarest of every few places, so that no item goes without however often it leaked. A
second pass aligns the surroundings of every seed in a document with the whole item, by words, and keeps the best alignment.
Items of a few words have no edits to allow: they are found whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a seed; share of the documents up to which an n-gram is rare; places of which one at least holds a seed.
SEED, RARE, STRIDE = 3, 1e-4, 4
#: Scores of equal words, unequal words and a gap; all of an item's words aligned score MATCH each.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's full score from which a document counts as contaminated; items of fewer words must be held whole.
THRESHOLD, LEAST_WORDS = 0.5, 8
#: Words of items whose finding drops a document: one or two words alone are no leak.
DROPS = 3
#: Bytes of benchmark items that a task holds at once; more are taken in blocks.
BLOCK_BYTES = 12_000_000
#: Cells that are aligned at once, a document's words times the pairs of a seed and an item.
CELLS = 1 << 18
#: Scripts that put no spaces between words; each of their characters counts as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def words_of(text: str | None) -> list[bytes]:
    """Words of ``text`` in lower case, without the marks around them."""
    text = (text or "").lower()
    if UNSPACED.search(text):
        text = UNSPACED.sub(r" \g<0> ", text)
    found = text.encode("utf-8", "surrogatepass").split()
    return [w for w in (x.strip(b".,;:!?\"'()[]{}<>|*#$%&") for x in found) if w]


class Runs:
    """Numbers of the runs of ``size`` words that ``texts`` have: exact, a word at a time, for any vocabulary."""

    def __init__(self, texts: list[np.ndarray], size: int):
        self.size = size
        self.levels: list[np.ndarray] = []
        for n in range(2, size + 1):
            found = [self.codes(t, n) for t in texts]
            self.levels.append(np.unique(np.concatenate([f[f >= 0] for f in found] or [np.empty(0, np.int64)])))

    def codes(self, words: np.ndarray, n: int) -> np.ndarray:
        """The number of the first n - 1 words of each run of ``n``, joined with its last word; -1 where either is unknown."""
        held = words if n == 2 else self.number(words, n - 1)
        held, last = held[: max(0, len(words) - n + 1)], words[n - 1 :]
        return np.where((held >= 0) & (last >= 0), (held << 31) | last, -1)

    def number(self, words: np.ndarray, n: int = 0) -> np.ndarray:
        """The number of each run of ``n`` words (``size`` without it) of ``words``; -1 where no text has it."""
        n = n or self.size
        if n == 1:
            return words
        codes, level = self.codes(words, n), self.levels[n - 2]
        if not len(level) or not len(codes):
            return np.full(len(codes), -1, dtype=np.int64)
        k = np.minimum(np.searchsorted(level, codes), len(level) - 1)
        return np.where(level[k] == codes, k, -1)


class Items:
    """The items of one block, as numbers of words, with their n-grams; short ones with the numbers of all their words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        self.words = [np.array([number(w) for w in words_of(t)], dtype=np.int64) for _, t in rows]
        long = [i for i, w in enumerate(self.words) if len(w) >= LEAST_WORDS]
        self.runs = Runs([self.words[i] for i in long], SEED)
        grams, item, at = [], [], []
        for i in long:
            found = self.runs.number(self.words[i])
            grams.append(found)
            item.append(np.full(len(found), i))
            at.append(np.arange(len(found)))
        self.gram, self.item, self.at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (grams, item, at))
        self.distinct = np.unique(self.gram)
        self.short: list[tuple[Runs, dict[int, list[int]]]] = []
        for n in range(1, LEAST_WORDS):
            some = [i for i, w in enumerate(self.words) if len(w) == n]
            if some:
                runs, named = Runs([self.words[i] for i in some], n), {}
                for i in some:
                    named.setdefault(int(runs.number(self.words[i])[0]), []).append(i)
                self.short.append((runs, named))

    def number(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def held(self, words: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``words`` that open with one of the sorted grams ``wanted``, and which."""
        grams = self.runs.number(words)
        at = np.flatnonzero(grams >= 0)
        if not len(at) or not len(wanted):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(wanted, grams[at]), len(wanted) - 1)
        equal = wanted[k] == grams[at]
        return at[equal], k[equal]

    def whole(self, words: np.ndarray) -> list[tuple]:
        """(item, 1, first word, end word) of each short item that ``words`` hold whole, where it stands first."""
        found: dict[int, tuple] = {}
        for runs, named in self.short:
            numbers = runs.number(words)
            number, first = np.unique(numbers, return_index=True)
            for k, at in zip(number.tolist(), first.tolist()):
                for i in named.get(k, ()):
                    found[i] = (i, 1.0, at, at + runs.size)
        return list(found.values())


def align(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of ``doc`` (k, m) with the row of ``item`` (k, n): score, first and end place in ``doc``.

    -1 fills the rows of ``doc`` and -2 those of ``item``; neither equals anything. A cell is its score and, in the low bits,
    where its alignment begins, so that of equal scores the one that begins last is carried on.
    """
    k, m = doc.shape
    one = 1 << 32
    place = np.arange(m + 1, dtype=np.int64)
    above = np.tile(place, (k, 1))
    best, end = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    slope = -GAP * one * place
    for j in range(item.shape[1]):
        word = item[:, j : j + 1]
        now = np.tile(place, (k, 1))
        step = np.where((doc == word) & (doc >= 0), MATCH * one, MISMATCH * one)
        np.maximum(above[:, :-1] + step, above[:, 1:] + GAP * one, out=now[:, 1:])
        np.maximum(now, place, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the document
        np.maximum(now, place, out=now)
        now = np.where(word == -2, above, now)
        top = (now >> 32).argmax(axis=1)
        cell = now[np.arange(k), top]
        better = cell >> 32 > best >> 32
        best[better], end[better] = cell[better], top[better]
        above = now
    return best >> 32, np.where(best >> 32 > 0, best & (one - 1), end), end


def counted(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many rows of ``docs`` (text) each distinct gram of the items occurs: one count a gram leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.distinct), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                _, k = items.held(items.number(words_of(text.as_py())), items.distinct)
                total[np.unique(k)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    found = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(items.distinct), dtype=np.int64)
    out[found.k.to_numpy()] = found.n.to_numpy()
    return out


def seeds(items: Items, often: np.ndarray, n_docs: int) -> np.ndarray:
    """Which of the items' grams are seeds."""
    if not len(items.gram):
        return np.zeros(0, dtype=bool)
    count = often[np.searchsorted(items.distinct, items.gram)]
    chosen = count <= max(2.0, RARE * n_docs)
    place = items.item * (1 << 40) + items.at // STRIDE
    order = np.lexsort((items.at, count, place))
    first = order[np.r_[True, np.diff(place[order]) != 0]]
    chosen[first] = True
    return chosen


def aligned(doc: np.ndarray, items: Items, wanted: np.ndarray, by_gram: list[np.ndarray], threshold: float) -> list[tuple]:
    """(item, score share, first word, end word) of each item that a document holds, best alignment each."""
    at, k = items.held(doc, wanted)
    if not len(at):
        return []
    tries: dict[tuple[int, int], None] = {}
    for a, g in zip(at.tolist(), k.tolist()):
        for s in by_gram[g].tolist():
            i, offset = int(items.item[s]), int(items.at[s])
            size = len(items.words[i])
            # seeds of one passage share its window: starts are rounded to half an item
            tries[i, (a - offset) // max(1, size // 2)] = None
    found: dict[int, tuple] = {}  # by item
    todo, at = sorted(tries, key=lambda t: len(items.words[t[0]])), 0
    while at < len(todo):
        stop = at + 1
        while stop < len(todo) and (stop + 1 - at) * 3 * len(items.words[todo[stop][0]]) <= CELLS:
            stop += 1
        part, at = todo[at:stop], stop
        n = max(len(items.words[i]) for i, _ in part)
        spans = []
        for i, half in part:
            size = len(items.words[i])
            start = half * max(1, size // 2) - size // 2
            spans.append((max(0, start), min(len(doc), start + 3 * size)))
        m = max(b - a for a, b in spans)
        left, right = np.full((len(part), m), -1, dtype=np.int64), np.full((len(part), n), -2, dtype=np.int64)
        for r, ((i, _), (a, b)) in enumerate(zip(part, spans)):
            left[r, : b - a] = doc[a:b]
            right[r, : len(items.words[i])] = items.words[i]
        for (i, _), (a, _), s, first, end in zip(part, spans, *(x.tolist() for x in align(left, right))):
            share = s / (MATCH * len(items.words[i]))
            if share >= threshold and share > found.get(i, (0, 0.0))[1]:
                found[i] = (i, share, a + first, a + end)
    return list(found.values())


class Finder:
    """What a task needs to find the items of one block."""

    def __init__(self, rows: DataFrame, items: Items, n_docs: int, threshold: float):
        chosen = seeds(items, counted(rows, items), n_docs)
        self.items, self.threshold = items, threshold
        self.wanted, inverse = np.unique(items.gram[chosen], return_inverse=True)
        place = np.flatnonzero(chosen)[np.argsort(inverse, kind="stable")]
        self.by_gram = np.split(place, np.cumsum(np.bincount(inverse, minlength=len(self.wanted)))[:-1])

    def __call__(self, text: str | None) -> list[tuple]:
        words = self.items.number(words_of(text))
        return aligned(words, self.items, self.wanted, self.by_gram, self.threshold) + self.items.whole(words)


def finders(docs: DataFrame, benchmark: DataFrame, threshold: float, least: int = 1) -> Iterator[Finder]:
    """One finder for each block of items of ``least`` words or more; a block's bytes are bounded, however large the benchmark is."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    n_docs = docs.count()
    for b in range(blocks if n_docs else 0):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        part = [(r.item_id, r.text) for r in part if len(words_of(r.text)) >= least]
        if part:
            yield Finder(docs.select("text"), Items(part), n_docs, threshold)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, matched_words, end_word) of every document that holds an item, whole or edited.

    ``score`` is the alignment's share of the item's full score; pairs below ``threshold`` are left out. Of the document's words,
    the ``matched_words`` before ``end_word`` are the alignment's. Items of fewer than LEAST_WORDS words are found where a
    document holds them whole. Null texts and items without words match nothing. Repeated items match each; repeated
    documents give their rows each.
    """
    schema = "doc_id long, item_id long, score double, matched_words long, end_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = [rows.mapInArrow(pairs(f), schema) for f in finders(rows, benchmark, threshold)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def pairs(find: Finder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hits = [], []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = find(text.as_py())
                ids += [doc_id.as_py()] * len(found)
                hits += found
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([find.items.ids[h[0]] for h in hits], pa.int64()),
                pa.array([h[1] for h in hits], pa.float64()),
                pa.array([h[3] - h[2] for h in hits], pa.int64()),
                pa.array([h[3] for h in hits], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "matched_words", "end_word"])

    return run


def without_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = DROPS) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``least`` words or more, with the columns of ``docs``; rows stay where they are.

    Null and empty texts hold nothing and stay; rows that repeat stay or go together. An empty benchmark drops nothing.
    """
    held = docs
    for find in finders(docs, benchmark, threshold, least):
        clean = F.pandas_udf(lambda s, find=find: pd.Series([not find(t) for t in s], dtype=bool), "boolean")
        held = held.where(clean(docs["text"]))
    return held
