"""Decontamination: alignment against a plain table, planted copies, whole copies in the tables, edge rows."""

import random

import numpy as np
import pytest

from prevspark.llm import decontaminate as D


def plain_align(doc, item):
    best = 0
    table = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_alignment(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(9)]
    items = [[rng.randrange(6) for _ in range(rng.randrange(1, 12))] for _ in range(9)]
    left, right = np.full((9, 30), -1), np.full((9, 12), -2)
    for r in range(9):
        left[r, : len(docs[r])], right[r, : len(items[r])] = docs[r], items[r]
    score, first, end = (x.tolist() for x in D.align(left, right))
    assert score == [plain_align(d, i) for d, i in zip(docs, items)]
    for d, i, s, a, b in zip(docs, items, score, first, end):  # the words between hold the alignment, which is of equal words at both ends
        assert plain_align(d[a:b], i) == s and (not s or d[a] in i and d[b - 1] in i)


def plain_matches(docs, items):
    """Every whole document against every item."""
    out = set()
    for d, text in docs:
        words = D.words_of(text)
        for i, item in items:
            w = D.words_of(item)
            if len(w) >= D.LEAST_WORDS and plain_align(words, w) >= len(w):
                out.add((d, i))
            if 0 < len(w) < D.LEAST_WORDS and any(words[k : k + len(w)] == w for k in range(len(words))):
                out.add((d, i))
    return out


def test_all_pairs(spark):
    """Random words of a small vocabulary, so that alignments arise by chance as well; items of every length."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfgk") + rng.choice("aeiou") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(1 + i % 20))) for i in range(60)]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randrange(0, 120))]
        if d % 2:
            text[len(text) // 3 : len(text) // 3] = items[d % 60][1].split()
        docs.append((d, " ".join(text)))
    found = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    truth = plain_matches(docs, items)
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= truth and len(got) > 50
    short = {i for i, t in items if len(t.split()) < D.LEAST_WORDS}
    assert {p for p in truth if p[1] in short} <= got
    assert {(d, d % 60) for d in range(1, 80, 2)} <= got  # whole copies
    for r in found:
        words, item = D.words_of(docs[r.doc_id][1]), D.words_of(items[r.item_id][1])
        part = words[r.end_word - r.matched_words : r.end_word]
        assert plain_align(part, item) == round(r.score * 2 * len(item))


def test_columns(spark):
    item = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, "filler " * 50 + item + " end"), (2, "甲乙丙丁戊己庚辛壬癸子丑")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "乙丙丁戊己庚辛壬癸"), (3, "end"), (4, "w3 w4")], "item_id long, text string")
    found = sorted(tuple(r) for r in D.matches(docs, bench).collect())
    assert found == [(1, 1, 1.0, 10, 60), (1, 3, 1.0, 1, 61), (1, 4, 1.0, 2, 55), (2, 2, 1.0, 9, 10)]
    # one or two words alone do not drop a document
    only = bench.where("item_id >= 3")
    assert D.without_matches(docs, only).count() == 2 and D.without_matches(docs, bench).count() == 0


def test_planted(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(3))
    items = [[word() for _ in range(rng.randrange(10, 60))] for _ in range(30)]
    docs, truth = [], set()
    for d in range(120):
        text = [word() for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            i = rng.randrange(30)
            copy = [word() if d % 2 and rng.random() < 0.15 else w for w in items[i]]
            if d % 4 == 0:
                del copy[len(copy) // 2]
            text[len(text) // 2 : len(text) // 2] = [w.upper() + "," for w in copy]
            if plain_align([w.lower() for w in copy], items[i]) >= len(items[i]):  # half of the full score
                truth.add((d, i))
        docs.append((d, " ".join(text), "x"))
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()}
    assert found == truth
    kept = D.without_matches(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(120)) - {d for d, _ in truth}
    assert len(truth) > 30


def test_blocks_find_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, D.matches(docs, bench).select("doc_id", "item_id", "score").collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 1800)
    monkeypatch.setattr(D, "CELLS", 500)
    assert sorted(map(tuple, D.matches(docs, bench).select("doc_id", "item_id", "score").collect())) == whole


def test_whole_copies_in_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts, items = docs.collect(), bench.collect()
    held = {(d.doc_id, i.item_id) for d in texts for i in items if i.text in d.text}
    found = {(r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()}
    assert held <= found and len(found) <= 2 * len(held)


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, item), (1, None), (2, ""), (3, item), (3, item), (4, "filler " * 50_000 + item), (5, "one two three")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (None, None), (9, "too short"), (10, "")], "item_id long, text string")
    found = sorted((r.doc_id or -1, r.item_id, r.score) for r in D.matches(docs, bench).collect())
    assert found == sorted((d, i, 1.0) for d in (-1, 3, 3, 4) for i in (7, 8))
    assert sorted(r.doc_id for r in D.without_matches(docs, bench).collect()) == [1, 2, 5]
    assert D.matches(docs, bench.limit(0)).collect() == [] == D.matches(docs.limit(0), bench).collect()
