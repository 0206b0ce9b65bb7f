"""SimHash: fingerprints, the Gray index, components and the kept rows, each against brute force."""

import random

import numpy as np
import pytest
import xxhash

from prevspark.llm import simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, component_id string"


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, k=4):
    """Least doc_id that is reachable, by position."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= k:
                root[find(i)] = find(j)
    return [min(prints[j][0] for j in range(n) if find(j) == find(i)) for i in range(n)]


def test_fingerprint_matches_definition():
    for text in (None, "", " \n\t", "One", "a b c d", "a b c d e", "É B C d e f\x0bg h", "x " * 500):
        assert simhash.fingerprint(text) == plain_print(text), text


@pytest.mark.parametrize("seed", range(5))
def test_index_joins_what_all_pairs_join(seed):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(60)]
    codes += [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for c in codes for _ in range(4)]
    codes = sorted(set(codes))
    bucket = np.array([rng.randrange(3) for _ in codes])
    a, b = simhash.GrayIndex(bucket, np.array(codes, dtype=np.uint64)).forest(4)
    label = {c: c for c in codes}

    def find(c):
        while label[c] != c:
            c = label[c]
        return c

    for x, y in zip(a.tolist(), b.tolist()):
        label[find(x)] = find(y)
    true = {c: c for c in codes}

    def find_true(c):
        while true[c] != c:
            c = true[c]
        return c

    for i, x in enumerate(codes):
        for j in range(i):
            if bucket[i] == bucket[j] and (x ^ codes[j]).bit_count() <= 4:
                true[find_true(x)] = find_true(codes[j])
    groups = {}
    for c in codes:
        assert groups.setdefault(find(c), find_true(c)) == find_true(c)
    assert len({find(c) for c in codes}) == len({find_true(c) for c in codes})


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_masks_cover_all_near_pairs(n):
    masks, rng = simhash.key_masks(n, 4), random.Random(1)
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(difference & m == 0 for m in masks)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [(i, plain_print(t)) for i, t in rows]
    expected = {(i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == expected
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in expected})


def test_edge_rows(spark):
    rows = [(3, None, "en", "x"), (1, "", None, None), (2, " \n", "en", "x"), (None, "alone here", "en", "x"),
            (7, "same words in a row", "en", "b"), (7, "same words in a row", "en", "a"), (9, "Same words in a row", "en", "a")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(3, 1), (1, 1), (2, 1), (None, None), (7, 7), (9, 7)}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 7]
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).collect() == [] == simhash.one_of_each(empty).collect()


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(-5, 3), (39, -1)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found[9] == -5 and found[3] == -5 and found[12] == 10 and found[30] == -1
