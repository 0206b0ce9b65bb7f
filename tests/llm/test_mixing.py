"""Mixing: targets against the plain rule, exact totals, the schedule's evenness, and the mix's rows."""

import random
import struct

import pytest
import xxhash

from prevspark.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3)):
    """Shares by weight; what is above three sizes is shared again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {None if i == 0 else f"s{i}é" if i == 3 else f"s{i}": rng.choice([0, 3, 50, 4000, 10**6]) for i in range(9)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_slots_are_exact_and_even(spark):
    need = {1: 500, 2: 0, 3: 3, 4: 1200, 5: 1}
    goals = spark.createDataFrame(list(need.items()), "source_id int, need long")
    rows = sorted(map(tuple, mixing.slots(goals).collect()))
    assert len({r[0] for r in rows}) == len(rows)
    for source, n in need.items():
        assert sorted(r[2] for r in rows if r[1] == source) == list(range(n))
    for end in (100, 400, 1000, 1600):  # near its share at any time
        for source, n in need.items():
            assert abs(sum(r[1] == source for r in rows[:end]) - end * n / 1704) < 6


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mixture(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(docs.repartition(3)).collect()))
    texts = {r.doc_id: (r.source, len([w for w in r.text.encode().split()])) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == {d: n for d, (_, n) in texts.items()} and len(rows) == len(texts)
    sizes = {}
    for s, n in texts.values():
        sizes[s] = sizes.get(s, 0) + n
    target = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if texts[r.doc_id][0] == s]
        assert sum(r.taken for r in own) == pytest.approx(target[s], abs=1)
        assert {r.source_size for r in own} == {sizes[s]} and own[0].target == pytest.approx(target[s])
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert max(r.taken for r in rows) > 0
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == {r.doc_id: r.taken for r in rows if r.taken}


def plain_mix(docs, block, seed=7, epochs=3):
    """(taken, first slot) of every (doc_id, source, size): golden points fill slots, a source's line fills its blocks."""
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s))
    whole = {s: min(int(t + 0.5), epochs * sizes[s]) for s, t in plain_targets(sizes).items()}
    need = {s: -(-whole[s] // block) for s in names}
    n, low, at = sum(need.values()), {}, 0
    for s in names:
        low[s], at = at, at + need[s]
    slot_of, have = {}, dict.fromkeys(names, 0)
    for t in range(n):
        u = (t + 1) % mixing.CIRCLE * mixing.GOLDEN % mixing.CIRCLE / mixing.CIRCLE * n
        s = max((x for x in names if need[x] and low[x] <= u), key=lambda x: low[x])
        slot_of[s, have[s]] = t
        have[s] += 1
    late = [(s, r) for s in names for r in range(have[s], need[s])]
    slot_of |= {key: n + i for i, key in enumerate(late)}
    out = {}
    for s in names:
        key = lambda d: xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", d), 42))
        at = 0
        for d, _, size in sorted((x for x in docs if x[1] == s), key=lambda x: key(x[0]) - (1 << 64) * (key(x[0]) >> 63)):
            taken, first = 0, None
            for turn in range(epochs):
                a, b = turn * sizes[s] + at, min(turn * sizes[s] + at + size, whole[s])
                if a < b:
                    taken += b - a
                    here = min(slot_of[s, r] for r in range(a // block, (b - 1) // block + 1))
                    first = here if first is None else min(first, here)
            out[d] = (taken, first)
            at += size
    return out


@pytest.mark.parametrize("block", [8, 128])
def test_the_schedule_is_the_plain_one(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    expected = plain_mix(plain, block)
    rows = mixing.mixture(docs, block=block)
    assert {r.doc_id: (r.taken, r.first_slot) for r in rows.collect()} == expected


def test_the_mix_follows_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 256)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slot = {r.doc_id: r.first_slot for r in mixing.mixture(docs).collect()}
    seen, order = set(), []
    for r in mixing.mixed(docs).collect():
        if r.doc_id not in seen:
            order.append(slot[r.doc_id])
            seen.add(r.doc_id)
    assert order == sorted(order) and len(order) > 500


def test_edge_rows(spark):
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, "one two", None, 0), (3, "one two", None, 1), (3, "x", None, 1), (None, "p q r", "b", 0),
            (4, "w " * 3000, "c", 0), (5, "\tz\x0b", "only", 0), (6, None, "empty", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    found = mixing.mixture(docs, block=4).collect()
    assert len(found) == 9 and sum(r.taken for r in found) == pytest.approx(3009, abs=4)
    assert all(r.taken <= 3 * r.size for r in found)
    got = mixing.mixed(docs, block=4)
    assert got.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in got.collect()) == sum(r.taken for r in found)
    assert mixing.mixture(docs.limit(0)).collect() == [] == mixing.mixed(docs.limit(0)).collect()
