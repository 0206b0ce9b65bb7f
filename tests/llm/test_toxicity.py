"""Toxicity: held-out accuracy, what may enter a score, and edge rows."""

import math
import random
import zlib

import numpy as np
import pytest

from prevspark.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    found = toxicity.rated(docs, labels).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert ((found.score >= 0.5).astype(int) == found.predicted).all()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id] == found.held_out.tolist()
    held = found[found.held_out].merge(labels.toPandas(), on="doc_id")
    toxic, said = held.toxic == 1, held.predicted == 1
    # a sixth of these toxic labels mark texts without any sign of it, and 260 toxic documents train the dictionary
    figures = (toxic == said).mean(), (toxic & said).sum() / said.sum(), (toxic & said).sum() / toxic.sum()
    assert figures > (0.9,) and figures[1] > 0.6 and figures[2] > 0.2, figures


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    sample = toxicity.training_sample(docs, labels)
    held = toxicity.held_out(labels["doc_id"])
    flipped = labels.withColumn("toxic", toxicity.F.when(held, 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.training_sample(docs, flipped) == sample


def test_edge_rows(spark):
    rng, words = random.Random(0), "you utter fool nobody likes that".split()
    docs = []
    for i in range(60):
        text = [f"word{rng.randrange(400)}" for _ in range(20)]
        text[3:3] = words[:3] if i % 2 else words[3:]
        docs.append((i, " ".join(text)))
    docs += [(None, "fool"), (1000, None), (1001, ""), (1002, "fool " * 30_000), (1002, "plain")]
    docs = spark.createDataFrame([(*d, "x", 0.5) for d in docs], "doc_id long, text string, score string, toxic_score double")
    labels = [(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (1000, 0), (5, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.rated(docs, labels).toPandas()
    assert len(found) == 65 and found.score.notna().all() and not found.held_out[found.doc_id.isna()].any()
    assert found.predicted[found.doc_id < 60].tolist() == [int(i) % 2 for i in found.doc_id[found.doc_id < 60]]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == (found.predicted == 0).sum()
    empty = docs.limit(0)
    assert toxicity.rated(empty, labels).collect() == []
    assert set(toxicity.rated(docs, labels.limit(0)).toPandas().score) == {0.0}


def plain_score(model, text):
    """One window at a time, with compressors of its own, as the docstrings say."""
    press = {(d, quick): toxicity.compressor.__wrapped__(d, quick) for d in (model.ordinary, model.toxic) for quick in (True, False)}
    gain = lambda w, quick: max(-32, min(32, len(press[model.ordinary, quick].compress(w)) - len(press[model.toxic, quick].compress(w))))
    words = (text or "").lower().encode().split()
    cut = [b" " + b" ".join(words[i : i + 4]) + b" " for i in range(0, max(1, len(words) - 2), 2)] if words else []
    quick = [gain(w, True) for w in cut]
    best = [gain(w, False) if g >= toxicity.WORTH else -32 for w, g in zip(cut, quick)]
    n, x = len(cut), []
    for gains, thresholds, above in zip((quick, best), model.thresholds, model.above):
        hits = [sum(g > t for g in gains) for t in thresholds]
        x += [(h - n * a) / math.sqrt(n * a + 0.5) for h, a in zip(hits, above)] + [math.log1p(h) for h in hits]
    best.sort(reverse=True)
    x += [max(0, best[r]) if n > r else 0 for r in toxicity.RANKS]
    x += [math.log1p(n), sum(quick) / max(n, 1)]
    z = model.weights[0] + sum(w * v for w, v in zip(model.weights[1:], x))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_are_those_of_a_plain_scorer(tables):
    docs, labels = tables
    model = toxicity.fit(toxicity.training_sample(docs, labels))
    # both are trained dictionaries, not lists of words
    assert all(d[:4] == b"\x37\xa4\x30\xec" for d in (model.toxic, model.ordinary)) and len(model.toxic) > 10_000
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()] + [None, "", "one", "one two", " ", "x" * 50_000]
    found = toxicity.scores(model, texts)
    assert np.allclose(found, [plain_score(model, t) for t in texts])


def test_slices_meet_at_words(monkeypatch):
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("ab c\n") for _ in range(rng.randrange(200)))
        monkeypatch.setattr(toxicity, "SLICE", 1 << 20)
        whole = [w for part in toxicity.slices(text) for w in toxicity.windows(part)]
        monkeypatch.setattr(toxicity, "SLICE", rng.randrange(12, 40))
        parts = [w for part in toxicity.slices(text) for w in toxicity.windows(part)]
        # all words are in windows, those at a slice's edge perhaps in more
        assert {w for p in parts for w in p.split()} == {w for p in whole for w in p.split()} == set(text.encode().split())
        assert len(whole) <= len(parts)
