"""The pipeline: each stage against a plain version on its own input, and the whole run."""

import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prevspark.llm import toxicity
from prevspark.llm.common import store
from prevspark.llm.simhash import fingerprints

from .test_mixing import plain_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_rows(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    whole = {tuple(r) for r in stages[0].collect()}
    assert all({tuple(r) for r in s.collect()} <= whole for s in stages[1:4])


def test_toxic_documents_go(spark, stages):
    scores = toxicity.rated(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scores if r.predicted == 0}


def test_one_of_each_group_stays(stages):
    rows = stages[1].collect()
    prints = [fingerprints(r.text, 5, corpus_pipeline.PRINTS) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if any((a ^ b).bit_count() <= 4 for a, b in zip(prints[i], prints[j])):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(least.values())


def test_near_copies_go_and_others_stay(spark):
    """Texts of 100 to 800 words with scattered words replaced, at a share of common five-word shingles of about 0.9."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    texts = [[word() for _ in range(rng.randrange(100, 800))] for _ in range(150)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:100]):
        new = list(t)
        for _ in range(max(1, len(t) // 100)):
            new[rng.randrange(len(t))] = word()
        rows.append((1000 + i, " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert set(range(150)) <= kept and len(kept) - 150 < 30


def test_rows_of_every_kind_pass_through(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and empty tables, from the first stage to the last."""
    rows = [(None, None, None, "a", 1), (1, "", "s", "a", 1), (2, "one two three", None, "a", 1), (2, "one two three", None, "a", 1), (None, "four five six seven eight", "s", None, None)]
    plain = ["calm river stone under the tall green hill", "warm bread on the old wooden kitchen table"]
    rows += [(10 + i, f"{plain[i % 3 // 2]} w{i} x{i} y{i} z{i}" if i % 2 == 0 else f"you utter rotten fool v{i} u{i} t{i}", "s", "a", 1) for i in range(30)]
    rows += [(99, "river stone " * 100_000, "t", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, toxic_score string, size int")
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(30)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "nobody holds this one"), (None, None)], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, docs.limit(0)):
        held = start
        for name, stage in corpus_pipeline.STAGES:
            held = store(stage(spark, held, str(tmp_path)), name)
            assert name == "tokens" or held.columns == docs.columns
            if start is docs and name == "toxicity":
                left = {r.doc_id for r in held.select("doc_id").collect()}
                assert {10, 12, 14, 16} <= left and not {11, 13, 15, 17} & left
        assert (held.count() > 0) == (start is docs)


def test_contaminated_documents_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in stages[3].collect()}
    gone = [r for r in stages[2].collect() if r.doc_id not in left]
    held = {r.doc_id for r in stages[2].collect() if any(i in r.text for i in items)}
    assert held <= {r.doc_id for r in gone} and len(gone) <= len(held) + 3


def test_mix_reaches_its_targets(stages):
    size, got = {}, {}
    for rows, into in ((stages[3], size), (stages[4], got)):
        for r in rows.collect():
            into[r.source] = into.get(r.source, 0) + len(r.text.encode().split())
    for source, target in plain_targets(size).items():
        assert got.get(source, 0) == pytest.approx(target, abs=1)


def test_tokens(stages):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    lengths = sorted((r.doc_id, len(encode(r.text, add_special_tokens=False).ids) + 1) for r in stages[4].collect())
    rows = sorted(stages[5].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == lengths
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_registered():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
