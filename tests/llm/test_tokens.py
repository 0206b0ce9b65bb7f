"""Wavelet matrices against plain lists; shards against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prevspark.llm import tokens
from prevspark.llm.wavelet import WaveletMatrix, from_bytes, to_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("ids", [[], [0], [5], [0] * 2000, list(range(700)) * 2, [70_000, 3, 70_000, 0]])
def test_matrix(ids):
    made, docs, lengths = from_bytes(to_bytes(WaveletMatrix.build(np.array(ids, dtype=np.uint32)), [4, None], np.array([1, 2])))
    assert docs == [4, None] and lengths.tolist() == [1, 2]
    assert made.all().tolist() == ids
    for at in range(0, len(ids), 97):
        assert made.access(at) == ids[at]
    for token in set(ids[:3]) | {1, 10**6}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert made.count(token) == len(places)
        assert [made.select(token, k) for k in range(0, len(places), 53)] == places[::53]
        assert made.rank(token, len(ids) // 2) == sum(p < len(ids) // 2 for p in places)
    with pytest.raises(IndexError):
        made.access(len(ids))


def test_encoder_equals_library():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    encode = tokens.Encoder(PATH)
    texts = ["", "a  b\n\n c\t", "It's we'll 'S x'dare", "3² ½ 12ab", "é×÷ñ naïve", "\x1c\x1d a\x85b\xa0c", "日本 語😀 x", "<|endoftext|>",
             "\x0b\x0c a", "a" * 3000, "   ", "ªµº", "– “x”…€"]
    rng = random.Random(4)
    parts = ["'s", "'", "'ll", "'l", "re", "S", " ", "  ", "\n", "\t", "a", "É", "9", "!", "—", "×", "word", "'re'd", "\r\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    for some in (texts, texts[:10], texts[::-1], [texts[0]]):
        ids, lengths = encode.many(some)
        for text, found in zip(some, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
            assert found.tolist() == plain.encode(text, add_special_tokens=False).ids + [0], repr(text)


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_pieces_of_one_hash(size):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2^64 from 1,024 letters on."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(size))
    other = word.translate(str.maketrans("ab", "ba"))
    plain = Tokenizer.from_file(PATH)
    for some in ([word, other], [f"it's {other} and", f"so {word} 12", "clean"], [word + " " + other], [other, word]):
        encode = tokens.Encoder(PATH)
        for _ in range(2):
            ids, lengths = encode.many(some)
            for text, found in zip(some, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                assert found.tolist() == plain.encode(text, add_special_tokens=False).ids + [0]


def test_texts_beyond_the_table():
    plain, encode = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    long = "".join(f"w{k % 7919} it's {k % 13},\n" for k in range(150_000))
    assert len(long) > 4 * tokens.GROUP
    ids, lengths = encode.many(["before", long, "after it"])
    expected = [plain.encode(t, add_special_tokens=False).ids + [0] for t in ("before", long, "after it")]
    assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "PLACES", 256)
    plain, encode = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    for k in range(20):
        text = " ".join(f"w{k}x{i} it's" for i in range(40))
        ids, _ = encode.many([text, "same again"])
        assert ids.tolist() == plain.encode(text).ids + [0] + plain.encode("same again").ids + [0]


def test_documents_come_back(spark):
    rows = [(5, "b c", 1), (2, None, 1), (None, "x", 1), (5, "a", 2), (9, "long " * 4000, 1), (7, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    plain = Tokenizer.from_file(PATH)
    for shard in (1, 100, 1 << 20):
        found = sorted(tokens.encode_corpus(docs, PATH, shard=shard).collect(), key=lambda r: r.start)
        start = 0
        for (doc_id, text, _), row in zip(sorted(rows, key=lambda r: (r[0] or -1, r[1] or "")), found, strict=True):
            ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
            crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc)
            start += len(ids)
    assert tokens.encode_corpus(docs.limit(0), PATH).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = Tokenizer.from_file(PATH)
    start, expected = 0, []
    for r in docs.orderBy("doc_id").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    found = tokens.encode_corpus(docs, PATH, shard=5000).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, found.collect())) == expected
