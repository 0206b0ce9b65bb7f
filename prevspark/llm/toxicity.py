"""Toxicity by compression distance: two zstandard dictionaries, and how much better one compresses a window than the other.

One dictionary is trained on ordinary documents, the other on toxic ones. Most of a toxic document is ordinary text, so that the
toxic dictionary is trained twice: first on whole passages, by folds, which tells the windows that other toxic documents help to
compress and ordinary ones do not; then on those windows. Every window of a text is compressed with both dictionaries. How
many of its gains exceed thresholds, against what ordinary documents show, enters a logistic curve; thresholds and curve are
calibrated on labelled documents that trained neither dictionary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevspark.llm.common import own_name, store

#: Words of a window, words from one window to the next, words of a passage that the first dictionaries are trained on.
WORDS, STEP, PASSAGE = 4, 2, 32
#: Bytes of the dictionaries: of ordinary text, of toxic passages, of toxic windows.
ORDINARY_BYTES, PASSAGE_BYTES, TOXIC_BYTES = 1 << 19, 1 << 19, 1 << 16
#: Bytes of the segments that the trainer takes from passages and from windows, and of the runs whose frequency it counts.
PASSAGE_SEGMENT, WINDOW_SEGMENT, RUN = 256, 40, 8
#: One of so many sampled documents calibrates, the others train.
PARTS = 3
#: Folds of the toxic documents, and the share of their windows that trains the final dictionary.
FOLDS, TOXIC_SHARE = 3, 0.05
#: Bounds of the training sample: documents of each class, bytes of each class, bytes of a document.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT = {0: 6000, 1: 3000}, 12_000_000, 1 << 17
#: Quantiles of the ordinary calibration documents' gains that serve as thresholds; ranks of gains that are features.
QUANTILES, RANKS = (0.95, 0.98, 0.99, 0.995, 0.999), (0, 1, 2, 3, 4, 6, 8)
#: Gains are counted in bytes from -SPAN to SPAN; windows that are compressed at once; characters that are cut at once.
SPAN, AT_ONCE, SLICE = 32, 1 << 17, 1 << 20
#: No headers, so that lengths are those of the content; an optimal parse, and a quick one that leaves literals as they are.
BARE = {"window_log": 21, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
OPTIMAL = {"search_log": 4, "min_match": 3, "target_length": 16, "strategy": zstandard.STRATEGY_BTULTRA2}
QUICK = {"search_log": 1, "min_match": 5, "target_length": 1, "strategy": zstandard.STRATEGY_FAST}
#: Bytes that a window gains by the quick parse from which it is parsed optimally as well.
WORTH = 3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for measuring: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, toxic) of a bounded sample of the labelled documents that are not held out, in a fixed order.

    The least hashes of each class are taken: a threshold that leaves about twice as many keeps all others from being sorted.
    Of rows that repeat an id the least text counts.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = store(marked.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))), "labelled")
    found = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    ids = []
    for y, n in SAMPLE_DOCS.items():
        cut = (1 << 40) * min(1.0, 2 * n / max(1, found.get(y, 0)))
        ids += marked.where((F.col("toxic") == y) & (F.col("h") < cut)).orderBy("h", "doc_id").limit(n).collect()
    if not ids:
        return []
    # at most as many ids as SAMPLE_DOCS allows
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic, i) for i, r in enumerate(ids)], "id_ long, toxic int, n int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= SAMPLE_TEXT)
    texts = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id_")).groupBy("n", "toxic").agg(F.min("text").alias("text"))
    texts = store(texts, "sample")
    sizes = texts.select("toxic", "n", F.octet_length("text").alias("size")).orderBy("n").toPandas()
    last = [sizes.n[(sizes.toxic == y) & (sizes["size"][sizes.toxic == y].cumsum() <= SAMPLE_BYTES)].max() for y in SAMPLE_DOCS]
    held = (F.col("toxic") == 0) & (F.col("n") <= int(last[0])) if last[0] == last[0] else F.lit(False)
    held = held | (F.col("toxic") == 1) & (F.col("n") <= int(last[1])) if last[1] == last[1] else held
    rows = texts.where(held).orderBy(F.desc("toxic"), "n").collect()  # toxic ones first: of copies with unlike labels, toxic holds
    return unlike([(r.text, r.toxic) for r in rows])


def unlike(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """``sample`` without near copies, which would count as evidence many times: they share the least of the shingles' hashes."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text, y in sample:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        keys = {(seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in (1, 2)}
        if not keys & seen:
            kept.append((text, y))
        seen |= keys
    return kept


def slices(text: str) -> Iterator[list[bytes]]:
    """The words of ``text`` in lower case, a bounded slice at a time; each slice begins with the last words of the one before."""
    at, left, tail = 0, "", []
    while at < len(text) or left:
        part = left + text[at : at + SLICE]
        at += SLICE
        left = ""
        if at < len(text) and not part[-1].isspace():  # the last word may go on
            cut = max(part.rfind(" "), part.rfind("\n")) + 1
            part, left = (part[:cut], part[cut:]) if cut else (part, "")
        words = tail + part.lower().encode("utf-8", "surrogatepass").split()
        if words:
            yield words
        tail = words[len(words) - WORDS + 1 :] if len(words) >= WORDS else words


def windows(words: list[bytes], size: int = 0, step: int = 0) -> list[bytes]:
    """Runs of ``size`` words (WORDS), one from every ``step``-th word on (STEP), with the spaces around them."""
    size, step = size or WORDS, step or STEP
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, max(1, len(words) - size + step), step)] if words else []


def passages(texts: list[str]) -> list[bytes]:
    return [p for t in texts for w in slices(t) for p in windows(w, PASSAGE, PASSAGE)]


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=RUN).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@lru_cache(maxsize=16)
def compressor(content: bytes, quick: bool = False) -> zstandard.ZstdCompressor:
    """A worker keeps the digested dictionary from task to task; its tables grow with it."""
    bits = max(14, len(content).bit_length())
    shape = zstandard.ZstdCompressionParameters(**BARE, **(QUICK if quick else OPTIMAL), hash_log=bits, chain_log=bits)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=shape)


def lengths(content: bytes, pieces: list[bytes], quick: bool = False) -> np.ndarray:
    """Bytes that each piece takes under a dictionary."""
    out = np.zeros(len(pieces), dtype=np.int64)
    press = compressor(content, quick).multi_compress_to_buffer if pieces else None
    for at in range(0, len(pieces), AT_ONCE):
        found = press(pieces[at : at + AT_ONCE])
        out[at : at + len(found)] = [len(found[i]) for i in range(len(found))]
    return out


@dataclass
class Model:
    """Two dictionaries, the thresholds with the shares of ordinary gains above them, and the curve over a document's features.

    Thresholds and shares are of the quick and of the optimal parse.
    """

    toxic: bytes = b""
    ordinary: bytes = b""
    thresholds: tuple[tuple[int, ...], ...] = ()
    above: tuple[tuple[float, ...], ...] = ()
    weights: tuple[float, ...] = ()
    share: float = 0.0


def gains(model: Model, pieces: list[bytes]) -> np.ndarray:
    """(2, pieces): bytes that each window gains under the toxic dictionary, by the quick and by the optimal parse.

    Windows that gain less than WORTH by the quick parse count as gaining the least by the optimal one.
    """
    limit = lambda x: np.clip(x, -SPAN, SPAN)
    quick = limit(lengths(model.ordinary, pieces, True) - lengths(model.toxic, pieces, True))
    best = np.full(len(pieces), -SPAN)
    worth = np.flatnonzero(quick >= WORTH)
    some = [pieces[i] for i in worth.tolist()]
    best[worth] = limit(lengths(model.ordinary, some) - lengths(model.toxic, some))
    return np.stack([quick, best])


def gain_counts(model: Model, texts: list[str | None]) -> np.ndarray:
    """(texts, 2, bytes): how many windows of each text gain -SPAN, ..., SPAN bytes, by either parse."""
    out = np.zeros((len(texts), 2, 2 * SPAN + 1), dtype=np.int64)
    pieces: list[bytes] = []
    owner: list[np.ndarray] = []

    def settle() -> None:
        if pieces:
            of = np.concatenate(owner)
            first, last, width = of[0], of[-1] + 1, out.shape[2]
            for parse, found in enumerate(gains(model, pieces)):
                seen = np.bincount((of - first) * width + found + SPAN, minlength=(last - first) * width)
                out[first:last, parse] += seen.reshape(-1, width)
            pieces.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for words in slices(text or ""):
            for at in range(0, max(1, len(words) - WORDS + 1), AT_ONCE):
                part = windows(words[at : at + AT_ONCE + WORDS - 1])
                pieces += part
                owner.append(np.full(len(part), i))
                if len(pieces) >= AT_ONCE:
                    settle()
    settle()
    return out


def features(model: Model, counts: np.ndarray) -> np.ndarray:
    """Per text: by either parse, how many gains exceed each threshold, against chance and as such; the largest; mean and number."""
    quick, best = counts[:, 0], counts[:, 1]
    n = quick.sum(axis=1)
    bytes_ = np.arange(-SPAN, SPAN + 1)
    columns = []
    for parse in (0, 1):
        hits = np.stack([counts[:, parse, bytes_ > t].sum(axis=1) for t in model.thresholds[parse]], axis=1)
        expected = n[:, None] * np.array(model.above[parse])
        columns += [(hits - expected) / np.sqrt(expected + 0.5), np.log1p(hits)]
    upto = best[:, ::-1].cumsum(axis=1)  # of the largest gains, how many are of so many bytes or more
    top = [np.where(n > r, np.maximum(0, SPAN - (upto <= r).sum(axis=1)), 0) for r in RANKS]
    return np.column_stack([*columns, *top, np.log1p(n), (quick @ bytes_) / np.maximum(n, 1)]).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton's method; the first is the constant."""
    spread = x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - x.mean(axis=0)) / spread]
    ridge = penalty * len(x) * np.r_[0.0, np.ones(x.shape[1])]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = w[1:] / spread
    return np.r_[w[0] - slope @ x.mean(axis=0), slope]


def telling_windows(toxic: list[str], ordinary: bytes) -> list[bytes]:
    """The windows that dictionaries of other toxic documents compress better than the ordinary one, by the most.

    Windows that documents share word for word are copied text, which tells nothing of what makes a text toxic.
    """
    held = Counter(run for t in toxic for run in {xxhash.xxh64_intdigest(w) for words in slices(t) for w in windows(words, step=1)})
    copied = {run for run, n in held.items() if n > 1}
    found: list[bytes] = []
    gains: list[np.ndarray] = []
    for fold in range(FOLDS):
        others = passages([t for i, t in enumerate(toxic) if i % FOLDS != fold])
        own = [w for i, t in enumerate(toxic) if i % FOLDS == fold for words in slices(t) for w in windows(words)]
        own = [w for w in own if xxhash.xxh64_intdigest(w) not in copied]
        if others and own:
            gains.append(lengths(ordinary, own) - lengths(dictionary(others, PASSAGE_BYTES, PASSAGE_SEGMENT), own))
            found += own
    if not found:
        return passages(toxic)
    gain = np.concatenate(gains)
    least = np.quantile(gain, 1 - TOXIC_SHARE)
    return [w for w, g in zip(found, gain.tolist()) if g > least] or found


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    plain = dictionary(passages(ordinary) or [b" "], ORDINARY_BYTES, PASSAGE_SEGMENT)
    return Model(dictionary(telling_windows(toxic, plain) or [b" "], TOXIC_BYTES, WINDOW_SEGMENT), plain)


def fit(sample: list[tuple[str, int]]) -> Model:
    """Dictionaries from most of the sample; thresholds and curve from the rest.

    Without both classes there is nothing to compare: the score is the share of toxic labels, 0 without labels. With too few
    documents for both parts, all serve both.
    """
    texts, toxic = [t for t, _ in sample], np.array([y for _, y in sample], dtype=np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(share=float(toxic.mean()) if len(toxic) else 0.0)
    rest = np.zeros(len(texts), dtype=bool)
    for y in (0, 1):  # both classes in both parts, as far as there are enough of each
        rest[toxic == y] = np.arange((toxic == y).sum()) % PARTS == PARTS - 1
    train = ~rest
    if len(set(toxic[rest].tolist())) < 2:
        rest[:] = train[:] = True
    model = dictionaries(*[[t for t, y, k in zip(texts, toxic.tolist(), train.tolist()) if k and y == c] for c in (1, 0)])
    counts, y = gain_counts(model, [t for t, k in zip(texts, rest.tolist()) if k]), toxic[rest]
    thresholds, above = [], []
    for usual in counts[y == 0].sum(axis=0):
        share = usual.cumsum() / max(1, usual.sum())
        places = [min(int(np.searchsorted(share, q)), 2 * SPAN) for q in QUANTILES]
        thresholds.append(tuple(at - SPAN for at in places))
        above.append(tuple(float(1 - share[at]) for at in places))
    model.thresholds, model.above = tuple(thresholds), tuple(above)
    model.weights = tuple(logistic(features(model, counts), y.astype(float)).tolist())
    return model


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """The chance, 0 to 1, that each text is toxic."""
    if not model.weights:
        return np.full(len(texts), model.share)
    z = model.weights[0] + features(model, gain_counts(model, texts)) @ np.array(model.weights[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a ``toxic_score`` in 0 to 1 of the whole text; null and empty texts are scored as texts without windows."""
    name = own_name(docs, "toxic_score")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(model, batch.tolist()))

    return docs.withColumn(name, score(F.col(text_col)))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, learnt from ``labels`` (doc_id, toxic).

    Rows with a null doc_id are scored and not held out; repeated rows are scored each; a document with labels that differ
    counts as toxic. An empty table gives no rows.
    """
    model = fit(training_sample(docs, labels))
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with the columns of ``docs``.

    Null and empty texts are scored as texts without windows; rows that repeat, or have no doc_id, are scored each. An empty
    table gives no rows; without labels of both classes the score is the share of toxic labels.
    """
    model = fit(training_sample(docs, labels))
    scored = with_score(docs, model)
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*[scored[c] for c in docs.columns])
