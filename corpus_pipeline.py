"""The training-data pipeline over ``documents``: toxicity, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and reads again as the
next stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prevspark.llm import decontaminate, mixing, registry, simhash, tokens, toxicity
from prevspark.llm.common import store, table


#: Fingerprints of a document in the near-duplicate stage.
PRINTS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; labels of the held-out fold are not learnt from.

    Null and empty texts have no windows and stay; rows that repeat are scored each.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Five-word shingles and eight fingerprints, of which one differs in at most four bits: scattered edits move a single one too far.
    Texts without words are one group; of rows that repeat a doc_id, or have none, one stays.
    """
    return simhash.one_of_each(docs, shingle=5, prints=PRINTS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of three words or more, whole or edited; null and empty texts stay."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them, in the schedule's order; one of each source at most is cut.

    Texts without words are not in the mix; a null source is a source of its own; rows that repeat count each.
    """
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's token ids, read back from wavelet-matrix shards."""
    return tokens.encode_corpus(docs, registry.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: The first stage learns a model, which SQL cannot express; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
