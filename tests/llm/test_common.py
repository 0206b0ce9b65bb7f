"""Extra columns with names that operators use inside come through unchanged."""

import pytest
from pyspark.sql import functions as F

from prevspark.llm import decontaminate, lines, mixing, simhash, toxicity

NAMES = ["gone_id", "again_id", "fp", "row", "size_", "n_", "key_", "taken_", "id_", "copy_", "crc_", "lines_", "d_", "toxic_score", "_1", "aside_0_", "Score"]


@pytest.mark.parametrize("operator", ["mixed", "one_of_each", "deduplicated", "without_toxic", "without_matches"])
def test_clashing_columns(spark, operator):
    rows = [(i, f"one two three four five six seven eight nine {i % 3 and i} " * 3, "s") for i in range(8)] + [(7, "one two", None), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select(*[F.lit(n).alias(n) for n in NAMES], "*")
    if operator == "mixed":
        out = mixing.mixed(docs, block=4)
    elif operator == "one_of_each":
        out = simhash.one_of_each(docs)
    elif operator == "deduplicated":
        out = lines.deduplicated(docs)
    elif operator == "without_toxic":
        out = toxicity.without_toxic(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"))
    else:
        out = decontaminate.without_matches(docs, spark.createDataFrame([(1, "ten words that are not in any of these texts here")], "item_id long, text string"))
    assert out.columns == docs.columns
    for r in out.collect():
        assert [r[n] for n in NAMES] == NAMES
