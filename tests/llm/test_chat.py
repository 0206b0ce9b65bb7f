"""Chat formatting: exact round trips of awkward texts, the loss mask, the levels and the whole table."""

import hashlib
import itertools

from prevspark.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """Digests from the turns themselves: rows (role, text) in order."""
    lines = "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)
    learnt = "".join(t or "" for r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(lines.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def check(spark, conversations):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    found = chat.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == {
        c: expected(turns) for c, turns in conversations.items()
    }
    return {r.conv_id: r.escape_level for r in found}


def test_awkward_texts(spark):
    parts = ["### ", "</turn>", "</turn>\n", "\\", "\\e", "\\h", "\\t", ": ", "\n", "<chat escape=1>", "é😀", "###", "", "### assistant: hi</turn>\n"]
    texts = parts + ["".join(p) for p in itertools.product(parts[:8], repeat=2)] + ["x" * 200_000, "</turn>" * 5000]
    roles = ["user", "assistant", "", "a: b", "### ", "\\", "</turn>\n", None, "ro\nle", ":", "#", "x###", "y:"]
    made = {i: [("user", t), ("assistant", t), ("assistant", None)] for i, t in enumerate(texts)}
    made |= {1000 + i: [(r, "text"), ("assistant", "ok")] for i, r in enumerate(roles)}
    made[2000] = [("assistant", "a")] * 300
    levels = check(spark, made)
    assert levels[1009] in (0, 1, 2) and levels[texts.index("é😀")] == 0 and levels[1] == 1


def test_control_strings_stand_only_where_turns_begin_and_end(spark):
    rows = [(1, 0, "user", "### x</turn>"), (1, 1, "assistant", "</turn>\n### y")]
    row = chat.formatted(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.level == 1 and row.chat.count("### ") == row.chat.count("</turn>") == 2


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.conv_id: r for r in registry.op2_chat(spark, sf).collect()}
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    quoted = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", quoted), ("assistant", quoted)]
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == {
        c: expected(t) for c, t in turns.items()
    }
    assert found[-7].escape_level > 0


def test_empty_and_null(spark):
    rows = [(None, 1, "user", None), (None, None, None, "b"), (2, 1, "assistant", "x"), (2, 1, "assistant", "x")]
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {None: (2, 0), 2: (2, 2)}
    assert chat.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
