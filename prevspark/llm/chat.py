r"""Chat formatting with a grammar round trip, with DataFrame functions only.

    chat := "<chat escape=" LEVEL ">" LF turn*
    turn := "### " ROLE ": " TEXT "</turn>" LF

"### " and "</turn>" are control strings and stand nowhere else. A conversation is rendered without escapes, parsed again and
compared with its turns; where they differ it is rendered at the next level, until they are the same. Level 1 escapes control
strings and the escape character: "\" as "\e", "### " as "\h", "</turn>" as "\t", and in roles ": " as "\c". Every backslash
of an escaped text is then followed by its letter, so that undoing the letters first and "\e" last is exact. Level 2 escapes
every "#", "<" and ":" and holds for whatever a role or text may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevspark.llm.common import let, running, store

#: What each level replaces, in order.
ESCAPES = {
    0: [],
    1: [("\\", "\\e"), ("### ", "\\h"), ("</turn>", "\\t"), (": ", "\\c")],
    2: [("\\", "\\e"), ("#", "\\n"), ("<", "\\l"), (":", "\\d")],
}
TURN, END, SPLIT = "### ", "</turn>\n", ": "
TRAINED = "assistant"


def escaped(text: Column, level: int) -> Column:
    for plain, code in ESCAPES[level]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, level: int) -> Column:
    for plain, code in reversed(ESCAPES[level]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def rendered(turns: Column, level: int) -> Column:
    """The conversation's text for an array of (role, text)."""
    turn = lambda t: F.concat(
        F.lit(TURN), escaped(t["role"], level), F.lit(SPLIT), escaped(t["text"], level), F.lit(END)
    )
    return F.concat(F.lit(f"<chat escape={level}>\n"), F.array_join(F.transform(turns, turn), ""))


def pieces(chat: Column) -> Column:
    """What stands before each turn's end, without the header; the last piece is what follows the last turn."""
    body = F.substr(chat, F.locate("\n", chat) + 1)
    return F.split(body, r"</turn>\n", -1)


def parsed_at(chat: Column, level: int) -> Column:
    """Turns (role, text) of a text of this level; null where the grammar does not hold."""

    def turn(piece: Column) -> Column:
        at = F.locate(SPLIT, piece)
        role = F.substr(piece, F.lit(len(TURN) + 1), at - len(TURN) - 1)
        sound = piece.startswith(TURN) & (at > len(TURN)) & (F.locate(TURN, piece, 2) == 0) & ~piece.contains("</turn>")
        return F.when(sound, F.struct(unescaped(role, level).alias("role"), unescaped(F.substr(piece, at + len(SPLIT)), level).alias("text")))

    def whole(found: Column) -> Column:
        turns = F.transform(F.slice(found, 1, F.size(found) - 1), turn)
        sound = (F.element_at(found, -1) == "") & F.forall(turns, lambda t: t.isNotNull())
        return F.when(sound, turns)

    return let(pieces(chat), lambda found: let(F.transform(F.array(found), whole)[0], lambda t: t))


def parsed(chat: Column) -> Column:
    """Turns (role, text) of a rendered conversation, by the level in its header."""
    level = F.substr(chat, F.lit(len("<chat escape=") + 1), F.lit(1))
    return F.coalesce(*[F.when(level == str(n), parsed_at(chat, n)) for n in ESCAPES])


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, chat, level) of every conversation; its turns in order of turn, then role, then text, nulls first.

    Null roles and texts count as empty, repeated rows stay, rows with a null conv_id are one conversation. One row holds a
    conversation, as its text does.
    """
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), empty).alias("role"),
            F.coalesce(F.col("text"), empty).alias("text"),
        ).alias("row"),
    )
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    turns = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    held = held.select("conv_id", turns.alias("turns"))
    chat, level = F.lit(None).cast("string"), F.lit(None).cast("int")
    for n in ESCAPES:
        held = held.withColumn(f"chat{n}", F.when(chat.isNull(), rendered(F.col("turns"), n)) if n else rendered(F.col("turns"), n))
        same = parsed_at(F.col(f"chat{n}"), n).eqNullSafe(F.col("turns"))
        held = held.withColumn(f"same{n}", same)
        chat = F.coalesce(chat, F.when(F.col(f"same{n}"), F.col(f"chat{n}")))
        level = F.coalesce(level, F.when(F.col(f"same{n}"), F.lit(n)))
    broken = F.raise_error(F.concat(F.lit("no escape level holds conversation "), F.col("conv_id").cast("string")))
    return held.select("conv_id", F.coalesce(chat, broken.cast("string")).alias("chat"), level.alias("level"))


def with_loss(chats: DataFrame, trained: str = TRAINED) -> DataFrame:
    """``chats`` with ``loss``: (start, end) code points of the escaped texts of the turns whose role is ``trained``.

    In time near the length of the conversation, however many turns it has.
    """
    header = F.locate("\n", F.col("chat")).cast("long")

    def spans(turns: Column) -> Column:
        ends = running(F.transform(turns, lambda t: F.length(t).cast("long") + len(END)))

        def span(x: Column) -> Column:
            end = header + x["end"] - len(END)
            at = F.locate(SPLIT, x["turn"])
            role = F.substr(x["turn"], F.lit(len(TURN) + 1), at - len(TURN) - 1)
            start = end - F.length(x["turn"]) + at + len(SPLIT) - 1
            return F.when(role == trained, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))

        both = F.arrays_zip(turns.alias("turn"), ends.alias("end"))
        return F.filter(F.transform(both, span), lambda s: s.isNotNull())

    turns = let(pieces(F.col("chat")), lambda x: F.slice(x, 1, F.size(x) - 1))
    return chats.withColumn("loss", let(turns, spans))


def digest(chats: DataFrame) -> DataFrame:
    """What the written conversations (conv_id, chat, loss) hold, read back by the parser and through the loss mask."""
    level = F.substr("chat", F.lit(len("<chat escape=") + 1), F.lit(1))
    under = F.transform("loss", lambda s: F.substr(F.col("chat"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    plain = F.transform(under, lambda t: F.coalesce(*[F.when(level == str(n), unescaped(t, n)) for n in ESCAPES]))
    rows = chats.withColumn("turns", parsed(F.col("chat"))).withColumn("learnt", F.array_join(plain, ""))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("chat").cast("long").alias("formatted_chars"),
        F.col("level").alias("escape_level"),
    )


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format, write to the shared folder, read back and digest."""
    return digest(store(with_loss(formatted(conversations)), "chats"))
