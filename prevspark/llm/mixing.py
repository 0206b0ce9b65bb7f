"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every slot of the schedule takes one block of ``block`` words. Golden-ratio points, mapped through the cumulative targets, say
which source fills a slot; a slot's rank within its source says which block. A source's documents lie end to end in a hashed
order, read again up to three times, and its blocks are cut from that line. Both prefix sums are taken in two steps, over
pieces and then over their totals, so that no task has to hold a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevspark.llm.common import WORD, columns_aside, store

#: Words of a block; times a source may be read; weights of the sources in order, repeating.
BLOCK, EPOCHS, WEIGHTS = 128, 3, (1, 2, 3)
#: Rows, slots and parts of the cumulative weights that one sort takes.
PIECE, CHUNK, BUCKETS = 1 << 14, 1 << 16, 1 << 12
#: Slots of a partition of the mix.
SPREAD = 1 << 15
#: 2^31 divided by the golden ratio, rounded to an odd number: points step * t modulo 2^31.
GOLDEN, CIRCLE = 1327217885, 1 << 31


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) for one row (source, source_size) per source.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``epochs`` times its source's size, and the excess is shared again by weight until no target is above. That end is a
    level L with target = min(L * weight, cap): by ascending cap / weight, the sources that are full come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    upto, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(everything).cast("double")
    # were this source and all after it not full, they would share what is left at this level
    left = total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    rows = rows.withColumn("shared", left / F.sum("weight").over(after))
    rows = rows.withColumn("n", F.row_number().over(by_level))
    level = F.min(F.when(F.col("shared") <= F.col("level"), F.struct("n", "shared"))).over(everything)["shared"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def prefix(rows: DataFrame, group: list[str], piece: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` before each row of its ``group``, in order of ``piece`` and then ``order``."""
    inside = Window.partitionBy(*group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, piece).agg(F.sum(value).alias("all_"))
    totals = totals.withColumn("base_", F.coalesce(F.sum("all_").over(before), F.lit(0))).drop("all_")
    rows = rows.withColumn("inside_", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [rows[c].eqNullSafe(totals[c]) for c in [*group, piece]]
    joined = rows.join(totals, same)
    return joined.select(*[rows[c] for c in rows.columns if c != "inside_"], (F.col("base_") + rows["inside_"]).alias(name))


def slots(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source_id, rank): the schedule for goals (source_id, need), ``need`` the blocks that a source fills.

    Points fall on a source in proportion to its need, within a few of it; surplus slots go, and the few that are missing
    follow at the end, so that a source's slots are exactly its ranks below ``need``.
    """
    spark = goals.sparkSession
    goals = goals.where("need > 0")
    upto = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    low = goals.withColumn("low", F.coalesce(F.sum("need").over(upto), F.lit(0)))
    n = low.agg(F.sum("need")).first()[0] or 0
    u = F.pmod(F.pmod(F.col("slot") + 1, F.lit(CIRCLE)) * F.lit(GOLDEN), F.lit(CIRCLE)) / F.lit(float(CIRCLE)) * F.lit(float(n))
    points = spark.range(n).select(F.col("id").alias("slot")).withColumn("u", u)
    bucket = F.floor(F.col("u") * BUCKETS / F.lit(float(max(n, 1)))).cast("long")
    first = F.floor(F.col("low") * BUCKETS / F.lit(float(max(n, 1)))).cast("long")
    last = F.floor((F.col("low") + F.col("need")) * BUCKETS / F.lit(float(max(n, 1)))).cast("long")
    # where each source begins; and in each bucket after that which it reaches into, once more
    edges = low.select("source_id", F.explode(F.sequence(first, last)).alias("bucket"), F.col("low").cast("double").alias("u"))
    edges = edges.select(F.lit(None).cast("long").alias("slot"), "u", "bucket", "source_id")
    both = points.select("slot", "u", bucket.alias("bucket"), F.lit(None).cast("int").alias("source_id")).unionByName(edges)
    seek = Window.partitionBy("bucket").orderBy("u", F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("source_id", F.last("source_id", ignorenulls=True).over(seek)).where("slot is not null")
    filled = filled.select("slot", "source_id", (F.col("slot") / CHUNK).cast("long").alias("chunk"), F.lit(1).alias("one"))
    ranked = store(prefix(filled, ["source_id"], "chunk", [F.col("slot")], "one", "rank"), "ranked")
    have = ranked.groupBy("source_id").agg(F.count("*").alias("have"))
    short = goals.join(have, "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    missing = short.select("source_id", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank"))
    tail = Window.orderBy("source_id", "rank")
    missing = missing.select((F.lit(n) + F.row_number().over(tail) - 1).alias("slot"), "source_id", "rank")
    kept = ranked.join(F.broadcast(goals) if goals.count() <= 100_000 else goals, "source_id").where("rank < need")
    return kept.select("slot", "source_id", F.col("rank").cast("long")).unionByName(missing)


def lined_up(docs: DataFrame, seed: int, epochs: int) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets, and documents (doc_id, source, size, source_id, at): where each lies in its source's line."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"))
    rows = store(rows, "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), epochs)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = store(sources.withColumn("source_id", F.row_number().over(by_name)), "sources")
    named = rows.join(sources.select(F.col("source").alias("name"), "source_id"), F.col("source").eqNullSafe(F.col("name")))
    named = named.drop("name").withColumn("shuffle", F.xxhash64("doc_id", F.lit(seed)))
    pieces = max(1, -(-rows.count() // PIECE))
    named = named.withColumn("piece", F.pmod(F.shiftrightunsigned("shuffle", 20), F.lit(pieces)))
    order = [F.col("shuffle"), F.col("doc_id"), F.col("size")]
    return sources, prefix(named, ["source_id"], "piece", order, "size", "at")


def planned(docs: DataFrame, block: int, seed: int, epochs: int) -> DataFrame:
    """(doc_id, size, source_size, target, reads) of every row of ``docs``: ``reads`` is (slot, words) of each reading, by slot.

    A reading's slot is the first that takes a block with a word of it; null where the mix takes nothing.
    """
    sources, lined = lined_up(docs, seed, epochs)
    whole = F.floor(F.col("target") + 0.5).cast("long")
    sources = sources.withColumn("whole", F.least(whole, F.col("source_size") * epochs))
    schedule = slots(sources.select("source_id", F.ceil(F.col("whole") / block).cast("long").alias("need")), block)
    lined = lined.join(sources.select("source_id", "source_size", "target", "whole"), "source_id")
    lined = store(lined.select("doc_id", "size", "source_id", "source_size", "target", "whole", "at"), "lined")
    # where a document lies in each reading of its line, as far as the target goes
    turn = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    read = lined.where("size > 0").withColumn("turn", turn)
    read = read.withColumn("a", F.col("turn") * F.col("source_size") + F.col("at"))
    read = read.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("whole"))).where("a < b")
    parts = read.withColumn("rank", F.explode(F.sequence((F.col("a") / block).cast("long"), ((F.col("b") - 1) / block).cast("long"))))
    inside = F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)
    parts = parts.select("source_id", "at", "turn", "rank", inside.alias("part")).join(schedule, ["source_id", "rank"])
    of = lambda t, c: F.when(F.col("turn") == t, F.col(c))
    each = [x for t in range(epochs) for x in (F.min(of(t, "slot")).alias(f"slot{t}"), F.sum(of(t, "part")).alias(f"words{t}"))]
    taken = parts.groupBy("source_id", "at").agg(*each)
    reads = F.array(*[F.struct(F.col(f"slot{t}").alias("slot"), F.col(f"words{t}").alias("words")) for t in range(epochs)])
    taken = taken.select("source_id", "at", F.sort_array(F.filter(reads, lambda r: r["slot"].isNotNull())).alias("reads"))
    # one document with words lies at each place; those without any take nothing
    return lined.join(taken, ["source_id", "at"], "left").select(
        "doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("reads")).alias("reads")
    )


def mixture(docs: DataFrame, block: int = BLOCK, seed: int = 7, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) of every row of ``docs`` (doc_id, text, source).

    Null texts have size 0 and are not taken. Rows that repeat a doc_id count each; a null source is a source of its own. An
    empty table gives no rows. ``taken`` adds up to a source's target, rounded to whole words; ``first_slot`` is the slot of
    the schedule at which the mix comes to the document first, null if it never does.
    """
    taken = F.aggregate("reads", F.lit(0).cast("long"), lambda s, r: s + r["words"])
    return planned(docs, block, seed, epochs).select(
        "doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
        F.get(F.col("reads"), F.lit(0))["slot"].alias("first_slot"),
    )


@columns_aside(("doc_id", "text", "source"))
def mixed(
    docs: DataFrame, block: int = BLOCK, seed: int = 7, epochs: int = EPOCHS, broadcast_rows: int = 500_000
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each reading, in the order of the schedule's slots.

    Partitions follow one another in that order, SPREAD slots each. At most one reading of a source is cut: after the words that its source
    still takes. Rows without words are not in the mix. Up to ``broadcast_rows`` rows of what is taken are broadcast; more
    are shuffled.
    """
    taken = planned(docs, block, seed, epochs).where("size(reads) > 0")
    taken = taken.select(F.col("doc_id").alias("id_"), F.col("size").alias("size_"), F.col("reads").alias("reads_"))
    taken = store(taken, "taken")
    rows = docs.withColumn("key_", F.col("doc_id").cast("long"))
    if taken.groupBy("id_").count().where("count > 1 or id_ is null").limit(1).count():
        # rows that repeat a doc_id stand in for one another, by size
        rows = rows.withColumn("words_", words(F.col("text"))).where("words_ > 0")
        rows = rows.withColumn("n_", F.row_number().over(Window.partitionBy("key_", "words_").orderBy(F.xxhash64("text"))))
        taken = taken.withColumn("n_", F.row_number().over(Window.partitionBy("id_", "size_").orderBy(F.desc("reads_"))))
        same = rows["key_"].eqNullSafe(taken["id_"]) & (rows["words_"] == taken["size_"]) & (rows["n_"] == taken["n_"])
    else:
        taken = F.broadcast(taken) if taken.count() <= broadcast_rows else taken
        same = rows["key_"] == taken["id_"]
    out = rows.join(taken, same).select(*[rows[c] for c in docs.columns], "size_", F.explode("reads_").alias("read_"))
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    short = F.col("read_.words") < F.col("size_")
    cut = F.when(short, F.array_join(F.slice(pieces, F.lit(1), F.col("read_.words").cast("int")), "")).otherwise(F.col("text"))
    last = taken.agg(F.max(F.element_at("reads_", -1)["slot"])).first()[0] or 0
    out = out.withColumn("slot_", F.col("read_.slot"))
    out = out.repartitionById(int(last) // SPREAD + 1, (F.col("slot_") / SPREAD).cast("int")).sortWithinPartitions("slot_")
    return out.select(*[cut.alias(c) if c == "text" else F.col(c) for c in docs.columns])
