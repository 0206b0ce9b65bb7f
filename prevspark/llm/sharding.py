"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's hash puts it in one of ``SLOTS`` virtual slots. Bytes and rows are added up per slot, and a versioned map says
which shard holds each slot. A new version keeps every slot where it is as far as its shard stays within its share; the slots
that go beyond, the largest first, move to the shard with the fewest bytes. Data moves a slot at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prevspark.llm.common import scratch, store

#: Virtual slots, fixed for the life of a data set; bytes that a record takes besides its text.
SLOTS, OVERHEAD = 8192, 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # the checksum enters too, so that rows that repeat an id, or have none, don't share a slot
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def placed(slots: DataFrame, shards: int) -> DataFrame:
    """``slots`` (vslot, bytes, rows, shard) with every null shard filled in: largest slot first, to the lightest shard.

    One row holds the map while it is made; it has one entry for each virtual slot, a fixed number.
    """
    held = slots.where("shard is not null").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    loads = slots.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = loads.join(F.broadcast(held), "shard", "left").select("shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    loads = loads.agg(F.sort_array(F.collect_list(F.struct("shard", "bytes"))).alias("loads"))
    loads = loads.select(F.transform("loads", lambda x: x["bytes"]).alias("loads"))
    todo = slots.where("shard is null").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("less"), (-F.col("rows")).alias("fewer"), "vslot"))).alias("todo")
    )
    one = loads.withColumn("key", F.lit(1)).join(todo.withColumn("key", F.lit(1)), "key")
    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("chosen"))

    def place(state: Column, slot: Column) -> Column:
        lightest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int")
        grown = F.transform(state["loads"], lambda load, i: F.when(i + 1 == lightest, load - slot["less"]).otherwise(load))
        return F.struct(grown.alias("loads"), F.concat(state["chosen"], F.array(lightest - 1)).alias("chosen"))

    chosen = F.aggregate("todo", start, place, lambda state: state["chosen"])
    filled = one.select(F.arrays_zip("todo", chosen.alias("chosen")).alias("both"))
    filled = filled.select(F.explode("both").alias("x")).select(
        F.col("x.todo.vslot").alias("vslot"),
        (-F.col("x.todo.less")).alias("bytes"),
        (-F.col("x.todo.fewer")).alias("rows"),
        F.col("x.chosen").cast("int").alias("shard"),
    )
    return slots.where("shard is not null").select("vslot", "bytes", "rows", "shard").unionByName(filled)


def tallied(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, rows) of the slots that hold rows."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def rebalanced(tally: DataFrame, shards: int, previous: DataFrame | None = None, slack: float = 0.01) -> DataFrame:
    """The next version of the slot map: (version, vslot, bytes, rows, shard) for the slots of ``tally``.

    ``previous`` is such a map, or none. Its slots stay as long as their shard's bytes, the smallest slots first, are within
    the mean and ``slack``; what lies beyond, slots of shards that are no more, and new slots are placed anew.
    """
    if previous is None:
        return placed(tally.withColumn("shard", F.lit(None).cast("int")), shards).withColumn("version", F.lit(1))
    version = previous.agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    known = previous.where(F.col("shard") < shards).select("vslot", "shard")
    slots = tally.join(known, "vslot", "left")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fair = F.sum("bytes").over(everything) / shards * (1 + slack)
    upto = Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("fair", fair).withColumn("upto", F.sum("bytes").over(upto))
    kept = F.when(F.col("upto") <= F.col("fair"), F.col("shard"))
    return placed(slots.select("vslot", "bytes", "rows", kept.alias("shard")), shards).withColumn("version", F.lit(version))


def save_map(slot_map: DataFrame, path: str) -> int:
    """Add a version of the slot map to those below ``path``, and return its number; versions that are there stay."""
    version = slot_map.agg(F.max("version")).first()[0]
    if version is not None:
        slot_map.select("vslot", "bytes", "rows", "shard").coalesce(1).write.parquet(f"{path}/version={version}")
    return version or 0


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The slot map below ``path`` of a version, or the latest; none if there is none."""
    kept = spark.read.schema("vslot int, bytes long, rows long, shard int, version int")
    try:
        maps = kept.parquet(path)
        latest = maps.agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if latest is None:
        return None
    return maps.where(F.col("version") == (latest if version is None else version)).select("version", "vslot", "bytes", "rows", "shard")


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version) of every row of ``docs`` (doc_id, text).

    The law is ``bytes``: shards are near equal in size. ``slot`` is the row's place in its shard, gapless from 0: rows of a
    virtual slot follow one another. Null texts count as empty, rows that repeat stay, an empty table gives no rows.

    The map that the rows are placed by is read back from ``map_path``: if versions of it are there, the latest is edited
    for these rows and shards and saved as the next one, else version 1 is. Rows that are equal in id and text share a slot.
    """
    path = map_path or scratch(docs.sparkSession, "slot_maps")
    rows = store(sized(docs, slots), "sized")
    previous = load_map(docs.sparkSession, path)
    version = save_map(store(rebalanced(tallied(rows), shards, previous), "slot_map"), path)
    held = load_map(docs.sparkSession, path, version) if version else rows.select("vslot").limit(0).selectExpr("0 as version", "vslot", "0L as bytes", "0L as rows", "0 as shard")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = held.select("vslot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    # as many rows as virtual slots at most
    return rows.join(F.broadcast(places), "vslot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "version",
    )
