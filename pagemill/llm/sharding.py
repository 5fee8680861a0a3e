"""Shards by fixed virtual slots: records hash into slots, a versioned map deals slots to shards by bytes.

Only DataFrame functions are used. A record's slot never changes; rebalancing edits the map, which has one row
per slot and so a fixed size. Law: ``bytes``.

The map is a table of versions: ``shard`` deals the first, or goes by one that is given; ``grow`` and ``moved`` edit it.

Edge cases: a null text has no bytes (size 1, CRC 0), a long one counts whole; null ids hash like any value; repeated
rows are counted before the shuffle and numbered in blocks of ``BLOCK`` copies that go to different tasks, and each
copy hashes by its own number, so copies of one row spread over slots; slots of equal bytes are dealt by number; an
empty table gives an empty result and a map of empty slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import crc_of, stored

#: Virtual slots. At 100 TB one slot is about 25 GB of text, of which only ids and sizes are shuffled.
SLOTS = 4096
#: Copies of one row that a task numbers at a time.
BLOCK = 10_000


def records(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, copy, virtual_slot`` per row; the text itself is left behind."""
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        crc_of(F.col(text)).alias("text_crc32"),
    )
    counted = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    # A number of partitions that is given isn't coalesced by the bytes of blocks that have yet to grow.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    blocks = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))))
    dealt = blocks.repartition(tasks, "doc_id", "text_crc32", "first")
    inside = F.sequence("first", F.least(F.col("first") + BLOCK, F.col("n")) - 1)
    each = dealt.withColumn("copy", F.explode(inside)).drop("n", "first")
    return each.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int"))


def slot_sizes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, bytes, rows`` for every slot, empty ones included."""
    spark = recs.sparkSession
    got = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(got, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: slots by falling bytes, each to the shard with the fewest bytes so far.

    One fold over the slots, whose number is fixed; ``version, virtual_slot, shard, bytes``.
    """
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    ordered = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot"))).alias("s"))
    start = F.struct(zero.alias("load"), F.array().cast("array<int>").alias("shard"))

    def deal(state, slot):
        to = F.array_position(state["load"], F.array_min(state["load"])).cast("int")
        load = F.transform(state["load"], lambda x, i: F.when(i == to - 1, x - slot["minus"]).otherwise(x))
        return F.struct(load.alias("load"), F.concat(state["shard"], F.array(to - 1)).alias("shard"))

    dealt = ordered.select("s", F.aggregate("s", start, deal)["shard"].alias("shard"))
    pairs = dealt.select(F.explode(F.arrays_zip("s", "shard")).alias("x"))
    return pairs.select(
        F.lit(0).alias("version"), F.col("x.s.virtual_slot").alias("virtual_slot"), F.col("x.shard").alias("shard"), (-F.col("x.s.minus")).alias("bytes")
    )


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard: every shard keeps slots up to the new mean (to the nearest slot), the rest move."""
    by_slot = Window.partitionBy("shard").orderBy(F.xxhash64("virtual_slot"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    return slot_map.select(
        (F.col("version") + 1).alias("version"), "virtual_slot",
        F.when(F.sum("bytes").over(by_slot) - F.col("bytes") / 2 <= mean, F.col("shard")).otherwise(F.lit(shards)).alias("shard"), "bytes",
    )


def moved(slot_map: DataFrame, moves: DataFrame) -> DataFrame:
    """The next version after moving some slots by hand; ``moves``: ``virtual_slot, shard``, the largest shard counts if one is named twice."""
    to = moves.groupBy("virtual_slot").agg(F.max("shard").alias("to"))
    return slot_map.join(to, "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").cast("int").alias("shard"), "bytes"
    )


def newest(versions: DataFrame) -> DataFrame:
    """The last version of a stored map."""
    last = Window.partitionBy()
    return versions.withColumn("last", F.max("version").over(last)).where("version = last").drop("last")


def with_shards(recs: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each record with its shard and its gapless place in it.

    A slot's place in its shard is the running number of rows over the shard's slots (a window over the map);
    a record's place is its row number in the slot. So no task ever sees more than one slot's ids.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.join(sizes.select("virtual_slot", "rows"), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    numbered = recs.withColumn("at", F.row_number().over(inside))
    # The map has exactly one narrow row per slot: its size is bounded by the number of slots.
    return numbered.join(F.broadcast(placed), "virtual_slot").withColumn("slot", (F.col("first") + F.col("at") - 1).cast("long")).drop("first", "at")


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, versions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The placed records, and the stored map of both versions (``shards``, then one more).

    With ``versions``, a map stored before, records go by its last version and it comes back as it is; it must have a
    row for each of the ``slots``.
    """
    recs = stored(records(docs, slots), "shard-records")
    sizes = stored(slot_sizes(recs, slots).coalesce(1), "slot-sizes")
    if versions is not None:
        return with_shards(recs, newest(versions), sizes), versions
    first = stored(first_map(sizes, shards).coalesce(1), "slot-map-0")
    placed = with_shards(recs, first, sizes)
    return placed, first.unionByName(stored(grow(first, shards).coalesce(1), "slot-map-1"))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, versions = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    grown = versions.where("version = 1").select("virtual_slot", F.col("shard").alias("rebalanced_shard"))
    return placed.join(F.broadcast(grown), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "rebalanced_shard",
    )
