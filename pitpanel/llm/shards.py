"""Sharding through fixed virtual slots.

A record's slot is a hash of the record, modulo a number of slots that never changes. Which shard holds a slot is
kept in a small versioned table (version, slot, shard). Balancing edits that table by the bytes counted in each slot:
slots that fit under the mean of their shard stay where they are, the rest move to the emptiest shards, largest first.
Everything that is gathered has one row per slot, whatever the number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 8192
#: Bytes a record takes beside its text.
OVERHEAD = 16
#: Records of one slot are numbered in so many parts.
PARTS = 8


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (NULL: none) and the overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: stable for equal records, whatever the table around them.

    The text takes part, so records that share a key (or have none) still spread. Rows that are equal in both share a slot.
    """
    return F.pmod(F.xxhash64(key, F.crc32(F.coalesce(text, F.lit(""))), F.coalesce(F.octet_length(text), F.lit(-1))), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt to shards in turn, whatever they hold."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"),
                                     F.pmod("id", F.lit(shards)).cast("int").alias("shard"))


def rebalance(current: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map: columns version, slot, shard.

    ``current`` holds one version; ``slot_bytes`` has (slot, bytes) for slots in use. A slot stays if the bytes of its
    shard up to it, in an order fixed by its number, reach no further than the mean of all shards. Slots beyond, and slots
    of shards that are no more, go one by one, largest first, to the shard with fewest bytes. Ties go to the lower number.
    """
    known = current.join(slot_bytes, "slot", "left").select(
        "version", "slot", F.when(F.col("shard") < shards, F.col("shard")).alias("shard"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    whole = Window.partitionBy(F.lit(0))  # one row per slot, so one task is enough
    in_shard = Window.partitionBy("shard").orderBy(F.xxhash64("slot"), "slot")
    held = known.withColumn("mean", F.sum("bytes").over(whole) / shards).withColumn(
        "stays", F.col("shard").isNotNull() & (F.sum("bytes").over(in_shard) <= F.col("mean")))
    one = held.agg(
        F.max("version").alias("version"),
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("b"), F.col("slot").alias("s"))))).alias("moving"),
        F.collect_list(F.when(F.col("stays"), F.struct("slot", "shard", "bytes"))).alias("staying"))
    dealt = one.select("version", "staying", F.expr(f"""
        aggregate(moving,
          named_struct('load', aggregate(staying, transform(sequence(1, {shards}), i -> 0L),
                                         (l, x) -> transform(l, (v, i) -> v + if(i = x.shard, x.bytes, 0L))),
                       'to', cast(array() as array<struct<slot:int,shard:int>>)),
          (a, x) -> named_struct(
            'load', transform(a.load, (v, i) -> v - if(i + 1 = array_position(a.load, array_min(a.load)), x.b, 0L)),
            'to', array_append(a.to, named_struct('slot', x.s, 'shard', cast(array_position(a.load, array_min(a.load)) - 1 as int)))),
          a -> a.to)""").alias("moved"))
    rows = dealt.select((F.col("version") + 1).alias("version"), F.explode(F.concat(
        "moved", F.transform("staying", lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard"))))).alias("r"))
    return rows.select("version", "r.slot", "r.shard")


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds ``shard`` to records that have a ``slot``; the map has one row per slot and is broadcast."""
    return records.join(F.broadcast(slot_map.select("slot", "shard")), "slot", "left")


def positions(records: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``: 0, 1, 2 ... without gaps inside each shard.

    ``records`` must be stored, have ``slot``, ``part`` (below ``PARTS``) and ``shard``. Records are numbered within (slot, part), and
    each such group starts where the groups before it in its shard end; no task sorts a whole shard.
    """
    groups = records.groupBy("shard", "slot", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("slot", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("slot", "part").orderBy(*order)
    numbered = records.withColumn("n", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["slot", "part"]).withColumn("position", F.col("start") + F.col("n")).drop("start", "n")
