"""Sharding over fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes are summed per slot;
a versioned table maps each slot to a shard.  Version 0 deals the slots round
robin.  Rebalancing adds a version: every shard keeps its largest slots up to
the mean load, the others go, largest first, to the shard that is lightest at
that time.  The map has one row per slot, whatever the data's size.

Cases with a defined result: a null text counts 0 bytes plus the overhead and
has checksum 0; null and repeated ids are hashed together with the text; rows
that repeat both spread over the slots too (which of the equal rows goes where
is not defined); an empty table gives an empty result and leaves version 0's
loads at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import utf8_bytes, written

SLOTS = 8192
OVERHEAD = 8


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Written narrow rows (doc_id, size, text_crc32, vslot); one scan of the texts.

    Rows that repeat another's id and text would share its slot; their place in
    the scan takes part in their hash, so that they spread like other rows.
    """
    text = F.col(text_col)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), (utf8_bytes(text) + F.lit(OVERHEAD)).alias("size"),
                               F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                               F.xxhash64(F.col(id_col), text).alias("key"), F.monotonically_increasing_id().alias("uid")),
                   "shard-sizes")
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    spread = F.when(F.col("times").isNotNull(), F.xxhash64("key", "uid")).otherwise(F.col("key"))
    return written(rows.join(repeated, "key", "left").select(
        "doc_id", "size", "text_crc32", F.pmod(spread, F.lit(slots)).cast("int").alias("vslot")), "shard-rows")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: (vslot, shard), dealt round robin."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"),
                                     (F.col("id") % shards).cast("int").alias("shard"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, n) for every slot, empty ones included."""
    used = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
                                                    F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map`` (vslot, shard): only slots above a shard's mean load move.

    ``shards`` may exceed the shards in the map: new ones start empty.  The
    moving slots are dealt out in one aggregate over an array of at most
    ``slots`` entries (a fixed number).
    """
    placed = slot_map.join(loads, "vslot")
    mean = placed.agg((F.sum("bytes") / shards).alias("mean")).select("mean")
    by_size = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot")
    placed = (placed.crossJoin(mean)  # one row
              .withColumn("stays", (F.sum("bytes").over(by_size) <= F.col("mean")) & (F.col("shard") < shards)))
    kept = placed.where("stays")
    held = (placed.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
            .join(kept.groupBy("shard").agg(F.sum("bytes").alias("b")), "shard", "left")
            .agg(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("b", F.lit(0)).alias("b")))).alias("h"))
            .select(F.expr("transform(h, x -> cast(x.b as bigint))").alias("held")))
    moving = placed.where(~F.col("stays")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("moving"))
    deal = """aggregate(moving, struct(held as loads, cast(array() as array<int>) as dealt),
        (a, x) -> struct(
            transform(a.loads, (l, i) -> if(i = array_position(a.loads, array_min(a.loads)) - 1, l - x.minus, l)) as loads,
            concat(a.dealt, array(cast(array_position(a.loads, array_min(a.loads)) - 1 as int))) as dealt)).dealt"""
    dealt = (moving.crossJoin(held)  # one row each
             .select("moving", F.expr(deal).alias("shard")).select(F.explode(F.arrays_zip("moving", "shard")).alias("z"))
             .select(F.col("z.moving.vslot").alias("vslot"), F.col("z.shard").alias("shard")))
    return kept.select("vslot", "shard").unionByName(dealt)


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Write a version of the map below ``path`` and read it back."""
    at = f"{path}/version={version}"
    slot_map.select("vslot", "shard").coalesce(1).write.parquet(at)
    return load_map(slot_map.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """``rows`` (with vslot) plus ``shard`` and ``slot``, the row's place in its shard, gapless from 0.

    Rows are numbered within their virtual slot; a slot starts where the slots
    before it in the same shard end.
    """
    firsts = (slot_map.join(loads, "vslot")
              .withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n"))
              .select("vslot", "shard", "first"))
    nth = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    # the map has SLOTS rows, so the broadcast is bounded
    return (rows.withColumn("nth", nth).join(F.broadcast(firsts), "vslot")
            .withColumn("slot", (F.col("first") + F.col("nth") - 1).cast("long")).drop("nth", "first"))


def shard_by_bytes(docs: DataFrame, shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text",
                   slots: int = SLOTS) -> DataFrame:
    """All rows with (doc_id, size, text_crc32, vslot, shard, slot) and shards of near-equal bytes.

    Stores version 0 (round robin) and version 1 (rebalanced by bytes) of the
    slot map under ``map_path``.
    """
    rows = sized(docs, id_col, text_col, slots)
    loads = written(slot_loads(rows, slots).coalesce(1), "slot-bytes")
    v0 = store_map(first_map(docs.sparkSession, shards, slots), map_path, 0)
    v1 = store_map(rebalance(v0, loads, shards), map_path, 1)
    return place(rows, v1, loads)
