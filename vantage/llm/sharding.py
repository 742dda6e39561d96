"""Sharding by jump consistent hashing, with DataFrame functions only.

A key walks through increasing shard numbers: from shard ``b`` it jumps to ``floor((b + 1) / u)``
with ``u`` in (0, 1] drawn from a hash of (key, b), and its shard is the last number below the
shard count. The walk doesn't depend on the count, so another shard takes rows only into itself,
and about ``1 / (n + 1)`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def jump_walk(key: Column, shards: int) -> Column:
    """Struct (b, before): the last stop of ``key`` below ``shards`` and the stop before it (-1: none)."""
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def step(at: Column, _: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", text, at["next"].cast("string"))), 1, 8), 16, 10).cast("long")
        moved = F.struct(
            at["next"].alias("b"),
            at["b"].alias("before"),
            F.floor((at["next"] + 1).cast("double") * F.lit(TWO32) / (draw + 1)).cast("long").alias("next"),
        )
        return F.when(at["next"] < shards, moved).otherwise(at)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("before"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    Null keys all walk as the word "null"; a null text has size 1 and the checksum of no bytes.
    Slots number the rows of a shard from 0 without gaps: rows are numbered within (shard, input
    partition) and moved by the counts of the partitions before, so no task holds a whole shard,
    even if one key has most rows. The input has to be a table that is read, whose partitions
    are the same in each attempt. Only keys, sizes and checksums are shuffled, no text.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    rows = (
        docs.select(F.col(key).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
        .withColumn("walk", jump_walk(F.col("doc_id"), shards + 1))
        .select(
            "doc_id", "size", "text_crc32", "part",
            F.when(F.col("walk.b") == shards, F.col("walk.before")).otherwise(F.col("walk.b")).cast("int").alias("shard"),
            F.col("walk.b").cast("int").alias("grown_shard"),
        )
    )
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(own))
    return ranked.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )
