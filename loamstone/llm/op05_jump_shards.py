"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's stable key draws a sequence of uniform numbers; starting in shard 0 it jumps, for each draw r in (0, 1], from shard b to
shard floor((b + 1) / r), and stays where the next jump would leave the range. No ring table is kept. With one more shard, a
row either stays or moves into the new shard, and about one row in the new number of shards moves. The draws are digits of an md5 of
key and step.

The law is ``key``, which leaves sizes and counts of shards to chance, and equal texts to the shards of their keys. The key alone decides the shard, so rows of one key (repeated rows, ids that occur twice) share a shard; a null key hashes
like an empty one. A null text has size 16 and the crc32 of an empty text. Slots follow a hash of the key, then the key,
size and crc32; rows that are equal in all of these are interchangeable. An empty table gives an empty result; extra columns
pass through ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered

#: Bytes that a row counts besides its text.
ROW_OVERHEAD = 16


def _number(key: Column, step: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest of key and step, which any engine can compute alike."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), step.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """The shard of ``key`` among ``shards``: at most ``shards`` jumps, each of them forward."""

    def jump(state: Column, step: Column) -> Column:
        draw = (_number(key, step, 13).cast("double") + 1) / F.lit(float(1 << 52))
        landing = F.floor((state["next"] + 1) / draw)
        # ``at`` is the last landing inside the range; once a jump leaves it, the state no longer changes
        return F.when(state["next"] >= shards, state).otherwise(F.struct(state["next"].alias("at"), F.least(landing, F.lit(shards)).cast("long").alias("next")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump)["at"].cast("int")


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """One row per document: key, size, text_crc32, shard, slot within the shard, and the shard if there were one more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), shards).alias("shard"),
        shard_of(F.col(key), shards + 1).alias("grown_shard"),
    )
    return numbered(placed, ["shard"], [F.col(key), F.col("size"), F.col("text_crc32")], "slot", spread=_number(F.col(key), F.lit(0), 8))


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write ``docs`` with all its columns as one folder per shard; a shard's rows are dealt to several tasks by key."""
    name = free_name(docs, "_shard")
    part = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(files_per_shard))
    docs.withColumn(name, shard_of(F.col(key), shards)).repartition(shards * files_per_shard, name, part).write.partitionBy(name).parquet(path)
