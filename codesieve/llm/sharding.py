"""Rendezvous hashing of record keys over weighted shards.

Each shard scores -weight / ln(u) with u in (0, 1) drawn by a hash of key and shard name; the highest score has the
record. Scores of other shards never change when a shard is added, so a record moves only into the new shard.

Defined cases: a null key is a key of its own; a null text has size 1 and CRC 0; repeated rows go to one shard and get
slots of their own; equal scores go to the earlier shard; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-ranges of a shard that are numbered independently; a hot shard is spread over so many tasks.
SUB_RANGES = 256


def drawn(key: Column, name: str) -> Column:
    """52 bits of a hash of key and name."""
    named = F.concat(F.lit(f"{name}:"), F.coalesce(key.cast("string"), F.lit("\0")))
    return F.conv(F.substring(F.md5(F.encode(named, "UTF-8")), 1, 13), 16, 10).cast("bigint")


def score(key: Column, name: str, weight: float) -> Column:
    u = (drawn(key, name).cast("double") + 0.5) / F.lit(float(2**52))
    return F.lit(-float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Index of the shard that has the key."""
    scores = F.array(*(score(key, f"shard-{i}", w) for i, w in enumerate(weights)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def numbered(rows: DataFrame, by: str, order: Sequence[str], sub: Column) -> DataFrame:
    """rows with `slot`, gapless from 0 within each value of by. No task sees a whole shard: sub-ranges are numbered
    alone and start where those before them, of which there are a fixed few, end."""
    rows = rows.withColumn("sub", sub)
    starts = rows.groupBy(by, "sub").agg(F.count(F.lit(1)).alias("n")).select(by, "sub", (F.sum("n").over(Window.partitionBy(by).orderBy("sub")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(by, "sub").orderBy(*order)) - 1
    # at most shards x SUB_RANGES rows
    return rows.withColumn("inside", inside).join(F.broadcast(starts), [by, "sub"]).withColumn("slot", (F.col("before") + F.col("inside")).cast("bigint")).drop("sub", "inside", "before")


def shard(docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where records lie, and where with one more shard."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.col("doc_id")
    rows = docs.select(key, (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, new_weight]).alias("grown_shard"))
    sub = (drawn(key, "slot") % SUB_RANGES).cast("int")
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], sub).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
