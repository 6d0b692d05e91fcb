"""Sharding by jump consistent hashing.

A row's stable key and the number of shards decide its shard, without a table of the ring; one more shard takes its
fair part of the rows and no row moves between the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackline.llm.common import free_name, gapless_rank

SHARDS = 24
# Fixed value: the multiplier of the method's 64-bit linear congruential generator.
MULTIPLIER = 2862933555777941757
# A row's expected jumps are the logarithm of the shard count; the chance of more than this many is nil.
MAX_JUMPS = 512
LOW, HALF = (1 << 32) - 1, (1 << 16) - 1
RANK_BUCKETS = 1024


def next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64, on the state's 32-bit halves, so that no product overflows."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & LOW
    near, far = m_low & HALF, m_low >> 16
    by_near, by_far = low * near, low * far
    total = by_near + F.shiftleft(by_far.bitwiseAND(HALF), 16) + 1
    carry = F.shiftright(total, 32) + F.shiftright(by_far, 16)
    cross = (high * near).bitwiseAND(LOW) + F.shiftleft((high * far).bitwiseAND(HALF), 16)
    return (carry + (low * m_high).bitwiseAND(LOW) + cross).bitwiseAND(LOW), total.bitwiseAND(LOW)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key."""
    high = F.shiftrightunsigned(key, 32)
    start = F.struct(
        high.alias("high"), key.bitwiseAND(LOW).alias("low"), F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )

    def jump(state: Column, _: Column) -> Column:
        high, low = next_state(state.high, state.low)
        draw = F.shiftright(high, 1) + 1
        ahead = F.floor((state.next + 1) * (F.lit(float(1 << 31)) / draw.cast("double")))
        moved = F.struct(high.alias("high"), low.alias("low"), state.next.alias("at"), ahead.alias("next"))
        return F.when(state.next < shards, moved).otherwise(state)

    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS) + 1))
    # The last jump inside the range is the shard; jumping stops at the first target beyond.
    return F.aggregate(steps, start, jump, lambda state: state.at).cast("int")


def shard(df: DataFrame, identity: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``df`` with size, text_crc32, law, shard, slot and grown_shard; columns of these names are replaced.

    The shard follows from the id and ``shards`` alone, ``grown_shard`` from one shard more. ``slot`` numbers the
    rows of a shard from 0 without gaps, by (a hash bucket, id, text hash). Rows with a null id are keyed by the
    text, so that they do not meet in one shard; null texts have no bytes. Rows equal in id and text share the
    shard and get slots of their own. An empty table gives no rows.
    """
    own = F.coalesce(F.col(identity).cast("string"), F.concat(F.lit("~"), F.coalesce(text, F.lit(""))))
    key = free_name(df, "shard_key")
    rows = df.withColumn(key, F.xxhash64(own)).withColumns(
        {
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
            "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")),
            "law": F.lit("key"),
            "shard": jump_shard(F.col(key), shards),
            "grown_shard": jump_shard(F.col(key), shards + 1),
        }
    )
    order = [F.col(identity), F.xxhash64(F.col(text))]
    spread = F.struct(F.col(identity), F.col(text))
    return gapless_rank(rows, "shard", order, spread, RANK_BUCKETS, "slot").drop(key)


def write_shards(df: DataFrame, path: str, identity: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """``df`` as Parquet with one folder per shard. A task writes several shards, so a hot shard is several files."""
    own = F.coalesce(F.col(identity).cast("string"), F.concat(F.lit("~"), F.coalesce(text, F.lit(""))))
    df.withColumn("shard", jump_shard(F.xxhash64(own), shards)).write.partitionBy("shard").parquet(path)
