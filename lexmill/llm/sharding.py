"""Operator 9: sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
#: Each shard is numbered in so many independent buckets.
BUCKETS = 128


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys: from n to n + 1 shards a key stays or goes to the new shard.

    The state is one 64-bit number a key, advanced by a linear congruential step; each step jumps forward, so the
    loop ends after about ln(shards) rounds.
    """
    state = keys.astype(np.uint64)
    at = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = jump[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            jump[live] = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            live = live[jump[live] < shards]
    return at


def shard_column(key, shards: int):
    """Column of shard numbers for a long column of hashed keys; only the keys go to Python, in Arrow batches."""

    @F.pandas_udf("int")
    def pick(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return pick(key)


def shard_documents(docs: DataFrame, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """Shard, slot and the shard after one more shard is appended, for each document.

    The law is `key`: doc_id and the shard count alone decide. Slots are gapless from 0 in each shard, ordered by a
    bucket of the hashed id, then by doc_id. Each shard is numbered bucket by bucket with the bucket's start from a
    table of shards x buckets counts, so no task holds a whole shard.

    Null text: size 1, checksum of nothing. Null ids hash alike and share a shard. Repeated rows get slots of their
    own. Empty table: no rows. Other columns of the input are not read, whatever their names.
    """
    key = F.xxhash64(F.col("doc_id"))
    bucket = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("slot")), F.lit(buckets)).cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select("doc_id").select(shard_column(key, shards).alias("shard"), bucket.alias("bucket"))
    counts = ids.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
        bucket.alias("bucket"),
    ).select(
        "doc_id", "size", "text_crc32", "bucket",
        shard_column(F.col("key"), shards).alias("shard"),
        shard_column(F.col("key"), shards + 1).alias("grown_shard"),
    )
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    # starts has at most shards x buckets rows
    return rows.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("nth")).cast("long").alias("slot"), "grown_shard",
    )
