"""Operator 5: sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slots, text_of

MULTIPLIER = 2862933555777941757  # fixed value of the published generator


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key: the last jump below ``shards``.

    Each key draws its own series of jump targets; a shard more lets exactly the
    keys whose next jump hits it move, all of them into it."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = ahead[live]
            k = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            key[live] = k
            step = float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0)
            ahead[live] = ((at[live] + 1).astype(np.float64) * step).astype(np.int64)
            live = live[ahead[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of a 64-bit key (not null)."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.arrow_udf("int")
    def shard(a: pa.Array) -> pa.Array:
        keys = np.asarray(a.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
        return pa.array(jump(keys, shards), pa.int32())

    return shard(key)


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot and grown_shard of each row.

    The key alone decides (law ``key``): equal texts under different ids may part.
    A null key hashes like the other keys to one shard; a null text has no bytes
    and the checksum of the empty text; repeated rows share a shard and take a
    slot each.  Slots follow (doc_id, checksum, size) inside a shard; only these
    narrow columns are shuffled, and no shard has to fit into one task."""
    key = F.xxhash64(F.col(doc_id).cast("long"))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_of(text)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"), F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"))
    return slots(narrow, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
