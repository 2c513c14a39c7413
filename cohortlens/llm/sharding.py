"""Weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import pinned
from .common import hash60, key_string, place_in_class

SHARDS = 40


def shard_of(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard whose score -ln(u) / weight is smallest, u being a hash of key and shard in (0, 1); of equal scores the first.

    A shard that is added wins only rows whose score there is smaller than at all old ones, so rows move into it alone. Shards of
    weight 0 take none.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    name = key_string(*keys)
    used = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in used])

    def score(s: Column) -> Column:
        u = (hash60(F.concat(name, F.lit("#"), s["shard"].cast("string"))) + F.lit(0.5)) / F.lit(float(1 << 60))
        return F.struct((-F.log(u) / s["weight"]).alias("score"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, score))["shard"]


def assign(df: DataFrame, keys: Sequence[str], weights: Sequence[float], name: str = "shard") -> DataFrame:
    """`df` with the shard of each row in a column `name` (replaced if there). A null key is a key like any other."""
    return df.withColumn(name, shard_of([F.col(k) for k in keys], weights))


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """`key`, `size`, `text_crc32`, `law`, `shard`, `slot`, `grown_shard` for equal weights.

    `size`: bytes of the text plus 16; a null text counts as empty. `slot`: from 0 without gaps inside a shard, in the order of a
    hash of the key, then key, checksum and size; rows alike in all of these may change places. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = pinned(rows.select(
        "id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        shard_of([F.col("id")], [1.0] * shards).alias("shard"), shard_of([F.col("id")], [1.0] * (shards + 1)).alias("grown_shard"),
        hash60(F.concat(F.lit("slot:"), key_string(F.col("id")))).alias("hash"),
    ))
    numbered = place_in_class(placed, "shard", ("hash", "id", "text_crc32", "size"), "slot")
    return numbered.select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
