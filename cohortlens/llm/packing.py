"""Best-fit packing under conflicts.

**Items.** A document longer than the capacity is cut into full pieces and a rest; nothing is lost. Items are dealt to packing shards
by a hash of their key and, of equal rows, the number of the copy, so a hot source, a large group of copies or one row that is repeated
very often is spread over all shards, and a shard has a bounded number of items whatever the input. Shards are packed independently.

**Rule.** Inside a shard items come by falling size. Open bins are kept in the order of their residual capacity; each carries a bitmap
of the sources and one of the duplicate clusters it holds. The search starts at the least residual that fits and goes on to the next
larger ones until a bin shares neither source nor cluster with the item; without one a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import each_copy, n_words

CAPACITY = 1024
SHARD_ITEMS = 4096


def pack(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each item; items are placed in the order given."""
    bit = [{v: i for i, v in enumerate(dict.fromkeys(column))} for column in (sources, clusters)]
    order: list[tuple[int, int]] = []  # (residual, bin), residual ascending
    held: list[list[int]] = []  # per bin: the bitmaps of sources and clusters
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        a, b = 1 << bit[0][source], bit[1][cluster]
        at = bisect_left(order, (size, -1))
        while at < len(order):
            into = held[order[at][1]]
            if not into[0] & a and not into[1] >> b & 1:
                break
            at += 1
        if at < len(order):
            residual, place = order.pop(at)
        else:
            residual, place = capacity, len(held)
            held.append([0, 0])
        held[place][0] |= a
        held[place][1] |= 1 << b
        bins.append(place)
        offsets.append(capacity - residual)
        if residual > size:
            insort(order, (residual - size, place))
    return bins, offsets


def _pack_shard(shard: pd.DataFrame, capacity: int) -> pd.DataFrame:
    shard = shard.sort_values(["size", "hash", "id", "piece"], ascending=[False, True, True, True], kind="stable", na_position="last")
    source = shard["source"].where(shard["source"].notna(), None)
    shard["bin"], shard["offset"] = pack(shard["size"].tolist(), source.tolist(), shard["cluster"].tolist(), capacity)
    return shard[["id", "piece", "start", "size", "source", "cluster", "shard", "bin", "offset"]]


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None,
           cluster: Column | None = None, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per piece: `key`, `piece` (from 0), `start` and `size` (in words), `source`, `cluster`, `shard`, `bin`, `offset`.

    A bin (`shard`, `bin`) has at most `capacity` words, no source twice and no duplicate cluster twice; by default a cluster is an
    equal text. The pieces of a document are of one source and so lie in different bins. A document without words is one piece of
    size 0. A null source is a source, null texts are one cluster, null keys are allowed; of repeated rows each is packed. Other
    columns are ignored. The result depends on the rows, not on their order or partitions.
    """
    words = n_words(F.col(text)) if size is None else size
    same = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) if cluster is None else cluster
    rows = docs.select(
        F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), words.cast("long").alias("words"),
        same.cast("long").alias("cluster"),
    )
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("int")
    # Equal rows are counted, not shuffled one by one, and have a number each.
    counted = rows.groupBy("id", "source", "cluster", "words").agg(F.count("*").alias("n"))
    items = each_copy(counted, "n", "copy").select(
        "id", "source", "cluster", "words", "copy", F.explode(F.sequence(F.lit(0), last)).alias("piece")
    ).select(
        "id", "source", "cluster", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece").cast("long") * capacity).alias("size"),
        F.xxhash64("id", "cluster", "piece", "source", "copy").alias("hash"),
    )
    # The number of pieces decides how many shards there are.
    total = rows.agg(F.sum(F.greatest(F.ceil(F.col("words") / capacity), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_items))
    schema = "id long, piece int, start long, size long, source string, cluster long, shard int, bin long, offset long"
    dealt = items.withColumn("shard", F.pmod(F.col("hash"), F.lit(shards)).cast("int"))
    done = dealt.groupBy("shard").applyInPandas(lambda shard: _pack_shard(shard, capacity), schema)
    return done.withColumnRenamed("id", key)
