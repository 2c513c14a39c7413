"""Conversation prefix trie: subtree sums by the Euler-tour technique.

**Nodes.** A node is a distinct sequence of the first `d` turns. It is known by its depth and two sums of 64-bit hashes over (place, MD5 of role
and text) of its turns, 128 bits in all: two of n sequences would be confused with odds below n * n / 2^129. The sums are running sums over
ranges of turns, so a conversation of any length is spread over tasks.

**Tour.** Each node has an enter and an exit arc. Enter is followed by the enter of the child that is visited first (the one of the largest
conversation), else by the own exit; exit by the enter of the next smaller sibling, else by the parent's exit. The arcs are one linked list.

**List ranking.** Nodes lie in order of conversation and depth, so most links stay inside a block of `BLOCK` nodes: each block's chains are
contracted in its task to one arc each, with sums and offsets. What is left is contracted in rounds: an arc is merged into its predecessor when
a coin of the round says so for it and not for the predecessor, about a quarter of them each time, until `FINISH` arcs are left, one chain for
one task. Going back through the rounds gives every arc the sums of all arcs before it. A subtree's leaves and savings are the differences of
these sums at its node's exit and enter arcs. The shuffled rows of all rounds together are a few times the number of arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.ordering import numbered, with_previous
from ..session import pinned
from .common import sized_broadcast

BLOCK = 16_384
FINISH = 16_384
CHUNK = 4096
GROUP = 100
MOST_SHARED = 6
EMPTY = hashlib.sha256(b"").hexdigest()
WEIGHTS = ("leaves", "saved")


def _shared(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each conversation's rebuilt turns as (`conv`, `pos` from 1, `mark`, `len`), and (`conv`, `n`): its number of rebuilt turns.

    `mark` is the MD5 of role and text, `len` the text's code points. Texts are not shuffled. Turns are ordered by number, nulls first, then `mark`.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary")).alias("mark"),
        F.char_length(said).cast("long").alias("len"),
    ).filter(F.col("conv").isNotNull())
    placed = numbered(rows, F.asc("conv"), F.asc_nulls_first("turn"), F.asc("mark"), name="place")
    own = pinned(placed.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("own")).withColumn("shared", _shared(F.col("conv"))))
    heads = own.filter(F.col("conv") % GROUP == 0).select(F.col("conv").alias("head"), F.col("own").alias("there"))
    grouped = own.withColumn("head", F.col("conv") - F.col("conv") % GROUP).join(heads, "head", "left")
    taken = F.least(F.col("shared"), F.coalesce("there", F.lit(0)))
    convs = pinned(grouped.withColumn("taken", taken.cast("long")).select(
        "conv", "head", "first", "shared", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))).alias("n")
    ))
    at = F.col("place") - F.col("first") + 1
    numbered_turns = placed.join(convs.select("conv", "first", "shared", "taken"), "conv").withColumn("at", at)
    tail = numbered_turns.filter(F.col("at") > F.col("shared")).select("conv", (F.col("at") - F.col("shared") + F.col("taken")).cast("long").alias("pos"), "mark", "len")
    # At most five turns of each group's first conversation, for at most a hundred conversations.
    opening = placed.filter(F.col("conv") % GROUP == 0).join(own.select("conv", "first"), "conv").withColumn("at", at).filter(
        F.col("at") < MOST_SHARED
    ).select(F.col("conv").alias("head"), F.col("at").cast("long").alias("pos"), "mark", "len")
    prefix = opening.join(convs.select("conv", "head", "taken"), "head").filter(F.col("pos") <= F.col("taken")).select("conv", "pos", "mark", "len")
    return tail.unionByName(prefix), convs.select("conv", "n")


def running_sums(rows: DataFrame, key: str, order: str, sums: Sequence[str]) -> DataFrame:
    """`rows` with running sums (up to and including the row) of `sums` per key; a key is spread over ranges of its order. Written."""
    placed = pinned(rows.repartitionByRange(key, order).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy(key, "part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    parts = placed.groupBy(key, "part").agg(*[F.sum(s).alias(f"of_{s}") for s in sums])
    earlier = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(
        F.col(key).alias("of_key"), F.col("part").alias("of_part"),
        *[F.coalesce(F.sum(f"of_{s}").over(earlier), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"before_{s}") for s in sums],
    )
    local = placed.select(*[c for c in placed.columns if c not in sums], *[F.sum(s).over(inside).cast("decimal(38,0)").alias(s) for s in sums])
    joined = local.join(before, (F.col(key) == F.col("of_key")) & (F.col("part") == F.col("of_part")))
    return pinned(joined.select(
        *[c for c in rows.columns if c not in sums], *[(F.col(s) + F.col(f"before_{s}")).cast("decimal(38,0)").alias(s) for s in sums]
    ))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "mark").cast("decimal(38,0)")


def trie(turns: DataFrame, columns: Sequence[str] = ("conv_id", "turn", "role", "text")) -> tuple[DataFrame, DataFrame]:
    """The nodes, with (`node`, `conv`, `depth`, `n_convs`, `len`, `parent`, `parent_conv`, `n_children`, `first_child`, `sibling`), and the
    conversations' ends as (`node`, `ends_sha256`). `node` numbers lie in order of conversation and depth."""
    rows, convs = rebuilt(turns, *columns)
    steps = rows.withColumn("a", _hash(1)).withColumn("b", _hash(2))
    upto = running_sums(steps, "conv", "pos", ("a", "b"))
    members = upto.select("conv", "pos", "len", "a", "b", *[(F.col(c) - _hash(seed)).cast("decimal(38,0)").alias(f"p{c}") for seed, c in ((1, "a"), (2, "b"))])
    zero = F.lit(0).cast("decimal(38,0)")
    inner = members.groupBy(F.col("pos").alias("depth"), "a", "b").agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv"), F.min("len").alias("len"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
    )
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("a"), zero.alias("b"), "n_convs", "conv", F.lit(0).cast("long").alias("len"),
        F.lit(None).cast("decimal(38,0)").alias("pa"), F.lit(None).cast("decimal(38,0)").alias("pb"),
    )
    nodes = pinned(
        inner.unionByName(root).repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth").withColumn("node", F.monotonically_increasing_id())
    )
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    linked = pinned(nodes.join(above, ["depth", "pa", "pb"]).select("node", "conv", "parent", "parent_conv"))
    ordered = pinned(with_previous(linked, ["parent"], ["conv"], "node", "sibling"))
    below = linked.groupBy("parent").agg(F.count("*").alias("n_children"), F.max_by("node", "conv").alias("first_child"))
    whole = (
        nodes.select("node", "conv", "depth", "n_convs", "len")
        .join(ordered.select("node", "parent", "parent_conv", "sibling"), "node", "left")
        .join(below.select(F.col("parent").alias("node"), "n_children", "first_child"), "node", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    )
    last = members.join(convs.filter("n > 0").select("conv", F.col("n").alias("pos")), ["conv", "pos"]).select(F.col("pos").alias("depth"), "a", "b", "conv")
    turnless = convs.filter("n = 0").select(F.lit(0).cast("long").alias("depth"), zero.alias("a"), zero.alias("b"), "conv")
    ends = hashed(last.unionByName(turnless), ["depth", "a", "b"])
    return pinned(whole), nodes.select("depth", "a", "b", "node").join(ends, ["depth", "a", "b"]).select("node", "ends_sha256")


def hashed(ends: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """`keys` and `ends_sha256`: the SHA-256 of each group's `conv`s, ascending, comma-joined.

    Numbers become texts of `chunk` numbers each in parallel. A group of one text is hashed in the JVM; the texts of a larger one stream through
    one hash, whose steps can't be shared, and are never held together.
    """
    placed = pinned(ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").withColumn("at", F.monotonically_increasing_id()))
    pieces = placed.groupBy(*keys, F.floor(F.col("at") / chunk).alias("chunk")).agg(F.array_sort(F.collect_list("conv")).alias("convs"))
    texts = pinned(pieces.select(*keys, "chunk", F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("joined")))
    groups = texts.groupBy(*keys).agg(F.count("*").alias("chunks"), F.min("joined").alias("joined"))
    small = groups.filter("chunks = 1").select(*keys, F.sha2(F.col("joined"), 256).alias("ends_sha256"))
    large = sized_broadcast(pinned(groups.filter("chunks > 1").select(*keys)))
    names = [*keys, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    if at is not None:
                        yield one(at, state)
                    at, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if at is not None:
            yield one(at, state)

    kinds = [ends.schema[k].dataType.simpleString() for k in keys]

    def one(key: list, state) -> pa.RecordBatch:
        types = [pa.decimal128(38, 0) if k.startswith("decimal") else pa.int64() for k in kinds]
        return pa.RecordBatch.from_arrays([*[pa.array([k], t) for k, t in zip(key, types)], pa.array([state.hexdigest()])], names=names)

    stream = texts.join(large, list(keys)).repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "joined")
    return small.unionByName(stream.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in zip(names, [*kinds, "string"]))))


def arcs(nodes: DataFrame) -> DataFrame:
    """The tour as a linked list: `id` (twice the node's number, plus one for exit), `next` and the weights of each arc."""
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    is_leaf = F.col("n_children") == 0
    saved = (F.col("n_convs") - 1) * F.col("len")
    none = F.lit(0).cast("long")
    pair = F.array(
        F.struct(enter.alias("id"), F.coalesce(F.col("first_child") * 2, leave).alias("next"), F.when(is_leaf, 1).otherwise(0).cast("long").alias("leaves"), saved.alias("saved")),
        F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), none.alias("leaves"), none.alias("saved")),
    )
    return nodes.select(F.inline(pair))




def _chains(ids: np.ndarray, following: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a set of arcs: the row of each one's chain head, the weights before it in the chain, the chain's last row by head, all its weights by head."""
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids[order], following), len(ids) - 1)]
    step = np.where((following >= 0) & (ids[at] == following), at, -1)
    heads = np.ones(len(ids), bool)
    heads[step[step >= 0]] = False
    head, before = np.zeros(len(ids), np.int64), np.zeros_like(weights)
    last, total = np.zeros(len(ids), np.int64), np.zeros_like(weights)
    steps, plain = step.tolist(), weights.tolist()
    for h in np.flatnonzero(heads).tolist():
        row, sums = h, [0] * weights.shape[1]
        while row >= 0:
            head[row], before[row], end = h, sums, row
            sums = [a + b for a, b in zip(sums, plain[row])]
            row = steps[row]
        last[h], total[h] = end, sums
    return head, before, last, total


def contract_blocks(listed: DataFrame, block: Column) -> DataFrame:
    """Every arc with its chain's head (`into`) and the weights before it there; for heads also the chain's `next` and all its weights (`of_`).

    A chain is a run of arcs of one block. The arcs of a block meet in a task.
    """
    names = ["id", "into", *WEIGHTS, "next", *[f"of_{w}" for w in WEIGHTS]]

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = table["id"].to_numpy()
        following = table["next"].fill_null(-1).to_numpy()
        weights = np.stack([table[w].to_numpy() for w in WEIGHTS], axis=1)
        head, before, last, total = _chains(ids, following, weights)
        own = head == np.arange(len(ids))
        ends = following[last]
        columns = [pa.array(ids), pa.array(ids[head]), *[pa.array(before[:, i]) for i in range(len(WEIGHTS))],
                   pa.array(ends, mask=~own | (ends < 0)), *[pa.array(total[:, i], mask=~own) for i in range(len(WEIGHTS))]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:  # sorted by block; a block may go on in the next batch
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for start, end in zip(cuts, cuts[1:]):
                if held and group[start] != at:
                    yield of(held)
                    held = []
                at = group[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield of(held)

    grouped = listed.withColumn("block", block).repartition("block").sortWithinPartitions("block").select("block", "id", "next", *WEIGHTS)
    return grouped.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _heads(contracted: DataFrame) -> DataFrame:
    return contracted.filter("id = into").select("id", "next", *[F.col(f"of_{w}").alias(w) for w in WEIGHTS])


def merge_round(listed: DataFrame, number: int, head: int) -> tuple[DataFrame, DataFrame]:
    """One round of the random contraction: the arcs that are left, and those that were merged into their predecessors. One join."""
    def coin(arc: str) -> Column:
        return (F.pmod(F.xxhash64(F.lit(number), arc), F.lit(2)) == 1) & (F.col(arc) != head)

    after = listed.select(F.col("id").alias("then"), F.col("next").alias("then_next"), *[F.col(w).alias(f"then_{w}") for w in WEIGHTS])
    pairs = pinned(listed.join(after, F.col("next") == F.col("then"), "left").withColumn("goes", coin("id")).withColumn(
        "then_goes", F.coalesce(coin("then"), F.lit(False))
    ))
    merges = ~F.col("goes") & F.col("then_goes")
    stays = pairs.filter(~F.col("goes")).select(
        "id", F.when(merges, F.col("then_next")).otherwise(F.col("next")).alias("next"),
        *[(F.col(w) + F.when(merges, F.col(f"then_{w}")).otherwise(0)).alias(w) for w in WEIGHTS],
    )
    passed = pairs.filter(F.col("goes") & F.col("then_goes")).select(
        F.col("then").alias("id"), F.col("then_next").alias("next"), *[F.col(f"then_{w}").alias(w) for w in WEIGHTS]
    )
    merged = pairs.filter(merges).select(F.col("then").alias("id"), F.col("id").alias("into"), *WEIGHTS)
    return stays.unionByName(passed), merged


def sums_before(listed: DataFrame, head: int, block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """`id` and, for each weight, the sum over all arcs before it on the list. `head` is the first arc, which no coin removes."""
    # Two arcs a node; node numbers are consecutive inside a partition of the table that they were given in.
    levels = [pinned(contract_blocks(listed, F.floor(F.col("id") / (2 * block))))]
    left = pinned(_heads(levels[0]))
    number = 0
    while left.count() > finish:
        stays, merged = merge_round(left, number, head)
        levels.append(pinned(merged))
        left = pinned(stays)
        number += 1
    known = pinned(contract_blocks(left, F.lit(0).cast("long")).select("id", *WEIGHTS))
    for level in levels[:0:-1]:
        came = level.join(known.select(F.col("id").alias("into"), *[F.col(w).alias(f"at_{w}") for w in WEIGHTS]), "into").select(
            "id", *[(F.col(w) + F.col(f"at_{w}")).alias(w) for w in WEIGHTS]
        )
        known = pinned(known.unionByName(came))
    first = levels[0].select("id", "into", *WEIGHTS)
    return first.join(known.select(F.col("id").alias("into"), *[F.col(w).alias(f"at_{w}") for w in WEIGHTS]), "into").select(
        "id", *[(F.col(w) + F.col(f"at_{w}")).alias(w) for w in WEIGHTS]
    )


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK,
                finish: int = FINISH) -> DataFrame:
    """One row per node: `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`.

    Turns come by number, nulls first; turns of equal number by the MD5 of role and text, repeats stay. Null roles and texts are empty. A null
    conversation has no number to rebuild it by and takes no part. A conversation without rebuilt turns ends at the root. An empty table has no
    node. Other columns are ignored.
    """
    nodes, ends = trie(turns, (conv, turn, role, text))
    top = nodes.filter("depth = 0").select("node").first()  # one row, or none
    listed = arcs(nodes)
    before = sums_before(listed, 2 * top.node if top else -1, block, finish)
    signed = [F.when(F.col("id") % 2 == 1, F.col(w)).otherwise(-F.col(w)) for w in WEIGHTS]
    below = before.groupBy(F.floor(F.col("id") / 2).alias("node")).agg(F.sum(signed[0]).alias("n_leaves"), F.sum(signed[1]).alias("saved_tokens"))
    return nodes.join(below, "node").join(ends, "node", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
