"""Token rows for training: best-fit-decreasing packing of token documents into rows of a fixed length.

**Shards.** A task gathers the pieces it reads until they hold `shard_tokens` tokens, packs them, writes the rows and goes on. No text and
no token is shuffled, memory is bounded by the shard, and a lost executor costs its tasks' shards only. Each shard leaves a few rows that
are not full, out of thousands.

**Pieces.** A document longer than a row is cut into full rows and a rest; its pieces are numbered, so nothing is lost.

**Packing.** Best-fit-decreasing looks at lengths alone, so a shard is planned from its number of pieces of each length. A segment tree over
the capacities 0..length holds how many open rows have each residual; the tightest fitting residual is a search for the first non-empty
leaf at or above the piece. All pieces of one length and all rows of one run of equal residual are moved at once, which gives the same
rows as placing piece by piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LENGTH = 2048
BLOCK_ROWS = 64
SHARD_TOKENS = 1 << 22
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PADDING = 50256


class ResidualTree:
    """A segment tree over residuals 0..top with the number of open rows in each; lists name them as (first row, rows)."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def add(self, residual: int, first: int, rows: int) -> None:
        if rows:
            self.runs[residual].append((first, rows))
            self._change(residual, rows)

    def take(self, residual: int) -> tuple[int, int]:
        run = self.runs[residual].pop()
        self._change(residual, -run[1])
        return run

    def _change(self, residual: int, by: int) -> None:
        at = residual + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least residual of at least `size` that an open row has."""
        at = size + self.leaves
        while not self.count[at]:
            while at & 1:  # a right child: what lies to the right is under an ancestor
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing of `counts[size]` pieces: entries (size, first rank, pieces, first row, pieces a row, offset).

    Piece `first rank + i` goes to row `first row + i // (pieces a row)`, `i % (pieces a row)` pieces behind `offset`.
    """
    tree, entries, rows = ResidualTree(length), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        if size == 0:
            if left:  # empty documents take no place
                entries.append((0, 0, left, 0, left, 0))
                rows = max(rows, 1)
            continue
        while left:
            residual = tree.tightest(size)
            if residual is None:
                residual, each = length, length // size
                first, there = rows, -(-left // each)
                rows += there
            else:
                each = residual // size
                first, there = tree.take(residual)
            full = min(there, left // each)
            rest = min(left - full * each, each) if full < there else 0
            used = full + (rest > 0)
            entries.append((size, rank, full * each + rest, first, each, length - residual))
            tree.add(residual - each * size, first, full)
            if rest:
                tree.add(residual - rest * size, first + full, 1)
            tree.add(residual, first + used, there - used)
            rank += full * each + rest
            left -= full * each + rest
    return entries


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding(
        "ranks", pat_str=pattern, special_tokens={},
        mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())},
    )


OUTPUT = (
    "partition int, shard int, block int, n_rows int, row_length int, ids binary, position_ids binary, "
    "cu_seqlens array<array<int>>, doc_ids array<array<long>>, pieces array<array<int>>"
)


def pack_shard(held: list[tuple], length: int, block_rows: int, padding: int) -> Iterator[dict]:
    """Blocks of the rows that hold the pieces (`id`, `piece`, `tokens`)."""
    sizes = np.array([len(t) for _, _, t in held], np.int64)
    order = np.argsort(-sizes, kind="stable")
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    rows: dict[int, list[tuple[int, int]]] = {}
    entries = plan(counts, length)
    begins = {}
    at = 0
    for size in sorted(counts, reverse=True):
        begins[size] = at
        at += counts[size]
    for size, rank, number, first, each, offset in entries:
        for i, piece in enumerate(order[begins[size] + rank:begins[size] + rank + number].tolist()):
            rows.setdefault(first + i // each, []).append((offset + i % each * size, piece))
    last = max(rows, default=-1)
    for begin in range(0, last + 1, block_rows):
        here = min(block_rows, last + 1 - begin)
        ids = np.full((here, length), padding, np.uint16)
        resets = np.zeros((here, length), np.uint16)
        ends, docs, numbers = [], [], []
        for row in range(here):
            segments = sorted(rows.get(begin + row, []), key=lambda s: (s[0], sizes[s[1]]))
            for start, piece in segments:
                n = sizes[piece]
                ids[row, start:start + n] = held[piece][2]
                resets[row, start:start + n] = np.arange(n, dtype=np.uint16)
            ends.append([0] + [int(start + sizes[piece]) for start, piece in segments])
            docs.append([held[piece][0] for _, piece in segments])
            numbers.append([held[piece][1] for _, piece in segments])
        yield {
            "block": begin // block_rows, "n_rows": here, "row_length": length, "ids": ids.tobytes(), "position_ids": resets.tobytes(),
            "cu_seqlens": ends, "doc_ids": docs, "pieces": numbers,
        }


_KINDS = [pa.int32()] * 5 + [pa.binary()] * 2 + [pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32()))]


def packed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, block_rows: int = BLOCK_ROWS,
                shard_tokens: int = SHARD_TOKENS, ranks: bytes | None = None, padding: int = PADDING) -> DataFrame:
    """Blocks of `n_rows` rows: `ids` and `position_ids` are row-major matrices of little-endian 16-bit numbers.

    `cu_seqlens` has per row the cumulative segment ends from 0; `doc_ids` and `pieces` name each segment; positions start again at 0 in
    every segment; behind the last end there is padding. The segments of a document in the order of `pieces` are its tokens. A null or
    empty text is one empty segment. Null keys are allowed, repeated rows are packed each, an empty table gives no block, other columns
    are ignored. Which documents share a row depends on how the input is split; which tokens are written does not.
    """
    if not 0 < length < 65536:
        raise ValueError("a row has 1 to 65535 tokens")
    vocab = ranks or vocabulary()
    names = [field.split()[0] for field in OUTPUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab).encode_ordinary
        partition, shard, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def out():
            for block in pack_shard(held, length, block_rows, padding):
                values = {"partition": partition, "shard": shard, **block}
                yield pa.RecordBatch.from_arrays([pa.array([values[n]], kind) for n, kind in zip(names, _KINDS)], names=names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.array(encode(text.as_py() or ""), np.uint16)
                for piece in range(max(1, -(-len(found) // length))):
                    held.append((key, piece, found[piece * length:(piece + 1) * length]))
                tokens += len(found)
                if tokens >= shard_tokens or len(held) >= shard_tokens:
                    yield from out()
                    shard, held, tokens = shard + 1, [], 0
        yield from out()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, OUTPUT)
