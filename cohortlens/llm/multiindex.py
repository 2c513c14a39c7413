"""Approximate nearest neighbours with an inverted multi-index.

**Index.** A vector's two halves are quantised separately; the pair of centroids is its cell, so `k` centroids a half give `k * k` cells.
The codebooks are fitted on a sample that is bounded by `SAMPLE` distinct vectors; every vector is indexed.

**Traversal.** For a query the pairs of centroids come by rising sum of the two squared distances: a heap holds, for each first centroid that
was reached, the next second one. Cells are taken until they hold the candidate budget; the candidates are then ranked by their distance.

**Budget.** How many candidates are enough depends on the data: vectors without structure need a large share of all rows, clustered ones few.
So `PROBES` sample queries are compared with every row, and the budget is the number of candidates that reaches the wanted share of their
true neighbours. This costs one pass over the rows, whatever their number.

**Large tables.** Equal vectors are one entry with their smallest ids, as more can't be among the nearest. Cells are dealt to blocks of about
`BLOCK` vectors, a larger cell to several. A block is held by a task while its queries stream past; a block that very many queries want is
given to several tasks. Each sends on the few nearest of a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import top_per_group
from ..session import pinned
from .common import sized_broadcast
from .vectors import as_doubles, common_length, is_sound

NEAREST = 10
EVERY = 100
SAMPLE = 16_384
PROBES = 160
RECALL = 0.96
MOST_CENTROIDS = 256
CELL_ROWS = 32
BLOCK = 2048
BLOCK_QUERIES = 16_384
ROUNDS = 10


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The index of the nearest centroid of each point, in slices that bound the distance matrix."""
    norms = (centroids**2).sum(1)
    return np.concatenate([
        (norms - 2 * points[i:i + 2048] @ centroids.T).argmin(1) for i in range(0, len(points), 2048)
    ] or [np.zeros(0, np.int64)])


def fit(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds. The points are sorted first, so the result does not depend on their order."""
    points = points[np.lexsort(points.T[::-1])]
    spread = np.unique(points, axis=0)
    centroids = spread[np.linspace(0, len(spread) - 1, min(k, len(spread))).astype(int)].copy()
    for _ in range(rounds):
        of = _nearest(points, centroids)
        count = np.bincount(of, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, of, points)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def codebooks(sample: DataFrame, length: int, k: int) -> list[np.ndarray]:
    """One codebook for each half, each fitted in a task of its own on the bounded sample (`vec`)."""
    cut = length // 2
    halves = sample.select(F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.slice("vec", 1, cut).alias("part")),
        F.struct(F.lit(1).alias("half"), F.slice("vec", cut + 1, length - cut).alias("part")),
    )).alias("h")).select("h.*")

    def of_half(rows: pd.DataFrame) -> pd.DataFrame:
        points = np.array(rows["part"].tolist(), dtype=np.float64).reshape(len(rows), -1)
        found = fit(points, k) if points.shape[1] else np.zeros((1, 0))
        return pd.DataFrame({"half": int(rows["half"].iloc[0]), "at": range(len(found)), "centroid": list(found)})

    rows = halves.groupBy("half").applyInPandas(of_half, "half int, at int, centroid array<double>").orderBy("half", "at").collect()
    found = [[r.centroid for r in rows if r.half == h] for h in (0, 1)]
    return [np.array(each, dtype=np.float64).reshape(len(each), size) for each, size in zip(found, (cut, length - cut))]


def pairs_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs by rising `first[i] + second[j]`, each once: a pair is followed by the next `j`, and at the first `j` by the next `i` too."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield a[i], b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


class Index:
    """Codebooks and the number of vectors of each cell: what a traversal needs. At most `MOST_CENTROIDS` squared numbers."""

    def __init__(self, books: list[np.ndarray]):
        self.books, self.cut, self.counts = books, books[0].shape[1], np.zeros(len(books[0]) * len(books[1]), np.int64)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors[:, :self.cut], self.books[0]) * len(self.books[1]) + _nearest(vectors[:, self.cut:], self.books[1])

    def visited(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells that hold vectors, in the order of the traversal, with the number of vectors up to and including each."""
        near = [((c - q) ** 2).sum(1) for c, q in zip(self.books, (query[:self.cut], query[self.cut:]))]
        seen, width = 0, len(self.books[1])
        for i, j in pairs_by_distance(*near):
            cell = i * width + j
            if self.counts[cell]:
                seen += int(self.counts[cell])
                yield cell, seen


def _nearest_entries(query: np.ndarray, rows: np.ndarray, norms: np.ndarray, ids: list, k: int) -> list[tuple]:
    """The `k` smallest (distance, id), null ids last. A matrix product finds the rows; their distances are computed anew from the components."""
    rough = norms - 2 * (rows @ query)
    if len(rough) > k:
        close = np.partition(rough, k - 1)[k - 1] + 1e-9 * (norms.max() + query @ query)
        at = np.flatnonzero(rough <= close)
    else:
        at = np.arange(len(rough))
    exact = np.sqrt(((rows[at] - query) ** 2).sum(1))
    found = [(float(d), i is None, i) for d, r in zip(exact, at) for i in ids[r]]
    return [(d, i) for d, _, i in sorted(found, key=lambda e: (e[0], e[1], e[2] or 0))[:k]]


def _sound(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    rows = df.select(F.col(key).cast("long").alias("id"), as_doubles(vector).alias("vec"))
    length = common_length(rows, "vec")
    plain = rows.filter(is_sound(F.col("vec")) & (F.size("vec") == length))
    return plain.filter(F.exists("vec", lambda x: x != 0)), length


def _indexed(rows: DataFrame, index: Index, length: int, keep: int) -> DataFrame:
    """`vec`, `ids` (the `keep` smallest of equal vectors, nulls last) and `cell` of each distinct vector."""
    few = top_per_group(rows, ["vec"], [F.col("id").asc_nulls_last()], keep)
    entries = few.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.cells(_matrix(batch.column(0), length)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec", "ids", "cell"])

    return entries.select("vec", F.transform("ids", lambda e: e["id"]).alias("ids")).mapInArrow(
        run, "vec array<double>, ids array<long>, cell int"
    )


def _probe(entries: DataFrame, probes: np.ndarray, index: Index, k: int, recall: float) -> int:
    """The number of candidates at which `recall` of the probes' true neighbours have been visited. Each task keeps `k + 1` rows a probe."""
    length = probes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in probes]
        for batch in batches:
            rows, cell = _matrix(batch.column(0), length), batch.column(1).to_numpy()
            for start in range(0, len(rows), 4096):
                part, of = rows[start:start + 4096], cell[start:start + 4096]
                far = (part**2).sum(1)[:, None] - 2 * part @ probes.T
                for p, column in enumerate(far.T):
                    at = np.argpartition(column, k)[:k + 1] if len(column) > k + 1 else range(len(column))
                    best[p] = heapq.nsmallest(k + 1, best[p] + [(float(column[i]), int(of[i])) for i in at])
        found = [(p, d, c) for p, each in enumerate(best) for d, c in each]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int32()))], names=["probe", "far", "cell"]
        )

    found = entries.select("vec", "cell").mapInArrow(run, "probe int, far double, cell int")
    # k + 1 rows of each of a fixed number of probes; the nearest one is the probe itself.
    top = top_per_group(found, ["probe"], [F.asc("far"), F.asc("cell")], k + 1).orderBy("probe", "far", "cell").collect()
    needed = []
    for p, query in enumerate(probes):
        upto = dict(index.visited(query))
        needed += [upto[r.cell] for r in [r for r in top if r.probe == p][1:]]
    needed.sort()
    return needed[min(len(needed) - 1, int(recall * len(needed)))] if needed else 1


def _blocks(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block and the number of blocks of each cell: small neighbours share one, a cell above `size` has several."""
    first, number, block, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > size:
            block, held = block + 1, 0
        first[cell] = block
        if n > size:
            number[cell] = -(-n // size)
            block, held = block + number[cell], 0
        else:
            held += n
    return first, number


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEAREST, recall: float = RECALL,
            budget: int | None = None, sample: int = SAMPLE, block: int = BLOCK, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: the `k` nearest found of each row whose key is a multiple of `every`.

    `score` is the Euclidean distance of the vectors as given, in double precision; of equal ones the smaller key is nearer, a null key last.
    Every other row is a candidate, also one with the same key or an equal vector; repeated rows each count and repeated queries each have
    their result. A query with fewer than `k` other rows has all of them. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do those of another length than the commonest. An empty table gives an empty result; other columns are
    ignored. `budget` is the number of candidates to rank for each query; without it, it is measured so that `recall` of the true neighbours of
    a sample of queries are among them.
    """
    spark = df.sparkSession
    rows, length = _sound(df, key, vector)
    keep = k + 1
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    # Distinct vectors by a threshold on their hash, so that copies are one; about `sample` of them, whatever the table's size.
    share = min(1.0, sample / total)
    of = F.pmod(F.xxhash64(F.lit("sample"), "vec"), F.lit(1 << 30))
    chosen = pinned(rows.filter(of < int(share * (1 << 30)) + 1).select("vec").distinct())
    centroids = int(min(MOST_CENTROIDS, max(2, np.ceil(np.sqrt(total / CELL_ROWS)))))
    index = Index(codebooks(chosen, length, centroids))
    entries = pinned(_indexed(rows, index, length, keep))
    sizes = entries.groupBy("cell").agg(F.count("*").alias("n")).collect()  # at most MOST_CENTROIDS squared rows
    index.counts[[r.cell for r in sizes]] = [r.n for r in sizes]
    if budget is None:
        probes = [r.vec for r in chosen.orderBy(F.xxhash64(F.lit("probe"), "vec")).limit(PROBES).collect()]
        budget = _probe(entries, np.array(probes, dtype=np.float64).reshape(-1, length), index, k, recall)
    first, number = _blocks(index.counts, block)

    # The queries' distinct vectors, each with the blocks it visits and the cells it wants there.
    asked = pinned(rows.filter(F.col("id") % every == 0).select("id", F.col("vec").alias("query_vec")))
    distinct = pinned(asked.select("query_vec").distinct().withColumn("query", F.monotonically_increasing_id()))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, out = _matrix(batch.column(1), length), []
            for at, query in enumerate(vectors):
                wanted: dict[int, list[int]] = {}
                for cell, seen in index.visited(query):
                    for b in range(first[cell], first[cell] + number[cell]):
                        wanted.setdefault(int(b), []).append(cell)
                    if seen >= max(budget, keep):
                        break
                out += [(at, b, cells) for b, cells in wanted.items()]
            take = pa.array([o[0] for o in out], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))],
                names=["query", "vec", "block", "cells"],
            )

    visits = pinned(distinct.select("query", "query_vec").mapInArrow(route, "query long, vec array<double>, block long, cells array<int>"))
    shares = pinned(visits.groupBy("block").agg(F.count("*").alias("n")).select(
        F.col("block").alias("of_block"), F.ceil(F.col("n") / block_queries).cast("int").alias("shares")
    ))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy()
            to = first[cell] + batch.column(3).to_numpy() % number[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(to)], names=["vec", "ids", "cell", "block"])

    salted = entries.withColumn("salt", F.pmod(F.xxhash64("vec"), F.lit(1 << 40)))
    dealt = salted.mapInArrow(deal, "vec array<double>, ids array<long>, cell int, block long")
    held = dealt.join(sized_broadcast(shares), F.col("block") == F.col("of_block")).select(
        "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("query"),
        "vec", "ids", "cell", F.lit(None).cast("array<int>").alias("cells"),
    )
    asks = visits.join(sized_broadcast(shares), F.col("block") == F.col("of_block")).select(
        "block", F.pmod(F.xxhash64("query"), F.col("shares")).cast("int").alias("share"), F.lit(True).alias("asks"), "query", "vec",
        F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("cell"), "cells",
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block and share, the block's vectors before its queries."""
        at, vectors, ids, cells = None, [], [], []
        matrix = norms = starts = ends = None
        for batch in batches:
            names = batch.schema.names
            column = {n: batch.column(i) for i, n in enumerate(names)}
            groups = list(zip(column["block"].to_pylist(), column["share"].to_pylist()))
            asking, batch_vectors = column["asks"].to_pylist(), _matrix(column["vec"], length)
            queries, wanted, batch_ids, batch_cells = (column[n] for n in ("query", "cells", "ids", "cell"))
            out = []
            for r, group in enumerate(groups):
                if group != at:
                    at, vectors, ids, cells, matrix = group, [], [], [], None
                if not asking[r]:
                    vectors.append(batch_vectors[r].copy())
                    ids.append(batch_ids[r].as_py())
                    cells.append(batch_cells[r].as_py())
                    continue
                if not vectors:
                    continue
                if matrix is None:
                    order = np.argsort(cells, kind="stable")
                    matrix, ids = np.array(vectors)[order], [ids[i] for i in order]
                    of_cell, norms = np.array(cells)[order], (matrix**2).sum(1)
                    known, begin = np.unique(of_cell, return_index=True)
                    starts = dict(zip(known.tolist(), begin.tolist()))
                    ends = dict(zip(known.tolist(), [*begin.tolist()[1:], len(of_cell)]))
                spans = [np.arange(starts[c], ends[c]) for c in wanted[r].as_py() if c in starts]
                if not spans:
                    continue
                pick = np.concatenate(spans)
                query = queries[r].as_py()
                out += [(query, d, i) for d, i in _nearest_entries(batch_vectors[r], matrix[pick], norms[pick], [ids[p] for p in pick], keep)]
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int64()))], names=["query", "score", "vec_id"]
            )

    grouped = held.unionByName(asks).repartition("block", "share").sortWithinPartitions("block", "share", "asks")
    found = grouped.mapInArrow(search, "query long, score double, vec_id long")
    order = F.struct("score", F.col("vec_id").isNull().alias("none"), "vec_id")
    few = top_per_group(found, ["query"], [order.asc()], keep)
    best = few.groupBy("query").agg(F.array_sort(F.collect_list(order)).alias("best"))
    mine = asked.join(distinct, "query_vec").select("id", "query").join(best, "query")
    # The query's own row: the first entry at distance 0 with its key. At most `k + 1` entries a query.
    own = F.array_position(F.transform("best", lambda e: (e["score"] == 0) & (e["vec_id"].eqNullSafe(F.col("id")))), True)
    others = mine.select("id", F.slice(F.filter("best", lambda e, i: i + 1 != own), 1, k).alias("best"))
    return others.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "entry")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.vec_id").alias("vec_id"), F.col("entry.score").alias("score")
    )
