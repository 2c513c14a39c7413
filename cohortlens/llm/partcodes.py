"""Vector codes from four codebooks, learnt with anchors-hierarchy metric trees.

**Trees.** Rows are held in blocks of `BLOCK`, and each block has a metric tree for each part position. A tree is built middle-out: about
`sqrt(n)` anchors take over points from each other (a new anchor is the farthest point of the widest one, and points nearer to their anchor
than half the way to the new one are not looked at); the anchors' balls are merged pairwise, the tightest union first, up to a root; balls
above `LEAF` points are divided by anchors again. A ball caches its centre, its radius, and the sum and the number of its points. Trees do
not depend on the codebooks: they are built and written once.

**Rounds.** A ball inherits the list of entries that may own some of its points. Entry `e` leaves it if another entry is nearer for every
point of the ball: `|c - e|^2 - |c - f|^2 > 2 r |e - f|`. When one entry is left it owns the ball wholly, whose cached sum and number are
added; leaves compare their points with what is left of the list. All points and entries are integers and compared exactly.

Each task sends on one row an entry; a codebook is bounded by 256 entries a part, so it is shipped with the tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import top_per_group
from ..session import pinned
from .common import sized_broadcast
from .vectors import as_doubles, common_length, is_sound

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 4096
LEAF = 128


def anchors(points: np.ndarray) -> list[np.ndarray]:
    """The points' indexes by anchor. Fewer than `sqrt(n)` groups if the points are few distinct ones."""
    n = len(points)
    owner, chosen = np.zeros(n, np.int64), [0]
    far = np.sqrt(((points - points[0]) ** 2).sum(1))
    widest = [float(far.max())]
    while len(chosen) < int(np.ceil(np.sqrt(n))):
        a = int(np.argmax(widest))
        if widest[a] == 0:
            break
        mine = np.flatnonzero(owner == a)
        new = int(mine[np.argmax(far[mine])])
        between = np.sqrt(((points[chosen] - points[new]) ** 2).sum(1))
        near = np.flatnonzero(far > between[owner] / 2)
        to_new = np.sqrt(((points[near] - points[new]) ** 2).sum(1))
        won = to_new < far[near]
        taken = near[won]
        lost_by = np.unique(owner[taken])
        owner[taken], far[taken] = len(chosen), to_new[won]
        chosen.append(new)
        widest.append(float(far[taken].max()))
        for b in lost_by:
            left = far[owner == b]
            widest[b] = float(left.max()) if len(left) else 0.0
    return [g for g in (np.flatnonzero(owner == a) for a in range(len(chosen))) if len(g)]


def _shape(points: np.ndarray, at: np.ndarray) -> tuple | np.ndarray:
    """The points `at` as a nested pair of balls, or as the indexes of a leaf."""
    if len(at) <= LEAF:
        return at
    groups = anchors(points[at])
    if len(groups) == 1:  # equal points
        return at
    members = [at[g] for g in groups]
    nodes = [_shape(points, m) for m in members]
    centre = [points[m].mean(0) for m in members]
    radius = [float(np.sqrt(((points[m] - c) ** 2).sum(1)).max()) for m, c in zip(members, centre)]
    size = [len(m) for m in members]
    # Union of the two balls with the smallest radius first; a merged ball takes the first's place, the second's row is closed.
    centres, radii = np.array(centre), np.array(radius)
    wide = (np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + radii[:, None] + radii[None]) / 2
    np.fill_diagonal(wide, np.inf)
    for _ in range(len(nodes) - 1):
        i, j = divmod(int(np.argmin(wide)), len(nodes))
        nodes[i], total = (nodes[i], nodes[j]), size[i] + size[j]
        merged = (centres[i] * size[i] + centres[j] * size[j]) / total
        radii[i] = max(np.sqrt(((merged - centres[m]) ** 2).sum()) + radii[m] for m in (i, j))
        centres[i], size[i] = merged, total
        wide[j], wide[:, j] = np.inf, np.inf
        open_ = np.isfinite(wide[i])
        wide[i, open_] = (np.sqrt(((centres[open_] - merged) ** 2).sum(1)) + radii[open_] + radii[i]) / 2
        wide[open_, i] = wide[i, open_]
        top = nodes[i]
    return top


def tree(points: np.ndarray) -> dict[str, np.ndarray]:
    """The metric tree of integer points: their `order`, and for each ball `start`, `end` in that order, `left`, `right` (-1: leaf), `radius`, `sum`.

    Balls come before their children; the root is the first.
    """
    real = points.astype(np.float64)
    order: list[np.ndarray] = []
    balls: list[list[int]] = []  # start, end, left, right
    placed = 0
    todo: list[tuple] = [(_shape(real, np.arange(len(points))), -1, 0)]
    while todo:
        node, parent, side = todo.pop()
        if parent == -2:  # a ball whose children are done
            balls[side][1] = placed
            continue
        at = len(balls)
        if parent >= 0:
            balls[parent][2 + side] = at
        balls.append([placed, placed, -1, -1])
        if isinstance(node, tuple):
            todo += [(None, -2, at), (node[1], at, 1), (node[0], at, 0)]
        else:
            order.append(node)
            placed += len(node)
            balls[at][1] = placed
    laid = np.array(balls, np.int32).reshape(-1, 4)
    order_ = np.concatenate(order).astype(np.int32)
    sums = np.array([points[order_[s:e]].sum(0) for s, e in laid[:, :2]], np.int64)
    centre = sums / (laid[:, 1] - laid[:, 0])[:, None]
    radius = np.array([np.sqrt(((real[order_[s:e]] - c) ** 2).sum(1)).max() for (s, e), c in zip(laid[:, :2], centre)])
    return {"order": order_, "balls": laid, "radius": radius, "sum": sums}


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and entries. A product of doubles is exact while all its sums are below 2 to the 52."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * points.shape[1] < 1 << 52:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p**2).sum(1)[:, None] - 2 * (p @ e.T) + (e**2).sum(1)).astype(np.int64)
    return ((points[:, None, :] - entries[None]) ** 2).sum(2)


class Book:
    """The entries of one part position, with their distances from each other."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.real = entries, entries.astype(np.float64)
        self.gaps = np.sqrt(squares(entries, entries).astype(np.float64))
        # An entry that equals one before it owns nothing.
        self.first = np.sort(np.unique(entries, axis=0, return_index=True)[1])


def owners(points: np.ndarray, balls: dict[str, np.ndarray], book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The owner of each point, and each entry's sum and number of points; also how many points were never compared one by one."""
    laid, radius, cached, order = (balls[n] for n in ("balls", "radius", "sum", "order"))
    owner = np.zeros(len(points), np.int32)
    sums, count = np.zeros_like(book.entries), np.zeros(len(book.entries), np.int64)
    single: list[np.ndarray] = []
    whole = 0
    todo = [(0, book.first)]
    while todo:
        at, listed = todo.pop()
        start, end, left, right = laid[at].tolist()
        if len(listed) > 1:
            centre = cached[at] / (end - start)
            away = ((book.real[listed] - centre) ** 2).sum(1)
            best = int(np.argmin(away))
            slack = 1e-9 * (1 + float(away.max()))
            listed = listed[away - away[best] <= 2 * radius[at] * book.gaps[listed, listed[best]] * (1 + 1e-9) + slack]
        if len(listed) == 1:
            sums[listed[0]] += cached[at]
            count[listed[0]] += end - start
            owner[order[start:end]] = listed[0]
            whole += end - start
        elif left < 0:
            rows = order[start:end]
            owner[rows] = listed[squares(points[rows], book.entries[listed]).argmin(1)]  # the first of equal ones: the lowest index
            single.append(rows)
        else:
            todo += [(left, listed), (right, listed)]
    if single:
        rows = np.concatenate(single)
        np.add.at(sums, owner[rows], points[rows])
        count += np.bincount(owner[rows], minlength=len(count))
    return owner, sums, count, whole


def _packed(trees: list[dict[str, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{i}_{name}": a for i, each in enumerate(trees) for name, a in each.items()})
    return out.getvalue()


def _unpacked(data: bytes) -> list[dict[str, np.ndarray]]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return [{name: held[f"{i}_{name}"] for name in ("order", "balls", "radius", "sum")} for i in range(PARTS)]


def blocks(rows: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Rows (`id`, `label`, `vec`) as blocks where they are read: `ids`, `labels`, `points` (int32 matrix) and `trees`. Nothing is shuffled."""

    def of(ids: list, labels: list, points: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        trees = _packed([tree(part) for part in np.split(points.astype(np.int64), PARTS, axis=1)])
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(schema.field("label").type)),
                   pa.array([points.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "points", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held, schema = [], [], [], None
        for batch in batches:
            schema = batch.schema
            vectors = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, length) * SCALE)
            top = float(np.abs(vectors).max(initial=0))
            if top >= 1 << 31 or 4 * top * top * (length // PARTS) >= 1 << 61:
                raise ValueError("a component is so large that its squared distances do not fit a long")
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            held.append(vectors)
            while len(ids) >= block:
                points = np.concatenate(held)
                yield of(ids[:block], labels[:block], points[:block], schema)
                ids, labels, held = ids[block:], labels[block:], [points[block:]]
        if ids:
            yield of(ids, labels, np.concatenate(held), schema)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "vec").mapInArrow(run, f"ids array<long>, labels array<{kind}>, points binary, trees binary")


def _points(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(-1, length).astype(np.int64)


def first_entries(held: DataFrame, length: int, entries: int = ENTRIES) -> np.ndarray:
    """The integer vectors of the `entries` smallest ids, ascending, null last; an id that repeats counts once, by its smallest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple, tuple] = {}
        for batch in batches:
            for ids, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = [(i is None, i or 0) for i in ids]
                few = set(heapq.nsmallest(entries, set(keys) | set(least)))
                points = _points(data, length)
                for row, key in enumerate(keys):
                    if key in few:
                        vector = tuple(points[row].tolist())
                        least[key] = min(least.get(key, vector), vector)
                least = {key: vector for key, vector in least.items() if key in few}
        found = sorted(least.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if none else i for (none, i), _ in found], pa.int64()), pa.array([list(v) for _, v in found], pa.list_(pa.int64()))], names=["id", "vec"]
        )

    few = top_per_group(held.select("ids", "points").mapInArrow(run, "id long, vec array<long>"), ["id"], [F.asc("vec")])
    rows = few.orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    return np.array([r.vec for r in rows], np.int64).reshape(-1, length)


def learnt(held: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after `rounds`: each entry the floor of its parts' mean, unused ones as they were."""
    length = sum(b.shape[1] for b in books)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            ready = [Book(b) for b in books]
            sums, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                for data, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for p, (part, balls) in enumerate(zip(np.split(_points(data, length), PARTS, axis=1), _unpacked(packed))):
                        _, s, n, _ = owners(part, balls, ready[p])
                        sums[p] += s
                        count[p] += n
            used = [(p, int(e)) for p in range(PARTS) for e in np.flatnonzero(count[p])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u[0] for u in used], pa.int32()), pa.array([u[1] for u in used], pa.int32()), pa.array([int(count[p][e]) for p, e in used], pa.int64()),
                 pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
            )

        found = held.select("points", "trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
        widths = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(length // PARTS)]
        books = [b.copy() for b in books]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *widths).collect():  # one row an entry
            books[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(length // PARTS)]
    return books


def coded(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """`key`, `code`, `error`, `label_error`, `codebooks_sha256` of each row whose vector is complete and finite.

    Rows with a null or empty vector, null or non-finite components are left out, as are those of another length than the commonest one that is
    a multiple of four; a zero vector is a vector. Of equal distances the lower index wins. Repeated rows each have their code; of an id that
    repeats, the smallest vector may start an entry; a null id comes after all others. Null labels are one label. An empty table gives an empty
    result; other columns are ignored. Components above about 185,000 (for 64 dimensions) are refused with an error, as their squared distances
    need not fit a long.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), as_doubles(vector).alias("vec"))
    length = common_length(rows, "vec", PARTS)
    if not length:
        return df.sparkSession.createDataFrame([], f"`{key}` long, code string, error long, label_error long, codebooks_sha256 string")
    plain = rows.filter(is_sound(F.col("vec")) & (F.size("vec") == length))
    held = pinned(blocks(plain, length, block))
    books = learnt(held, [b.copy() for b in np.split(first_entries(held, length), PARTS, axis=1)])
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Book(b) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                points, trees = _points(batch.column(2)[i].as_py(), length), _unpacked(batch.column(3)[i].as_py())
                codes, error = [], np.zeros(len(points), np.int64)
                for book, part, balls in zip(ready, np.split(points, PARTS, axis=1), trees):
                    owner = owners(part, balls, book)[0]
                    codes.append(owner)
                    error += ((part - book.entries[owner]) ** 2).sum(1)
                code = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(code), pa.array(error)], names=["id", "label", "code", "error"]
                )

    kind = rows.schema["label"].dataType.simpleString()
    marks = pinned(held.mapInArrow(run, f"id long, label {kind}, code string, error long"))
    errors = pinned(marks.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return marks.join(sized_broadcast(errors), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
