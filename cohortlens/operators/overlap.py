"""Array kernels of the text lists: items (words, trigrams) that rows and queries share, counted block by block inside a task.

Queries come as `Asked`: their ids, their items as numbers and how many each needs. They travel to the tasks; rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and items of a block that is counted at once; shares of its rows (one in so many) from which an item is an array over them, with occurrences.
BLOCK_DOCS, BLOCK_ITEMS, DENSE, COMMON = 32_768, 1 << 22, 64, 12
#: Rows whose items are looked up one by one.
FEW = 24
#: Titles and trigrams of a block, and bytes of its bit maps.
BLOCK_TITLES, BLOCK_GRAMS, BLOCK_BITS = 65_536, 1 << 23, 1 << 26
#: Sets of trigrams are compared together if they differ in size by less than this factor.
STEP = 1.5
#: Places of a stretch that is looked at as a whole before its runs are, and cells (begins x places) of runs that are compared at once.
LONG, RUN_CELLS = 512, 1 << 18
#: Stands for a null id, which comes first.
NO_ID = -(1 << 63)
#: A rank as one number: covered items above occurrences.
SHIFT = 40


@dataclass
class Asked:
    """Queries: `ids` (an Arrow array), the numbers of each one's items, and the least number of them that must be shared."""

    ids: pa.Array
    known: pa.Array
    items: list[np.ndarray]
    needed: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, items: pa.Array, needed: pa.Array) -> Asked:
        flat = items.flatten().dictionary_encode()
        lengths = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        numbers = np.split(flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(lengths)[:-1]) if len(items) else []
        return cls(ids, flat.dictionary, numbers, needed.to_numpy(zero_copy_only=False).astype(np.int64))


    @property
    def flat(self) -> np.ndarray:
        return np.concatenate(self.items) if self.items else np.zeros(0, np.int64)

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(i) for i in self.items])]).astype(np.int64)


def _bounds(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def numbering(known: pa.Array) -> Callable:
    """A task that replaces the items of its rows (id, items) by their numbers among the known ones: each once, with its occurrences."""
    def number(batches):
        for batch in batches:
            lists = batch.column("items")
            at = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(at >= 0)
            if not len(some):
                continue
            row = np.repeat(np.arange(len(batch)), np.diff(_bounds(lists)))[some]
            places, times = np.unique(row * len(known) + at[some], return_counts=True)
            row, item = places // len(known), places % len(known)
            kept, counts = np.unique(row, return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array(item.astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ], ["id", "items", "times"])

    return number


class Block:
    """Numbered rows by item, seen by some queries. Items that many rows have are arrays over the rows, the others lists of rows."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, item: np.ndarray, times: np.ndarray, asked: Asked):
        width = len(asked.known)
        # A row's items come in order, so these are, too.
        self.width, self.cells, self.cell_times = width, row.astype(np.int64) * width + item, times
        self.items = asked.items
        order = np.argsort(item, kind="stable")
        self.ids, self.rows, self.times = ids, row[order], times[order]
        item, n = item[order], len(ids)
        held = np.bincount(item, minlength=width)
        starts = np.concatenate([[0], np.cumsum(held)])

        def dense(share: int, values, kind) -> tuple[np.ndarray, list[np.ndarray]]:
            which = np.flatnonzero(held * share >= n)
            slot = np.full(width, -1, np.int64)
            slot[which] = np.arange(len(which))
            cells = np.zeros((len(which), n), kind)
            inside = slot[item] >= 0
            cells[slot[item[inside]], self.rows[inside]] = values if np.isscalar(values) else values[inside]
            return slot, list(cells)

        most = int(times.max()) if len(times) else 0
        has, self.has = dense(DENSE, 1, np.uint8)
        often, self.often = dense(COMMON, self.times, np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)
        # The items of all queries one after the other, as the loops need them.
        flat = asked.flat
        self.of_has, self.of_often = has[flat].tolist(), often[flat].tolist()
        self.begins, self.ends = starts[flat].tolist(), starts[flat + 1].tolist()
        self.present = np.add.reduceat((held[flat] > 0).astype(np.int64), asked.bounds[:-1]).tolist() if len(flat) else []
        self.bounds = asked.bounds.tolist()
        self.covers = {kind: np.zeros(n, kind) for kind in (np.uint8, np.uint16, np.int64)}
        self.sums = np.zeros(n, np.int64)

    def covered(self, q: int) -> np.ndarray:
        """How many items of a query each row has; the array is used again."""
        low, high = self.bounds[q], self.bounds[q + 1]
        acc = self.covers[np.uint8 if high - low < 1 << 8 else np.uint16 if high - low < 1 << 16 else np.int64]
        acc.fill(0)
        lists = []
        for j in range(low, high):
            slot = self.of_has[j]
            if slot >= 0:
                np.add(acc, self.has[slot], out=acc)
            elif self.ends[j] > self.begins[j]:
                lists.append(self.rows[self.begins[j]:self.ends[j]])
        if lists:
            np.add.at(acc, np.concatenate(lists), acc.dtype.type(1))
        return acc

    def keys(self, q: int, rows: np.ndarray, covered: np.ndarray) -> np.ndarray:
        """The ranks of some rows."""
        if len(rows) <= FEW:
            cells = rows[:, None] * self.width + self.items[q]
            place = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            hits = np.where(self.cells[place] == cells, self.cell_times[place], 0).sum(1)
            return (covered.astype(np.int64) << SHIFT) + hits
        hits = np.zeros(len(rows), np.int64)
        lists = []
        for j in range(self.bounds[q], self.bounds[q + 1]):
            slot = self.of_often[j]
            if slot >= 0:
                hits += self.often[slot][rows]
            elif self.ends[j] > self.begins[j]:
                lists.append(slice(self.begins[j], self.ends[j]))
        if lists:
            for part in lists:
                self.sums[self.rows[part]] += self.times[part]
            hits += self.sums[rows]
            for part in lists:
                self.sums[self.rows[part]] = 0
        return (covered.astype(np.int64) << SHIFT) + hits


def _numbered_blocks(batches, asked: Asked, wanted: np.ndarray | None = None) -> Iterator[Block]:
    """The rows of a task (id, items, times) in blocks; with `wanted` only some items."""
    held: list[tuple] = []
    docs = items = 0

    def block() -> Block:
        ids = np.concatenate([h[0] for h in held])
        shift = np.cumsum([0, *[len(h[0]) for h in held]])
        row = np.concatenate([h[1] + s for h, s in zip(held, shift)])
        return Block(ids, row.astype(np.int32), np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), asked)

    for batch in batches:
        ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        bounds = _bounds(batch.column("items"))
        item = batch.column("items").flatten().to_numpy(zero_copy_only=False)
        times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
        begin = 0
        while begin < len(ids):
            end = int(np.searchsorted(bounds, bounds[begin] + max(0, BLOCK_ITEMS - items), "right")) - 1
            end = min(len(ids), max(end, begin + (not held)), begin + BLOCK_DOCS - docs)
            if end > begin:
                low, high = bounds[begin], bounds[end]
                row = np.repeat(np.arange(end - begin), np.diff(bounds[begin:end + 1]))
                use = slice(None) if wanted is None else wanted[item[low:high]]
                held.append((ids[begin:end], row[use], item[low:high][use], times[low:high][use]))
                docs, items, begin = docs + end - begin, items + int(high - low), end
            if begin < len(ids):
                yield block()
                held, docs, items = [], 0, 0
    if held:
        yield block()


def heads(asked: Asked, n: int, floor: np.ndarray) -> Callable:
    """A task that reads numbered rows and gives per query the number of rows in its list, and the ranks and ids of the first `n`.

    A query's rows are counted in all blocks; only rows that cover as much as the last of `n` known ones are looked at further. `floor` is a rank
    per query that at least `n` rows of all tasks are known to reach (0: none known).
    """
    def read(batches):
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(asked.items)
        # Plain numbers: an array of bytes compared with a long is copied first.
        needed, least = asked.needed.tolist(), np.maximum(asked.needed, floor >> SHIFT).tolist()
        total = np.zeros(len(asked.items), np.int64)
        for block in _numbered_blocks(batches, asked):
            for q in range(len(asked.items)):
                if block.present[q] < needed[q]:
                    continue
                acc = block.covered(q)
                inside = acc >= needed[q]
                many = np.count_nonzero(inside)
                total[q] += many
                if not many:
                    continue
                rows = np.flatnonzero(inside if least[q] == needed[q] else acc >= least[q])
                if not len(rows):
                    continue
                covered = acc[rows]
                if len(rows) > n:
                    upto = np.cumsum(np.bincount(covered)[::-1])
                    cut = len(upto) - 1 - int(np.searchsorted(upto, n))
                    rows, covered = rows[covered >= cut], covered[covered >= cut]
                keys = block.keys(q, rows, covered)
                ids = block.ids[rows]
                before = found[q]
                lowest = before[0][-1] if before is not None and len(before[0]) == n else floor[q]
                better = keys >= lowest
                keys, ids = keys[better], ids[better]
                if not len(keys):
                    continue
                if before is not None:
                    keys, ids = np.concatenate([before[0], keys]), np.concatenate([before[1], ids])
                if len(keys) > n:
                    last = keys >= np.partition(keys, len(keys) - n)[len(keys) - n]
                    keys, ids = keys[last], ids[last]
                order = np.lexsort((ids, -keys))[:n]
                found[q] = keys[order], ids[order]
                if len(order) == n:
                    least[q] = max(least[q], int(found[q][0][-1]) >> SHIFT)
        some = np.flatnonzero(total)
        for begin in range(0, len(some), 4096):
            here = some[begin:begin + 4096]
            lists = [found[q] or (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q in here]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(keys) for keys, _ in lists])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                asked.ids.take(pa.array(here)), pa.array(total[here]),
                *[pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[i] for x in lists]))) for i in (0, 1)],
            ], ["query_id", "size", "keys", "ids"])

    return read


def first_of(n: int) -> Callable:
    """The first `n` rows of a query from what the tasks found: (query_id, id, covered, hits, position, size)."""
    def merged(table: pa.Table) -> pa.Table:
        keys = pc.list_flatten(table.column("keys")).to_numpy()
        ids = pc.list_flatten(table.column("ids")).to_numpy()
        order = np.lexsort((ids, -keys))[:n]
        keys, ids = keys[order], ids[order]
        query = table.column("query_id")[0].as_py()
        return pa.table({
            "query_id": pa.array([query] * len(ids), pa.int64()), "id": pa.array(ids, mask=ids == NO_ID), "covered": keys >> SHIFT,
            "hits": keys & ((1 << SHIFT) - 1), "position": np.arange(1, len(ids) + 1, dtype=np.int32),
            "size": np.full(len(ids), pc.sum(table.column("size")).as_py(), np.int64),
        })

    return merged


def places(asked: Asked, watched: list[tuple[np.ndarray, np.ndarray]]) -> Callable:
    """A task that counts per query the rows ahead of each watched rank (keys and ids): (query_id, id, n)."""
    def read(batches):
        width = len(asked.known)
        wanted = np.zeros(width, bool)
        for items in asked.items:
            wanted[items] = True
        ahead = [np.zeros(len(keys), np.int64) for keys, _ in watched]
        for block in _numbered_blocks(batches, asked, wanted):
            for q, (keys, ids) in enumerate(watched):
                least = int(keys.min()) >> SHIFT
                if block.present[q] < least:
                    continue
                acc = block.covered(q)
                rows = np.flatnonzero(acc >= least)
                if not len(rows):
                    continue
                ranks, at = block.keys(q, rows, acc[rows]), block.ids[rows]
                for i, (key, id_) in enumerate(zip(keys, ids)):
                    ahead[q][i] += np.count_nonzero(ranks > key) + np.count_nonzero((ranks == key) & (at < id_))
        if watched:
            each = pa.array(np.repeat(np.arange(len(watched)), [len(keys) for keys, _ in watched]))
            yield pa.RecordBatch.from_arrays(
                [asked.ids.take(each), pa.array(np.concatenate([ids for _, ids in watched])), pa.array(np.concatenate(ahead))], ["query_id", "id", "n"]
            )

    return read


def shared_by(asked: Asked) -> Callable:
    """A task that counts what numbered rows (id, items, times, asked: ids of queries) share with those queries: (query_id, id, covered, hits)."""
    def read(batches):
        number = {q: i for i, q in enumerate(asked.ids.to_pylist())}
        for batch in batches:
            bounds, of = _bounds(batch.column("items")), batch.column("asked").to_pylist()
            item = batch.column("items").flatten().to_numpy(zero_copy_only=False)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            found = []
            for r, queries in enumerate(of):
                own, often = item[bounds[r]:bounds[r + 1]], times[bounds[r]:bounds[r + 1]]
                for q in queries:
                    if (i := number.get(q)) is None:
                        continue
                    same = np.flatnonzero(np.isin(own, asked.items[i]))
                    if len(same) >= asked.needed[i]:
                        found.append((q, r, len(same), int(often[same].sum())))
            if found:
                q, r, covered, hits = zip(*found)
                yield pa.RecordBatch.from_arrays([
                    pa.array(q, pa.int64()), batch.column("id").take(pa.array(r)), pa.array(covered, pa.int64()), pa.array(hits, pa.int64()),
                ], ["query_id", "id", "covered", "hits"])

    return read


# --- runs of trigrams -------------------------------------------------------------------------


def run_in_reach(before: np.ndarray, shared: np.ndarray, size: int, minimum: float) -> bool:
    """Whether any run of a sequence can have the similarity `minimum` with a set of `size` items: true of all that have it.

    `before` is the place of the same item before each place (-1: none), `shared` tells the set's items. For one length, the distinct items of
    all windows are counted together: place j is the first of its item in the windows that begin after `before[j]`. A run is at least as long
    as one length and at most as long as the next, so its shared items are at most those of the longer window and its other items at least
    those of the shorter one.
    """
    n = len(before)
    places = np.arange(n)

    def distinct(of: np.ndarray, length: int) -> np.ndarray:
        first = np.maximum(before[of] + 1, of - length + 1)
        return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(of + 1, minlength=n + 1))[:n]

    ours, others = places[shared], places[~shared]
    low = max(1, int(np.ceil(size * minimum - 1e-9)))
    while low <= n:
        high = min(n, low + low // 10 + 1)
        other = distinct(others, low)[:n - low + 1]
        if other.min() > size / minimum - size + 1e-9:
            return False
        if (distinct(ours, high)[:n - low + 1] >= minimum * (size + other) - 1e-9).any():
            return True
        if high == n:
            return False
        low = high
    return False


def stretches(before: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Overlapping stretches of sequences with at most `2 * most` distinct items each; every run with at most `most` lies in one.

    The sequences are [begins, ends) of one array, none empty. A stretch ends where a distinct item too many comes; the next one begins where the
    first `most` distinct items of this one end, as a run that begins before has at most `most` in front of it. Stretches come in arrays, one of
    each sequence: (sequence, begin, end, stretch of each distinct item's first place, that place).
    """
    of = np.arange(len(begins))
    begins = begins.copy()
    while len(of):
        # Stretches that repeat much are read once more with longer windows, alone.
        length = 4 * most + 16
        todo, p = np.arange(len(of)), begins
        upto, after = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        parts = []
        while len(todo):
            step = max(1, (1 << 21) // length)
            again = []
            for low in range(0, len(todo), step):
                here = todo[low:low + step]
                start = p[here]
                left = np.minimum(ends[of[here]] - start, length)
                width = int(left.max())
                place = start[:, None] + np.arange(width)
                inside = np.arange(width) < left[:, None]
                new = (before[np.minimum(place, len(before) - 1)] < start[:, None]) & inside
                count = np.cumsum(new, axis=1, dtype=np.int32)
                whole = (count[:, -1] > 2 * most) | (start + left == ends[of[here]])
                upto[here] = ((count <= 2 * most) & inside).sum(1)
                after[here] = ((count <= most) & inside).sum(1)
                new &= (count <= 2 * most) & whole[:, None]
                at, column = np.nonzero(new)
                parts.append((here[at], start[at] + column))
                again.append(here[~whole])
            todo, length = np.concatenate(again), length * 4
        stretch, first = (np.concatenate([x[i] for x in parts]) for i in range(2))
        yield of, p.copy(), p + upto, stretch, first
        more = p + upto < ends[of]
        of, begins = of[more], (p + after)[more]


def _grams(words: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of rows of words as numbers, row by row: those known have theirs, others the next ones. Each word is cut once."""
    flat = words.flatten().dictionary_encode()
    numbers, counts, more = [], [], {}
    for word in flat.dictionary.to_pylist():
        padded = f"  {word} "
        grams = [padded[i:i + 3] for i in range(len(word) + 1)] if word else []
        numbers += [known[g] if g in known else more.setdefault(g, len(known) + len(more)) for g in grams]
        counts.append(len(grams))
    numbers, counts = np.array(numbers, np.int64), np.array(counts, np.int64)
    of = flat.indices.to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(counts[of])]) if len(of) else np.zeros(1, np.int64)
    first = (np.cumsum(counts) - counts)[of] if len(of) else of
    place = np.arange(upto[-1]) + np.repeat(first - upto[:-1], np.diff(upto))
    return numbers[place], upto[_bounds(words)]


def best_runs(before: np.ndarray, after: np.ndarray, shared: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int, minimum: float) -> np.ndarray:
    """The greatest similarity of a set of `size` items and any run of each stretch if it reaches `minimum`, else a lower value.

    The stretches lie one behind the other in the arrays: `before` and `after` are the places of the same item next to each place (-1 and the end
    of the array without one), `shared` tells the set's items. A run of the set's items alone that has them all is found first. Any other begins
    with a shared item and ends before that one comes again, so all runs together have at most as many places as the stretch, by `size`.
    """
    places = np.arange(len(before))
    stretch = np.repeat(np.arange(len(begins)), ends - begins)
    best = np.zeros(len(begins))
    left = np.zeros(len(before), bool)
    left[begins] = True
    right = np.zeros(len(before), bool)
    right[ends - 1] = True
    first = np.flatnonzero(shared & (left | ~np.roll(shared, 1)))
    last = np.flatnonzero(shared & (right | ~np.roll(shared, -1))) + 1
    long = last - first >= size
    if long.any():
        first, last = first[long], last[long]
        bounds = np.concatenate([[0], np.cumsum(last - first)])
        at = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], last - first)
        whole = np.add.reduceat((before[at] < np.repeat(first, last - first)).astype(np.int64), bounds[:-1]) == size
        best[stretch[first[whole]]] = 1.0
    enough = int(np.ceil(size * minimum - 1e-9))
    rank = np.cumsum(shared)
    start = np.flatnonzero(shared & (best[stretch] < 1) & (rank[ends - 1][stretch] - rank + 1 >= enough))
    span = np.minimum(after[start], ends[stretch[start]]) - start
    # A run of fewer places than that cannot have enough distinct ones.
    start, span = start[span >= enough], span[span >= enough]
    order = np.argsort(span, kind="stable")
    start, span = start[order], span[order]
    low = 0
    while low < len(start):
        high = min(len(start), low + max(1, RUN_CELLS // int(span[low])))
        while high > low + 1 and (high - low) * int(span[high - 1]) > 2 * RUN_CELLS:
            high = low + (high - low) // 2
        a, n = start[low:high, None], span[low:high, None]
        place = np.minimum(a + places[:int(n[-1, 0])], len(before) - 1)
        new = (before[place] < a) & (places[:place.shape[1]] < n)
        distinct = np.cumsum(new, axis=1, dtype=np.int32)
        own = np.cumsum(new & shared[place], axis=1, dtype=np.int32)
        np.maximum.at(best, stretch[start[low:high]], (own / (size + distinct - own)).max(1))
        low = high
    return best


def alike(asked: Asked, forms: np.ndarray, minimum: float) -> Callable:
    """A task that reads titles (id, words) and gives the pairs of which a run of trigrams has the similarity `minimum`: (query_id, form, id, similarity).

    A run that has it with a set of m items has at most m / minimum distinct ones, so long sequences are cut into `stretches` by the sizes of the
    sets. Of m items at most `m - needed` may be missing: dealt to one group more than that, one group is there as a whole. The groups are
    intersected as bit maps over a block's stretches; what is left is counted, and then compared run by run: long stretches only if `run_in_reach`
    says so. A pair may come more than once.
    """
    sizes = np.array([len(i) for i in asked.items], np.int64)
    by_size = np.floor(np.log(np.maximum(sizes, 1)) / np.log(STEP)).astype(np.int64)
    classes = [np.flatnonzero(by_size == c) for c in np.unique(by_size)]

    def look(ids: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> Iterator[tuple]:
        """Arrays (query, row, similarity) of the forms `of`, which are about as large."""
        width = len(asked.known)
        most = int(np.floor(sizes[of].max() / minimum + 1e-9))
        needed_here = int(asked.needed[of].min())
        vocabulary = np.full(width + 1, -1, np.int32)
        own = np.unique(np.concatenate([asked.items[q] for q in of]))
        vocabulary[own] = np.arange(len(own))
        number = vocabulary[at]
        row = np.repeat(np.arange(len(ids)), np.diff(bounds))
        first = before < bounds[row]
        distinct = np.bincount(row[first], minlength=len(ids))
        short = distinct <= 2 * most
        # A short sequence is one stretch: each of its items where it comes first.
        use = first & short[row] & (number >= 0)
        pieces = [(np.flatnonzero(short), bounds[:-1][short], bounds[1:][short])]
        shorts = np.cumsum(short) - 1
        pairs = [(shorts[row[use]], number[use])]
        count = int(short.sum())
        long = np.flatnonzero(~short)
        for sequence, low, high, stretch, place in stretches(before, bounds[:-1][long], bounds[1:][long], most):
            pieces.append((long[sequence], low, high))
            known = number[place] >= 0
            pairs.append((count + stretch[known], number[place[known]]))
            count += len(sequence)
        owner, begins, ends = (np.concatenate([p[i] for p in pieces]) for i in range(3))
        stretch, item = (np.concatenate([p[i] for p in pairs]) for i in range(2))
        held = np.bincount(stretch, minlength=count)
        # Stretches by their number of known items: a set looks only at those that have enough.
        order = np.argsort(held, kind="stable")
        order = order[np.searchsorted(held[order], needed_here):]
        rank = np.full(count, -1)
        rank[order] = np.arange(len(order))
        keep = rank[stretch] >= 0
        stretch, item = rank[stretch][keep], item[keep]
        held, owner, begins, ends = held[order], owner[order], begins[order], ends[order]
        step = max(64, BLOCK_BITS * 8 // max(1, len(own)) // 64 * 64)
        flag = np.zeros(width + 1, bool)
        for low in range(0, len(order), step):
            high = min(len(order), low + step)
            inside = (stretch >= low) & (stretch < high) if step < len(order) else slice(None)
            s, i = stretch[inside] - low, item[inside]
            maps = np.zeros((len(own), -(-(high - low) // 64)), np.uint64)
            # A stretch has an item once, so a sum sets the bit.
            np.add.at(maps.reshape(-1), i.astype(np.int64) * maps.shape[1] + (s >> 6), np.uint64(1) << (s & 63).astype(np.uint64))
            times = np.bincount(i, minlength=len(own))
            enough, seen = held[low:high], np.zeros(maps.shape[1] * 64, bool)
            for q in of:
                mine = vocabulary[asked.items[q]]
                often = times[mine]
                there = mine[often > 0]
                spare = len(there) - int(asked.needed[q])
                if spare < 0:
                    continue
                begin = int(np.searchsorted(enough, asked.needed[q])) >> 6
                if begin >= maps.shape[1]:
                    continue
                there = there[np.argsort(often[often > 0])]
                groups = spare + 1
                some = maps[there[:groups], begin:]
                if len(there) > groups:
                    more = there[groups:2 * groups]
                    some[:len(more)] &= maps[more, begin:]
                # Few places are left, which are followed one by one.
                group, word = np.nonzero(some)
                value = some[group, word]
                word += begin
                for level in range(2 * groups, len(there), groups):
                    more = there[level:level + groups]
                    inside = group < len(more)
                    value[inside] &= maps[more[group[inside]], word[inside]]
                    group, word, value = group[value != 0], word[value != 0], value[value != 0]
                if not len(word):
                    continue
                place = np.flatnonzero(np.unpackbits(value.view(np.uint8), bitorder="little"))
                seen[word[place >> 6] * 64 + (place & 63)] = True
                left = np.flatnonzero(seen)
                seen[left] = False
                shared = 0
                # Of the rarest `2 * spare + 1` no more than `spare` may be missing, either.
                for part, least in ((there[:spare + groups], groups), (there[spare + groups:], asked.needed[q])):
                    bit = np.uint64(1) << (left & 63).astype(np.uint64)
                    shared = shared + np.count_nonzero(maps[part[:, None], left >> 6] & bit, axis=0)
                    kept = shared >= min(least, asked.needed[q])
                    left, shared = left[kept], shared[kept]
                if not len(left):
                    continue
                flag[asked.items[q]] = True
                chosen = low + left
                lengths = ends[chosen] - begins[chosen]
                if lengths.max() > LONG:
                    reached = [
                        n <= LONG or run_in_reach(np.maximum(before[a:a + n] - a, -1), flag[at[a:a + n]], sizes[q], minimum)
                        for a, n in zip(begins[chosen], lengths)
                    ]
                    chosen = chosen[np.array(reached)]
                part = 0
                while part < len(chosen):
                    upto = np.cumsum(ends[chosen[part:]] - begins[chosen[part:]])
                    some = chosen[part:part + max(1, int(np.searchsorted(upto, RUN_CELLS)))]
                    part += len(some)
                    lengths = ends[some] - begins[some]
                    high_ = np.cumsum(lengths)
                    low_ = high_ - lengths
                    shift = np.repeat(begins[some] - low_, lengths)
                    place = np.arange(high_[-1]) + shift
                    similarity = best_runs(before[place] - shift, after[place] - shift, flag[at[place]], low_, high_, int(sizes[q]), minimum)
                    found = similarity >= minimum
                    if found.any():
                        yield np.full(np.count_nonzero(found), q), owner[some[found]], similarity[found]
                flag[asked.items[q]] = False

    def read(batches):
        def block():
            ids = np.concatenate([h[0] for h in held])
            shift = np.cumsum([0, *[len(h[1]) for h in held]])
            at = np.concatenate([h[1] for h in held])
            before = np.concatenate([np.where(h[2] >= 0, h[2] + s, -1) for h, s in zip(held, shift)])
            after = np.concatenate([h[3] + s for h, s in zip(held, shift)])
            bounds = np.concatenate([[0], *[h[4][1:] + s for h, s in zip(held, shift)]])
            for of in classes:
                parts = list(look(ids, at, before, after, bounds, of))
                if parts:
                    q, r, similarity = (np.concatenate([p[i] for p in parts]) for i in range(3))
                    yield pa.RecordBatch.from_arrays([
                        asked.ids.take(pa.array(q)), pa.array(forms[q].astype(np.int32)), pa.array(ids[r], mask=ids[r] == NO_ID), pa.array(similarity),
                    ], ["query_id", "form", "id", "similarity"])

        held: list[tuple] = []
        known = {g: i for i, g in enumerate(asked.known.to_pylist())}
        for batch in batches:
            if not len(batch) or not len(asked.items):
                continue
            number, bounds = _grams(batch.column("words"), known)
            at = np.minimum(number, len(asked.known))
            row = np.repeat(np.arange(len(batch), dtype=np.int64), np.diff(bounds))
            key = row * (int(number.max(initial=0)) + 1) + number
            order = np.argsort(key, kind="stable")
            same = np.flatnonzero(np.diff(key[order]) == 0)
            before = np.full(len(key), -1, np.int64)
            before[order[same + 1]] = order[same]
            after = np.repeat(bounds[1:], np.diff(bounds))
            after[order[same]] = order[same + 1]
            held.append((batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False), at, before, after, bounds))
            if sum(len(h[0]) for h in held) >= BLOCK_TITLES or sum(len(h[1]) for h in held) >= BLOCK_GRAMS:
                yield from block()
                held = []
        if held:
            yield from block()

    return read
