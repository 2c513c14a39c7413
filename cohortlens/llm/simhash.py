"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components.

**Candidates.** Two 64-bit fingerprints that differ in at most 2 bits agree on at least two of four 16-bit blocks. Each of the
six pairs of blocks is a mask, and `fingerprint & mask` names a shard: every link lies inside a shard. A shard builds a BK-tree
(children keyed by their Hamming distance to the parent) and each fingerprint searches it, following only the edges whose
distance is within the radius. Trees are built where their shard is, not broadcast: together they grow with the data.

**Hot shards.** A shard of more than `tree_size` fingerprints is cut again by the same rule on the bits that its mask leaves
free: 32, then 16, then 8 free bits, where at most 256 distinct fingerprints exist. Nothing is dropped or capped.

**Output size.** A tree reports a spanning forest of its links, so copies and dense groups do not become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField

from ..operators.ordering import literal_table, top_per_group
from ..session import pinned

RADIUS = 2
SEED = 42
SHINGLE = 3
TREE_SIZE = 2048


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; no word: zero."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits on 20 and 09-0D only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start:start + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """`key`, `fingerprint` (a signed long) and the long columns `more` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fingerprint", *more])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "fingerprint", *more)))


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints, found with a BK-tree."""
    links: list[tuple[int, int]] = []
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    children: list[dict[int, int]] = [{}]
    for new in range(1, len(values)):
        value, todo = values[new], [0]
        children.append({})
        while todo:
            at = todo.pop()
            distance = ((values[at] ^ value) & 0xFFFFFFFFFFFFFFFF).bit_count()
            if distance <= radius and find(at) != find(new):
                root[find(new)] = find(at)
                links.append((values[at], value))
            todo += [child for edge, child in children[at].items() if abs(edge - distance) <= radius]
        at = 0
        while True:
            distance = ((values[at] ^ value) & 0xFFFFFFFFFFFFFFFF).bit_count()
            if distance not in children[at]:
                children[at][distance] = new
                break
            at = children[at][distance]
    return links


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def masks(levels: int = 3) -> list[dict[int, list[int]]]:
    """Per level the masks that refine each mask of the level before: two of four equal parts of its free bits are added."""
    found: list[dict[int, list[int]]] = []
    parents = [(0, list(range(64)))]
    for _ in range(levels):
        level: dict[int, list[int]] = {}
        following = []
        for mask, free in parents:
            size = len(free) // 4
            parts = [free[i * size:(i + 1) * size] for i in range(4)]
            for pair in combinations(range(4), 2):
                child = mask | sum(1 << b for p in pair for b in parts[p])
                level.setdefault(mask, []).append(child)
                following.append((child, [b for p in range(4) if p not in pair for b in parts[p]]))
        found.append(level)
        parents = list({m: (m, f) for m, f in following}.values())
    return found


def links(distinct: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (`a`, `b`) that connect the distinct `fingerprint`s of a written table as all links would; some may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(values: list[int]) -> pa.RecordBatch:
            pairs = tree_links(values)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        shard, held = None, []
        for batch in batches:  # rows come sorted by shard; a shard may go on in the next batch
            for mask, part, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (mask, part) != shard:
                    if len(held) > 1:
                        yield of(held)
                    shard, held = (mask, part), []
                held.append(value)
        if len(held) > 1:
            yield of(held)

    spark = distinct.sparkSession
    found, left = [], distinct.select(F.lit(0).cast("long").alias("mask"), "fingerprint")
    for number, level in enumerate(masks()):
        if number == 0:
            children = F.array(*[F.lit(_signed(child)) for child in level[0]])
            masked = left.select(F.explode(children).alias("child"), "fingerprint")
        else:
            table = [(_signed(m), _signed(child)) for m, each in level.items() for child in each]
            masked = left.join(literal_table(spark, "mask long, child long", table), "mask")
        shards = masked.select(
            F.col("child").alias("mask"), F.col("fingerprint").bitwiseAND(F.col("child")).alias("part"), "fingerprint"
        )
        sizes = shards.groupBy("mask", "part").agg(F.count("*").alias("n")).filter("n > 1")
        sized = pinned(shards.join(sizes, ["mask", "part"]))
        last = number == 2
        here = sized if last else sized.filter(F.col("n") <= tree_size)
        rows = here.select("mask", "part", "fingerprint")
        if not last:
            # A shard fits one tree here, so its rows may meet in a task.
            rows = rows.repartition("mask", "part")
        else:
            rows = rows.distinct().repartition("mask", "part")
        found.append(rows.sortWithinPartitions("mask", "part").mapInArrow(run, "a long, b long"))
        if last:
            break
        left = sized.filter(F.col("n") > tree_size).select("mask", "fingerprint").distinct()
        if left.isEmpty():
            break
    union = found[0]
    for each in found[1:]:
        union = union.unionByName(each)
    return union


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`node` and `root` (the smallest node of its component) for every node of an edge table (`a`, `b`).

    Alternates large-star and small-star steps; each round is written, so its lineage is one join deep. Only minima per node are
    aggregated, so a node with very many links is no group in one task.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row.n, row.s

    edges = pinned(oriented(edges))
    now = state(edges)
    for _ in range(rounds):
        if now[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = oriented(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select("b", "m", "a")
        stars = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = pinned(oriented(stars))
        before, now = now, state(edges)
        if now == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _groups(marks: DataFrame, tree_size: int) -> DataFrame:
    """`mark`, `root` (the smallest fingerprint of the component, which names it) and `component_id` for each fingerprint of a written table."""
    distinct = pinned(marks.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = pinned(components(links(distinct, tree_size)))
    linked = roots.join(distinct, roots.node == distinct.fingerprint).select("root", "fingerprint", "least")
    whole = linked.groupBy("root").agg(F.min("least").alias("component"))
    joined = linked.select("root", "fingerprint").join(whole, "root").select("fingerprint", "root", "component")
    # Written, so that the last join has a plain shuffle on either side, which Spark can split where a fingerprint is hot.
    return pinned(distinct.join(joined, "fingerprint", "left").select(
        F.col("fingerprint").alias("mark"), F.coalesce("root", "fingerprint").alias("root"), F.coalesce("component", "least").alias("component_id")
    ))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", tree_size: int = TREE_SIZE) -> DataFrame:
    """`key`, `fingerprint` (16 hex digits) and `component_id` (the smallest key reachable) for each row.

    Null and blank texts have fingerprint zero and are linked like others. Null keys come after all others: a component with no
    other key has component null. Repeated rows give repeated results; an empty table gives an empty one. Other columns are ignored.
    """
    marks = pinned(fingerprints(docs, key, text))
    known = _groups(marks, tree_size)
    return marks.join(known, marks.fingerprint == known.mark).select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def _hash(row: Column, fields: list[StructField]) -> Column:
    """A hash of all columns; maps, which Spark does not hash, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(row[f.name])) if "map<" in f.dataType.simpleString() else row[f.name] for f in fields])


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each component: that of the smallest key, nulls last, then the smallest hash of the text, then of the row.

    Keys may be null or repeat: a component is known by its root fingerprint, a row by its key and two hashes of its text. All columns stay.
    """
    name = ["__none", "__key", "__hash", "__hash2"]
    of_key = [F.col("id").isNull().alias("__none"), F.coalesce("id", F.lit(0).cast("long")).alias("__key")]
    of_text = [F.xxhash64("text").alias("__hash"), F.xxhash64(F.lit(1), "text").alias("__hash2")]
    short = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    marks = pinned(fingerprints(short.select("id", "text", *of_text), "id", "text", name[2:]))
    known = _groups(marks, TREE_SIZE)
    found = marks.join(known, marks.fingerprint == known.mark).select("root", F.struct(*of_key, *name[2:]).alias("row"))
    stay = found.groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    whole = docs.select(F.struct("*").alias("__row"))
    rows = whole.select("__row", F.col("__row")[key].cast("long").alias("id"), F.col("__row")[text].cast("string").alias("text"))
    # Equal keys and texts: one row per task is left before the shuffle, which the join then shares.
    single = top_per_group(rows.select("__row", *of_key, *of_text), name, [_hash(F.col("__row"), docs.schema.fields)])
    return single.join(stay, name, "left_semi").select("__row.*")
