"""Fingerprints bit by bit, links against all pairs, components against a search."""

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def slow_components(rows):
    """rows: (key, fingerprint). The smallest key reachable for each row."""
    marks = sorted({m for _, m in rows})
    near = {m: [] for m in marks}
    for a, b in combinations(marks, 2):
        if (a ^ b).bit_count() <= 2:
            near[a].append(b)
            near[b].append(a)
    label = {}
    for m in marks:
        if m in label:
            continue
        todo, group = [m], {m}
        while todo:
            for other in near[todo.pop()]:
                if other not in group:
                    group.add(other)
                    todo.append(other)
        keys = [k for k, mark in rows if mark in group and k is not None]
        for g in group:
            label[g] = min(keys, default=None)
    return [label[m] for _, m in rows]


def check(docs, **more):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, **more).collect()), key=str)
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    wanted = sorted(((k, f"{m:016x}", c) for (k, m), c in zip(rows, slow_components(rows))), key=str)
    assert got == wanted


def test_documents_against_all_pairs(documents):
    check(documents)


def test_odd_rows(odd, empty):
    check(odd)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tree_size", [2, 40])
def test_links_of_dense_and_hot_shards(spark, tree_size, rows):
    """Fingerprints around a few centres, so that shards must be cut again down to the last level."""
    random.seed(3)
    marks = set()
    for centre in (0, (1 << 64) - 1, 0x0123456789ABCDEF):
        for _ in range(150):
            value = centre
            for _ in range(random.randint(0, 4)):
                value ^= 1 << random.choice([0, 1, 2, 3, 17, 18, 40, 63])
            marks.add(value)
    marks |= {random.getrandbits(64) for _ in range(50)}
    signed = {m: m - (1 << 64) if m >> 63 else m for m in marks}
    distinct = spark.createDataFrame([(s,) for s in signed.values()], "fingerprint long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct, tree_size)).collect()}
    wanted = slow_components([(signed[m], m) for m in sorted(marks)])
    for m, least in zip(sorted(marks), wanted):
        assert roots.get(signed[m], signed[m]) == least


def test_masks_cover_every_pair_of_near_fingerprints():
    for level in simhash.masks():
        for parent, children in level.items():
            free = [b for b in range(64) if not parent >> b & 1]
            for pair in random.sample(list(combinations(free, 2)), min(60, len(free) * (len(free) - 1) // 2)):
                assert any(not any(c >> b & 1 for b in pair) for c in children)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 60)]
    both = spark.createDataFrame(path + star + [(7, 7), (500, 400), (400, 500)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(both).collect()}
    assert roots == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(60)}, 400: 400, 500: 400}


def test_one_of_each_group_stays(odd, documents):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "6", "8", "None", "9", "10", "11"])
    groups = simhash.near_duplicates(documents).collect()
    assert sorted(r.doc_id for r in simhash.keep_one(documents).collect()) == sorted({r.component_id for r in groups})


def test_groups_with_null_and_repeated_keys_each_keep_one(spark):
    one, two, three, four = ("alpha beta gamma delta", "red green blue black", "north south east west", "iron gold zinc lead")
    rows = [
        (None, one, "x"), (None, two, "x"), (None, two, "y"),  # unlike texts without a key
        (5, three, "x"), (5, four, "x"), (5, four, "x"), (9, four.upper(), "x"),  # one key, two texts; one has a copy under a larger key
        (3, one + " more words", "x"), (None, one + " more words", "x"),  # the keyed row stands for its group
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("tags", F.create_map(F.lit("a"), F.col("source")))
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(None, one), (None, two), (5, three), (5, four), (3, one + " more words")], key=str)
