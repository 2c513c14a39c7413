"""Bins against a search over all open bins, and the rules that any packing keeps."""

import re
from collections import Counter, defaultdict

from hypothesis import given, settings, strategies as st

from cohortlens.llm import packing


def naive(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [(left, i) for i, (left, a, b) in enumerate(bins) if left >= size and left > 0 and source not in a and cluster not in b]
        if fits:
            _, at = min(fits)
        else:
            at = len(bins)
            bins.append([capacity, set(), set()])
        out.append((at, capacity - bins[at][0]))
        bins[at][0] -= size
        bins[at][1].add(source)
        bins[at][2].add(cluster)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from("abcd"), st.integers(0, 6)), max_size=60), st.integers(20, 40))
def test_tightest_compatible_bin(items, capacity):
    columns = list(zip(*items)) if items else ([], [], [])
    bins, offsets = packing.pack(*columns, capacity)
    assert list(zip(bins, offsets)) == naive(*columns, capacity)


def check(docs, capacity, shard_items):
    rows = packing.packed(docs, capacity=capacity, shard_items=shard_items).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.shard, r.bin].append(r)
    for found in held.values():
        assert sum(r.size for r in found) <= capacity
        assert max(Counter(r.source for r in found).values()) == 1
        assert max(Counter(r.cluster for r in found).values()) == 1
        at = 0
        for r in sorted(found, key=lambda r: (r.offset, r.size)):
            assert r.offset == at
            at += r.size
    pieces = Counter((r.doc_id, r.start, r.size) for r in rows)
    wanted = Counter()
    for d in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        wanted.update((d.doc_id, s, min(capacity, n - s)) for s in range(0, max(n, 1), capacity))
    assert pieces == wanted
    return rows


def test_documents(documents):
    one = check(documents, 256, 1 << 20)
    many = check(documents, 256, 50)
    assert {r.shard for r in one} == {0} and len({r.shard for r in many}) > 3
    again = packing.packed(documents.repartition(5), capacity=256, shard_items=1 << 20).collect()
    assert sorted(map(str, again)) == sorted(map(str, one))


def test_odd_rows(odd, empty):
    check(odd, 100, 1 << 20)
    check(odd, 1000, 3)
    assert packing.packed(empty).count() == 0


def test_equal_rows_are_spread_over_shards(spark):
    """12,000 equal rows: no shard has many more items than its share, and the packing is quick."""
    docs = spark.range(12_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'two words' AS text", "'a' AS source")
    rows = packing.packed(docs, shard_items=1000).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 12_000 and len(sizes) == 12 and max(sizes.values()) < 1200
    assert len({(r.shard, r.bin) for r in rows}) == 12_000, "copies share no bin"
