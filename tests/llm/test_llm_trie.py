"""The prefix trie against one that is built in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string, conv string, id string, next string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items() if c is not None}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + v[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(
        (min(v), len(k), min(members[k[:-1]]) if k else -1, len(v), len(kids[k]), leaves[k], saved[k], digest(k)) for k, v in members.items()
    )


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def given(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    return df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_given_conversations_through_many_rounds(given):
    df, rows = given
    assert got(trie.prefix_trie(df, block=32, finish=20)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "a"), (0, 2, "assistant", "b"), (0, 3, "user", "été 漢字😀"), (0, 3, "user", "tie"), (0, 3, "user", "tie"), (0, None, None, None),
        (1, 1, "user", "a"), (1, None, "", ""), (2, 5, "user", None), (7, 1, "user", "only"), (107, 1, "x", "no head"), (107, 9, "x", "w " * 20_000),
        (None, 1, "user", "no conversation"), (None, None, None, None), (101, 4, "r", "t"), (208, 0, "user", "a"), (301, 0, "user", "a"),
        *[(c, t, "user", f"same {t}") for c in range(400, 470) for t in range(4)],
    ]
    assert got(trie.prefix_trie(frame(spark, rows))) == brute(rows)
    assert got(trie.prefix_trie(frame(spark, rows), block=4, finish=3)) == brute(rows)


def test_a_long_conversation_and_a_wide_node(spark):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(3000)] + [(c, 0, "system", "the same") for c in range(1000, 2500)]
    rows += [(c, 1, "user", f"unlike {c}") for c in range(1000, 2500, 2)]
    assert got(trie.prefix_trie(frame(spark, rows), block=128, finish=100)) == brute(rows)


def test_empty(spark):
    assert got(trie.prefix_trie(frame(spark, []))) == []
    assert got(trie.prefix_trie(frame(spark, [(None, 1, "user", "a")]))) == []


def test_hash_of_a_group_in_many_texts(spark):
    ends = spark.range(5000).select(F.when(F.col("id") < 4900, 0).otherwise(F.col("id")).alias("k"), ((F.col("id") * 7919) % 5000 - 30).alias("conv"))
    want = defaultdict(list)
    for r in ends.collect():
        want[r.k].append(r.conv)
    found = {r.k: r.ends_sha256 for r in trie.hashed(ends, ["k"], chunk=64).collect()}
    assert found == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_sums_before_on_a_shuffled_list(spark):
    ids = list(range(0, 4000, 2))
    order = sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows = [(i, order[p + 1] if p + 1 < len(order) else None, i % 5, i) for p, i in enumerate(order)]
    listed = spark.createDataFrame(rows, "id long, next long, leaves long, saved long")
    found = {r.id: (r.leaves, r.saved) for r in trie.sums_before(listed, order[0], block=50, finish=30).collect()}
    a = b = 0
    for i in order:
        assert found[i] == (a, b)
        a, b = a + i % 5, b + i
