"""Rendezvous shards: weights, movement and slots."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import common, sharding


def test_documents(documents):
    got = sharding.sharded(documents).collect()
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "key"
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    for shard, number in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(number))


def test_odd_rows(odd, empty):
    got = sharding.sharded(odd).collect()
    assert len(got) == odd.count() and sharding.sharded(empty).count() == 0
    slots = Counter((r.shard, r.slot) for r in got)
    assert max(slots.values()) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert {r.size for r in got if r.doc_id in (3, 4)} == {16}


def test_few_rows_move(spark):
    rows = spark.range(4000).withColumn("other", F.lit(None).cast("string"))
    placed = sharding.assign(rows, ["id", "other"], [1, 2, 1, 0], "a")
    placed = sharding.assign(placed, ["id", "other"], [1, 2, 1, 0, 1], "b")
    placed = sharding.assign(placed, ["id", "other"], [1, 2.5, 1, 0], "c").collect()
    counts = Counter(r.a for r in placed)
    assert set(counts) == {0, 1, 2} and abs(counts[1] - 2000) < 150 and abs(counts[0] - 1000) < 120
    assert all(r.b in (r.a, 4) for r in placed) and abs(sum(r.b == 4 for r in placed) - 800) < 120
    assert all(r.c in (r.a, 1) for r in placed)
    for bad in ([], [0], [-1, 2]):
        with pytest.raises(ValueError):
            sharding.assign(rows, ["id"], bad)


def test_places_in_a_class_of_equal_rows(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("a"), (F.col("id") % 5).alias("b"))
    got = common.place_in_class(rows, "k", ("a", "b"), "place").collect()
    by_class = {}
    for r in got:
        by_class.setdefault(r.k, []).append(r)
    for mine in by_class.values():
        mine.sort(key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(len(mine)))
        order = [(r.a is not None, r.a or 0, r.b) for r in mine]
        assert order == sorted(order)
    assert len(got) == 4000


def test_a_third_of_the_rows_without_a_key(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    got = sharding.sharded(docs).collect()
    for shard, number in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(number))
    assert len(got) == 3000 and len({r.shard for r in got if r.doc_id is None}) == 1


def test_copies_of_a_counted_table(spark):
    counted = spark.createDataFrame([("a", 1), ("b", 10_000), ("c", 4096), ("d", 4097)], "k string, n long")
    got = Counter(r.k for r in common.each_copy(counted, "n", "copy").collect())
    assert got == {"a": 1, "b": 10_000, "c": 4096, "d": 4097}
    places = sorted(r.copy for r in common.each_copy(counted, "n", "copy").filter("k = 'd'").collect())
    assert places == list(range(4097))
