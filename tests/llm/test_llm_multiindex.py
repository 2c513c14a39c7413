"""The inverted multi-index against brute force."""

import itertools
import math

import numpy as np
import pytest

from cohortlens.llm import multiindex
from cohortlens.llm.queries import op11_inverted_multiindex

SCHEMA = "vec_id long, embedding array<float>, cell string, query string, ids string, block string, best string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 5) for i, v in rows], SCHEMA)


def sound(rows):
    length = {}
    for _, v in rows:
        if v:
            length[len(v)] = length.get(len(v), 0) + 1
    common = max(length, key=lambda n: (length[n], n), default=0)
    fine = lambda v: v and len(v) == common and all(x is not None and math.isfinite(x) for x in v) and any(v)
    return [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if fine(v)]


def brute(rows, every=100, k=10):
    """Sorted (query, rank, id, score) of every row whose id is a multiple; a row is not its own neighbour, whatever its id."""
    rows, found = sound(rows), []
    for at, (i, v) in enumerate(rows):
        if i is None or i % every:
            continue
        others = [(float(np.sqrt(((w - v) ** 2).sum())), j is None, j or 0) for place, (j, w) in enumerate(rows) if place != at]
        found += [(i, r, None if none else j, d) for r, (d, none, j) in enumerate(sorted(others)[:k], start=1)]
    return sorted(found, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pairs_come_by_rising_sum_and_once():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 4.0, 0.5, 1.0])
    pairs = list(multiindex.pairs_by_distance(a, b))
    assert sorted(pairs) == sorted(itertools.product(range(3), range(4)))
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums)


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    true = brute(rows)
    mine = op11_inverted_multiindex(spark, folder).collect()
    by_pair = {(q, i): d for q, _, i, d in true}
    hits = sum((r.query_id, r.vec_id) in by_pair for r in mine)
    assert len(mine) == len(true) and hits >= 0.9 * len(true)
    vectors = dict(sound(rows))
    for r in mine:
        assert r.score == pytest.approx(float(np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())), abs=1e-12)
    ranks = {}
    for r in sorted(mine, key=lambda r: (r.query_id, r.rank)):
        ranks.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert all(len(x) == 10 and x == sorted(x) for x in ranks.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).round(1).tolist()) for i in range(0, 1200, 25)]
    rows += [(None, [0.5] * 5), (None, [0.5] * 5), (100, rows[3][1]), (100, rows[4][1]), (200, rows[8][1]), (7, rows[8][1]), (9, rows[8][1]), (-100, [1.0] * 5)]
    rows += [(300, None), (301, []), (400, [0.0] * 5), (500, [1.0, None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 5), (700, [float("inf")] * 5), (800, [1.0, 2.0])]
    whole = multiindex.nearest(frame(spark, rows), budget=10**9, block=8, block_queries=2)
    assert whole.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert got(whole) == brute(rows)


def test_copies_hold_a_third_of_the_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 50, [0.25, -1.0, 0.5, 2.0]) for i in range(150)] + [(i * 50 + 1 + 49 * (i % 3 == 0), rng.normal(size=4).tolist()) for i in range(300)]
    assert got(multiindex.nearest(frame(spark, rows), budget=10**9, block=32, block_queries=3)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert got(multiindex.nearest(frame(spark, rows))) == brute(rows)
    assert multiindex.nearest(frame(spark, rows[:1])).collect() == []
    assert multiindex.nearest(frame(spark, [])).collect() == []
    assert multiindex.nearest(frame(spark, [(1, None), (2, [0.0])])).collect() == []
    assert got(multiindex.nearest(frame(spark, [(0, [1.0]), (1, [3.0]), (2, [2.5])]))) == [(0, 1, 2, 1.5), (0, 2, 1, 2.0)]
