"""Codes from metric trees against plain assignment."""

import hashlib
import math

import numpy as np

from cohortlens.llm import partcodes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, part string, entry string, points string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)


def brute(rows):
    count = {}
    for _, v, _ in rows:
        if v and len(v) % 4 == 0:
            count[len(v)] = count.get(len(v), 0) + 1
    length = max(count, key=lambda n: (count[n], n), default=0)
    kept = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 1024).astype(np.int64), lab) for i, v, lab in rows
            if v and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v, _ in kept:
        key = (i is None, i or 0)
        least[key] = min(least.get(key, tuple(v)), tuple(v))
    start = np.array([v for _, v in sorted(least.items())][:256], np.int64).reshape(-1, length)
    parts = np.split(np.array([v for _, v, _ in kept]), 4, axis=1)
    books = [b.copy() for b in np.split(start, 4, axis=1)]
    nearest = lambda p, b: ((p[:, None] - b[None]) ** 2).sum(2).argmin(1)
    for _ in range(4):
        for p, b in zip(parts, books):
            of = nearest(p, b)
            for e in set(of.tolist()):
                b[e] = p[of == e].sum(0) // (of == e).sum()
    codes = [nearest(p, b) for p, b in zip(parts, books)]
    error = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(parts, books, codes)).tolist()
    by_label = {}
    for (_, _, lab), e in zip(kept, error):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[n]:02x}" for c in codes), error[n], by_label[lab], digest) for n, (i, _, lab) in enumerate(kept)), key=str)


def got(df):
    assert df.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 3
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.05).astype(np.float32)


def test_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), i % 3 if i % 4 else None) for i, v in enumerate(rng.normal(size=(400, 8)).round(2).astype(np.float32))]
    rows += [(5, rows[5][1], 1), (5, rows[9][1], 1), (None, rows[3][1], None), (None, rows[4][1], 2), (-7, [0.0] * 8, 0), (500, [0.0] * 8, 0)]
    rows += [(600, None, 1), (601, [], 1), (602, [1.0, None] * 4, 1), (603, [float("nan")] * 8, 1), (604, [float("-inf")] * 8, 1), (605, [1.0] * 7, 1), (606, [1.0] * 4, 1)]
    rows += [(700 + i, [0.5] * 8, 9) for i in range(250)]  # many copies
    rows += [(1000, [3000.5] * 8, 9), (1001, [-3000.5] * 8, 9)]
    assert got(partcodes.coded(frame(spark, rows), block=100)) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(3, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.1, 0.2, 0.3, 0.4], None), (2, [-0.1] * 4, None)]
    assert got(partcodes.coded(frame(spark, rows))) == brute(rows)
    assert got(partcodes.coded(frame(spark, []))) == []
    assert got(partcodes.coded(frame(spark, [(1, None, 1), (2, [1.0], 1), (3, [float("nan")] * 4, None)]))) == []


def test_balls_hold_their_points():
    points = np.floor(clustered(3000, 4, 1) * 1024).astype(np.int64)
    held = partcodes.tree(points)
    assert sorted(held["order"].tolist()) == list(range(3000))
    for (start, end, left, right), radius, total in zip(held["balls"], held["radius"], held["sum"]):
        mine = points[held["order"][start:end]]
        assert (mine.sum(0) == total).all()
        assert np.sqrt(((mine - total / (end - start)) ** 2).sum(1)).max() <= radius * (1 + 1e-12)
        if left >= 0:
            assert held["balls"][left][0] == start and held["balls"][left][1] == held["balls"][right][0] and held["balls"][right][1] == end


def test_most_points_are_owned_through_their_balls():
    points = np.floor(clustered(4000, 16, 2) * 1024).astype(np.int64)
    entries = points[:64].copy()
    owner, sums, count, whole = partcodes.owners(points, partcodes.tree(points), partcodes.Book(entries))
    plain = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (owner == plain).all() and count.tolist() == np.bincount(plain, minlength=64).tolist()
    assert all((sums[e] == points[plain == e].sum(0)).all() for e in range(64))
    few = np.floor(clustered(12, 16, 2)[:1] * 1024).astype(np.int64)
    far = np.concatenate([few, few + 50_000])
    assert partcodes.owners(points, partcodes.tree(points), partcodes.Book(far))[3] == len(points)


def test_large_integers_are_compared_exactly():
    rng = np.random.default_rng(3)
    points, entries = rng.integers(-(1 << 27), 1 << 27, (50, 16)), rng.integers(-(1 << 27), 1 << 27, (9, 16))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in points]
    assert partcodes.squares(points, entries).tolist() == want
