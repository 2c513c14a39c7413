"""Signatures and edited texts against plain Python."""

import hashlib
import struct
from collections import Counter

import pytest
import xxhash

from cohortlens.llm import orderhash


def h(*values, seed=42):
    """Spark's 64-bit hash of strings, 64-bit and 32-bit numbers, each seeded by the one before."""
    state = seed
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Int) else "<q", v)
        state = xxhash.xxh64(data, seed=state).intdigest()
    return state - (1 << 64) if state >> 63 else state


class Int(int):
    pass


def slow_sketch(text, pick=orderhash.PICK, bits=orderhash.BIN_BITS):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [h(w) for w in text.split(" ") if w]
    mers = [h2(a, b) for a, b in zip(words, words[1:])] if len(words) > 1 else [h(*map(int, words))] if words else []
    seen = Counter()
    every = []
    for i, m in enumerate(mers):
        every.append((h2(m, Int(seen[m])), i))
        seen[m] += 1
    out = []
    for b in range(1 << bits if every else 0):
        rotated = sorted(every, key=lambda e: (e[0] - ((b << 64 - bits) - (1 << 63))) % (1 << 64))
        first = sorted((i, g) for g, i in rotated[:pick])
        state = 42
        for _, g in first:
            state = xxhash.xxh64(struct.pack("<q", g), seed=state).intdigest()
        out.append(f"{b:02x}{state & 0xFFFFFFFF:08x}")
    return out


def h2(a, b):
    state = xxhash.xxh64(struct.pack("<q", a), seed=42).intdigest()
    state = xxhash.xxh64(struct.pack("<i" if isinstance(b, Int) else "<q", b), seed=state).intdigest()
    return state - (1 << 64) if state >> 63 else state


def slow_likeness(a, b):
    used = {t[:2] for t in a} | {t[:2] for t in b}
    return len(set(a) & set(b)) / len(used) if used else 1.0


def check(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    tie = lambda r: (-(1 << 70) if r[0] is None else r[0], [-x for x in (h(r[1]),)])
    rows.sort(key=tie, reverse=True)
    wanted = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        a, b, c = slow_sketch(text), slow_sketch(edited), slow_sketch(following)
        wanted.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), round(slow_likeness(a, b), 9), round(slow_likeness(a, c), 9)))
    got = [
        (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
        for r in orderhash.edited_pairs(docs).collect()
    ]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    return got


@pytest.mark.parametrize("bucket", [3, 50, 2000])
def test_documents(documents, bucket, monkeypatch):
    monkeypatch.setattr(orderhash, "BUCKET_ROWS", bucket)
    got = check(documents)
    mean = [sum(r[i] for r in got) / len(got) for i in (5, 6)]
    assert mean[0] > 0.2 > 10 * mean[1] or mean[0] > 3 * mean[1]


@pytest.mark.parametrize("bucket", [2, 2000])
def test_odd_rows(odd, empty, bucket, monkeypatch):
    monkeypatch.setattr(orderhash, "BUCKET_ROWS", bucket)
    check(odd)
    assert orderhash.edited_pairs(empty).count() == 0
    one = odd.filter("doc_id = 9")
    check(one)


def test_order_and_repeats_count(spark):
    a = " ".join(f"w{i}" for i in range(300))
    swapped = " ".join([f"w{i}" for i in range(150, 300)] + [f"w{i}" for i in range(150)])
    df = spark.createDataFrame([(1, a), (2, swapped), (3, a + " " + a), (4, a)], "i int, text string")
    s = {r.i: r.s for r in orderhash.sketch(df, "text", "s").collect()}
    assert s[1] == s[4] == slow_sketch(a)
    assert slow_likeness(s[1], s[2]) < 0.8 and slow_likeness(s[1], s[3]) < 0.8


@pytest.mark.parametrize("words", [30, 80, 300, 1000])
def test_moved_blocks_lower_the_likeness_at_any_length(spark, words):
    """Six blocks in another order keep nearly all 2-mers; the likeness must fall well below their share."""
    rows = []
    for i in range(20):
        text = [f"t{i}w{n}" for n in range(words)]
        size = -(-words // 6)
        parts = [text[a:a + size] for a in range(0, words, size)]
        rows.append((i, " ".join(text), " ".join(w for p in (3, 0, 5, 1, 4, 2) if p < len(parts) for w in parts[p])))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    near = orderhash.sketch(orderhash.sketch(df, "a", "s"), "b", "t").select(orderhash.likeness("s", "t")).collect()
    mean = sum(r[0] for r in near) / len(near)
    same = (words - 6) / (words + 4)  # share of 2-mers that both orders have
    assert mean < 0.75 * same


def test_hashes_are_not_rebuilt_for_their_bins(spark):
    """The bin is read off the sorted hashes: no pass over all of them adds it or takes it away again."""
    df = spark.createDataFrame([(1, "a b c a b")], "i int, text string")
    plan = orderhash.sketch(df, "text", "s")._jdf.queryExecution().analyzed().toString()
    assert "shiftright" in plan and "AS bin" not in plan and "named_struct(bin" not in plan and "struct(bin" not in plan
