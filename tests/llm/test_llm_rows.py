"""Rows against packing piece by piece, and the tokens put together again."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cohortlens.llm import rows


def naive(sizes, length):
    """Best-fit-decreasing one piece at a time: the residuals of the rows."""
    left = []
    for size in sorted((s for s in sizes if s), reverse=True):
        fits = [r for r in left if r >= size]
        if fits:
            left[left.index(min(fits))] -= size
        else:
            left.append(length - size)
    return sorted(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 50))
def test_plan_equals_packing_piece_by_piece(sizes, length):
    counts = {s: sizes.count(s) for s in set(sizes)}
    used = defaultdict(list)
    done = defaultdict(int)
    for size, rank, number, first, each, offset in rows.plan(counts, length):
        assert rank == done[size]
        done[size] += number
        for i in range(number):
            used[first + i // each].append((offset + i % each * size, size))
    assert dict(done) == counts
    for segments in used.values():
        at = 0
        for start, size in sorted(segments):
            assert start == at
            at += size
        assert at <= length
    assert sorted(length - sum(s for _, s in segments) for segments in used.values()) == naive(sizes, length)


def read_back(blocks):
    """Tokens per document (as a list, as keys may repeat), from the written matrices."""
    parts = defaultdict(list)
    for b in blocks:
        ids = np.frombuffer(b.ids, "<u2").reshape(b.n_rows, b.row_length)
        resets = np.frombuffer(b.position_ids, "<u2").reshape(b.n_rows, b.row_length)
        assert len(b.cu_seqlens) == b.n_rows
        for row, ends, docs, numbers in zip(range(b.n_rows), b.cu_seqlens, b.doc_ids, b.pieces):
            assert ends[0] == 0 and len(ends) == len(docs) + 1 == len(numbers) + 1
            for start, end, doc, piece in zip(ends, ends[1:], docs, numbers):
                assert resets[row, start:end].tolist() == list(range(end - start))
                parts[doc].append((piece, ids[row, start:end].tolist()))
            assert (ids[row, ends[-1]:] == rows.PADDING).all() and not resets[row, ends[-1]:].any()
    return parts


@pytest.mark.parametrize("shard_tokens", [500, 1 << 22])
def test_round_trip(documents, shard_tokens):
    parts = read_back(rows.packed_rows(documents, length=128, block_rows=5, shard_tokens=shard_tokens).collect())
    encode = rows.encoder(rows.vocabulary()).encode_ordinary
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert set(parts) == set(texts)
    for doc, pieces in parts.items():
        pieces.sort()
        assert [p for p, _ in pieces] == list(range(len(pieces)))
        assert [t for _, tokens in pieces for t in tokens] == encode(texts[doc])


def test_odd_rows(odd, empty):
    parts = read_back(rows.packed_rows(odd, length=64).collect())
    assert parts[3] == parts[4] == [(0, [])] and len(parts[1]) == 2 and len(parts[None]) == 2
    assert sum(len(t) for _, t in parts[6]) == sum(len(t) for _, t in parts[7]) > 9000
    assert rows.packed_rows(empty).count() == 0
    with pytest.raises(ValueError):
        rows.packed_rows(odd, length=1 << 16)
