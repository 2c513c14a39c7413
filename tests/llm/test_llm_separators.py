"""Token files against tokenizing each text, and hand-made files."""

import numpy as np
import pytest
import sentencepiece

from cohortlens.llm import separators


def found(df):
    return {(r.file, r.doc_no): (r.start, r.n_tokens, r.ended) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_counts_follow_the_texts(spark, odd, tmp_path, block):
    path = str(tmp_path / "t")
    some = odd.filter("doc_id is null or doc_id not in (6, 7)").coalesce(1)
    separators.write_token_files(some, path)
    encode = sentencepiece.SentencePieceProcessor(model_proto=separators.vocabulary()).encode
    sizes = [len(encode(r.text or "")) for r in some.collect()]
    rows = sorted(separators.token_counts(spark, path, block_tokens=block).collect(), key=lambda r: r.doc_no)
    assert [r.n_tokens for r in rows] == sizes
    assert [r.doc_no for r in rows] == list(range(len(sizes)))
    assert [r.start for r in rows] == [sum(sizes[:i]) + i for i in range(len(sizes))]
    assert all(r.ended for r in rows)


@pytest.mark.parametrize("block", [1, 2, 4, 5, 64])
def test_boundaries_across_blocks_and_groups(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(separators, "GROUP_BLOCKS", 2)
    files = {"a": [5, 2, 2, 7, 8, 9, 10, 11, 12, 13, 2, 3], "b": [2], "c": [9, 9, 9, 9, 9, 9, 9, 9, 9], "d": [], "e": [514, 512, 2, 2]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = {(k[0].rsplit("/", 1)[1], k[1]): v for k, v in found(separators.token_counts(spark, str(tmp_path), block_tokens=block)).items()}
    wanted = {}
    for name, ids in files.items():
        start = doc = 0
        for i, token in enumerate(ids):
            if token == 2:
                wanted[name, doc] = (start, i - start, True)
                start, doc = i + 1, doc + 1
        if start < len(ids):
            wanted[name, doc] = (start, len(ids) - start, False)
    assert got == wanted


def test_odd_length_and_empty_table(spark, empty, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f").write_bytes(b"abc")
    with pytest.raises(ValueError):
        separators.token_counts(spark, str(tmp_path / "x"))
    assert separators.corpus_token_counts(empty).count() == 0


def test_a_separator_in_a_text_is_text(spark):
    docs = spark.createDataFrame([("a </s> b",), ("\x02\x00",)], "text string")
    assert separators.corpus_token_counts(docs).count() == 2
