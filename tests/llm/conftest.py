import pytest

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use themselves, as columns of the input.
CLASHES = ("id", "size", "hash", "shard", "slot", "bin", "piece", "at", "row", "fingerprint", "component_id", "target", "total", "kept", "n_words", "host", "part")


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest test tables."""
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and columns whose names clash."""
    long_text = " ".join(f"w{i % 4001}" for i in range(9000))
    rows = [
        (1, "one two three four", "en", "a"), (1, "one two three four", "en", "a"), (2, "ONE two\tthree  four\n", "en", "a"),
        (3, "", "en", "b"), (4, None, "de", "b"), (5, "   \n\t ", None, None), (6, long_text, "en", "c"), (7, long_text, "en", "c"),
        (8, "été ñandú 漢字 😀 one", "fr", None), (None, "a text without a key", "en", "a"), (None, None, None, None),
        (9, "x", "de", ""), (10, "a\nb\na\nb\n \n \na", "xx", "b"), (11, "tie tie tie tie tie tie", "en", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    records = [(*r, len(r[1]) if r[1] is not None else None, *(f"{c} value" for c in CLASHES)) for r in rows]
    return spark.createDataFrame(records, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
