"""Token counts of documents in flat token files that have no index.

A token file is a run of little-endian 16-bit ids; one id ends each document. Nothing says where documents are. Files are read in blocks of
a fixed number of ids, so a file may be of any size. A block is searched for the separator with one vector comparison. A document may begin
in an earlier block: a prefix scan over the blocks (the running maximum of the last separator's position and the running number of
separators) gives each block the start of its first document and the number of documents before it. The scan runs over block summaries in
two steps, inside groups of blocks and over the groups, so that a huge file is no group in one task.

Files are opened by URI through pyarrow's file systems (local or mounted, HDFS, S3, GCS), as Spark has no reader that splits such files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import pinned, work_dir

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: `</s>` of that vocabulary. As two bytes it is also valid UTF-8, so Spark's text writer can put it behind each record.
SEPARATOR = 2
BLOCK_TOKENS = 1 << 20
GROUP_BLOCKS = 1024


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def write_token_files(docs: DataFrame, path: str, text: str = "text", model: bytes | None = None, separator: int = SEPARATOR) -> None:
    """Writes the ids of every text and a separator behind each, one file per partition, in the order of the rows.

    A null or empty text is a separator alone. The files are committed by Spark's own writer, so lost tasks leave nothing.
    The separator's two bytes must be ASCII.
    """
    vocab = model or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_proto=vocab).encode
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for start in range(0, len(texts), 256):
                found = encode(texts[start:start + 256], num_threads=1)
                yield pa.RecordBatch.from_arrays([pa.array([np.array(f, "<u2").tobytes() for f in found], pa.binary())], names=["ids"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "ids binary")
    end = separator.to_bytes(2, "little").decode("ascii")
    rows.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end).text(path)


def block_list(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`file`, `block`, `n` of every block. Lists the files only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    if not files.filter(F.col("length") % 2 == 1).isEmpty():
        raise ValueError("a token file has an odd number of bytes")
    tokens = F.shiftright("length", 1)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((tokens - 1) / block_tokens))
    return files.filter("length > 0").select("path", tokens.alias("tokens"), F.explode(blocks).alias("block")).select(
        F.col("path").alias("file"), "block", F.least(F.lit(block_tokens), F.col("tokens") - F.col("block") * block_tokens).alias("n"),
    )


SUMMARY = "file string, block long, begin long, n long, found long, last long, ends array<int>"


def scan(blocks: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per block the positions of its separators (`ends`, in the block), their number and the place of the last one in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, block, n in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = fs.FileSystem.from_uri(file)
                begin = block * block_tokens
                with system.open_input_file(inner) as stream:
                    ids = np.frombuffer(stream.read_at(2 * n, 2 * begin), "<u2")
                if len(ids) != n:
                    raise OSError(f"{file} ended early")
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                last = begin + int(ends[-1]) if len(ends) else None
                values = [[file], [block], [begin], [n], [len(ends)], [last], [ends]]
                kinds = [pa.string()] + [pa.int64()] * 5 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in SUMMARY.split(", ")]
                )

    return blocks.select("file", "block", "n").repartition("file", "block").mapInArrow(run, SUMMARY)


def token_counts(spark: SparkSession, path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """`file`, `doc_no` (from 0 in the file), `start` (in tokens), `n_tokens`, `ended` of every document in the files below `path`.

    Two separators in a row enclose an empty document. Tokens behind the last separator are a document with `ended` false. An empty file
    has no document. Records of the same content are counted each.
    """
    summaries = pinned(scan(block_list(spark, path, block_tokens), separator, block_tokens))
    grouped = summaries.withColumn("part", F.floor(F.col("block") / GROUP_BLOCKS))
    narrow = grouped.select("file", "part", "block", "begin", "n", "found", "last")
    parts = narrow.groupBy("file", "part").agg(F.sum("found").alias("found"), F.max("last").alias("last"), F.max(F.col("begin") + F.col("n")).alias("size"))
    before_part = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    outer = parts.select(
        "file", "part", F.coalesce(F.sum("found").over(before_part), F.lit(0)).alias("docs_before"),
        F.max("last").over(before_part).alias("last_before"), F.max("size").over(W.partitionBy("file")).alias("tokens"),
    )
    before = W.partitionBy("file", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    joined = grouped.join(outer, ["file", "part"])
    placed = joined.withColumn("doc", F.col("docs_before") + F.coalesce(F.sum("found").over(before), F.lit(0))).withColumn(
        "start", F.coalesce(F.greatest("last_before", F.max("last").over(before)), F.lit(-1)) + 1
    )
    closed = placed.filter("found > 0").select("file", "begin", "doc", "start", "ends", F.posexplode("ends").alias("i", "end"))
    first = F.when(F.col("i") == 0, F.col("start")).otherwise(F.col("begin") + F.try_element_at("ends", F.col("i")) + 1)
    whole = closed.select(
        "file", (F.col("doc") + F.col("i")).alias("doc_no"), first.alias("start"),
        (F.col("begin") + F.col("end") - first).alias("n_tokens"), F.lit(True).alias("ended"),
    )
    at_end = placed.filter(F.col("begin") + F.col("n") == F.col("tokens"))
    start = F.coalesce(F.col("last") + 1, F.col("start"))
    open_end = at_end.filter(start < F.col("tokens")).select(
        "file", (F.col("doc") + F.col("found")).alias("doc_no"), start.alias("start"), (F.col("tokens") - start).alias("n_tokens"),
        F.lit(False).alias("ended"),
    )
    return whole.unionByName(open_end)


def corpus_token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Writes the corpus as token files below the shared folder and counts the tokens of every document in them. `file` is the file's name."""
    path = work_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, text)
    return token_counts(docs.sparkSession, path).withColumn("file", F.regexp_extract("file", r"(part-\d+)[^/]*$", 1))
