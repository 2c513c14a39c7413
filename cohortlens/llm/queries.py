"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, mixing, multiindex, orderhash, packing, pages, partcodes, quality, rows, separators, sharding, simhash, trie
from .oracles import ORACLES


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.corpus_token_counts(_table(spark, sf_dir, "documents"))


def op2_bfd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.packed_rows(_table(spark, sf_dir, "documents"))


def op3_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(_table(spark, sf_dir, "pages"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(_table(spark, sf_dir, "conversations"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.edited_pairs(_table(spark, sf_dir, "documents"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op9_language_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op10_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op11_inverted_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest(_table(spark, sf_dir, "embeddings"))


def op12_euler_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partcodes.coded(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_separator_scan, op2_bfd_rows, op3_host_suffix_array, op4_simhash_bktree, op5_hash_threshold_mix, op6_perspective_rotation,
        op7_order_minhash, op8_rendezvous_shards, op9_language_divergence, op10_conflict_packing,
        op11_inverted_multiindex, op12_euler_trie, op13_anchor_codes,
    )
}
ORACLE_SQL = {name: sql for name, sql in ORACLES.items() if name in QUERIES}
