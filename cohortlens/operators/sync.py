"""Change-only synchronisation by natural key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.records import same


def change_only_upsert(target: DataFrame, source: DataFrame, key: Sequence[str], values: Sequence[str],
                       insert_only: bool = False, stamps: Sequence[str] = ()) -> DataFrame:
    """The target after the load, with `action` = inserted, updated, equal or kept.

    Rows absent from the source are kept. Stamps are not compared; they are NULL on written rows,
    for the writer to fill.
    """
    columns = [*key, *values]
    left = target.select(*columns, *stamps, F.lit(True).alias("_t")).alias("t")
    right = source.select(*columns, F.lit(True).alias("_s")).alias("s")
    condition = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    matched = left.join(right, condition, "full")
    equal = same([F.col(f"t.{v}") for v in values], [F.col(f"s.{v}") for v in values])
    action = (
        F.when(F.col("_t").isNull(), "inserted").when(F.col("_s").isNull(), "kept")
        .when(equal | F.lit(insert_only), "equal").otherwise("updated")
    )
    write = F.col("action").isin("inserted", "updated")
    return matched.withColumn("action", action).select(
        *[F.coalesce(F.col(f"t.{k}"), F.col(f"s.{k}")).alias(k) for k in key],
        *[F.when(write, F.col(f"s.{v}")).otherwise(F.col(f"t.{v}")).alias(v) for v in values],
        *[F.when(~write, F.col(f"t.{s}")).alias(s) for s in stamps],
        "action",
    )


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count_if(F.col("action") == "updated").alias("updated"),
    )


def detach(fact: DataFrame, dimension: DataFrame, surrogate: str, natural: Sequence[str]) -> DataFrame:
    """The fact with natural attributes in place of a surrogate key."""
    return fact.join(dimension.select(surrogate, *natural), surrogate).drop(surrogate)


def relink(travelled: DataFrame, dimension: DataFrame, surrogate: str, natural: Sequence[str]) -> DataFrame:
    """The fact with the destination's surrogate key in place of the natural attributes."""
    return travelled.join(dimension.select(surrogate, *natural), list(natural)).drop(*natural)
