"""Minimum group sizes and re-identification risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.numbers import half_even, percent


def equivalence_classes(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Rows per class size: (k, groups, rows)."""
    return (
        df.groupBy(*quasi).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("groups"))
        .withColumn("rows", F.col("k") * F.col("groups"))
    )


def uniqueness(df: DataFrame, quasi: Sequence[str], top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row of risk figures, class sizes: all, or the `top` most frequent)."""
    sizes = equivalence_classes(df, quasi)
    figures = sizes.agg(
        F.sum("rows").alias("rows"),
        F.sum("groups").alias("combinations"),
        F.coalesce(F.sum(F.when(F.col("k") == 1, F.col("groups"))), F.lit(0)).alias("singletons"),
        F.coalesce(F.min("k"), F.lit(0)).alias("min_k"),
    ).withColumn("unique_pct", percent(F.col("singletons"), F.col("rows"), 4, 0))
    return figures, sizes if top is None else sizes.orderBy(F.desc("groups"), F.asc("k")).limit(top)


def grain_study(df: DataFrame, grains: dict[str, Sequence[str]], k: int = V.MIN_GROUP,
                weight: str | None = None) -> DataFrame:
    """Per grain: groups, groups below `k`, rows lost and both shares; the empty grain is the row itself.

    Grains nest, so the counts of the finest one feed all the others and the table is read once.
    """
    finest = max(grains.values(), key=len)
    base = df.groupBy(*finest).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    result = None
    for name, columns in grains.items():
        if not columns:
            part = base.agg(F.sum("_n").alias("groups")).select(
                F.lit(name).alias("grain"), "groups", F.col("groups").alias("below_k"),
                F.col("groups").alias("rows_lost"), F.col("groups").alias("rows"),
            )
        else:
            counted = base.groupBy(*columns).agg(F.sum("_n").alias("_n"))
            small = F.col("_n") < k
            part = counted.agg(
                F.count("*").alias("groups"), F.count_if(small).alias("below_k"),
                F.coalesce(F.sum(F.when(small, F.col("_n"))), F.lit(0)).alias("rows_lost"), F.sum("_n").alias("rows"),
            ).select(F.lit(name).alias("grain"), "groups", "below_k", "rows_lost", "rows")
        result = part if result is None else result.unionByName(part)
    return result.withColumn("below_k_pct", half_even(F.col("below_k") * 100.0 / F.col("groups"), 1)).withColumn(
        "rows_lost_pct", half_even(F.col("rows_lost") * 100.0 / F.col("rows"), 1)
    )


def min_cell(tables: dict[str, tuple[DataFrame, str]], k: int = V.MIN_GROUP) -> DataFrame:
    """Published rows below `k` people, per table."""
    result = None
    for name, (df, count) in tables.items():
        part = df.agg(F.count_if(F.col(count) < k).alias("below_k"), F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), F.lit(count).alias("column"), "rows", "below_k",
            F.when(F.col("below_k") == 0, "OK").otherwise("VIOLAÇÃO").alias("status"),
        )
        result = part if result is None else result.unionByName(part)
    return result
