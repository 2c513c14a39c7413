"""Composite risk index, quartile classes and the panel of critical programmes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.numbers import half_even
from .ordering import ranked


def _clip(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def risk_index(metrics: DataFrame, delay: str = "mean_delay", dropout: str = "dropout_pct",
               weights: tuple[float, float] = V.RISK_WEIGHTS, clip: tuple[float, float] = V.RISK_CLIP,
               name: str = "risk_index") -> DataFrame:
    """0..100 index of the already rounded delay and dropout rate, one decimal.

    Inputs are clipped to two percentiles, scaled between their extremes and weighted. Clipping is
    monotone, so the extremes of the clipped values follow from the extremes of the inputs and one
    scalar subquery serves every limit.
    """
    inputs = metrics.withColumn("_d", F.greatest(F.coalesce(F.col(delay), F.lit(0.0)), F.lit(0.0))).withColumn(
        "_e", F.coalesce(F.col(dropout), F.lit(0.0))
    )
    limits = inputs.agg(
        F.struct(
            *[F.percentile(c, p).alias(f"{c}{i}") for c in ("_d", "_e") for i, p in enumerate(clip)],
            *[f(c).alias(f"{c}_{n}") for c in ("_d", "_e") for n, f in (("min", F.min), ("max", F.max))],
        ).alias("limits")
    ).scalar()
    scored = inputs.withColumn("_l", limits)

    def scaled(c: str) -> Column:
        low, high = F.col(f"_l.{c}0"), F.col(f"_l.{c}1")
        least = _clip(F.col(f"_l.{c}_min"), low, high)
        most = _clip(F.col(f"_l.{c}_max"), low, high)
        return (_clip(F.col(c), low, high) - least) / (most - least + F.lit(1e-6))

    index = (F.lit(weights[0]) * scaled("_d") + F.lit(weights[1]) * scaled("_e")) * 100
    return scored.withColumn(name, half_even(index, 1)).drop("_d", "_e", "_l")


def risk_class(df: DataFrame, index: str = "risk_index", name: str = "risk_class") -> DataFrame:
    """Quartile class of the rounded index, `>=` from the top."""
    cuts = df.agg(F.percentile(index, [0.75, 0.5, 0.25]).alias("cuts")).scalar()
    value = F.col(index)
    return (
        df.withColumn("_cuts", cuts)
        .withColumn(
            name,
            F.when(value >= F.col("_cuts")[0], V.RISK_CLASSES[0])
            .when(value >= F.col("_cuts")[1], V.RISK_CLASSES[1])
            .when(value >= F.col("_cuts")[2], V.RISK_CLASSES[2])
            .otherwise(V.RISK_CLASSES[3]),
        )
        .drop("_cuts")
    )


def critical_panel(df: DataFrame, key: str, trunk: tuple[str, ...], index: str = "risk_index") -> DataFrame:
    """Keys outside the trunk with their shared rank by index."""
    return ranked(df.filter(~F.col(key).isin(*trunk)), index)


def same_load(panel: DataFrame, current: DataFrame, key: str, index: str) -> Column:
    """Whether two tables hold the same set of (key, index with one decimal)."""
    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("k"), half_even(F.col(index), 1).alias("v")).distinct()

    sides = pairs(panel).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(
        pairs(current).withColumn("a", F.lit(0)).withColumn("b", F.lit(1))
    )
    different = sides.groupBy("k", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> b")
    return different.agg(F.count("*") == 0).scalar()


def panel_or_current(panel: DataFrame, current: DataFrame, key: str, index: str,
                     trunk: tuple[str, ...], columns: list[str]) -> DataFrame:
    """The panel if it belongs to the current load, else the panel rebuilt from the current table."""
    terminal = current.filter(~F.col(key).isin(*trunk))
    fresh = same_load(panel, terminal, key, index)
    rebuilt = ranked(terminal, index)
    kept = panel.filter(fresh).select("position", *columns, F.lit("panel").alias("origin"))
    return kept.unionByName(
        rebuilt.filter(~fresh).select("position", *columns, F.lit("rebuilt").alias("origin"))
    )
