"""Small statistics over published tables: weighted rates, correlation and trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import half_even, percent


def weighted_rate(df: DataFrame, keys: Sequence[str], part: str, whole: str, name: str) -> DataFrame:
    """Rate re-aggregated from its parts."""
    return df.groupBy(*keys).agg(F.sum(part).alias(part), F.sum(whole).alias(whole)).withColumn(
        name, percent(F.col(part), F.col(whole))
    )


def mean_rate(df: DataFrame, keys: Sequence[str], rate: str, sums: Sequence[str], name: str) -> DataFrame:
    """Unweighted mean of a rate beside plain sums."""
    return df.groupBy(*keys).agg(
        half_even(F.avg(F.col(rate).cast("decimal(20,4)")).cast("double"), 2).alias(name),
        *[F.sum(c).alias(c) for c in sums],
    )


def pearson(df: DataFrame, x: str, y: str, where: Column | None = None, minimum: int = 3) -> DataFrame:
    """(n, r) over the complete pairs; r is NULL below `minimum` pairs."""
    rows = df if where is None else df.filter(where)
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.agg(F.count("*").alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("_r")).select(
        "n", F.when(F.col("n") >= minimum, F.col("_r")).alias("r")
    )


def log_correlation(df: DataFrame, x: str, y: str, critical: float = 1.96) -> DataFrame:
    """Correlation with log10(x), its t statistic and the verdict of a two-sided test."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) > 0))
    one = rows.agg(F.count("*").alias("n"), F.corr(F.log10(x), F.col(y).cast("double")).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12)))
    return one.withColumn("t", F.when(F.col("n") > 2, t).otherwise(0.0)).withColumn(
        "significant", F.abs("t") > critical
    )


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def extremes(df: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """The `n` largest and the `n` smallest rows, each row once."""
    top = df.orderBy(F.desc(value), F.asc(tie)).limit(n)
    bottom = df.orderBy(F.asc(value), F.asc(tie)).limit(n)
    return top.union(bottom).distinct()


def kpis(df: DataFrame, sums: Sequence[str], gap: str, label: str, watched: str) -> DataFrame:
    """Sums, rows above and below zero, and rows of one class."""
    return df.agg(
        F.count("*").alias("rows"),
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(F.col(gap) > 0).alias("above"),
        F.count_if(F.col(gap) < 0).alias("below"),
        F.count_if(F.col(label) == watched).alias("watched"),
    )
