"""Entity resolution, unions of sources, inheritance by prefix and match audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import half_even
from .ordering import numbered, top_per_group


def resolve(df: DataFrame, rules: DataFrame, column: str, source: str, target: str, name: str) -> DataFrame:
    """`name` = target of the alias rule for `column`, or `column` itself.

    Spark broadcasts the rules when their size allows it; no hint is given, so a large rule table
    is joined by key.
    """
    alias = rules.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    return (
        df.join(alias, F.col(column) == F.col("_from"), "left")
        .withColumn(name, F.coalesce("_to", column))
        .drop("_from", "_to")
    )


def rule_usage(df: DataFrame, rules: DataFrame, column: str, source: str, order: str) -> DataFrame:
    """Rows touched by each rule, the most used first (ties in the given order)."""
    # Only the names that a rule mentions are counted.
    named = df.join(rules.select(F.col(source).alias(column)), column, "left_semi")
    used = named.groupBy(column).agg(F.count("*").alias("rows"))
    counted = rules.join(used, F.col(source) == F.col(column), "left").drop(column)
    counted = counted.withColumn("rows", F.coalesce("rows", F.lit(0)))
    # The window covers the rule table only.
    return counted.withColumn("position", F.row_number().over(W.orderBy(F.desc("rows"), order)))


def union_sources(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All sources in one table, each row tagged; columns that a source lacks are NULL."""
    stacked = None
    for label, df in sources.items():
        part = df.withColumn(tag, F.lit(label))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked


def latest_per_key(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    return top_per_group(df, [key], list(newest_first))


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smallest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return top_per_group(counts, [key], [F.desc("_n"), F.asc(value)]).drop("_n")


def inherit_by_prefix(bases: DataFrame, known: DataFrame, name: str, value: str, separator: str = " - ") -> DataFrame:
    """(name, value) of the bases that `known` lacks but whose 'name - ...' entries all agree.

    Every known name is exploded into the prefixes that end before a separator, so the prefix
    condition becomes an equi-join.
    """
    pieces = F.split(F.col(name), separator)
    cut = F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda i: F.array_join(F.slice(pieces, 1, i), separator),
    )
    prefixes = known.filter(F.size(pieces) > 1).select(F.explode(cut).alias("_base"), F.col(value).alias("_value"))
    # Distinct agreement is kept as min and max: two counters per prefix, whatever the group size.
    agreed = (
        prefixes.groupBy("_base").agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
        .filter(F.col("_low") == F.col("_high"))
    )
    missing = bases.select(name).filter(F.col(name) != "").distinct().join(known.select(name), name, "left_anti")
    return missing.join(agreed, F.col(name) == F.col("_base")).select(name, F.col("_low").alias(value))


def match_report(df: DataFrame, matched: Column, label: str, top: int | None = None,
                 weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one-row totals, unmatched labels: all, or the `top` most frequent); `weight` counts pre-aggregated rows."""
    n = F.lit(1) if weight is None else F.col(weight)
    hit = F.coalesce(matched, F.lit(False))
    totals = df.agg(F.sum(n).alias("total"), F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias("matched")).select(
        "total",
        "matched",
        (F.col("total") - F.col("matched")).alias("unmatched"),
        half_even(F.col("matched") / F.col("total") * 100, 2).alias("matched_pct"),
    )
    unmatched = df.filter(~hit).groupBy(label).agg(F.sum(n).alias("rows"))
    return totals, unmatched if top is None else unmatched.orderBy(F.desc("rows"), F.asc(label)).limit(top)


def stable_ids(df: DataFrame, *order: Column, name: str = "id") -> DataFrame:
    """Ids 1..n in a total order: an identical reload gets identical ids."""
    return numbered(df, *order, name=name)


