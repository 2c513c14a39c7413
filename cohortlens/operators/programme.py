"""Peer benchmark, grants over rate series and the social programme reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed_values as V
from ..functions.numbers import half_even, percent, ratio
from ..session import pinned
from .ordering import sized, with_previous


def peer_benchmark(df: DataFrame, key: str, peer: str, home: Column, size: str, events: Sequence[str],
                   demand: tuple[str, str], minimum: int = V.MIN_PEER_SIZE) -> DataFrame:
    """Rates of the home institution against the median of its peers.

    Offers are summed to (key, institution) first. Peer medians use unrounded rates, the home rate
    is rounded before the gap and the ratio are taken. `events` are counts over `size`; `demand` is
    (applicants, seats).
    """
    seats = demand[1]
    sums = df.groupBy(key, peer, home.alias("_home")).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (size, *events, *demand)]
    ).filter(F.col(size) >= minimum)
    rated = sums.select("*", *[percent(F.col(c), F.col(size), None).alias(f"_{c}") for c in events])
    own = rated.filter("_home").select(
        key, size, *events,
        *[half_even(F.col(f"_{c}"), 2).alias(f"{c}_pct") for c in events],
        ratio(F.col(demand[0]), F.col(seats)).alias("demand_ratio"),
    )
    # One row per institution and key: the percentile buffer is as small as the list of institutions.
    others = rated.filter("not _home").groupBy(key).agg(
        F.count("*").alias("peers"),
        *[half_even(F.percentile(f"_{c}", 0.5), 2).alias(f"{c}_median") for c in events],
    )
    joined = own.join(others, key, "left")
    for c in events:
        mine, median = F.col(f"{c}_pct"), F.col(f"{c}_median")
        joined = joined.withColumn(f"{c}_gap", half_even(mine - median, 2)).withColumn(
            f"{c}_ratio", ratio(mine, median)
        )
    return joined


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def rate_periods(rates: DataFrame, since: str, value: str, series: str | None = None) -> DataFrame:
    """Rate series as months [first, until); the first rate of a series also covers the months before it."""
    order = W.partitionBy(series).orderBy(since) if series else W.orderBy(since)
    month = F.to_date(F.concat(F.col(since), F.lit("-01")))
    return rates.select(
        *([F.col(series)] if series else []),
        F.when(F.lag(since).over(order).isNull(), F.lit("0001-01-01").cast("date")).otherwise(month).alias("first"),
        F.coalesce(F.lead(month).over(order), F.lit("9999-01-01").cast("date")).alias("until"),
        F.col(value).cast("decimal(18,2)").alias("rate"),
    )


def cumulated_rates(rates: DataFrame, since: str, value: str, low: int, high: int, series: str | None = None) -> DataFrame:
    """For each month number from `low` to `high` + 1 the sum of the monthly rates from `low` on before it, per series.

    A row a month of the calendar in use, whatever the number of changes.
    """
    keys = [series] if series else []
    periods = rate_periods(rates, since, value, series)
    begin = F.greatest(_month(F.col("first")), F.lit(low))
    end = F.least(_month(F.col("until")) - 1, F.lit(high + 1))  # the last month has no use of its own: it ends the sums
    months = periods.filter(begin <= end).select(*keys, "rate", F.explode(F.sequence(begin, end)).alias("month"))
    before = (W.partitionBy(series) if series else W.partitionBy(F.lit(0))).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    return months.select(*keys, "month", F.coalesce(F.sum("rate").over(before), F.lit(0)).cast("decimal(28,2)").alias("upto"))


def rate_in_force(df: DataFrame, start: str, end: str, rates: DataFrame, since: str, value: str,
                  name: str, series: str | None = None) -> DataFrame:
    """Sum of the monthly rate in force from the month of `start` to the month of `end`.

    The difference of two running sums over the months, each found by an equi-join; with `series`, a column of both sides, by the row's own
    series. The months are broadcast if they are few. A row whose end is in a month before its start has 0, one without start, end or
    series has null.
    """
    low, high = F.col(start), F.col(end)
    used = df.agg(F.min(_month(low)).alias("low"), F.max(_month(high)).alias("high"), F.max(_month(low)).alias("top")).first()
    if used.low is None or used.high is None:
        return df.withColumn(name, F.lit(None).cast("decimal(28,2)"))
    sums = sized(pinned(cumulated_rates(rates, since, value, used.low, max(used.high, used.top), series)))

    def at(side: str, month: Column) -> tuple[DataFrame, Column]:
        named = sums.select(*([F.col(series).alias(f"_{side}_of")] if series else []), F.col("month").alias(f"_{side}_at"), F.col("upto").alias(f"_{side}"))
        on = month == F.col(f"_{side}_at")
        return named, on & (F.col(series) == F.col(f"_{side}_of")) if series else on

    joined = df.join(*at("from", _month(low)), "left").join(*at("to", F.greatest(_month(high) + 1, _month(low))), "left")
    amount = F.when(low.isNotNull() & high.isNotNull(), (F.col("_to") - F.col("_from")).cast("decimal(28,2)"))
    return joined.withColumn(name, amount).drop("_from", "_to", "_from_at", "_to_at", "_from_of", "_to_of")


def append_on_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first row of a key always stays."""
    marked = with_previous(df, keys, order, value, "_previous", first="_first")
    return marked.filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_previous"))).drop("_previous", "_first")


def _grant_counts(weight: str | None = None) -> list[Column]:
    n = F.lit(1) if weight is None else F.col(weight)

    def sum_if(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return [
        F.sum(n).alias("projects"),
        sum_if(F.col("kind") == "REMUNERADA").alias("paid"),
        sum_if(F.col("kind") == "VOLUNTARIA").alias("voluntary"),
        sum_if(F.col("is_quota")).alias("quota_rows"),
        F.sum("amount").alias("invested"),
    ]


def grants_per_key(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Projects, kinds, quotas and money per key; `weight` counts pre-aggregated rows."""
    counted = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*_grant_counts(weight))
    return counted.withColumnRenamed("quota_rows", "quota")


def social_groups(df: DataFrame, keys: Sequence[str], k: int = V.MIN_GROUP, weight: str | None = None) -> DataFrame:
    """Projects, quotas and money per group, groups below `k` and the empty programme left out."""
    n = F.lit(1) if weight is None else F.col(weight)
    race, poor = F.col("profile") == "PPI / ETNICO-RACIAL", F.col("income") == "BAIXA RENDA (<= 1.5 SM)"
    counted = df.filter(F.col(keys[0]) != "").groupBy(*keys).agg(
        *_grant_counts(weight),
        F.coalesce(F.sum(F.when(race, n)), F.lit(0)).alias("quota_race"),
        F.coalesce(F.sum(F.when(poor, n)), F.lit(0)).alias("low_income"),
    ).withColumnRenamed("quota_rows", "quota").filter(F.col("projects") >= k)
    return counted.withColumn("quota_pct", percent(F.col("quota"), F.col("projects"), 1)).withColumn(
        "voluntary_pct", percent(F.col("voluntary"), F.col("projects"), 1)
    )


def programme_report(df: DataFrame, grains: Sequence[str], students: DataFrame, area: str,
                     weight: str | None = None) -> DataFrame:
    """Projects, quotas and money at several grains in one pass, with participation per area.

    Grouping sets expand each row once per grain and combine before the shuffle; `weight` counts
    rows that are already aggregated to the finest grain.
    """
    sets = [[F.col(g)] for g in grains] + [[]]
    grouped = df.groupingSets(sets, *[F.col(g) for g in grains]).agg(
        *_grant_counts(weight), F.grouping_id().alias("_gid")
    )
    top = (1 << len(grains)) - 1
    label, value = F.lit("all"), F.lit("")
    for i, grain in enumerate(grains):
        here = F.col("_gid") == (top ^ (1 << (len(grains) - 1 - i)))
        label = F.when(here, grain).otherwise(label)
        value = F.when(here, F.col(grain).cast("string")).otherwise(value)
    rows = grouped.select(
        label.alias("grain"), value.alias("value"), "projects", "paid", "voluntary",
        F.col("quota_rows").alias("quota"), "invested",
    )
    total = df.agg(F.count("*") if weight is None else F.sum(weight)).scalar()
    people = students.select(F.lit(area).alias("grain"), F.col(area).alias("value"), F.col("students"))
    return (
        rows.filter(F.col("value").isNotNull())
        .join(people, ["grain", "value"], "left")
        .withColumn("projects_pct", percent(F.col("projects"), total))
        .withColumn("quota_pct", percent(F.col("quota"), F.col("projects")))
        .withColumn("participation_pct", percent(F.col("projects"), F.col("students")))
    )
