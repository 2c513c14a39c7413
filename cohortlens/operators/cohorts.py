"""Cohort outcomes, active snapshots and the roll-ups over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.numbers import half_even, percent


def mature(df: DataFrame, year: str, years: int = V.MATURITY_YEARS, universe: DataFrame | None = None) -> DataFrame:
    """Cohorts that had time to finish: `year <= max(year) - years`.

    The maximum is taken over `universe`, all enrolments, when rows were filtered before.
    """
    last = (df if universe is None else universe).agg(F.max(year)).scalar()
    return df.filter(F.col(year) <= last - years)


def outcome_cube(df: DataFrame, *keys: str) -> DataFrame:
    """Rows counted per keys, cohort, outcome and permanence.

    All outcome metrics are functions of these cells. Their number depends on the programmes, the
    cohorts and the terms, not on the rows, so the big table is read and shuffled once and already
    combined.
    """
    return df.groupBy(*keys, "entry_year", "outcome", "permanence").agg(F.count("*").alias("n"))


def _sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def deadlines(cube: DataFrame, key: str, low: float = 0.25, middle: float = 0.5, high: float = 0.9) -> DataFrame:
    """Minimum, ideal and maximum terms of a key as percentiles of its permanence, one decimal."""
    cuts = F.percentile("permanence", [low, middle, high], F.col("n"))
    return cube.groupBy(key).agg(cuts.alias("_p")).select(
        key,
        half_even(F.col("_p")[0], 1).alias("minimum"),
        half_even(F.col("_p")[1], 1).alias("ideal"),
        half_even(F.col("_p")[2], 1).alias("maximum"),
    )


def outcome_metrics(cube: DataFrame, key: str, k: int = V.MIN_GROUP) -> DataFrame:
    """Outcome counts, rates and times per key, groups below `k` left out.

    Expects cells with outcome, permanence, n, minimum, ideal and maximum. `at_maximum` counts
    `permanence >= maximum`; the shares have the graduates with a known permanence as denominator
    and are 0 when there are none.
    """
    done = F.col("outcome") == V.GRADUATED
    time, n = F.col("permanence"), F.col("n")
    timed = done & time.isNotNull()
    counted = cube.groupBy(key).agg(
        F.sum(n).alias("total"),
        _sum_if(done, n).alias("graduates"),
        _sum_if(F.col("outcome") == V.DROPPED, n).alias("dropouts"),
        _sum_if(F.col("outcome") == V.ACTIVE, n).alias("actives"),
        _sum_if(timed, n).alias("timed"),
        _sum_if(done & (time <= F.col("minimum")), n).alias("_within_min"),
        _sum_if(done & (time <= F.col("ideal")), n).alias("_within_ideal"),
        _sum_if(done & (time > F.col("ideal")), n).alias("_above_ideal"),
        _sum_if(done & (time >= F.col("maximum")), n).alias("_at_max"),
        F.sum(F.when(timed, time * n)).alias("_terms"),
        F.percentile(F.when(done, time), 0.5, n).alias("_median"),
        F.sum(F.when(timed, (time - F.col("ideal")) * n)).alias("_delay"),
        F.min("minimum").alias("minimum"),
        F.min("ideal").alias("ideal"),
        F.min("maximum").alias("maximum"),
    ).filter(F.col("total") >= k)
    known = F.nullif(F.col("timed"), F.lit(0))
    return counted.select(
        key, "minimum", "ideal", "maximum", "total", "graduates", "dropouts", "actives",
        percent(F.col("graduates"), F.col("total")).alias("graduation_pct"),
        percent(F.col("dropouts"), F.col("total")).alias("dropout_pct"),
        percent(F.col("_within_min"), known, empty=0).alias("within_minimum_pct"),
        percent(F.col("_within_ideal"), known, empty=0).alias("within_ideal_pct"),
        percent(F.col("_above_ideal"), known, empty=0).alias("above_ideal_pct"),
        percent(F.col("_at_max"), known, empty=0).alias("at_maximum_pct"),
        half_even(F.col("_terms") / known, 2).alias("mean_terms"),
        half_even(F.col("_median"), 2).alias("median_terms"),
        half_even(F.col("_delay") / known, 2).alias("mean_delay"),
    )


def first_department(df: DataFrame, key: str, department: str, order: str) -> DataFrame:
    """First non-null department of each key in stored order."""
    return df.groupBy(key).agg(
        F.min_by(department, F.when(F.col(department).isNotNull(), F.col(order))).alias(department)
    )


def active_snapshot(cells: DataFrame, curricula: DataFrame, key: str, trunk: tuple[str, ...],
                    k: int = V.MIN_GROUP) -> DataFrame:
    """Active students per key beyond the ideal and the maximum time; trunk keys are left out.

    Expects cells (key, terms, n) of active students.
    """
    rows = cells.filter(~F.col(key).isin(*trunk)).join(curricula.select(key, "ideal", "maximum"), key)
    n = F.col("n")
    counted = rows.groupBy(key).agg(
        F.min("ideal").alias("ideal"),
        F.min("maximum").alias("maximum"),
        F.sum(n).alias("actives"),
        _sum_if(F.col("terms") > F.col("ideal"), n).alias("above_ideal"),
        _sum_if(F.col("terms") > F.col("maximum"), n).alias("above_maximum"),
    ).filter(F.col("actives") >= k)
    return counted.withColumn("above_ideal_pct", percent(F.col("above_ideal"), F.col("actives")))


def global_totals(cube: DataFrame) -> DataFrame:
    """One row of totals over the mature cohorts, from cells with deadlines."""
    done = F.col("outcome") == V.GRADUATED
    time, n = F.col("permanence"), F.col("n")
    timed = done & time.isNotNull()
    one = cube.agg(
        F.min("entry_year").alias("first_cohort"),
        F.max("entry_year").alias("last_cohort"),
        F.sum(n).alias("analysed"),
        _sum_if(done, n).alias("graduates"),
        _sum_if(timed, n).alias("_timed"),
        _sum_if(done & (time <= F.col("ideal")), n).alias("_in"),
        _sum_if(done & (time > F.col("ideal")), n).alias("_out"),
        F.sum(F.when(timed, time * n)).alias("_terms"),
        F.sum(F.when(timed, (time - F.col("ideal")) * n)).alias("_delay"),
    )
    known = F.nullif(F.col("_timed"), F.lit(0))
    return one.select(
        "first_cohort", "last_cohort", "analysed", "graduates",
        percent(F.col("_in"), known).alias("within_ideal_pct"),
        percent(F.col("_out"), known).alias("above_ideal_pct"),
        half_even(F.col("_terms") / known, 2).alias("mean_terms"),
        half_even(F.col("_delay") / known, 2).alias("mean_delay"),
    )


def duration_histogram(df: DataFrame, key: str, value: str, first: int, last: int) -> DataFrame:
    """Graduates of one key and a range of cohorts per number of terms."""
    return (
        df.filter((F.col(key) == value) & F.col("entry_year").between(first, last))
        .filter((F.col("outcome") == V.GRADUATED) & F.col("permanence").isNotNull())
        .groupBy("permanence").agg(F.count("*").alias("graduates"))
    )


def delay_quantiles(df: DataFrame, days: str, tolerance_days: int) -> DataFrame:
    """Median, p90, p95 and p99 of a delay in days, and the share above the tolerance.

    Rows are counted per day first: days have a small domain, so one buffer holds them all.
    """
    counts = df.filter(F.col(days).isNotNull()).groupBy(F.col(days).alias("_d")).agg(F.count("*").alias("_n"))
    above = F.sum(F.when(F.col("_d") > tolerance_days, F.col("_n")).otherwise(0))
    one = counts.agg(
        F.sum("_n").alias("rows"),
        F.percentile("_d", [0.5, 0.9, 0.95, 0.99], F.col("_n")).alias("_p"),
        (above * 100.0 / F.sum("_n")).alias("above_pct"),
    )
    return one.select("rows", *[F.col("_p")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))], "above_pct")
