"""One row per key out of many versions or offers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.labels import campus_name, degree_category, shift_group
from .ordering import top_per_group


def first_non_null(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *order: Column) -> DataFrame:
    """Per key and column, the first non-null value in the given ascending order."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns]
    )


def latest_non_null(df: DataFrame, key: str, columns: Sequence[str], version: str, flag: str) -> DataFrame:
    """Per key and column, the value of the newest version that has one; `flag` marks keys in the last version."""
    last = df.agg(F.max(version)).scalar()
    newest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in columns]
    return df.groupBy(key).agg(*newest, F.max(version).alias("_seen")).withColumn(
        flag, F.col("_seen") == last
    ).drop("_seen")


def consolidate_curricula(df: DataFrame, key: str, year: str, ideal: str, low: str, high: str,
                          maxima: Sequence[str], owner: str, tie: str) -> DataFrame:
    """Median, minimum, maximum and first-of-the-newest per key; rows without key or ideal are dropped."""
    kept = df.filter((F.col(key) != "") & F.col(ideal).isNotNull())
    # min_by skips rows whose order is NULL; -year puts the newest first, a missing year last.
    newest = F.struct(F.coalesce(-F.col(year), F.lit(0)), F.col(tie))
    return kept.groupBy(key).agg(
        F.percentile(ideal, 0.5).alias(ideal),
        F.min(low).alias(low),
        F.max(high).alias(high),
        *[F.max(c).alias(c) for c in maxima],
        F.min_by(owner, F.when(F.col(owner).isNotNull(), newest)).alias(owner),
    )


def mixed_keys(df: DataFrame, key: str, degree: str) -> DataFrame:
    """Keys offered in more than one degree category."""
    category = degree_category(F.col(degree))
    return (
        df.groupBy(key).agg(F.min(category).alias("_a"), F.max(category).alias("_b"))
        .filter(F.col("_a") != F.col("_b")).select(key)
    )


def offers(df: DataFrame, key: str, shift: str, campus: str) -> DataFrame:
    """Shift label and campus of a key over all its offers.

    The labels come from small fixed domains, so the collected sets hold a handful of entries.
    """
    shifts = F.collect_set(F.when(F.col(shift).isNotNull(), shift_group(F.col(shift))))
    place = F.when(F.col(campus).isNotNull(), campus_name(F.col(campus)))
    return df.groupBy(key).agg(
        F.array_join(F.array_sort(shifts), " E ").alias("_shift"), F.min(place).alias("_low"), F.max(place).alias("_high")
    ).select(
        key,
        F.coalesce(F.nullif(F.col("_shift"), F.lit("")), F.lit(V.DEFAULT_SHIFT)).alias("shift"),
        F.when(F.col("_low") != F.col("_high"), V.MANY_CAMPUSES)
        .otherwise(F.coalesce("_low", F.lit(V.MAIN_CAMPUS))).alias("campus"),
    )


def canonical_attributes(curricula: DataFrame, offers_df: DataFrame, key: str, offer_id: str, current: str,
                         owner: str, degree: str, attributes: Sequence[str]) -> DataFrame:
    """Attributes of each curriculum: main offer of its name, else the owning offer; mixed degrees say so."""
    columns = [degree, *attributes]
    main = top_per_group(offers_df, [key], [F.desc(current), F.asc(offer_id)]).select(
        key, *[F.col(c).alias(f"_main_{c}") for c in columns]
    )
    mixed = mixed_keys(offers_df, key, degree).withColumn("_mixed", F.lit(True))
    owners = offers_df.select(F.col(offer_id).alias(owner), *[F.col(c).alias(f"_own_{c}") for c in columns])
    joined = curricula.join(owners, owner).join(main, key, "left").join(mixed, key, "left")
    value = {c: F.coalesce(F.col(f"_main_{c}"), F.col(f"_own_{c}")) for c in columns}
    return joined.select(
        key,
        owner,
        F.when(F.col("_mixed"), V.MIXED_DEGREE).otherwise(value[degree]).alias(degree),
        F.when(F.col("_mixed"), V.MIXED_CATEGORY).otherwise(degree_category(value[degree])).alias("category"),
        *[value[c].alias(c) for c in attributes],
    )
