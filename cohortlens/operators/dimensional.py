"""Star schema: dimensions with history, facts that point to current versions, the wide view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed_values as V
from ..functions.records import natural_key, same, version_key


def upsert_dimension(current: DataFrame, incoming: DataFrame, key: Sequence[str], attributes: Sequence[str],
                     surrogate: str) -> DataFrame:
    """Rows of both sides by natural key; incoming attributes win, no key is deleted, hash keys never move."""
    sides = current.select(*key, *attributes, F.lit(0).alias("_new")).unionByName(
        incoming.select(*key, *attributes, F.lit(1).alias("_new"))
    )
    merged = sides.groupBy(*key).agg(F.max_by(F.struct(*attributes), "_new").alias("_a"))
    return merged.select(natural_key(*[F.col(k) for k in key]).alias(surrogate), *key, "_a.*")


def time_dimension(df: DataFrame, year: str, last_year: int, terms: Sequence[int] = (1, 2)) -> DataFrame:
    """One row per year and term from the first year of the data to `last_year`."""
    years = df.agg(F.explode(F.sequence(F.min(year).cast("int"), F.lit(last_year))).alias("year"))
    rows = years.select("year", F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    return rows.select(
        (F.col("year") * 10 + F.col("term")).alias("time_key"),
        "year",
        "term",
        F.concat_ws("/", "year", "term").alias("label"),
        (F.col("year") - F.col("year") % 10).alias("decade"),
    )


def scd2_merge(dimension: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], type1: Sequence[str],
               load_time: Column, epoch: str = V.SERIES_START) -> DataFrame:
    """One load applied to a type-2 dimension.

    A changed key closes its current version at `load_time` and opens another; a new key opens at
    `epoch`; a key that vanished keeps its current version; type-1 attributes are overwritten on
    the current version only.
    """
    columns = [key, *tracked, *type1]
    new = source.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_s_{c}") for c in (*tracked, *type1)])
    open_rows = dimension.filter("is_current").join(new, F.col(key) == F.col("_key"), "full")
    changed = ~same([F.col(c) for c in tracked], [F.col(f"_s_{c}") for c in tracked])
    state = (
        F.when(F.col("_key").isNull(), "kept").when(F.col(key).isNull(), "new")
        .when(changed, "changed").otherwise("same")
    )
    versions = F.when(F.col("_state") == "changed", F.array(F.lit("close"), F.lit("open"))).otherwise(F.array("_state"))
    steps = open_rows.withColumn("_state", state).withColumn("_step", F.explode(versions))
    opened = F.col("_step").isin("open", "new")
    closed = dimension.filter("not is_current")
    # A key whose versions are all closed gets its next one from the load time, not from the epoch.
    known = closed.select(F.col(key).alias("_old")).distinct()
    steps = steps.join(known, F.col("_key") == F.col("_old"), "left")
    start = F.when(F.col("_step") == "open", load_time).when(F.col("_old").isNotNull(), load_time).otherwise(
        F.lit(epoch).cast("timestamp_ntz")
    )
    fresh = F.col("_step").isin("open", "new", "same")
    return closed.select(*columns, "valid_from", "valid_to", "is_current").unionByName(
        steps.select(
            F.coalesce(key, "_key").alias(key),
            *[F.when(opened, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in tracked],
            *[F.when(fresh, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in type1],
            F.when(opened, start).otherwise(F.col("valid_from")).alias("valid_from"),
            F.when(F.col("_step") == "close", load_time).alias("valid_to"),
            (F.col("_step") != "close").alias("is_current"),
        )
    )


def scd2_from_loads(loads: DataFrame, key: str, load_time: str, tracked: Sequence[str], type1: Sequence[str],
                    epoch: str = V.SERIES_START) -> DataFrame:
    """Type-2 history of a sequence of loads, one row per (key, load).

    Versions start where a tracked attribute differs from the load before and end where the next
    one starts. Type-1 attributes show the newest value on every version; vanished keys stay open.
    A key has as many rows as there were loads, so its windows are small.
    """
    window = W.partitionBy(key).orderBy(load_time)
    before = F.lag(F.struct(*tracked)).over(window)
    starts = loads.withColumn("_changed", ~before.eqNullSafe(F.struct(*tracked))).filter("_changed").withColumn(
        "_rn", F.row_number().over(window)
    )
    versions = starts.withColumn(
        "valid_from", F.when(F.col("_rn") == 1, F.lit(epoch).cast("timestamp_ntz")).otherwise(F.col(load_time))
    ).withColumn("valid_to", F.lead(load_time).over(window))
    newest = loads.groupBy(key).agg(F.max_by(F.struct(*type1), load_time).alias("_t1"))
    return versions.drop(*type1).join(newest, key).select(
        version_key(F.col(key), F.col("valid_from")).alias("version_key"),
        key, *tracked, "_t1.*", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"),
    )


def current_fact(measures: DataFrame, dimension: DataFrame, key: str, surrogate: str) -> DataFrame:
    """Measures with the surrogate key of the current version in place of the natural key."""
    current = dimension.filter("is_current").select(key, surrogate)
    return measures.join(current, key).drop(key)


def executive_view(fact: DataFrame, dimension: DataFrame, actives: DataFrame, surrogate: str,
                   trunk_flag: str, counts: dict[str, str]) -> DataFrame:
    """Fact rows of current, non-trunk versions with the active snapshot beside them, 0 where missing."""
    rows = fact.join(dimension.filter(F.col("is_current") & ~F.col(trunk_flag)), surrogate)
    beside = actives.select(surrogate, *[F.col(c).alias(n) for c, n in counts.items()])
    return rows.join(beside, surrogate, "left").fillna(0, subset=list(counts.values()))


class EmptySource(RuntimeError):
    """A refresh was refused because its source has no rows."""


def guarded(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """`df`, unless a source is empty: a good view must not be replaced by an empty one."""
    for i, source in enumerate(sources):
        if source.isEmpty():
            raise EmptySource(f"source {i} is empty: refresh refused")
    return df


def distinct_profiles(df: DataFrame, columns: Sequence[str], default: str, filled: Sequence[str]) -> DataFrame:
    return df.select(
        *[F.coalesce(c, F.lit(default)).alias(c) if c in filled else F.col(c) for c in columns]
    ).distinct()


def null_safe_join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL matches NULL; Spark hashes `<=>` keys, so it stays a hash or merge join."""
    condition = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return left.join(right, condition, how)
