"""Late data: load ledger, snapshots, arrivals between loads and the windows they touch.

Late rows are never dropped. A stored watermark classifies them, and the windows that received
them are written again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed_values as V
from ..functions.periods import watermark, window_start
from ..functions.records import digests
from ..session import pinned


def ledger_entry(df: DataFrame, load_id: Column, published: Column, year: str,
                 maturity: int = V.MATURITY_YEARS, rows: str | None = None) -> DataFrame:
    """One row per load: publication, watermark, last mature cohort, rows.

    `rows` names a count column when the load comes as its snapshot cells.
    """
    total = F.count("*") if rows is None else F.sum(rows)
    return df.agg(F.max(year).alias("_last"), total.alias("total")).select(
        load_id.alias("load_id"),
        published.alias("published"),
        watermark(published).alias("watermark"),
        (F.col("_last") - maturity).alias("last_mature"),
        "total",
    )


def snapshot(df: DataFrame, load_id: Column, year: str, outcome: str, period: Column) -> DataFrame:
    """Rows of a load per cohort, outcome and exit period: counts only."""
    return snapshots(df.withColumn("_load", load_id), "_load", year, outcome, period)


def snapshots(df: DataFrame, load: str, year: str, outcome: str, period: Column) -> DataFrame:
    """The same for rows of several loads, each with its number."""
    cells = [F.col(load).alias("load_id"), F.col(year).alias("year"), F.col(outcome).alias("outcome"), period.alias("period")]
    return df.groupBy(*cells).agg(F.count("*").alias("total"))


def ledger(cells: DataFrame, loads: DataFrame, year: str, maturity: int = V.MATURITY_YEARS) -> DataFrame:
    """The ledger rows of all `loads` (load_id, published) that have cells."""
    sums = cells.groupBy("load_id").agg(F.max(year).alias("_last"), F.sum("total").alias("total"))
    return loads.join(sums, "load_id").select(
        "load_id", "published", watermark(F.col("published")).alias("watermark"), (F.col("_last") - maturity).alias("last_mature"), "total"
    )


def arrivals(ledger: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Windows whose count changed from one load to the next.

    Every cell counts for its own load and, with the sign turned, for the load after it; one sum over both gives before, after and
    difference. The class is taken by the watermark of the load before; the first load has no arrivals. Both inputs are counts: a
    ledger row per load and a handful of cells per cohort.
    """
    by_load = W.orderBy("load_id")
    chain = ledger.select(
        "load_id", F.lead("load_id").over(by_load).alias("_next"), F.lag("load_id").over(by_load).isNull().alias("_first"),
        "watermark", "last_mature",
    )
    cells = snapshots.join(chain, "load_id")
    uses = F.array(
        F.struct(F.col("load_id").alias("load"), F.lit(True).alias("now")), F.struct(F.col("_next").alias("load"), F.lit(False).alias("now"))
    )
    used = cells.withColumn("_use", F.explode(uses)).filter(
        F.col("_use.load").isNotNull() & ~(F.col("_use.now") & F.col("_first"))
    )
    now = F.col("_use.now")
    sums = used.groupBy(F.col("_use.load").alias("load_id"), "year", "outcome", "period").agg(
        F.sum(F.when(now, 0).otherwise(F.col("total"))).alias("before"), F.sum(F.when(now, F.col("total")).otherwise(0)).alias("after")
    ).filter("before <> after")
    limits = chain.filter(F.col("_next").isNotNull()).select(F.col("_next").alias("load_id"), "watermark", "last_mature")
    kind = (
        F.when(F.col("period").isNull(), V.NO_PERIOD).when(F.col("period") <= F.col("watermark"), V.LATE).otherwise(V.ON_TIME)
    )
    return sums.join(limits, "load_id").select(
        "load_id", "year", window_start(F.col("year")).alias("window"), "outcome", "period", "before", "after",
        (F.col("after") - F.col("before")).alias("difference"), kind.alias("arrival"),
        F.coalesce(F.col("year") <= F.col("last_mature"), F.lit(False)).alias("published"),
    )


def arrival_summary(changes: DataFrame) -> DataFrame:
    """Rows more, rows less and published cohorts revised, per load, window and class."""
    difference = F.col("difference")
    return changes.groupBy("load_id", "window", "arrival").agg(
        F.coalesce(F.sum(F.when(difference > 0, difference)), F.lit(0)).alias("more"),
        F.coalesce(-F.sum(F.when(difference < 0, difference)), F.lit(0)).alias("less"),
        F.count_distinct(F.when(F.col("published"), F.col("year"))).alias("cohorts_revised"),
    )


def revise(df: DataFrame, chosen: Column, changes: dict[str, Column]) -> DataFrame:
    """Conditional update of the chosen rows."""
    return df.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in changes.items()})


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Rows of an aggregate that are new or differ between two builds."""
    left = old.select(*keys, F.struct(*measures).alias("_old"))
    right = new.select(*keys, F.struct(*measures).alias("_new"))
    return right.join(left, keys, "left").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys, "_new.*")


def window_status(old: DataFrame, new: DataFrame, window: str) -> DataFrame:
    """`rewritten` or `intact` for every window of two versions, by the digests of their rows: nothing but sums is shuffled."""
    old = old.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in new.schema])
    sides = digests(new, [window]).withColumn("_side", F.lit(1)).unionByName(digests(old, [window]).withColumn("_side", F.lit(-1)))
    sums = sides.groupBy(window).agg(*[F.sum(F.col(c) * F.col("_side")).alias(c) for c in ("_rows", "_a", "_b")])
    same = (F.col("_rows") == 0) & (F.col("_a") == 0) & (F.col("_b") == 0)
    return sums.select(window, F.when(same, "intact").otherwise("rewritten").alias("status"))


def revision(df: DataFrame, chosen: Column, changes: dict[str, Column], keys: list[str], window: str,
             measures: dict[str, Callable[[Callable[[str], Column]], Column]]) -> tuple[DataFrame, DataFrame]:
    """What a revision moves, from one pass over the table: (rows of the aggregate that differ, status of every window).

    `measures` build an aggregate from a column lookup, which is the old or the revised column. A window is rewritten if a chosen row
    of it gets another value.
    """
    old = F.col
    new = lambda c: F.when(chosen, changes[c]).otherwise(F.col(c)) if c in changes else F.col(c)
    moved = F.lit(False)
    for c, value in changes.items():
        moved = moved | (chosen & ~F.col(c).eqNullSafe(value))
    cells = pinned(df.groupBy(*keys, window).agg(
        F.coalesce(F.bool_or(moved), F.lit(False)).alias("_moved"),
        *[of(old).alias(f"_old_{name}") for name, of in measures.items()], *[of(new).alias(name) for name, of in measures.items()],
    ))
    totals = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for name in measures for c in (f"_old_{name}", name)])
    differs = F.lit(False)
    for name in measures:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"_old_{name}"))
    status = cells.groupBy(window).agg(F.when(F.bool_or("_moved"), "rewritten").otherwise("intact").alias("status"))
    return totals.filter(differs).select(*keys, *measures), status
