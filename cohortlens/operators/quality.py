"""Declarative data checks. Every check returns (check, failures) rows; zero failures is a pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F, types as T

from ..functions import fixed_values as V
from ..functions.numbers import half_even
from ..functions.records import digests, row_hashes
from .ordering import exact_percentiles, joined_on


@dataclass(frozen=True)
class Rule:
    """One column check: not_null, accepted, range, unique or related."""

    kind: str
    column: str
    values: tuple = ()
    table: DataFrame | None = field(default=None, compare=False)
    target: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.column}"


def _failing(rule: Rule) -> Column | None:
    """Whether a row breaks a rule; None for rules that need other rows."""
    value = F.col(rule.column) if rule.kind != "true" else F.expr(rule.column)
    if rule.kind == "not_null":
        return value.isNull()
    if rule.kind == "accepted":
        return ~value.isin(*rule.values)
    if rule.kind == "range":
        return ~value.between(*rule.values)
    return ~value if rule.kind == "true" else None


def column_checks(df: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """Failures per rule: the row-local rules share one pass, uniqueness and relationships add a shuffle each.

    With `by`, (by, check, failures) of each group, so that many tables in one are checked at once; for uniqueness and relationships only
    groups that fail have a row.
    """
    result = None
    row_rules = [r for r in rules if _failing(r) is not None]
    if row_rules:
        counts = [F.count_if(_failing(r)).alias(f"c{i}") for i, r in enumerate(row_rules)]
        one = df.groupBy(*by).agg(*counts) if by else df.agg(*counts)
        pairs = ", ".join(f"'{r.name}', c{i}" for i, r in enumerate(row_rules))
        result = one.selectExpr(*by, f"stack({len(row_rules)}, {pairs}) AS (check, failures)")
    for rule in rules:
        value = F.col(rule.column) if rule.kind in ("unique", "related") else None
        if rule.kind == "unique":
            part = df.filter(value.isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n")).filter("_n > 1")
            failures = F.count("*")
        elif rule.kind == "related":
            # Distinct values first: one row per value crosses the network, not one per row.
            used = df.filter(value.isNotNull()).groupBy(*by, value.alias("_v")).agg(F.count("*").alias("_n"))
            known = rule.table.select(F.col(rule.target).alias("_k"))
            part = used.join(known, F.col("_v") == F.col("_k"), "left_anti")
            failures = F.coalesce(F.sum("_n"), F.lit(0))
        else:
            continue
        grouped = part.groupBy(*by) if by else part
        part = grouped.agg(failures.alias("failures")).select(*by, F.lit(rule.name).alias("check"), "failures")
        result = part if result is None else result.unionByName(part)
    return result


class Watched:
    """A table whose row-local rules are checked by whatever job reads `df` first, for example the one that writes it: no pass of its own."""

    def __init__(self, df: DataFrame, rules: Sequence[Rule]):
        wrong = [r.name for r in rules if _failing(r) is None]
        if wrong:
            raise ValueError(f"these rules need other rows, too: {wrong}")
        self._rules, self._seen = list(rules), Observation()
        self.df = df.observe(self._seen, *[F.count_if(_failing(r)).alias(f"c{i}") for i, r in enumerate(rules)])

    def failures(self) -> dict[str, int]:
        """Failures per rule, once the job is done; waits for it."""
        found = self._seen.get
        return {r.name: found.get(f"c{i}", 0) for i, r in enumerate(self._rules)}


def volume(df: DataFrame, low: int, high: int, by: Sequence[str] = ()) -> DataFrame:
    rows = F.count("*").alias("rows")
    return (df.groupBy(*by).agg(rows) if by else df.agg(rows)).withColumn("inside", F.col("rows").between(low, high))


def duplicate_keys(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Repeated keys with their count and first row."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(order).alias("first_row")).filter("rows > 1")


def first_offender(duplicates: DataFrame) -> DataFrame:
    return duplicates.orderBy("first_row").limit(1)


class SchemaMismatch(ValueError):
    """A table does not have the agreed columns and types."""


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df`, if its column names and types are the agreed ones."""
    found = {f.name: f.dataType for f in df.schema}
    wanted = {f.name: f.dataType for f in schema}
    wrong = sorted(n for n in found.keys() | wanted.keys() if found.get(n) != wanted.get(n))
    if wrong:
        raise SchemaMismatch(f"columns that differ from the contract: {wrong}")
    return df


def assert_absent(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """`df`, if none of the personal columns is in it."""
    leaked = sorted(set(df.columns) & set(forbidden))
    if leaked:
        raise SchemaMismatch(f"personal columns present: {leaked}")
    return df


def series_jumps(counts: DataFrame, year: str, count: str, limit: float = 0.3, by: Sequence[str] = ()) -> DataFrame:
    """Cohorts whose volume moved more than `limit` from the cohort before. One row per cohort comes in."""
    window = W.partitionBy(*by).orderBy(year) if by else W.orderBy(year)
    moved = counts.withColumn("previous", F.lag(count).over(window))
    return moved.filter(F.abs(F.col(count) - F.col("previous")) > limit * F.col("previous")).withColumn(
        "change_pct", half_even((F.col(count) - F.col("previous")) * 100.0 / F.col("previous"), 1)
    )


def outcome_shares(df: DataFrame, year: str, bands: dict[str, tuple[float, float]], by: Sequence[str] = ()) -> DataFrame:
    """Share of each outcome per cohort and whether all shares are inside their bands."""
    shares = df.groupBy(*by, year).agg(
        *[(F.count_if(F.col("outcome") == o) * 100.0 / F.count("*")).alias(f"_{o}") for o in bands]
    )
    inside = F.lit(True)
    for o, (low, high) in bands.items():
        inside = inside & F.col(f"_{o}").between(low, high)
    return shares.select(*by, year, *[half_even(F.col(f"_{o}"), 1).alias(o) for o in bands], inside.alias("inside"))


def vanishing_keys(df: DataFrame, key: str, year: str, minimum: int, by: Sequence[str] = ()) -> DataFrame:
    """(key, missing year) of keys with at least `minimum` rows in both neighbouring cohorts and none between.

    The last cohort may be incomplete and is not used as a neighbour.
    """
    cells = df.groupBy(*by, key, year).agg(F.count("*").alias("rows"))
    # A key has one cell per cohort, so the windows are small whatever the size of the key.
    window = W.partitionBy(*by, key).orderBy(year)
    gaps = cells.withColumn("next_year", F.lead(year).over(window)).withColumn("after", F.lead("rows").over(window))
    if by:
        last = df.groupBy(*by).agg(F.max(year).alias("last_year"))
        gaps = joined_on(gaps, last, by)
    else:
        gaps = gaps.withColumn("last_year", df.agg(F.max(year)).scalar())
    return gaps.filter(
        (F.col("next_year") == F.col(year) + 2)
        & (F.col("next_year") < F.col("last_year"))
        & (F.col("rows") >= minimum)
        & (F.col("after") >= minimum)
    ).select(*by, key, (F.col(year) + 1).alias("missing_year"), F.col("rows").alias("before"), "after")


def median_band(df: DataFrame, value: str, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    median = exact_percentiles(df, by, value, {"median": 0.5})
    return median.withColumn("inside", F.col("median").between(low, high))


def severity(failures: Column, error_above: int) -> Column:
    return F.when(failures > error_above, "error").when(failures > 0, "warning").otherwise("pass")


def parts_exceed_whole(df: DataFrame, parts: Sequence[str], whole: str) -> DataFrame:
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.filter((total > F.col(whole)) | (F.least(*parts) < 0))


def scd_violations(dimension: DataFrame, key: str, epoch: str = V.SERIES_START) -> DataFrame:
    """Keys that do not have exactly one open, current version, or whose ranges do not chain."""
    window = W.partitionBy(key).orderBy("valid_from")
    rows = dimension.withColumn("_next", F.lead("valid_from").over(window)).withColumn(
        "_rn", F.row_number().over(window)
    )
    broken = (
        ((F.col("_rn") == 1) & (F.col("valid_from") != F.lit(epoch).cast("timestamp_ntz")))
        | F.coalesce(F.col("valid_to") <= F.col("valid_from"), F.lit(False))
        | ~F.col("valid_to").eqNullSafe(F.col("_next"))
    )
    return rows.groupBy(key).agg(
        F.count_if("is_current").alias("current_versions"),
        F.bool_or(F.col("is_current") != F.col("valid_to").isNull()).alias("flag_broken"),
        F.bool_or(broken).alias("chain_broken"),
    ).filter((F.col("current_versions") != 1) | F.col("flag_broken") | F.col("chain_broken"))


def facts_on_closed_versions(fact: DataFrame, dimension: DataFrame, surrogate: str) -> DataFrame:
    return fact.join(dimension.filter(~F.col("is_current")), surrogate, "left_semi")


def count_reconciliation(counts: DataFrame) -> DataFrame:
    """Status of (table, source_rows, target_rows, error); NULL source rows were not counted."""
    source, target = F.col("source_rows"), F.col("target_rows")
    return counts.withColumn(
        "status",
        F.when(F.col("error"), "ERRO").when(source.isNull(), "NAO_VERIFICADO").when(source == target, "RECONCILIADO")
        .when(target > source, "RECONCILIADO_COM_EXTRAS").otherwise("DIVERGENTE"),
    )


def restricted_empty(counts: DataFrame) -> DataFrame:
    """Status per restricted table: rows are a violation, a count that failed proves nothing."""
    rows = F.col("rows")
    return counts.withColumn(
        "status",
        F.when(~F.col("present"), "OK").when(rows.isNull(), "INCONCLUSIVO").when(rows == 0, "OK")
        .otherwise("VIOLAÇÃO LGPD"),
    )


def verdict(statuses: DataFrame, accepted: Sequence[str]) -> DataFrame:
    """One row: FALHA_CRITICA, REQUER_ATENCAO or APROVADO."""
    return statuses.agg(
        F.when(F.bool_or(F.col("status").startswith("VIOLAÇÃO")), "FALHA_CRITICA")
        .when(F.bool_or(~F.col("status").isin(*accepted)), "REQUER_ATENCAO")
        .otherwise("APROVADO").alias("verdict")
    )


#: Parts that two tables are compared in before any row is shuffled.
COMPARED_PARTS = 1024


def two_way_except(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right"), parts: int = COMPARED_PARTS) -> DataFrame:
    """Distinct rows that only one side has, from one aggregation over the parts of both that differ.

    Rows are dealt to parts by a hash, and the parts' digests are compared first; rows of parts with equal digests, which are equal but for
    odds of about 2^-128 each, are not shuffled. Both sides are read twice.
    """
    columns = left.columns
    right = right.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in left.schema])
    part = lambda df: F.pmod(row_hashes(df)[0], F.lit(parts)).cast("int")
    sides = [df.withColumn("_part", part(df)) for df in (left, right)]
    sums = [digests(df, ["_part"]).withColumn("_side", F.lit(sign)) for df, sign in zip(sides, (1, -1))]
    compared = sums[0].unionByName(sums[1]).groupBy("_part").agg(*[F.sum(F.col(c) * F.col("_side")).alias(c) for c in ("_rows", "_a", "_b")])
    unlike = [r[0] for r in compared.filter("_rows <> 0 OR _a <> 0 OR _b <> 0").select("_part").collect()]
    if len(unlike) < parts:
        sides = [df.filter(F.col("_part").isin(unlike)) for df in sides]
    a = sides[0].select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = sides[1].select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    both = a.unionByName(b).groupBy(*columns).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return both.filter(F.col("_l") != F.col("_r")).select(
        F.when(F.col("_l") == 1, f"only_in_{names[0]}").otherwise(f"only_in_{names[1]}").alias("difference"), *columns
    )


def literal_nulls(df: DataFrame, columns: Sequence[str], order: str, token: str = "NULL") -> DataFrame:
    """Rows per column that hold a literal null token, with the first row number."""
    aggregates = []
    for c in columns:
        hit = F.col(c) == token
        aggregates += [F.count_if(hit).alias(f"{c}_n"), F.min(F.when(hit, F.col(order))).alias(f"{c}_f")]
    pairs = ", ".join(f"'{c}', {c}_n, {c}_f" for c in columns)
    return df.agg(*aggregates).selectExpr(f"stack({len(columns)}, {pairs}) AS (column, rows, first_row)")


def future_dates(df: DataFrame, day: Column, published: Column, order: str, top: int | None = None) -> DataFrame:
    """Rows whose date is after the publication: all of them, or the first `top` by `order`."""
    late = df.withColumn("_day", day).filter(F.col("_day") > published).drop("_day")
    return late if top is None else late.orderBy(order).limit(top)


def status_drift(older: DataFrame, newer: DataFrame, year: str, active: Column, cancelled: Column) -> DataFrame:
    """Active and cancelled rows per cohort in one extract beside the rows of a later list."""
    before = older.groupBy(year).agg(
        F.count(F.when(active, 1)).alias("active_before"), F.count(F.when(cancelled, 1)).alias("cancelled_before")
    )
    after = newer.groupBy(year).agg(F.count("*").alias("listed_after"))
    return before.join(after, year, "full").fillna(0)


def uncovered_keys(catalogue: DataFrame, curricula: DataFrame, key: str, trunk: Sequence[str]) -> DataFrame:
    """Distinct resolved keys that no curriculum covers, trunk keys aside."""
    wanted = catalogue.select(key).filter(~F.col(key).isin(*trunk)).distinct()
    return wanted.join(curricula.select(key), key, "left_anti")


def freshness(sources: DataFrame, processed: Column, now: Column, limit_days: int = V.FRESHNESS_DAYS) -> DataFrame:
    """Age in days of the last processing and of every publication not processed yet.

    A clock ahead gives age 0, and so does a publication already processed. `sources` has
    (source, published).
    """
    def days(since: Column) -> Column:
        return F.greatest((F.unix_micros(now) - F.unix_micros(since)) / 86_400_000_000, F.lit(0.0))

    pending = F.col("published") > processed
    checked = sources.select(
        F.concat(F.lit("source:"), F.col("source")).alias("check"),
        F.when(pending, days(F.col("published"))).otherwise(0.0).alias("age_days"),
    )
    # This row does not come from the sources: without any source the age of the processing still shows.
    own = sources.sparkSession.range(1).select(F.lit("processing").alias("check"), days(processed).alias("age_days"))
    return checked.unionByName(own).withColumn("inside", F.col("age_days") <= limit_days)


