"""Academic terms. A period is `year * 10 + term`; term 0 is the summer, 1 and 2 the halves."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as V


def parse_period(text: Column) -> tuple[Column, Column]:
    """(year, term) of a five-digit period; anything else gives NULLs."""
    digits = F.regexp_extract(F.replace(F.trim(text), F.lit(".0"), F.lit("")), r"^(\d{5})$", 1)
    return F.substring(digits, 1, 4).try_cast("int"), F.substring(digits, 5, 1).try_cast("int")


def day_month_year(text: Column) -> Column:
    return F.try_to_date(text, "dd/MM/yyyy")


def first_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """The date in the first format that parses."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def exit_term(day: Column, published: Column | None = None) -> tuple[Column, Column]:
    """(year, term) estimated from a diploma date; dates after `published` are ignored.

    January to April belong to term 2 of the year before, May to October to term 1, November and
    December to term 2.
    """
    if published is not None:
        day = F.when(day <= published, day)
    month = F.month(day)
    year = F.when(month <= 4, F.year(day) - 1).otherwise(F.year(day))
    term = F.when(month.isNull(), None).when(month.between(5, 10), 1).otherwise(2)
    return year, term


def permanence(entry_year: Column, exit_year: Column, term: Column) -> Column:
    """Terms between entry (assumed in term 1) and exit."""
    return 2 * (exit_year - entry_year) + term


def valid_permanence(terms: Column, low: int = V.VALID_PERMANENCE[0], high: int = V.VALID_PERMANENCE[1]) -> Column:
    return F.when(terms.between(low, high), terms)


def terms_attended(entry_year: Column, entry_term: Column, year: Column, term: Column) -> Column:
    """Terms from entry to a reference term, both counted; the summer counts as term 1, floor 1."""
    first = F.when(entry_term == 0, 1).otherwise(entry_term)
    return F.greatest((year - entry_year) * 2 + (term - first) + 1, F.lit(1))


def reference_term(file_name: Column) -> tuple[Column, Column]:
    """(year, term) in a file name that ends in `_YYYY_S.csv`; NULLs for another name."""
    pattern = r"_(\d{4})_(\d)\.csv$"
    return tuple(F.regexp_extract(file_name, pattern, part).try_cast("int") for part in (1, 2))


def window_start(year: Column, width: int = 5) -> Column:
    """First year of the window: 2023 -> 2020."""
    return year - year % width


def period_label(period: Column) -> Column:
    return F.concat_ws("/", F.floor(period / 10).cast("string"), (period % 10).cast("string"))


def period_end(period: Column) -> Column:
    """Nominal end: end of February for term 0, 31 July for term 1, 31 December for term 2."""
    year, term = F.floor(period / 10).cast("int"), period % 10
    return (
        F.when(term == 0, F.last_day(F.make_date(year, F.lit(2), F.lit(1))))
        .when(term == 1, F.make_date(year, F.lit(7), F.lit(31)))
        .otherwise(F.make_date(year, F.lit(12), F.lit(31)))
    )


def watermark(published: Column, months: int = V.TOLERANCE_MONTHS) -> Column:
    """Last period whose end plus the tolerance is not after the publication.

    Only six periods can qualify, those of the limit's year and of the year before, so the search
    is an expression and needs no join with a calendar.
    """
    limit = F.add_months(published, -months)
    candidates = [
        (F.year(limit) - back) * 10 + term for back in (0, 1) for term in (2, 1, 0)
    ]
    return F.coalesce(*[F.when(period_end(p) <= limit, p) for p in candidates])
