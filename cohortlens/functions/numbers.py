"""Rounding, guarded ratios and number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column, digits: int) -> Column:
    """Floating-point rounding with ties to even: 8.125 -> 8.12, 8.375 -> 8.38."""
    scale = float(10**digits)
    return F.rint(value.cast("double") * F.lit(scale)) / F.lit(scale)


def percent(part: Column, whole: Column, digits: int | None = 2, empty: float | None = None) -> Column:
    """`part / whole * 100`; a zero or missing `whole` gives `empty`."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
    ratio = half_even(ratio, digits) if digits is not None else ratio
    return ratio if empty is None else F.coalesce(ratio, F.lit(float(empty)))


def ratio(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """`part / whole`, NULL when `whole` is zero."""
    value = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return half_even(value, digits) if digits is not None else value


def grouped_integer(text: Column, separator: str = ",") -> Column:
    """'2,010' -> 2010; text that is not a number gives NULL."""
    return F.replace(F.trim(text), F.lit(separator), F.lit("")).try_cast("int")


def decimal_comma(text: Column) -> Column:
    """'1.234,56' -> 1234.56."""
    return F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".").try_cast("double")


def exact_sum(value: Column, digits: int = 2) -> Column:
    """Sum through decimals, so that the result does not depend on the order of the rows."""
    return F.sum(value.cast(f"decimal(28,{digits})")).cast("double")


def no_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))
