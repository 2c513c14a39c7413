"""Keyword classifiers, recodes, bands and the labels built from them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed_values as V
from .text import normalize_text


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a word occurs anywhere in the text; one pattern, so the text is evaluated once."""
    return text.rlike("|".join(re.escape(w) for w in words))


def first_match(rules: Iterable[tuple[Column, str]], default: str | None) -> Column:
    """Label of the first rule that holds."""
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def recode(value: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), value)
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def only(value: Column, allowed: Iterable[str]) -> Column:
    """The value if it is in the domain, else NULL."""
    return F.when(value.isin(*allowed), value)


def exit_reason(text: Column) -> Column:
    reason = normalize_text(text)
    return first_match(
        [(reason.contains(V.GRADUATED), V.GRADUATED), (contains_any(reason, V.DROPOUT_WORDS), V.DROPPED)],
        V.OTHER,
    )


def status_outcome(text: Column) -> Column:
    return recode(normalize_text(text), V.STATUS_OUTCOMES, V.OTHER)


def shift_group(shift: Column) -> Column:
    return first_match([(shift.contains("NOTURNO"), "NOTURNO"), (shift.contains("INTEGRAL"), "INTEGRAL")], "DIURNO")


def degree_category(degree: Column) -> Column:
    return first_match([(F.coalesce(degree, F.lit("")).contains("LICENCI"), "LICENCIATURA")], "BACHARELADO")


def campus_name(text: Column, names=V.CAMPUS_NAMES) -> Column:
    return first_match([(text.contains(word), name) for word, name in names], V.MAIN_CAMPUS)


def grant_campus(text: Column) -> Column:
    return campus_name(text, V.GRANT_CAMPUS_NAMES)


def grant_kind(text: Column) -> Column:
    kind = normalize_text(text)
    return first_match(
        [(kind.contains("REMUNERADA"), "REMUNERADA"), (kind.contains("VOLUNTARIA"), "VOLUNTARIA")], "NAO INFORMADO"
    )


def knowledge_area(area: Column, programme: Column) -> Column:
    """The area, except for the residual one, which is looked up by programme."""
    return F.when(area == V.DEFAULT_AREA, recode(programme, V.AREA_OVERRIDES, V.DEFAULT_AREA)).otherwise(area)


def social_profile(quota: Column) -> Column:
    """Struct (profile, quota, income, is_quota) of one normalised quota text."""
    open_seat = quota.isin(*V.OPEN_SEATS)

    def label(rules: Iterable[tuple[tuple[tuple[str, ...], ...], str]], default: str) -> Column:
        """The label of the first rule all of whose word groups have a word in the text."""
        found = [(reduce(and_, [contains_any(quota, words) for words in groups]), name) for groups, name in rules]
        return first_match([(open_seat, V.OPEN_LABELS[default]), *found], default)

    return F.struct(
        label(V.PROFILE_RULES, V.OTHER_PROFILE).alias("profile"), label(V.QUOTA_RULES, V.OTHER_QUOTA).alias("quota"),
        label(V.INCOME_RULES, V.OTHER_INCOME).alias("income"), (~open_seat).alias("is_quota"),
    )


def with_social_profile(df: DataFrame, text: Column) -> DataFrame:
    """The four attributes as columns. The text is normalised in a step of its own, once per row."""
    return df.withColumn("_quota", normalize_text(text)).withColumn("_p", social_profile(F.col("_quota"))).select(
        *df.columns, "_p.*"
    )


def band(value: Column, bands, lowest: str, missing: str) -> Column:
    """Verbal band of a number; `bands` are (threshold, label), highest threshold first."""
    return F.when(value.isNull(), missing).otherwise(
        first_match([(value >= threshold, label) for threshold, label in bands], lowest)
    )


def dropout_band(rate: Column) -> Column:
    return band(rate, V.DROPOUT_BANDS, V.DROPOUT_LOWEST, V.DROPOUT_MISSING)


def delay_band(delay: Column) -> Column:
    return band(delay, V.DELAY_BANDS, V.DELAY_LOWEST, V.DELAY_MISSING)


def sign_label(gap: Column, above: str = "Acima", below: str = "Abaixo") -> Column:
    return F.when(gap > 0, above).otherwise(below)
