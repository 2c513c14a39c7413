"""Third normal form from flat rows: courses, curriculum structures, people, movements and grants.

Ids are hashes of natural keys: an identical reload gives identical ids, and no table is sorted to number its rows. Names of the sources
meet the structures through the alias rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.records import sha1_key
from ..session import pinned
from .ordering import sized
from .resolve import latest_per_key, resolve


def courses(catalogue: DataFrame, name: str, attributes: dict[str, Column]) -> DataFrame:
    """One row per offer of the catalogue with its derived attributes."""
    return catalogue.select(sha1_key(F.col(name)).alias("course_id"), "*", *[c.alias(a) for a, c in attributes.items()])


def structures(curricula: DataFrame, courses_: DataFrame, name: str, attributes: Sequence[str]) -> DataFrame:
    """The curriculum of each name, with its course where the catalogue has one."""
    known = courses_.select(F.col(name).alias("_course"), "course_id")
    joined = curricula.join(known, F.col(name) == F.col("_course"), "left")
    return joined.select(sha1_key(F.col(name)).alias("structure_id"), "course_id", name, *attributes)


def people(rows: DataFrame, person: str, attributes: Sequence[str], *newest_first: Column) -> DataFrame:
    """One row per person with the attributes of the newest row."""
    newest = latest_per_key(rows, person, *newest_first)
    return newest.select(sha1_key(F.col(person)).alias("person_id"), person, *attributes)


def places(names: DataFrame, name: str, rules: DataFrame, structures_: DataFrame, canonical: str, origin: str = "origin", target: str = "target") -> DataFrame:
    """Each distinct published name with the structure and course of the name that it resolves to, null without one.

    Names are resolved here once; rows then meet this written table, which is broadcast if it has few rows.
    """
    resolved = resolve(names.select(name).distinct(), rules, name, origin, target, "_name")
    known = structures_.select(F.col(canonical).alias("_known"), "structure_id", "course_id")
    joined = resolved.join(known, F.col("_name") == F.col("_known"), "left")
    return sized(pinned(joined.select(F.col(name).alias("_published"), "structure_id", "course_id")))


def movements(rows: DataFrame, key: str, people_: DataFrame, person: str, places_: DataFrame, name: str, attributes: Sequence[str]) -> DataFrame:
    """Rows of known people whose resolved name has a structure. The others stay out: `without_structure` counts them."""
    known = places_.filter(F.col("structure_id").isNotNull())
    who = people_.select(F.col(person).alias("_person"), "person_id")
    joined = rows.join(known, F.col(name) == F.col("_published")).join(who, F.col(person) == F.col("_person"))
    return joined.select(sha1_key(F.col(key)).alias("movement_id"), "person_id", "course_id", "structure_id", *attributes)


def without_structure(rows: DataFrame, movements_: DataFrame) -> DataFrame:
    """One row: how many rows have no place in the movements."""
    total = rows.agg(F.count("*").alias("rows"))
    return total.withColumn("kept", movements_.agg(F.count("*")).scalar()).select("rows", "kept", (F.col("rows") - F.col("kept")).alias("left_out"))


def grants(rows: DataFrame, key: str, places_: DataFrame, name: str, attributes: Sequence[str]) -> DataFrame:
    """Every grant, with its structure and course where the resolved name has them. No person is kept."""
    joined = rows.join(places_, F.col(name) == F.col("_published"), "left")
    return joined.select(sha1_key(F.col(key)).alias("grant_id"), "course_id", "structure_id", *attributes)
