"""Vectors that take part: the rules that the vector operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def is_sound(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def common_length(df: DataFrame, vector: str, multiple: int = 1) -> int:
    """The commonest vector length that is a multiple of `multiple`, the greater of two as common; 0 without any."""
    size = F.size(F.col(vector))
    lengths = df.filter((size > 0) & (size % multiple == 0)).groupBy(size.alias("size")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    return top.size if top else 0
