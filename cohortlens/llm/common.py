"""Small shared parts of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import joined_on, numbered_per_group
from ..session import pinned

#: A word: a run of code points that are neither a space nor one of tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a written table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (a written table of narrow rows) with a broadcast hint if it has at most `limit` rows, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def key_string(*columns: Column) -> Column:
    """One string per key; a null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.concat_ws("\x1f", *parts)


def hash60(value: Column) -> Column:
    """The first 60 bits of the MD5 of a string, a number that SQL engines agree on."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


#: Equal rows that are dealt out by one row of a counted table.
COPIES = 4096


def each_copy(counted: DataFrame, n: str, name: str) -> DataFrame:
    """Rows of a counted table as often as `n` says, `name` being the number of the copy from 0."""
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES))
    dealt = counted.withColumn("__block", F.explode(blocks))
    inside = F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col(n) - F.col("__block") * COPIES) - 1)
    return dealt.withColumn("__in", F.explode(inside)).withColumn(name, F.col("__block") * COPIES + F.col("__in")).drop("__block", "__in", n)


def with_copy_number(df: DataFrame, same: Sequence[str], name: str) -> DataFrame:
    """`df` with the number from 0 of each row among the rows equal in `same`; which of them has which number is open.

    Rows that have no equal are left where they are. The others, however many of one kind, are numbered in ranges.
    """
    again = pinned(df.groupBy(*same).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n"))
    none = F.lit(0).cast("long").alias(name)
    if again.isEmpty():
        return df.select("*", none)
    known = sized_broadcast(again)
    repeated = joined_on(df, known, same, "left_semi").withColumn("__same", F.struct(*same)).withColumn("__tie", F.monotonically_increasing_id())
    placed = numbered_per_group(repeated, "__same", [F.asc("__tie")], "__at")
    single = joined_on(df, known, same, "left_anti").select("*", none)
    return single.unionByName(placed.select(*df.columns, (F.col("__at") - 1).cast("long").alias(name)))


def place_in_class(rows: DataFrame, cls: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds the place from 0 of each row among the rows of its class, in the given order.

    A class, or rows that are equal in all of the order, may be a large share of the table: rows are numbered in ranges, which rows that are
    equal share by a tie of their own. `rows` should be a written table.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    placed = numbered_per_group(tied, cls, [*[F.asc(c) for c in order], F.asc("__tie")], "__at")
    return placed.withColumn(name, (F.col("__at") - 1).cast("long")).drop("__at", "__tie")
