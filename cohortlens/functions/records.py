"""Keys, fingerprints and JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def natural_key(*columns: Column, separator: str = "|") -> Column:
    """md5 of the joined natural key."""
    return F.md5(F.concat_ws(separator, *columns))


def version_key(name: Column, valid_from: Column) -> Column:
    """md5 of a name with the start of its validity, to the microsecond."""
    return F.md5(F.concat_ws("|", name, F.date_format(valid_from, "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def content_hash(model: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), content), 256)


def sha1_key(*columns: Column) -> Column:
    return F.sha1(F.concat_ws("|", *columns))


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe comparison of two rows of columns."""
    equal = F.lit(True)
    for a, b in zip(left, right, strict=True):
        equal = equal & a.eqNullSafe(b)
    return equal


def row_digest(df: DataFrame) -> Column:
    """64-bit hash of every column of a row, NULL told apart from empty text."""
    parts = []
    for field in sorted(df.columns):
        parts += [F.col(f"`{field}`").isNull(), F.col(f"`{field}`")]
    return F.xxhash64(*parts)


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of every column of a row, null told apart from empty; maps and variants, which Spark does not hash, by their JSON."""
    parts = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        value, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        parts += [value.isNull(), F.to_json(F.struct(value)) if "map<" in kind or "variant" in kind else value]
    return [F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)") for seed in (1, 2)]


def digests(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`by`, and the number of rows and two sums of row hashes of each group: a digest of the rows as a bag.

    Tasks send partial sums, no rows. Unlike digests prove unlike rows. Equal ones are of equal rows but for odds of about 2^-128 a comparison.
    """
    first, second = row_hashes(df)
    return df.select(*by, first.alias("_a"), second.alias("_b")).groupBy(*by).agg(
        F.count("*").alias("_rows"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")
    )


def json_record(*columns: Column, keep_nulls: bool = True) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false" if keep_nulls else "true"})


def ordered_json(order: Column, record: Column) -> Column:
    """JSON array of records in key order. For groups with a known small bound only."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("k"), record.alias("v"))))
    return F.to_json(F.transform(entries, lambda e: e["v"]), {"ignoreNullFields": "false"})
