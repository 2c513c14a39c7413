"""Published text files: delimited scans, versions of one file, pages, JSON series, provenance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as V
from ..functions.numbers import decimal_comma
from ..functions.text import page_text
from ..operators.ordering import top_per_group

BAD = "_malformed"


class MissingColumns(ValueError):
    """A file lacks columns that the allow-list names."""


def delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], separator: str = ",",
              encoding: str = "UTF-8", multiline: bool = False) -> DataFrame:
    """Every column as text, nothing decoded to NULL; malformed lines keep their text in `_malformed`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, BAD)])
    reader = (
        spark.read.schema(schema)
        .option("header", True).option("enforceSchema", False)
        .option("sep", separator).option("encoding", encoding)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
        .option("nullValue", "\u0000").option("emptyValue", "")
        .option("columnPruning", False).option("multiLine", multiline).option("quote", '"').option("escape", '"')
    )
    df = reader.csv(path if isinstance(path, str) else list(path))
    # A missing trailing field is malformed; an empty field is empty text, not NULL.
    return df.select(
        *[F.when(F.col(BAD).isNull(), F.coalesce(c, F.lit(""))).otherwise(F.col(c)).alias(c) for c in columns], BAD
    )


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(BAD).isNull()).drop(BAD)


def line_counts(df: DataFrame) -> DataFrame:
    """(kept, dropped) lines. The first column takes part because Spark refuses to read `_malformed` alone."""
    read = F.coalesce(F.length(df.columns[0]), F.lit(0)) >= 0
    good = F.col(BAD).isNull()
    return df.agg(F.count_if(read & good).alias("kept"), F.count_if(read & ~good).alias("dropped"))


def minimised(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the allowed columns; a listed column that is absent stops the load."""
    absent = sorted(set(allowed) - set(df.columns))
    if absent:
        raise MissingColumns(f"expected columns are absent: {absent}")
    return df.select(*allowed)


def resources(listing: DataFrame, url: str, modified: str, pattern: str) -> DataFrame:
    """Newest publication of each file name that matches, with `file_name`."""
    named = listing.withColumn("file_name", F.regexp_extract(url, r"([^/]*)$", 1))
    matching = named.filter(F.col("file_name").rlike(f"(?i){pattern}"))
    return top_per_group(matching, ["file_name"], [F.desc(modified), F.desc(url)])


def newest_resource(listing: DataFrame, url: str, modified: str, pattern: str) -> DataFrame:
    return resources(listing, url, modified, pattern).orderBy(F.desc(modified), F.desc("file_name")).limit(1)


def stacked_versions(versions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """(rows, file name, publication date) stacked, each row tagged; columns a version lacks are NULL."""
    result = None
    for df, name, day in versions:
        part = df.withColumn("source_file", F.lit(name)).withColumn("published", F.lit(day))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def tagged_scan(df: DataFrame, published: dict[str, str]) -> DataFrame:
    """One scan of many versions of a file, each row tagged by the file it came from."""
    days = [F.lit(x) for pair in published.items() for x in pair]
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1)
    return df.withColumn("source_file", name).withColumn(
        "published", F.try_element_at(F.create_map(*days), F.col("source_file"))
    )


def filtered_ingest(rows: DataFrame, dimension: DataFrame, key: str, row_filter: Column,
                    dimension_filter: Column) -> DataFrame:
    """Big rows cut by a filter and an inner join with a filtered dimension, before anything is written.

    Both filters reach the scans; Spark broadcasts the dimension when its size allows it.
    """
    return rows.filter(row_filter).join(dimension.filter(dimension_filter), key)


def decode_nulls(df: DataFrame, tokens: Sequence[str] = V.NULL_TOKENS) -> DataFrame:
    """NULL in place of the null tokens, in every text column."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin(*tokens), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema
        ]
    )


def page_value(html: Column, pattern: str = V.GRANT_VALUE_PATTERN) -> Column:
    """Amount that the pattern captures in the visible text of a page."""
    return decimal_comma(F.nullif(F.regexp_extract(page_text(html), pattern, 1), F.lit("")))


def json_series(spark: SparkSession, path: str, field: str, columns: dict[str, str]) -> DataFrame:
    """Entries of an array inside JSON documents, ordered by the first column. `columns` gives each required field its type."""
    schema = f"{field} array<struct<{', '.join(f'{c}: {kind}' for c, kind in columns.items())}>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(field).alias("e"))
    checked = rows.select("e.*")
    for c in columns:
        checked = checked.withColumn(
            c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
                F.raise_error(F.lit(f"an entry of {field} has no {c}")).cast(checked.schema[c].dataType)
            )
        )
    return checked.orderBy(next(iter(columns)))


def _where_broken(content: bytes) -> tuple[int, str]:
    """(line, evidence) of the first byte that breaks the encoding."""
    try:
        content.decode()
    except UnicodeDecodeError as found:
        at = found.start
        begin = content.rfind(b"\n", 0, at) + 1
        shown = content[begin:begin + 80].split(b"\n", 1)[0]
        return content.count(b"\n", 0, at) + 1, f"byte 0x{content[at]:02x} is not UTF-8: {shown!r}"
    raise ValueError("the content is UTF-8")


def content_provenance(df: DataFrame, name: str, content: str) -> DataFrame:
    """One row per content: size, sha256, whether all of it is UTF-8, and the first bad line.

    Size, hash and validity are computed in the JVM over the whole content; only contents that are not UTF-8 go to Python.
    """
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    rows = df.select(
        F.col(name).cast("string").alias("name"),
        F.octet_length(content).cast("bigint").alias("bytes"),
        F.sha2(F.col(content), 256).alias("sha256"),
        valid.alias("valid_utf8"),
        F.when(~valid, F.col(content)).alias("broken"),
    )

    def check(batches) -> Iterator:
        for batch in batches:
            found = [None if b is None else _where_broken(bytes(b)) for b in batch.pop("broken")]
            yield batch.assign(
                bad_line=[f[0] if f else None for f in found], evidence=[f[1] if f else None for f in found]
            ).astype({"bad_line": "Int64"})

    return rows.mapInPandas(
        check, "name string, bytes bigint, sha256 string, valid_utf8 boolean, bad_line bigint, evidence string"
    )


INGESTION = (
    "table", "source", "package", "resource", "loaded_at", "bytes", "sha256", "encoding", "separator", "rows", "dropped",
    "valid_utf8", "bad_line", "evidence", "metadata",
)


def ingestion_record(contents: DataFrame, counts: DataFrame, table: str, source: str, resource: Column, loaded_at: Column,
                     encoding: str = "UTF-8", separator: str = ",", package: str | None = None,
                     metadata: Column | None = None) -> DataFrame:
    """One row per content for the ledger of loads.

    `contents` comes from `content_provenance`, `counts` is the one row (kept, dropped) of `line_counts`.
    """
    lines = counts.select(F.struct("kept", "dropped")).scalar()
    return contents.withColumn("lines", lines).select(
        F.lit(table).alias("table"), F.lit(source).alias("source"), F.lit(package).cast("string").alias("package"),
        resource.alias("resource"), loaded_at.alias("loaded_at"), "bytes", "sha256", F.lit(encoding).alias("encoding"),
        F.lit(separator).alias("separator"), F.col("lines.kept").alias("rows"), F.col("lines.dropped").alias("dropped"),
        "valid_utf8", "bad_line", "evidence", (F.lit(None) if metadata is None else metadata).cast("string").alias("metadata"),
    )


def upsert_ingestions(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """The ledger with one row per table: a fresh record takes the place of the stored one."""
    tagged = ledger.select(*INGESTION, F.lit(0).alias("_fresh")).unionByName(fresh.select(*INGESTION, F.lit(1).alias("_fresh")))
    newest = F.struct("_fresh", "loaded_at", "resource")
    return tagged.groupBy("table").agg(F.max_by(F.struct(*INGESTION[1:]), newest).alias("r")).select("table", "r.*")


def looks_misread(record: Column, encoding: Column) -> Column:
    """Whether a file read as Latin-1 would also be UTF-8, which hints at a change of the source."""
    return F.coalesce(record & F.lower(encoding).startswith("latin"), F.lit(False))


def provenance(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Provenance of the files below a folder, by file name. Spark refuses a file above its `binaryFile` limit of 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return content_provenance(
        files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1)), "file_name", "content"
    )
