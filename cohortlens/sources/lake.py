"""Partitioned Parquet tables bound to their folder: windows are Spark's own partitions.

A table is the folder `<root>/<name>`, with its schema and window column described in `<root>/<name>.schema`; nothing is kept in a session
or a catalog, so any later session on the same folder goes on with it. A whole replacement is an overwrite, some windows are replaced by
Spark's dynamic partition overwrite (as an option of the write, no setting of the session), and a window that lost all its rows is
overwritten with none. A layer that must change in several tables at once, or that has several writers, belongs in a table format with
transactions.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.periods import window_start
from ..functions.records import digests, row_digest
from ..session import pinned

ORDER = "_order"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: What Spark replaces by % and two hex digits in the name of a partition's folder, beside control characters.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


@dataclass(frozen=True)
class Description:
    """What a table's folder does not say: the type of its window, and the columns of an empty table."""

    schema: T.StructType
    window: str | None

    def line(self) -> str:
        return json.dumps({"window": self.window, "schema": json.loads(self.schema.json())})


def partition_folder(window: str, value: str | None) -> str:
    """The name that Spark gives the folder of a partition; `value` is the window as text."""
    if value is None:
        return f"{window}={NO_VALUE}"
    return f"{window}=" + "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 else c for c in value)


class Lake:
    """Tables below a folder, by name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def describe(self, table: str) -> Description | None:
        """The table's description, None without such a table."""
        try:
            line = self.spark.read.text(f"{self._path(table)}.schema").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if line is None:
            return None
        held = json.loads(line[0])
        return Description(T.StructType.fromJson(held["schema"]), held["window"])

    def _known(self, table: str) -> Description:
        found = self.describe(table)
        if found is None:
            raise ValueError(f"there is no table {table} in {self.root}")
        return found

    def exists(self, table: str) -> bool:
        return self.describe(table) is not None

    def window_of(self, table: str) -> str | None:
        """The column that a table is partitioned by."""
        return self._known(table).window

    def windows(self, table: str) -> list:
        """The windows that have rows; rows without a window come last as None."""
        return _in_order(r[0] for r in self.read(table).select(self.window_of(table)).distinct().collect())

    def read(self, table: str, first: int | None = None, last: int | None = None, width: int = 5) -> DataFrame:
        """The rows; with `first` and `last` years, only the windows that can hold them are read."""
        known = self._known(table)
        df = self.spark.read.schema(known.schema).parquet(self._path(table))
        window = F.col(known.window) if first is not None or last is not None else None
        if first is not None:
            df = df.filter(window >= first - first % width)
        if last is not None:
            df = df.filter(window <= last - last % width)
        return df

    def _write(self, df: DataFrame, path: str, window: str | None, mode: str, partitions: str = "static") -> None:
        writer = df.write.mode(mode).option("partitionOverwriteMode", partitions).option("compression", "zstd")
        writer = writer.option("parquet.compression.codec.zstd.level", 3)
        (writer.partitionBy(window) if window else writer).parquet(path)

    def replace(self, table: str, df: DataFrame, window: str | None = None) -> int:
        """The whole table; returns its rows. With `window`, it is partitioned by that column. Rows that come from the table itself are refused."""
        own = f"{urlsplit(self._path(table)).path}/"
        if any(unquote(urlsplit(file).path).startswith(own) for file in df.inputFiles()):
            raise ValueError(f"{table} can't be replaced by rows that are read from it: write them aside first")
        if window:
            # Rows of a window are spread over files by size, not squeezed into one task.
            df = df.select(*[c for c in df.columns if c != window], window).hint("rebalance", window)
        described = Description(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), window)
        self._write(df, self._path(table), window, "overwrite")
        if self.describe(table) != described:
            line = self.spark.createDataFrame([(described.line(),)], "line string")
            line.coalesce(1).write.mode("overwrite").text(f"{self._path(table)}.schema")
        return self.read(table).count()

    def append(self, table: str, df: DataFrame) -> None:
        known = self._known(table)
        self._write(df.select(*_typed(known.schema)), self._path(table), known.window, "append")

    def replace_windows(self, table: str, df: DataFrame, windows: Iterable) -> int:
        """Only the given windows, None among them; one that has no rows in `df` is emptied. Returns the rows written.

        Columns and types stay those of the stored table.
        """
        known = self._known(table)
        window = known.window
        if window is None:
            raise ValueError(f"{table} has no windows to replace")
        wanted = set(windows)
        if not wanted:
            return 0
        values = [w for w in wanted if w is not None]
        chosen = F.col(window).isin(*values) if values else F.lit(False)
        if None in wanted:
            chosen = chosen | F.col(window).isNull()
        rows = pinned(df.select(*_typed(known.schema)).filter(chosen))
        counts = {r[0]: r["count"] for r in rows.groupBy(window).count().collect()}
        if counts:
            self._write(rows.hint("rebalance", window), self._path(table), window, "overwrite", "dynamic")
        gone = _in_order(set(self.windows(table)) & wanted - set(counts))
        if gone:
            named = self.spark.range(1).select(*[F.lit(w).cast(known.schema[window].dataType).cast("string") for w in gone]).first()
            for value in named:
                self._write(rows.limit(0).drop(window), f"{self._path(table)}/{partition_folder(window, value)}", None, "overwrite")
        return sum(counts.values())

    def changed_windows(self, table: str, df: DataFrame, window: str | None = None, exact: bool = False) -> list:
        """Windows whose rows differ from the stored ones, in any column; every window if there is no table yet."""
        known = self.describe(table)
        window = window or (known.window if known else None)
        if known is None or window not in known.schema.names:
            found = df.select(window)
        elif set(known.schema.names) != set(df.columns):
            found = df.select(window).union(self.read(table).select(window))
        else:
            found = window_differences(df, self.read(table), window, exact)
        return _in_order(r[0] for r in found.distinct().collect())

    def export_windows(self, tables: dict[str, tuple[DataFrame, str | None]], windows: Sequence) -> dict[str, int]:
        """The given windows of every table that has windows; rows written per table. A table that is not there yet is written whole."""
        return {
            name: self.replace_windows(name, df, windows) if self.exists(name) else self.replace(name, df, window)
            for name, (df, window) in tables.items() if window
        }

    def export_changed(self, tables: dict[str, tuple[DataFrame, str | None]], exact: bool = False) -> dict[str, int]:
        """What differs from the stored tables: windows, or whole tables that have none; rows written per table."""
        written = {}
        for name, (df, window) in tables.items():
            known = self.describe(name)
            if known is None or known.window != window or set(known.schema.names) != set(df.columns):
                written[name] = self.replace(name, df, window)
            elif window:
                written[name] = self.replace_windows(name, df, self.changed_windows(name, df, exact=exact))
            else:
                written[name] = self.replace(name, df) if table_changed(df, self.read(name), exact) else 0
        return written

    def compact(self, table: str) -> None:
        """The same rows in files of the advisory partition size. They are written aside first, as a table can't overwrite what it reads."""
        self.replace(table, pinned(self.read(table)).hint("rebalance"), self.window_of(table))


def _in_order(windows: Iterable) -> list:
    return sorted(windows, key=lambda w: (w is None, w if w is not None else 0))


def _typed(schema: T.StructType) -> list[Column]:
    return [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]


def with_window(df: DataFrame, year: str, name: str = "window", width: int = 5) -> DataFrame:
    return df.withColumn(name, window_start(F.col(year), width))


def _tagged(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with how much more often."""
    both = new.withColumn("_n", F.lit(1)).unionByName(old.withColumn("_n", F.lit(-1)))
    return both.groupBy(*new.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")


def _as(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old` with the columns and types of `new`."""
    return old.select(*_typed(new.schema))


def window_differences(new: DataFrame, old: DataFrame, window: str, exact: bool = False) -> DataFrame:
    """Windows that gained, lost or changed rows, including those that only one side has.

    Digests are compared, of one row a window. With `exact`, the rows themselves, in a shuffle of both tables.
    """
    old = _as(old, new)
    if exact:
        return _tagged(new, old).select(window).distinct()
    sides = digests(new, [window]).withColumn("_side", F.lit(1)).unionByName(digests(old, [window]).withColumn("_side", F.lit(-1)))
    sums = sides.groupBy(window).agg(*[F.sum(F.col(c) * F.col("_side")).alias(c) for c in ("_rows", "_a", "_b")])
    return sums.filter("_rows <> 0 OR _a <> 0 OR _b <> 0").select(window)


def table_changed(new: DataFrame, old: DataFrame, exact: bool = False) -> bool:
    """Whether two tables differ as bags of rows: by their digests, or with `exact` by the rows themselves."""
    if set(new.columns) != set(old.columns):
        return True
    old = _as(old, new)
    if exact:
        return not _tagged(new, old).isEmpty()
    return digests(new).first() != digests(old).first()


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint) that does not depend on row order."""
    return df.select(row_digest(df).alias("_h")).agg(
        F.count("*").alias("rows"),
        F.sha2(
            F.concat_ws(
                "|", F.count("*"), F.sum(F.col("_h").cast("decimal(38,0)")), F.coalesce(F.bit_xor("_h"), F.lit(0))
            ),
            256,
        ).alias("fingerprint"),
    )


def stored_order(df: DataFrame, order: str = ORDER, control: Sequence[str] = ()) -> DataFrame:
    """Rows in stored order, without the control columns."""
    return df.orderBy(order).drop(order, *control)


def live(df: DataFrame, with_deleted: bool = False) -> DataFrame:
    return df if with_deleted else df.filter(~F.col("_deleted"))


def json_snapshot(tables: dict[str, tuple[DataFrame, Sequence[Column]]]) -> DataFrame:
    """Every table as JSON records: (place of the table, table, sort_key, record). Write it sorted, one line per record."""
    result = None
    for place, (name, (df, order)) in enumerate(tables.items(), start=1):
        part = df.select(
            F.lit(place).alias("place"), F.lit(name).alias("table"),
            F.struct(*order).cast("string").alias("sort_key") if len(order) > 1 else order[0].cast("string").alias("sort_key"),
            F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"),
        )
        result = part if result is None else result.unionByName(part)
    return result


def upsert_reports(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports (name, content) with a newer one in place of an older one of the same name."""
    sides = stored.select("name", "content", F.lit(0).alias("_new")).unionByName(
        reports.select("name", "content", F.lit(1).alias("_new"))
    )
    return sides.groupBy("name").agg(F.max_by("content", "_new").alias("content"))
