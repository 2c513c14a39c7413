"""Registry of queries: a name, its output columns, the Spark job and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


# Schemas by path: reading one from the footers is a job of its own, so it is done once per table.
_SCHEMAS: dict[str, T.StructType] = {}


class Tables:
    """The test tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        path = self.path(name)
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


@dataclass(frozen=True)
class Plan:
    name: str
    covers: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in self.columns])

    @cached_property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(f'CAST("{n}" AS {_SQL_TYPES[t]}) AS "{n}"' for n, t in self.columns)
        return f"SELECT {casts} FROM ({self.sql.strip()}) AS result"


PLANS: dict[str, Plan] = {}


def plan(columns: str, covers: str, sql: str | None = None, name: str | None = None):
    """Register a query. `columns` lists types followed by names: 'string course; bigint total rank'."""
    fields = []
    for group in columns.split(";"):
        kind, *names = group.split()
        fields += [(n, kind) for n in names]

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        if key in PLANS:
            raise ValueError(f"query {key} is registered twice")
        PLANS[key] = Plan(key, covers, tuple(fields), build, sql)
        return build

    return register
