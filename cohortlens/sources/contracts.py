"""Write contracts: the schema of a table decides what may be written to it."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

logger = logging.getLogger(__name__)


class ContractError(ValueError):
    """A DataFrame does not fit the schema of its table."""


def prepare(df: DataFrame, schema: T.StructType, table: str, defaults: Sequence[str] = ()) -> DataFrame:
    """`df` in the columns and types of the table.

    Unknown columns and absent required ones stop the write before it starts. Absent nullable ones
    are written as NULL, with a warning. A value that an integer column cannot hold without loss
    stops the job that writes it.
    """
    names = [f.name for f in schema]
    extra = sorted(set(df.columns) - set(names))
    if extra:
        raise ContractError(f"{table}: columns outside the schema: {extra}")
    absent = [f for f in schema if f.name not in df.columns and f.name not in defaults]
    required = [f.name for f in absent if not f.nullable]
    if required:
        raise ContractError(f"{table}: required columns are absent: {required}")
    if absent:
        logger.warning("%s: absent columns written as NULL: %s", table, [f.name for f in absent])
    out = []
    for f in schema:
        if f.name not in df.columns:
            if f.name not in defaults:
                out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.IntegralType):
            out.append(_whole(df, f).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def _whole(df: DataFrame, field: T.StructField):
    value = F.col(field.name)
    if isinstance(df.schema[field.name].dataType, T.StringType):
        wide = value.try_cast("decimal(38,10)")
    else:
        wide = value.cast("decimal(38,10)")
    whole = wide.try_cast(field.dataType)
    fits = value.isNull() | F.coalesce(wide == whole.cast("decimal(38,10)"), F.lit(False))
    return F.when(fits, whole).otherwise(
        F.raise_error(F.concat(F.lit(f"{field.name}: not a whole {field.dataType.simpleString()}: "), value.cast("string")))
        .cast(field.dataType)
    )


def lossy_rows(df: DataFrame, column: str, target: T.DataType) -> DataFrame:
    """Rows that `prepare` would refuse for an integer column."""
    wide = F.col(column).try_cast("decimal(38,10)")
    whole = wide.try_cast(target)
    fits = F.col(column).isNull() | F.coalesce(wide == whole.cast("decimal(38,10)"), F.lit(False))
    return df.filter(~fits)
