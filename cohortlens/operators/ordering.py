"""Order-sensitive building blocks that never bring a whole group or table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..session import pinned


BROADCAST_ROWS = 20_000


def literal_table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A constant table, hinted for broadcast because its size is fixed in the code; larger ones are refused."""
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("a literal table is for values that are written in the code")
    fields = T.StructType.fromDDL(schema)
    entries = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows
    ]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*entries))))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each group.

    Spark keeps `n` rows per group and task before the shuffle, so a hot group stays small.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def ranked_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "position"
) -> DataFrame:
    """As `top_per_group`, with the position kept."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows with a broadcast hint if it has at most `limit` rows, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """`row_number()` over the whole table: range partitions, then one offset per partition."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pinned(ranges.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per partition: the broadcast is bounded by the partition count, not by the data.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local + 1)
        .drop("_at", "_part", "_before")
    )


def numbered_per_group(df: DataFrame, key: str, order: Sequence[Column], name: str = "position") -> DataFrame:
    """`row_number()` per key with hot keys spread over tasks: numbers of the whole table, less the first of the key."""
    placed = numbered(df, F.asc(key), *order, name="_place")
    first = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_place").alias("_first"))
    joined = placed.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int")).drop("_place", "_key", "_first")


def ranked(df: DataFrame, metric: str, name: str = "position", descending: bool = True) -> DataFrame:
    """`rank()` by a metric: rows per value, running counts inside ranges of values, and one offset per range."""
    order = F.col(metric).desc() if descending else F.col(metric).asc()
    values = df.groupBy(metric).agg(F.count("*").alias("_n"))
    placed = pinned(values.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per range of values: the window and the broadcast are bounded by the partition count.
    starts = placed.groupBy("_part").agg(F.sum("_n").alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    ranks = placed.withColumn("_run", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(starts), "_part").select(
        F.col(metric).alias("_value"), (F.col("_start") + F.col("_run") + 1).alias(name)
    )
    return df.join(ranks, F.col(metric).eqNullSafe(F.col("_value"))).drop("_value")


def bounded_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str) -> DataFrame:
    """Exact continuous percentiles of a column with a small domain (terms, days, rounded rates).

    Rows are counted per value first; the buffer of `percentile` then holds one entry per value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.percentile(value, list(probs), F.col("_n")).alias(name))


def joined_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns that both sides have, null being equal to null; the left side's keys stay."""
    named = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(named, same, how).drop(*[f"_on_{k}" for k in keys])


#: Places that a percentile may be off in its sketch, as a share of the rows: one in so many.
SKETCH = 10_000


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], sketch: int = SKETCH) -> DataFrame:
    """Exact continuous percentiles of any numeric column, with hot groups spread over tasks; null keys are a group.

    A quantile sketch gives each wanted place a bracket of values that holds it, about four in `sketch` rows wide. A second pass counts rows
    by value inside the brackets and as a whole between them, so of all rows only the brackets' distinct values are shuffled and put in
    order. Groups for which a place is not in its bracket (by the sketch's guarantee none), or that hold NaN, are counted by value throughout.
    `df` is read twice.
    """
    names = sorted(probs, key=lambda n: probs[n])
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    off = 2 / sketch
    asked = [min(1.0, max(0.0, probs[n] + side)) for n in names for side in (-off, off)]
    odd = F.isnan("_v") if df.schema[value].dataType.typeName() in ("double", "float") else F.lit(False)
    # A group whose every row fits the sketch's error has brackets as wide as itself.
    brackets = pinned(rows.groupBy(*keys).agg(
        F.percentile_approx("_v", asked, sketch).alias("_b"), F.coalesce(F.bool_or(odd), F.lit(False)).alias("_odd")
    ))
    fine = brackets.filter("NOT _odd").select(*keys, "_b")
    near = joined_on(rows, sized(fine), keys) if keys else rows.withColumn("_b", fine.scalar()).filter(F.col("_b").isNotNull())
    pairs = [(F.col("_b")[2 * i], F.col("_b")[2 * i + 1]) for i in range(len(names))]
    inside, past = F.lit(False), F.lit(0)
    for low, high in pairs:
        inside = inside | F.col("_v").between(low, high)
        past = past + (F.col("_v") > high).cast("int")
    cells = near.groupBy(*keys, F.when(~inside, past).alias("_gap"), F.when(inside, F.col("_v")).alias("_own")).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_v")
    )
    found = _places(cells.withColumn("_whole", F.col("_gap").isNotNull()).drop("_gap", "_own"), keys, probs)
    missed = F.lit(False)
    for n in names:
        missed = missed | F.col(f"_{n}_whole")
    found = pinned(found.withColumn("_missed", missed))
    again = brackets.filter("_odd").select(*keys).unionByName(found.filter("_missed").select(*keys))
    result = _between(found.filter("NOT _missed"), keys, probs)
    if again.isEmpty():
        return result
    rest = joined_on(rows, again, keys, "left_semi") if keys else rows
    counted = rest.groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_whole", F.lit(False))
    return result.unionByName(_between(_places(counted, keys, probs), keys, probs))


def _places(cells: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """The two values next to each wanted place, from rows counted by value (`_v`, `_n`); `_whole` marks counts of more than one value.

    Cells are range-partitioned; running counts inside each range plus one offset per (group, range) give the places of every cell.
    """
    order = [*keys, "_v"]
    placed = pinned(cells.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    running = W.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumn("_run", F.sum("_n").over(running))
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    by_part = W.partitionBy(*keys).orderBy("_part") if keys else W.orderBy("_part")
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = totals.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_size").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    end = F.col("_before") + F.col("_run")
    start = end - F.col("_n")
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = ((start <= low) & (low < end)) | ((start <= high) & (high < end))
        picks += [
            F.max(F.when((start <= low) & (low < end), F.col("_v"))).alias(f"_{name}_low"),
            F.max(F.when((start <= high) & (high < end), F.col("_v"))).alias(f"_{name}_high"),
            F.max(at - low).alias(f"_{name}_part"),
            F.coalesce(F.bool_or(holds & F.col("_whole")), F.lit(False)).alias(f"_{name}_whole"),
        ]
    return joined_on(local, offsets, [*keys, "_part"]).groupBy(*keys).agg(*picks)


def _between(found: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    low, high, part = (lambda n: F.col(f"_{n}_low")), (lambda n: F.col(f"_{n}_high")), (lambda n: F.col(f"_{n}_part"))
    return found.select(*keys, *[(low(n) * (1 - part(n)) + high(n) * part(n)).alias(n) for n in probs])


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, first: str | None = None
) -> DataFrame:
    """`lag(column)` per key with hot keys spread over tasks.

    Rows are range-partitioned by key and order. Inside a range the lag is local; the first row of
    a key in a range takes the last value of that key in the range before. `first` names an
    optional flag for the first row of a key. A null key is a key.
    """
    placed = pinned(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    local = placed.withColumn("_lag", F.lag(column).over(inside)).withColumn("_rn", F.row_number().over(inside))
    edge = placed.groupBy(*keys, "_part").agg(F.max_by(F.struct(column), F.struct(*order)).alias("_edge"))
    carried = edge.select(*keys, "_part", F.lag("_edge").over(W.partitionBy(*keys).orderBy("_part")).alias("_edge"))
    joined = joined_on(local, carried, [*keys, "_part"])
    at_edge = F.col("_rn") == 1
    result = joined.withColumn(name, F.when(at_edge, F.col("_edge")[column]).otherwise(F.col("_lag")))
    if first:
        result = result.withColumn(first, at_edge & F.col("_edge").isNull())
    return result.drop("_part", "_lag", "_rn", "_edge")
