"""Change-data capture: decode, fold, replay.

The state of a table is a fold over its events. Per key the newest event decides: the row is
deleted if that event is a delete or lies before the newest marker (a TRUNCATE or the end of a
snapshot), and its values come from the newest event that carried values, or, for a key that
only deletes were seen of, from the newest delete. The fold is associative and idempotent, so
events may be folded in batches, out of order and more than once.

Folds are kept in one Parquet table per captured table, partitioned by `fold`. Each micro-batch overwrites
one partition with its own fold (one row per key it touched), so its cost follows the batch and a repeated
batch replaces its own rows. The state is one fold over the table. Every `compact_every` batches that fold is
written over the partition `all`; the partitions of the batches are then used again, and until they are,
idempotence makes their double rows harmless. All of it is Spark's dynamic partition overwrite: no file is
listed, merged or deleted here, and no log of versions is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..session import pinned

ENVELOPE = (
    "op string, before struct<{0}>, after struct<{0}>, "
    "source struct<ts_ms: bigint, lsn: bigint, sequence: string, snapshot: string>, _corrupt string"
)
CONTROL = ("_deleted", "_commit_lsn", "_lsn", "_origin_at")


@dataclass(frozen=True)
class Table:
    """A captured table: column names with their types, and its primary key."""

    name: str
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    @property
    def values(self) -> list[str]:
        return [n for n in self.names if n not in self.key]

    @property
    def fields(self) -> str:
        return ", ".join(f"{n}: {t}" for n, t in self.columns)

    def state_schema(self) -> T.StructType:
        columns = ", ".join(f"{n} {t}" for n, t in self.columns)
        return T.StructType.fromDDL(
            f"{columns}, _deleted boolean, _commit_lsn bigint, _lsn bigint, _origin_at timestamp, "
            "_value_live boolean, _value_commit bigint, _value_lsn bigint, "
            "_mark struct<commit_lsn: bigint, lsn: bigint, origin_at: timestamp>"
        )


def _opened(messages: DataFrame, table: Table, value: str) -> DataFrame:
    """`messages` with the envelope `_e`, its row `_row` and the reason `_bad` why it can't be used."""
    whole = {"columnNameOfCorruptRecord": "_corrupt"}  # else what can be read of a broken message would pass for all of it
    opened = messages.withColumn("_e", F.from_json(value, ENVELOPE.format(table.fields), whole))
    row = F.when(F.col("_e.op") == "d", F.col("_e.before")).otherwise(F.col("_e.after"))
    opened = opened.withColumn("_row", row)
    keyless = F.lit(False)
    for k in table.key:
        keyless = keyless | F.col(f"_row.{k}").isNull()
    op = F.col("_e.op")
    bad = (
        F.when(op.isNull() | F.col("_e._corrupt").isNotNull(), "unreadable").when(~op.isin("c", "u", "d", "r", "t"), "unknown operation")
        .when((op != "t") & keyless, "no key")
    )
    return opened.withColumn("_bad", bad)


def bad_messages(messages: DataFrame, table: Table, value: str = "value") -> DataFrame:
    """Messages that no event can be made of, as they came, with the `reason`."""
    opened = _opened(messages, table, value).filter(F.col("_bad").isNotNull())
    return opened.select(*messages.columns, F.col("_bad").alias("reason"))


def _decoded(messages: DataFrame, table: Table, value: str, skip_bad: bool) -> DataFrame:
    """Events of all messages, each with the reason `_bad` why it can't be used; without `skip_bad` such a message stops the job."""
    opened = _opened(messages, table, value)
    op = F.col("_e.op")
    if not skip_bad:
        stop = F.raise_error(F.concat(F.lit(f"a message of {table.name} is bad, it can't be used: "), F.col("_bad"))).cast("string")
        op = F.when(F.col("_bad").isNull(), op).otherwise(stop)
    rows = opened.select(op.alias("op"), "_row", "_e.source", "_bad")
    # columns of their own: `nullif` repeats what it is given, and the pair would be parsed anew each time
    rows = rows.withColumn("_pair", F.from_json(F.coalesce("source.sequence", F.lit("[null,null]")), "array<string>"))
    rows = rows.withColumns({"_commit": F.col("_pair")[0], "_own": F.col("_pair")[1].cast("bigint")})
    lsn = F.coalesce(F.nullif("_own", F.lit(0)), F.col("source.lsn"), F.lit(0))
    commit = F.coalesce(F.nullif("_commit", F.lit("")).cast("bigint"), lsn)
    return rows.select(
        "op",
        commit.alias("commit_lsn"),
        lsn.alias("lsn"),
        F.timestamp_millis("source.ts_ms").alias("origin_at"),
        F.coalesce(F.col("source.snapshot").isin("last", "last_in_data_collection"), F.lit(False)).alias("end_of_snapshot"),
        "_row", "_bad",
    ).select("op", "commit_lsn", "lsn", "origin_at", "end_of_snapshot", "_row.*", "_bad")


def decode(messages: DataFrame, table: Table, value: str = "value", skip_bad: bool = False) -> DataFrame:
    """Events from JSON envelopes: op, commit_lsn, lsn, origin_at, end_of_snapshot and the row's columns.

    A delete carries its row in `before`, the others in `after`. The position is the pair in
    `source.sequence`; where its parts are missing, the event's own lsn stands in. A bad message
    stops the job, unless `skip_bad` says that `bad_messages` takes care of them.
    """
    events = _decoded(messages, table, value, skip_bad)
    return (events.filter(F.col("_bad").isNull()) if skip_bad else events).drop("_bad")


def fold_events(events: DataFrame, table: Table) -> DataFrame:
    """One row per key of the state schema, from one pass over the events.

    Newest position, its delete flag, newest known values, and the newest marker seen with the key.
    The values of a delete rank below those of any other event. A TRUNCATE has no row, so its marker
    lands on the row whose key is NULL.
    """
    op = F.col("op")
    position = F.struct("commit_lsn", "lsn")
    moved = F.when(op != "t", position)
    valued = F.when(op != "t", F.struct((op != "d").alias("live"), F.col("commit_lsn"), F.col("lsn")))
    mark = F.when((op == "t") | F.col("end_of_snapshot"), F.struct("commit_lsn", "lsn", "origin_at"))
    folded = events.groupBy(*table.key).agg(
        F.max(moved).alias("_p"),
        F.max_by(op == "d", moved).alias("_deleted"),
        F.max_by("origin_at", moved).alias("_origin_at"),
        F.max(valued).alias("_vp"),
        F.max_by(F.struct(*table.values), valued).alias("_v") if table.values else F.first(F.lit(None)).alias("_v"),
        F.max(mark).alias("_mark"),
    )
    return folded.select(
        *[F.col(n) if n in table.key else F.col(f"_v.{n}").alias(n) for n in table.names],
        "_deleted",
        F.col("_p.commit_lsn").alias("_commit_lsn"),
        F.col("_p.lsn").alias("_lsn"),
        "_origin_at",
        F.col("_vp.live").alias("_value_live"),
        F.col("_vp.commit_lsn").alias("_value_commit"),
        F.col("_vp.lsn").alias("_value_lsn"),
        "_mark",
    )


def merge_states(base: DataFrame, newer: DataFrame, table: Table) -> DataFrame:
    """Two folds in one: a fold over both, so a single shuffle."""
    return refold(base.unionByName(newer), table)


INTERNAL = ("_value_live", "_value_commit", "_value_lsn", "_mark")


def newest_mark(folds: DataFrame) -> Column:
    """Newest marker of a fold, as a scalar subquery over its marker column."""
    return folds.agg(F.max("_mark")).scalar()


def apply_markers(folded: DataFrame, table: Table, mark: Column) -> DataFrame:
    """The state: rows older than the newest marker become deleted and take its position."""
    marked = folded.filter(F.col(table.key[0]).isNotNull()).withColumn("_m", mark)
    older = F.coalesce(
        F.struct(F.col("_commit_lsn").alias("c"), F.col("_lsn").alias("l"))
        < F.struct(F.col("_m.commit_lsn").alias("c"), F.col("_m.lsn").alias("l")),
        F.lit(False),
    ) & F.col("_m").isNotNull()
    return marked.withColumns(
        {
            "_reconciled": older & ~F.col("_deleted"),
            "_deleted": F.col("_deleted") | older,
            "_origin_at": F.when(older, F.col("_m.origin_at")).otherwise(F.col("_origin_at")),
            "_commit_lsn": F.when(older, F.col("_m.commit_lsn")).otherwise(F.col("_commit_lsn")),
            "_lsn": F.when(older, F.col("_m.lsn")).otherwise(F.col("_lsn")),
        }
    ).drop("_m", *INTERNAL)


def folded_state(events: DataFrame, table: Table) -> DataFrame:
    """The state after all events of a table, with `_reconciled` on rows a marker found alive.

    The fold is written once, one row per key: the markers and the state both read that.
    """
    folded = pinned(fold_events(events, table))
    return apply_markers(folded, table, newest_mark(folded))


def state_of(events: DataFrame, table: Table) -> DataFrame:
    """The state after all events of a table, tombstones included."""
    return folded_state(events, table).drop("_reconciled")


def reconciled_rows(events: DataFrame, table: Table) -> DataFrame:
    """Rows in the state and those that a marker found alive and marked as deleted."""
    return folded_state(events, table).agg(F.count_if("_reconciled").alias("reconciled"), F.count("*").alias("rows"))


class LogRegression(RuntimeError):
    """The source log went backwards: its newest position is behind the lake."""


class ChangeStore:
    """Folds of one table as a partitioned Parquet table below a folder. One writer at a time; it is given every batch of a run, empty ones too."""

    def __init__(self, spark: SparkSession, root: str, table: Table, compact_every: int = 50):
        self.spark, self.path, self.table, self.compact_every = spark, f"{root.rstrip('/')}/folds", table, compact_every
        self._newest: int | None = None

    def folds(self) -> DataFrame:
        schema = self.table.state_schema()
        try:
            return self.spark.read.schema(T.StructType([*schema, T.StructField("fold", T.StringType())])).parquet(self.path).drop("fold")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, fold: DataFrame, name: str) -> None:
        columns = [F.col(f.name).cast(f.dataType) for f in self.table.state_schema()]
        writer = fold.select(*columns, F.lit(name).alias("fold")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.option("compression", "zstd").partitionBy("fold").parquet(self.path)

    def write_batch(self, events: DataFrame, batch_id: int, run: str = "run") -> None:
        """The fold of one micro-batch over the partition of its place in the cycle; the last batch of a cycle also folds all into one.

        A retry replaces its own rows. The partition's earlier rows, of the cycle before, are in the partition `all` by then.
        """
        cycle = self.compact_every
        self._write(fold_events(events, self.table), f"{run}-{cycle}-{batch_id % cycle}" if cycle else f"{run}-{batch_id}")
        if cycle and batch_id % cycle == cycle - 1:
            self.compact()

    def compact(self) -> None:
        """One fold of all folds as the partition `all`. What it read stays where it is until batches use those partitions again."""
        self._write(refold(self.folds(), self.table).hint("rebalance"), "all")

    def state(self) -> DataFrame:
        """Current rows, tombstones included."""
        folds = self.folds()
        return apply_markers(refold(folds, self.table), self.table, newest_mark(folds)).drop("_reconciled")

    def high_water(self) -> int:
        """Largest lsn held, 0 for an empty store; reads the position columns only."""
        newest = F.max(F.greatest(F.coalesce("_lsn", F.lit(0)), F.coalesce("_mark.lsn", F.lit(0))))
        return self.folds().agg(F.coalesce(newest, F.lit(0))).first()[0]

    def reached(self, lsn: int | None) -> None:
        """Tells a position that was written, so that the next check need not read the store."""
        if self._newest is not None and lsn is not None:
            self._newest = max(self._newest, lsn)

    def check_source(self, newest_lsn: int) -> None:
        """Reads the store once; afterwards the writer's own batches keep the position up to date."""
        if self._newest is None:
            self._newest = self.high_water()
        if self._newest > newest_lsn:
            raise LogRegression(f"the lake holds position {self._newest}, the source is at {newest_lsn}")


def refold(folds: DataFrame, table: Table) -> DataFrame:
    """Fold of folds: the same reduction over rows that are already one per key and batch."""
    position = F.when(F.col("_commit_lsn").isNotNull(), F.struct("_commit_lsn", "_lsn"))
    valued = F.when(F.col("_value_commit").isNotNull(), F.struct("_value_live", "_value_commit", "_value_lsn"))
    folded = folds.groupBy(*table.key).agg(
        F.max_by(F.struct(*CONTROL), position).alias("_c"),
        F.max(valued).alias("_vp"),
        F.max_by(F.struct(*table.values), valued).alias("_v") if table.values else F.first(F.lit(None)).alias("_v"),
        F.max("_mark").alias("_mark"),
    )
    return folded.select(
        *[F.col(n) if n in table.key else F.col(f"_v.{n}").alias(n) for n in table.names],
        *[F.col(f"_c.{c}").alias(c) for c in CONTROL],
        F.col("_vp._value_live").alias("_value_live"),
        F.col("_vp._value_commit").alias("_value_commit"),
        F.col("_vp._value_lsn").alias("_value_lsn"),
        "_mark",
    )


def consume(stream: DataFrame, stores: dict[str, ChangeStore], checkpoint: str, topic: str = "topic",
            run: str = "run", available_now: bool = True, newest_lsn: Callable[[], int] | None = None,
            bad: str | None = None):
    """Apply a stream of (topic, value) messages, each topic to its store.

    The offset is committed by Spark after the batch is written, and a batch may be written twice
    without effect: at-least-once transport, exactly-once result. A new `checkpoint` with the
    source at its first offset replays everything.

    `newest_lsn` asks the source for its newest position; every batch first makes sure that no store
    is ahead of it, so a source whose log was reset stops the stream. Bad messages and those of a
    topic without a store are written below `bad`, with a reason; without `bad` they stop the stream,
    before the offset is committed. Each message is parsed once: the job that writes a store's fold
    also counts its bad messages, and only if there are any they are looked for again.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        if newest_lsn is not None:
            newest = newest_lsn()
            for store in stores.values():
                store.check_source(newest)
        batch.persist()
        try:
            known = F.coalesce(F.col(topic).isin(*stores), F.lit(False))
            unknown = batch.filter(~known)
            if bad is None and (found := unknown.first()):
                raise ValueError(f"a message of topic {found[topic]} can't be used: unknown topic")
            lost = unknown.select(*batch.columns, F.lit("unknown topic").alias("reason"))
            for name, store in stores.items():
                mine, seen = batch.filter(F.col(topic) == name), Observation()
                fine = F.col("_bad").isNull()
                events = _decoded(mine, store.table, "value", skip_bad=bad is not None).observe(
                    seen, F.count_if(~fine).alias("bad"), F.max(F.when(fine, F.col("lsn"))).alias("lsn")
                )
                store.write_batch(events.filter(fine).drop("_bad"), batch_id, run)
                store.reached(seen.get["lsn"])
                if seen.get["bad"]:
                    lost = lost.unionByName(bad_messages(mine, store.table))
            if bad is not None:
                lost.write.mode("overwrite").parquet(f"{bad}/{run}-{batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latency(state: DataFrame, written_at: Column, origin: str = "_origin_at") -> DataFrame:
    """Seconds from the source commit to visibility: mean, largest and rows."""
    seconds = (F.unix_micros(written_at) - F.unix_micros(F.col(origin))) / 1_000_000
    return state.agg(
        F.count("*").alias("rows"), F.avg(seconds).alias("mean_seconds"), F.max(seconds).alias("max_seconds")
    )


def envelope(op: Column, row: Column, commit: Column, lsn: Column, ts_ms: Column, snapshot: Column) -> Column:
    """JSON envelope of one change, for producers and tests."""
    return F.to_json(
        F.struct(
            op.alias("op"),
            F.when(op == "d", row).alias("before"),
            F.when(~op.isin("d", "t"), row).alias("after"),
            F.struct(
                ts_ms.alias("ts_ms"),
                lsn.alias("lsn"),
                F.concat(
                    F.lit("["), F.coalesce(F.concat(F.lit('"'), commit.cast("string"), F.lit('"')), F.lit("null")),
                    F.lit(',"'), lsn.cast("string"), F.lit('"]'),
                ).alias("sequence"),
                snapshot.alias("snapshot"),
            ).alias("source"),
        )
    )
