"""Change streams over `events` and late data over two extracts of the enrolments.

`events` is read as a change log: user_id is the key, event_id the lsn, event_id - event_id % 5 the
commit position; 'error' deletes, 'signup' inserts, the rest update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import late
from ..session import pinned, work_dir
from ..streaming import cdc
from . import domain as D
from .registry import Tables, plan

USERS = cdc.Table("silver.users", (("user_id", "bigint"), ("event_type", "string"), ("value", "double")), ("user_id",))
KINDS = cdc.Table("silver.kinds", (("event_type", "string"), ("value", "double")), ("event_type",))
LOG = "topic string, value string, event_id bigint"

#: Messages in a file of the log: a batch of a large log has many files, so that all cores read and parse it.
SEGMENT = 25_000

#: Micro-batches of the first run at most. A batch has a share of the log's files, so a larger log has larger batches, not more of them:
#: every third one folds the whole state.
BATCHES = 6


def message(truncates: bool = False, snapshots: bool = False) -> Column:
    """JSON envelope of an event as a change of its user. Some 'purchase' events become a TRUNCATE on demand.

    One user in 25 is only ever deleted: the state has nothing but those events to take the row from.
    """
    kind = F.col("event_type")
    op = F.when((kind == "error") | (F.col("user_id") % 25 == 3), "d").when(kind == "signup", "c").otherwise("u")
    if truncates:
        op = F.when((kind == "purchase") & (F.col("value") > 50) & (F.col("event_id") % 1000 == 0), "t").otherwise(op)
    mark = F.lit("false")
    if snapshots:
        op = F.when(op == "c", "r").otherwise(op)
        mark = F.when((op == "r") & (F.col("event_id") % 500 < 10), "last").otherwise(mark)
    row = F.struct("user_id", "event_type", "value")
    commit = F.col("event_id") - F.col("event_id") % 5
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return cdc.envelope(op, row, commit, F.col("event_id"), millis, mark)


def messages(t: Tables, truncates: bool = False, snapshots: bool = False) -> DataFrame:
    """JSON envelopes with topic, in event order."""
    return t.events.select(F.lit(USERS.name).alias("topic"), message(truncates, snapshots).alias("value"), "event_id")


def _log_sql(op: str, marker: str) -> str:
    """Newest event per key, markers applied. A position is the ordered pair of commit and lsn."""
    return f"""log AS (SELECT user_id, event_type, value, event_id AS lsn, [event_id - event_id % 5, event_id] AS p, {op} AS op FROM events
    ), mark AS (SELECT max(p) AS p FROM log WHERE {marker}
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC) AS newest,
        row_number() OVER (PARTITION BY user_id ORDER BY op = 'd', p DESC) AS valued FROM log WHERE op <> 't'
    ), folded AS (SELECT n.user_id, n.p, n.op, v.event_type, v.value FROM ranked n JOIN ranked v ON n.user_id = v.user_id AND n.newest = 1 AND v.valued = 1
    ), state AS (SELECT user_id, event_type, value, op = 'd' OR coalesce(f.p < (SELECT p FROM mark), false) AS deleted,
        CASE WHEN f.p < (SELECT p FROM mark) THEN (SELECT p[2] FROM mark) ELSE f.p[2] END AS lsn,
        coalesce(f.p < (SELECT p FROM mark), false) AND op <> 'd' AS reconciled FROM folded f)"""


_PLAIN = "CASE WHEN event_type = 'error' OR user_id % 25 = 3 THEN 'd' WHEN event_type = 'signup' THEN 'c' ELSE 'u' END"
_TRUNCATE = f"CASE WHEN event_type = 'purchase' AND value > 50 AND event_id % 1000 = 0 THEN 't' ELSE {_PLAIN} END"
_SNAPSHOT = "CASE WHEN event_type = 'error' OR user_id % 25 = 3 THEN 'd' WHEN event_type = 'signup' THEN 'r' ELSE 'u' END"
_STATE = "bigint user_id lsn; string event_type; double value; boolean deleted"


def _shown(state: DataFrame) -> DataFrame:
    return state.select("user_id", "event_type", "value", F.col("_deleted").alias("deleted"), F.col("_lsn").alias("lsn"))


@plan("string op; bigint events commits last_lsn snapshots", "I01",
      f"""WITH log AS (SELECT {_SNAPSHOT} AS op, event_id AS lsn, event_id - event_id % 5 AS com FROM events WHERE event_id % 97 <> 0)
      SELECT op, count(*) AS events, count(DISTINCT com) AS commits, max(lsn) AS last_lsn,
        count(*) FILTER (op = 'r' AND lsn % 500 < 10) AS snapshots FROM log GROUP BY 1
      UNION ALL SELECT 'unreadable', count(*), 0, max(event_id), 0 FROM events WHERE event_id % 97 = 0 HAVING count(*) > 0""")
def cdc_decode(t: Tables) -> DataFrame:
    """Every 97th message is cut off: it is counted, not lost."""
    value = F.when(F.col("event_id") % 97 == 0, F.substring("value", 1, 30)).otherwise(F.col("value"))
    sent = messages(t, snapshots=True).withColumn("value", value)
    events = cdc.decode(sent, USERS, skip_bad=True)
    per_commit = events.groupBy("op", "commit_lsn").agg(
        F.count("*").alias("n"), F.max("lsn").alias("lsn"), F.count_if("end_of_snapshot").alias("s")
    )
    read = per_commit.groupBy("op").agg(
        F.sum("n").alias("events"), F.count("*").alias("commits"), F.max("lsn").alias("last_lsn"), F.sum("s").alias("snapshots")
    )
    none = F.lit(0).cast("bigint")
    return read.unionByName(cdc.bad_messages(sent, USERS).groupBy(F.col("reason").alias("op")).agg(
        F.count("*").alias("events"), none.alias("commits"), F.max("event_id").alias("last_lsn"), none.alias("snapshots")
    ))


@plan(_STATE, "I03 I04 I05", f"""WITH {_log_sql(_PLAIN, "false")} SELECT user_id, event_type, value, deleted, lsn FROM state""")
def cdc_state(t: Tables) -> DataFrame:
    return _shown(cdc.state_of(cdc.decode(messages(t), USERS), USERS))


@plan("bigint user_id; string event_type; double value", "A20",
      f"""WITH {_log_sql(_PLAIN, "false")} SELECT user_id, event_type, value FROM state WHERE NOT deleted""")
def live_rows(t: Tables) -> DataFrame:
    from ..sources.lake import live

    return live(cdc.state_of(cdc.decode(messages(t), USERS), USERS))


@plan(_STATE, "I06", f"""WITH {_log_sql(_TRUNCATE, "op = 't'")} SELECT user_id, event_type, value, deleted, lsn FROM state""")
def cdc_truncate(t: Tables) -> DataFrame:
    return _shown(cdc.state_of(cdc.decode(messages(t, truncates=True), USERS), USERS))


@plan("bigint reconciled rows", "I07",
      f"""WITH {_log_sql(_SNAPSHOT, "op = 'r' AND lsn % 500 < 10")} SELECT count(*) FILTER (reconciled) AS reconciled, count(*) AS rows FROM state""")
def cdc_snapshot_end(t: Tables) -> DataFrame:
    return cdc.reconciled_rows(cdc.decode(messages(t, snapshots=True), USERS), USERS)


def _streamed(t: Tables, stores: dict[str, cdc.ChangeStore], folder: str, run: str, files_per_batch: int) -> None:
    newest = t.events.agg(F.max("event_id")).first()[0]
    stream = (
        t.spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/topics")
    )
    query = cdc.consume(
        stream, stores, f"{folder}/checkpoint-{run}", run=run, newest_lsn=lambda: newest, bad=f"{folder}/bad"
    )
    query.awaitTermination()


@plan("string topic event_type; bigint user_id lsn; double value; boolean deleted", "I02 I10 I11 I12 I13 I14",
      f"""WITH {_log_sql(_TRUNCATE, "op = 't'")} SELECT 'silver.users' AS topic, user_id, event_type, value, deleted, lsn FROM state
      UNION ALL SELECT 'silver.kinds', NULL, event_type, value, false, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1""")
def cdc_replay(t: Tables) -> DataFrame:
    """Two topics in one log, streamed in micro-batches, compacted on the way, and replayed from the first offset."""
    folder = work_dir(t.spark, "cdc")
    kinds = cdc.envelope(
        F.lit("u"), F.struct("event_type", "value"), F.col("event_id"), F.col("event_id"),
        F.unix_millis(F.col("ts").cast("timestamp")), F.lit("false"),
    )
    topics = {USERS.name: message(truncates=True), KINDS.name: kinds}
    sent = F.array(*[F.struct(F.lit(topic).alias("topic"), value.alias("value")) for topic, value in topics.items()])
    log = t.events.repartitionByRange("event_id").select(F.inline(sent), "event_id")  # dealt as events, which are shorter
    log.write.option("maxRecordsPerFile", SEGMENT).parquet(f"{folder}/topics")
    files = len(t.spark.read.schema(LOG).parquet(f"{folder}/topics").inputFiles())
    stores = {table.name: cdc.ChangeStore(t.spark, f"{folder}/{table.name}", table, compact_every=3) for table in (USERS, KINDS)}
    _streamed(t, stores, folder, "first", max(2, -(-files // BATCHES)))
    _streamed(t, stores, folder, "again", 1000)
    none = F.lit(None)
    users, kept = stores[USERS.name].state(), stores[KINDS.name].state()
    return _shown(users).withColumn("topic", F.lit(USERS.name)).unionByName(
        _shown(kept.withColumn("user_id", none.cast("bigint"))).withColumn("topic", F.lit(KINDS.name))
    )


@plan("bigint high_water last_commit", "I10", "SELECT max(event_id) AS high_water, max(event_id - event_id % 5) AS last_commit FROM events")
def cdc_high_water(t: Tables) -> DataFrame:
    state = cdc.state_of(cdc.decode(messages(t), USERS), USERS)
    return state.agg(F.max("_lsn").alias("high_water"), F.max("_commit_lsn").alias("last_commit"))


@plan("bigint rows; double mean_seconds max_seconds", "I19",
      """WITH s AS (SELECT user_id, arg_max(ts, event_id) AS ts FROM events GROUP BY 1)
      SELECT count(*) AS rows, round_even(sum(epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ts) // 1000)::DOUBLE / count(*) / 1000 * 1000, 0) / 1000 AS mean_seconds,
        max(epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ts) // 1000) / 1000 AS max_seconds FROM s""")
def cdc_latency(t: Tables) -> DataFrame:
    from ..functions.numbers import half_even

    state = cdc.state_of(cdc.decode(messages(t), USERS), USERS)
    one = cdc.latency(state, F.lit("2024-02-01").cast("timestamp_ntz").cast("timestamp"))
    return one.withColumn("mean_seconds", half_even(F.col("mean_seconds"), 3))


# --- late data ----------------------------------------------------------------------------------

_CUTS = (("1998-06-30", 1), ("1999-03-15", 2))


def _ledger_and_snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two extracts from one pass: an enrolment is in a load if it had started by the publication; later exits are unknown yet."""
    days = F.array(*[F.struct(F.lit(n).alias("load_id"), F.lit(d).cast("date").alias("published")) for d, n in _CUTS])
    rows = D.enrolments(t).select("entry_at", "entry_year", "outcome", "exit_at", "exit_year", "exit_term")
    loads = rows.withColumn("load", F.explode(F.filter(days, lambda x: F.col("entry_at") <= x["published"])))
    known = F.col("exit_at") <= F.col("load.published")
    seen = loads.select(
        F.col("load.load_id").alias("load_id"), "entry_year", F.when(known, F.col("outcome")).otherwise("ATIVO").alias("seen"),
        F.when(known & (F.col("outcome") != "ATIVO"), F.col("exit_year") * 10 + F.col("exit_term")).alias("period"),
    )
    cells = pinned(late.snapshots(seen, "load_id", "entry_year", "seen", F.col("period")))
    return late.ledger(cells, t.spark.range(1).select(F.inline(days)), "year", D.MATURITY), cells


_LATE = f"""{D.ENROLMENTS}, cuts(load_id, published, watermark) AS (VALUES (1, DATE '1998-06-30', 19980), (2, DATE '1999-03-15', 19981)
), loads AS (SELECT load_id, entry_year AS year, CASE WHEN exit_at <= published THEN outcome ELSE 'ATIVO' END AS outcome,
    CASE WHEN exit_at <= published AND outcome <> 'ATIVO' THEN exit_year * 10 + exit_term END AS period
  FROM enrolments JOIN cuts ON entry_at <= published
), cells AS (SELECT load_id, year, outcome, period, count(*) AS n FROM loads GROUP BY ALL
), ledger AS (SELECT load_id, published, watermark, (SELECT max(year) - {D.MATURITY} FROM loads l WHERE l.load_id = c.load_id) AS last_mature,
    (SELECT count(*) FROM loads l WHERE l.load_id = c.load_id) AS total FROM cuts c
), sums AS (SELECT 2 AS load_id, year, outcome, period, coalesce(sum(n) FILTER (load_id = 1), 0) AS before, coalesce(sum(n) FILTER (load_id = 2), 0) AS after
  FROM cells GROUP BY year, outcome, period
), arrivals AS (SELECT load_id, year, year - year % 5 AS window, outcome, period, before, after, after - before AS difference,
    CASE WHEN period IS NULL THEN 'SEM_PERIODO' WHEN period <= (SELECT watermark FROM ledger WHERE load_id = 1) THEN 'ATRASADA' ELSE 'NO_PRAZO' END AS arrival,
    coalesce(year <= (SELECT last_mature FROM ledger WHERE load_id = 1), false) AS published
  FROM sums WHERE before <> after)"""


@plan("bigint load_id watermark last_mature total; string published", "I15 B26",
      f"WITH {_LATE} SELECT load_id, watermark, last_mature, total, strftime(published, '%Y-%m-%d') AS published FROM ledger")
def load_ledger(t: Tables) -> DataFrame:
    return _ledger_and_snapshots(t)[0].withColumn("published", F.col("published").cast("string"))


@plan("bigint load_id year window period before after difference; string outcome arrival; boolean published", "I16 I18 G02 D20",
      f"WITH {_LATE} SELECT * FROM arrivals")
def late_arrivals(t: Tables) -> DataFrame:
    return late.arrivals(*_ledger_and_snapshots(t))


@plan("bigint load_id window more less cohorts_revised; string arrival", "I17",
      f"""WITH {_LATE} SELECT load_id, "window", arrival, coalesce(sum(difference) FILTER (difference > 0), 0) AS more,
        coalesce(-sum(difference) FILTER (difference < 0), 0) AS less, count(DISTINCT year) FILTER (published) AS cohorts_revised FROM arrivals GROUP BY ALL""")
def late_summary(t: Tables) -> DataFrame:
    return late.arrival_summary(late.arrivals(*_ledger_and_snapshots(t)))


@plan("string kind key; bigint graduates actives", "I21",
      f"""WITH {D.ENROLMENTS}, r AS (SELECT *, outcome = 'ATIVO' AND entry_year = 1996 AND amount > 400000 AS chosen FROM enrolments
      ), f AS (SELECT course, count(*) FILTER (outcome = 'FORMATURA' OR chosen) AS graduates, count(*) FILTER (outcome = 'ATIVO' AND NOT chosen) AS actives,
          count(*) FILTER (chosen) AS moved FROM r GROUP BY 1)
      SELECT 'course' AS kind, course AS key, graduates, actives FROM f WHERE moved > 0
      UNION ALL SELECT 'window', w || CASE WHEN moved THEN ' rewritten' ELSE ' intact' END, NULL, NULL FROM (SELECT entry_year - entry_year % 5 AS w, bool_or(chosen) AS moved FROM r GROUP BY 1)""")
def revision_impact(t: Tables) -> DataFrame:
    from ..sources.lake import with_window

    rows = with_window(D.enrolments(t).select("id", "course", "entry_year", "outcome", "amount"), "entry_year")
    chosen = (F.col("outcome") == "ATIVO") & (F.col("entry_year") == 1996) & (F.col("amount") > 400000)
    measures = {
        "graduates": lambda c: F.count_if(c("outcome") == "FORMATURA"),
        "actives": lambda c: F.count_if(c("outcome") == "ATIVO"),
    }
    moved, status = late.revision(rows, chosen, {"outcome": F.lit("FORMATURA")}, ["course"], "window", measures)
    none = F.lit(None).cast("bigint")
    return moved.select(F.lit("course").alias("kind"), F.col("course").alias("key"), "graduates", "actives").unionByName(
        status.select(
            F.lit("window").alias("kind"), F.concat_ws(" ", "window", "status").alias("key"), none.alias("graduates"), none.alias("actives")
        )
    )
