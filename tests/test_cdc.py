"""Change scenarios, each folded as one batch, in shuffled order and through the store in pieces.

A scenario is a line of changes: `+3:name` inserts, `=3:name` updates, `-3` deletes with the key alone, `-3:name` deletes with the
row, `!` truncates, `?3:name` is a snapshot row and `.3:name` the last one; `@commit/lsn` gives the position.
"""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import change_queries
from cohortlens.plans.registry import Tables
from cohortlens.session import work_dir, workspace
from cohortlens.sources.lake import fingerprint, live
from cohortlens.streaming import cdc

COURSES = cdc.Table("silver.courses", (("id", "int"), ("name", "string")), ("id",))
ENROLMENTS = cdc.Table("silver.enrolments", (("id", "bigint"), ("year", "int"), ("outcome", "string")), ("id", "year"))
KINDS = {"+": "c", "=": "u", "-": "d", "!": "t", "?": "r", ".": "r"}


def messages(spark, line, table=COURSES):
    """Envelopes of a line of changes, made by the producer's side of the library."""
    rows = []
    for kind, key, name, commit, lsn in re.findall(r"([-+=!?.])(\d*)(?::(\w+))?@(\d*)/(\d+)", line):
        rows.append((KINDS[kind], int(key or 0), name or None, int(commit) if commit else None, int(lsn), "last" if kind == "." else "false"))
    df = spark.createDataFrame(rows, "op string, id int, name string, commit long, lsn long, mark string")
    envelope = cdc.envelope(F.col("op"), F.struct("id", "name"), F.col("commit"), F.col("lsn"), F.lit(1000).cast("long"), F.col("mark"))
    return [r[0] for r in df.select(envelope).collect()]


def decoded(spark, messages, table=COURSES):
    return cdc.decode(spark.createDataFrame([(m,) for m in messages], "value string"), table)


def shown(df, table=COURSES):
    return sorted(tuple(r) for r in df.select(*table.names, "_deleted").collect())


SCENARIOS = {
    "insert and update": ("+1:A@10/11 =1:B@20/21", [(1, "B", False)]),
    "a delete keeps the values": ("+1:X@10/11 -1@20/21", [(1, "X", True)]),
    "a delete alone gives its row": ("-7:gone@20/21", [(7, "gone", True)]),
    "the newest delete gives the row": ("-7:first@20/21 -7:second@30/31", [(7, "second", True)]),
    "values rank above a delete's row": ("-7:late@30/31 +7:early@10/11", [(7, "early", True)]),
    "a stale event": ("=1:new@30/31 =1:old@20/21", [(1, "new", False)]),
    "a stale insert after a delete": ("-1@30/31 +1:Z@10/11", [(1, "Z", True)]),
    "one commit is ordered by lsn": ("=1:b@10/13 =1:a@10/12", [(1, "b", False)]),
    "truncate and reload in one commit": ("+1:A@10/11 +2:A@10/12 !@20/21 +2:R@20/22", [(1, "A", True), (2, "R", False)]),
    "the end of a snapshot reconciles": (
        "+1:A@10/11 +2:A@10/12 ?2:S@/50 .3:S@/50", [(1, "A", True), (2, "S", False), (3, "S", False)]
    ),
    "insert after delete": ("+1:A@10/11 -1@20/21 +1:N@30/31", [(1, "N", False)]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, name):
    line, wanted = SCENARIOS[name]
    sent = messages(spark, line)
    assert shown(cdc.state_of(decoded(spark, sent), COURSES)) == wanted
    mixed = sent * 2
    random.Random(name).shuffle(mixed)
    assert shown(cdc.state_of(decoded(spark, mixed), COURSES)) == wanted
    store = cdc.ChangeStore(spark, work_dir(spark, "cdc"), COURSES)
    for i, m in enumerate(mixed):
        store.write_batch(decoded(spark, [m]), i)
        if i % 3 == 1:
            store.compact()
    assert shown(store.state()) == wanted
    store.write_batch(decoded(spark, sent), 99, run="replay")
    assert shown(store.state()) == wanted
    first, second = (cdc.fold_events(decoded(spark, part), COURSES) for part in (mixed[::2], mixed[1::2]))
    merged = cdc.merge_states(first, second, COURSES)
    assert shown(cdc.apply_markers(merged, COURSES, cdc.newest_mark(merged))) == wanted


def test_reconciled_rows_are_counted(spark):
    events = decoded(spark, messages(spark, SCENARIOS["the end of a snapshot reconciles"][0]))
    assert tuple(cdc.reconciled_rows(events, COURSES).first()) == (1, 3)


def test_composite_key(spark):
    rows = [("c", 1, 2012, "ATIVO", 11), ("c", 1, 2021, "ATIVO", 12), ("u", 1, 2021, "EVASAO", 21)]
    df = spark.createDataFrame(rows, "op string, id long, year int, outcome string, lsn long")
    envelope = cdc.envelope(F.col("op"), F.struct("id", "year", "outcome"), F.col("lsn"), F.col("lsn"), F.lit(0).cast("long"), F.lit("false"))
    state = cdc.state_of(cdc.decode(df.select(envelope.alias("value")), ENROLMENTS), ENROLMENTS)
    assert shown(state, ENROLMENTS) == [(1, 2012, "ATIVO", False), (1, 2021, "EVASAO", False)]
    assert live(state).count() == 2


def test_position_falls_back_to_the_own_lsn(spark):
    sent = messages(spark, "?1:a@/77 .2:b@/78")
    sent[1] = sent[1].replace('"last"', '"last_in_data_collection"')
    got = decoded(spark, sent).orderBy("id").collect()
    assert [(r.commit_lsn, r.lsn, r.end_of_snapshot) for r in got] == [(77, 77, False), (78, 78, True)]


BAD = ['{"op": "c", "after"', '{"op": "x", "after": {"id": 1}}', '{"op": "c", "after": {"name": "no key"}}', "", None, '{"op": "d", "before": null}']


def test_bad_messages_stop_the_job_or_are_kept(spark):
    good = messages(spark, "+1:A@10/11")
    both = spark.createDataFrame([(m,) for m in BAD + good], "value string")
    with pytest.raises(Exception, match="is bad"):
        cdc.decode(both, COURSES).collect()
    assert shown(cdc.state_of(cdc.decode(both, COURSES, skip_bad=True), COURSES)) == [(1, "A", False)]
    kept = cdc.bad_messages(both, COURSES).collect()
    assert sorted(r.reason for r in kept) == ["no key", "no key", "unknown operation", "unreadable", "unreadable", "unreadable"]
    assert {r.value for r in kept} == set(BAD)


def test_stream_of_several_topics_crash_replay_and_guard(spark):
    folder = work_dir(spark, "cdc")
    chance = random.Random(5)
    line = " ".join(f"{chance.choice('+==-')}{i % 7}:n{i}@{i // 3 * 10}/{i}" for i in range(60))
    sent = messages(spark, line)
    other = messages(spark, "+1:x@5/6 =1:y@7/8")
    rows = [(COURSES.name, m) for m in sent] + [("silver.other", m) for m in other] + [(COURSES.name, "{"), ("silver.nobody", sent[0]), (None, sent[0])]
    source = spark.createDataFrame(rows, "topic string, value string")
    source.repartition(5).write.parquet(f"{folder}/topic")
    stores = {
        COURSES.name: cdc.ChangeStore(spark, f"{folder}/state", COURSES, compact_every=2),
        "silver.other": cdc.ChangeStore(spark, f"{folder}/other", COURSES, compact_every=2),
    }

    def drain(run, files, **more):
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/topic")
        cdc.consume(stream, stores, f"{folder}/checkpoint-{run}", run=run, **more).awaitTermination()
        return [fingerprint(s.state()).first().fingerprint for s in stores.values()]

    bad = f"{folder}/bad"
    first = drain("a", 1, bad=bad)
    assert drain("a", 1, bad=bad) == first, "a resumed stream has nothing left to do"
    assert drain("b", 5, bad=bad) == first, "a full replay changes nothing"
    assert first[0] == fingerprint(cdc.state_of(decoded(spark, sent), COURSES)).first().fingerprint
    assert shown(stores["silver.other"].state()) == [(1, "y", False)]
    lost = spark.read.option("recursiveFileLookup", "true").parquet(bad).collect()
    assert sorted(r.reason for r in lost) == sorted(["unreadable", "unknown topic", "unknown topic"] * 2)
    assert stores[COURSES.name].high_water() == 59
    assert drain("c", 5, bad=bad, newest_lsn=lambda: 59) == first
    with pytest.raises(Exception, match="holds position 59"):
        drain("d", 5, bad=bad, newest_lsn=lambda: 58)
    with pytest.raises(Exception, match="can't be used"):
        drain("e", 5)


def test_empty_store(spark):
    store = cdc.ChangeStore(spark, work_dir(spark, "cdc"), COURSES)
    assert store.state().count() == 0 and store.high_water() == 0
    store.compact()


def test_latency(spark):
    state = cdc.state_of(decoded(spark, messages(spark, "+1:A@10/11")), COURSES)
    written = F.timestamp_millis(F.lit(3500))
    assert tuple(cdc.latency(state, written).first()) == (1, 2.5, 2.5)


def test_larger_log_has_larger_batches_not_more(spark, monkeypatch):
    """40 ranges made 20 batches of two files, each read by two tasks; a file was as long as its range."""
    monkeypatch.setattr(change_queries, "SEGMENT", 10, raising=False)
    batches, write = [], cdc.ChangeStore.write_batch

    def counted(store, events, batch_id, run="run"):
        batches.append((store.path, run))
        write(store, events, batch_id, run)

    monkeypatch.setattr(cdc.ChangeStore, "write_batch", counted)
    t = Tables(spark, "/root/testdata/sf0.001")
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    with workspace(spark):
        try:
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", "40")
            replayed = change_queries.cdc_replay(t)
        finally:
            for name, value in kept.items():
                spark.conf.set(name, value)
        folder = batches[0][0].rsplit("/", 2)[0]
        log = spark.read.parquet(f"{folder}/topics")
        in_file = log.groupBy(F.input_file_name()).count().agg(F.count("*"), F.max("count")).first()
        assert log.count() == 2 * t.events.count()
        users = replayed.filter(F.col("topic") == change_queries.USERS.name).drop("topic")
        wanted = change_queries.cdc_truncate(t)
        assert sorted(users.collect()) == sorted(wanted.select(*users.columns).collect())
    assert in_file[1] <= 10 and in_file[0] >= 40
    for path in {path for path, _ in batches}:
        assert 3 <= batches.count((path, "first")) <= change_queries.BATCHES and batches.count((path, "again")) == 1


def test_position_of_an_event_is_parsed_once(spark):
    plan = decoded(spark, messages(spark, "+1:A@10/11"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(ArrayType") == 1
