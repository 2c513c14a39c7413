"""Dimensions with history, late data, synchronisation and data checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import dimensional, late, privacy, quality, stats, sync
from cohortlens.operators.quality import Rule

T0, T1, T2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
EPOCH = dt.datetime(1962, 4, 21)
DIM = "name string, area string, trunk boolean, origin int, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"


def load(spark, dimension, rows, moment):
    source = spark.createDataFrame(rows, "name string, area string, trunk boolean, origin int")
    when = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    return dimensional.scd2_merge(dimension, source, "name", ["area", "trunk"], ["origin"], when)


def test_scd2_loads(spark, rows):
    dim = load(spark, spark.createDataFrame([], DIM), [("A", "X", False, 1), ("B", None, False, 2)], T0)
    assert rows(dim) == [("A", "X", False, 1, EPOCH, None, True), ("B", None, False, 2, EPOCH, None, True)]
    same = load(spark, dim, [("A", "X", False, 1), ("B", None, False, 2)], T1)
    assert rows(same) == rows(dim), "an equal reload opens no version, NULL equals NULL"
    type1 = load(spark, dim, [("A", "X", False, 9), ("B", None, False, 2)], T1)
    assert rows(type1) == [("A", "X", False, 9, EPOCH, None, True), ("B", None, False, 2, EPOCH, None, True)]
    changed = load(spark, type1, [("A", "Y", False, 9), ("C", "Z", True, 3)], T2)
    assert rows(changed) == [
        ("A", "X", False, 9, EPOCH, T2, False), ("A", "Y", False, 9, T2, None, True),
        ("B", None, False, 2, EPOCH, None, True), ("C", "Z", True, 3, EPOCH, None, True),
    ]
    assert quality.scd_violations(changed, "name").count() == 0
    broken = changed.withColumn("valid_to", F.when(F.col("name") != "A", F.col("valid_to")))
    assert [r.name for r in quality.scd_violations(broken, "name").collect()] == ["A"]


def test_scd2_history_shows_type1_on_every_version(spark):
    data = [("A", "X", 1, T0), ("A", "X", 2, T1), ("A", "Y", 3, T2), ("B", "Z", 7, T0)]
    loads = spark.createDataFrame(data, "name string, area string, origin int, load_time timestamp_ntz")
    got = dimensional.scd2_from_loads(loads, "name", "load_time", ["area"], ["origin"]).orderBy("name", "valid_from").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("A", "X", 3, EPOCH, T2, False), ("A", "Y", 3, T2, None, True), ("B", "Z", 7, EPOCH, None, True)]
    assert len({r.version_key for r in got}) == 3


def test_view_and_guard(spark, rows):
    fact = spark.createDataFrame([("a", 5), ("b", 6), ("old", 7)], "sk string, total int")
    dim = spark.createDataFrame([("a", "A", True, False), ("b", "B", True, True), ("old", "A", False, False)],
                                "sk string, name string, is_current boolean, trunk boolean")
    actives = spark.createDataFrame([("z", 1)], "sk string, n int")
    assert rows(dimensional.executive_view(fact, dim, actives, "sk", "trunk", {"n": "now"}).select("name", "total", "now")) == [("A", 5, 0)]
    assert quality.facts_on_closed_versions(fact, dim, "sk").count() == 1
    with pytest.raises(dimensional.EmptySource):
        dimensional.guarded(fact, dim, spark.createDataFrame([], "x int"))


def test_arrivals_are_classified_by_the_load_before(spark, rows):
    ledger = spark.createDataFrame([(1, 20232, 2015, 10), (2, 20241, 2016, 12)], "load_id int, watermark int, last_mature int, total int")
    cells = [
        (1, 2012, "ATIVO", None, 3), (1, 2012, "FORMATURA", 20231, 4), (1, 2019, "ATIVO", None, 3), (1, 2019, "EVASAO", 20222, 2),
        (2, 2012, "ATIVO", None, 1), (2, 2012, "FORMATURA", 20231, 6), (2, 2019, "FORMATURA", 20241, 3), (2, 2019, "EVASAO", 20222, 2),
    ]
    snapshots = spark.createDataFrame(cells, "load_id int, year int, outcome string, period int, total int")
    changes = late.arrivals(ledger, snapshots)
    assert rows(changes.select("year", "outcome", "period", "difference", "arrival", "published")) == [
        (2012, "ATIVO", None, -2, "SEM_PERIODO", True), (2012, "FORMATURA", 20231, 2, "ATRASADA", True),
        (2019, "ATIVO", None, -3, "SEM_PERIODO", False), (2019, "FORMATURA", 20241, 3, "NO_PRAZO", False),
    ]
    assert rows(late.arrival_summary(changes).select("window", "arrival", "more", "less", "cohorts_revised")) == [
        (2010, "ATRASADA", 2, 0, 1), (2010, "SEM_PERIODO", 0, 2, 1), (2015, "NO_PRAZO", 3, 0, 0), (2015, "SEM_PERIODO", 0, 3, 0)]
    equal = snapshots.filter("load_id = 1").unionByName(snapshots.filter("load_id = 1").withColumn("load_id", F.lit(2)))
    assert late.arrivals(ledger, equal).count() == 0


def test_change_only_upsert(spark, rows):
    target = spark.createDataFrame([(1, "a", None, "t"), (2, "b", 1, "t"), (3, "c", 1, "t")], "id int, v string, w int, stamp string")
    source = spark.createDataFrame([(1, "a", None), (2, "B", 1), (4, "d", 2)], "id int, v string, w int")
    merged = sync.change_only_upsert(target, source, ["id"], ["v", "w"], stamps=["stamp"])
    assert rows(merged) == [
        (1, "a", None, "t", "equal"), (2, "B", 1, None, "updated"), (3, "c", 1, "t", "kept"), (4, "d", 2, None, "inserted")]
    assert tuple(sync.action_counts(merged).first()) == (1, 1)
    inserted = sync.change_only_upsert(target, source, ["id"], ["v", "w"], insert_only=True)
    assert tuple(sync.action_counts(inserted).first()) == (1, 0)


def test_facts_are_relinked(spark, rows):
    fact = spark.createDataFrame([("h1", 5), ("h2", 6)], "sk string, total int")
    here = spark.createDataFrame([("h1", "A", "x"), ("h2", "B", "y")], "sk string, name string, since string")
    there = spark.createDataFrame([("t9", "A", "x"), ("t8", "B", "y")], "sk string, name string, since string")
    assert rows(sync.relink(sync.detach(fact, here, "sk", ["name", "since"]), there, "sk", ["name", "since"]).select("sk", "total")) == [("t8", 6), ("t9", 5)]


def test_every_mutation_trips_its_check(spark):
    from cohortlens.plans.catalog import PLANS

    got = {}
    for r in PLANS["bad_data_matrix"].run(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.mutation, set()).add(r.tripped)
    wanted = {
        "half the rows are missing": "volume", "a row comes twice": "unique:id", "people unknown": "not_null:person",
        "an unknown status": "accepted:status", "a year out of range": "range:year", "an unknown person": "related:person",
        "a cohort halved": "series", "dropouts of a cohort renamed": "bands", "a kind vanishes from a cohort": "vanishing",
        "negative permanence": "range:terms", "exit before entry": "domain:exit", "a column changes its type": "schema",
        "graduates counted as dropouts": "median",
    }
    assert "none" not in got and set(got) == set(wanted)
    assert all(check in got[fault] for fault, check in wanted.items())


def test_checks_of_many_tables_in_one(spark):
    """Grouped checks give what each table gives alone."""
    rows = [(g, i % (5 + g), None if i % 7 == g else i % 4, 2000 + i % (6 - g), "FORMATURA" if i % 3 else "EVASAO") for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id int, v int, year int, outcome string")
    known = spark.range(3).select(F.col("id").cast("int").alias("k"))
    rules = [Rule("unique", "id"), Rule("not_null", "v"), Rule("range", "v", (1, 2)), Rule("true", "v < 3"), Rule("related", "v", table=known, target="k")]
    whole = {(r.g, r.check): r.failures for r in quality.column_checks(df, rules, ["g"]).collect() if r.failures}
    jumps = lambda d, by=(): quality.series_jumps(d.groupBy(*by, "year").agg(F.count("*").alias("n")), "year", "n", 0.05, by)
    shares = lambda d, by=(): quality.outcome_shares(d, "year", {"EVASAO": (30, 40)}, by)
    gone = lambda d, by=(): quality.vanishing_keys(d.filter("NOT (v = 1 AND year = 2001)"), "v", "year", 1, by)
    middle = lambda d, by=(): quality.median_band(d, "v", 1.5, 9, by)
    for g in range(3):
        one = df.filter(F.col("g") == g).drop("g")
        assert {c: n for (k, c), n in whole.items() if k == g} == {r.check: r.failures for r in quality.column_checks(one, rules).collect() if r.failures}
        for check in (jumps, shares, gone, middle):
            alone = sorted(map(str, check(one).collect()))
            assert sorted(map(str, check(df, ["g"]).filter(F.col("g") == g).drop("g").collect())) == alone
        assert quality.volume(df, 1, 50, ["g"]).filter(F.col("g") == g).first().inside is False


def test_faults_are_checked_together(spark):
    from cohortlens.plans.catalog import PLANS

    plan = PLANS["bad_data_matrix"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if "Relation [" in line and "exit_year" in line]
    assert 0 < len(read) <= 10, "the table with the faults is read a few times, not once a fault and check"


def test_rules_are_watched_while_a_table_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (None, 7), (3, None)], "a int, b int")
    watched = quality.Watched(df, [Rule("not_null", "a"), Rule("range", "b", (6, 9))])
    watched.df.write.parquet(str(tmp_path / "t"))
    assert watched.failures() == {"not_null:a": 1, "range:b": 1}
    with pytest.raises(ValueError):
        quality.Watched(df, [Rule("unique", "a")])


def test_checks_on_small_tables(spark, rows):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "y")], "id int, v string")
    found = quality.column_checks(df, [Rule("not_null", "id"), Rule("unique", "id"), Rule("range", "id", (2, 3))])
    assert rows(found) == [("not_null:id", 1), ("range:id", 2), ("unique:id", 1)]
    counts = spark.createDataFrame([(2010, 100), (2011, 131), (2012, 130)], "y int, n int")
    assert [(r.y, r.change_pct) for r in quality.series_jumps(counts, "y", "n").collect()] == [(2011, 31.0)]
    status = quality.count_reconciliation(spark.createDataFrame(
        [("a", 1, 1, False), ("b", 1, 2, False), ("c", 2, 1, False), ("d", None, 1, False), ("e", None, None, True)],
        "t string, source_rows int, target_rows int, error boolean"))
    assert [r.status for r in status.orderBy("t").collect()] == ["RECONCILIADO", "RECONCILIADO_COM_EXTRAS", "DIVERGENTE", "NAO_VERIFICADO", "ERRO"]
    ok = ["OK", "RECONCILIADO", "RECONCILIADO_COM_EXTRAS"]
    for statuses, verdict in ((["OK", "RECONCILIADO"], "APROVADO"), (["OK", "DIVERGENTE"], "REQUER_ATENCAO"), (["VIOLAÇÃO LGPD", "DIVERGENTE"], "FALHA_CRITICA")):
        assert quality.verdict(spark.createDataFrame([(s,) for s in statuses], "status string"), ok).first()[0] == verdict


def test_vanishing_key(spark, rows):
    cells = {("A", 2010): 80, ("A", 2012): 90, ("B", 2010): 79, ("B", 2012): 90, ("C", 2012): 85, ("C", 2014): 99, ("A", 2013): 1, ("Z", 2014): 1}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "key string, year int")
    assert rows(quality.vanishing_keys(df, "key", "year", 80)) == [("A", 2011, 80, 90)]


def test_freshness_limits(spark):
    def at(text):
        return F.lit(text).cast("timestamp")

    sources = spark.createDataFrame([("new", "2024-02-01 00:00:00"), ("old", "2024-01-01 00:00:00")], "source string, p string").selectExpr(
        "source", "CAST(p AS TIMESTAMP) AS published")
    got = {r.check: (r.age_days, r.inside) for r in quality.freshness(sources, at("2024-01-10 00:00:00"), at("2024-03-08 01:00:00")).collect()}
    assert got["source:old"] == (0.0, True)
    assert got["source:new"][1] is False and got["source:new"][0] == pytest.approx(36 + 1 / 24)
    ahead = quality.freshness(sources, at("2024-05-01 00:00:00"), at("2024-03-01 00:00:00")).filter("check = 'processing'").first()
    assert (ahead.age_days, ahead.inside) == (0.0, True)


def test_privacy(spark):
    df = spark.createDataFrame([("A", 1)] * 3 + [("A", 2), ("B", 3)], "c string, q int")
    figures, sizes = privacy.uniqueness(df, ["c", "q"])
    assert tuple(figures.first()) == (5, 3, 2, 1, 40.0)
    assert [tuple(r) for r in sizes.collect()] == [(1, 2, 2), (3, 1, 3)]
    study = {r.grain: tuple(r)[1:] for r in privacy.grain_study(df, {"row": [], "c": ["c"], "c,q": ["c", "q"]}, k=3).collect()}
    assert study == {"row": (5, 5, 5, 5, 100.0, 100.0), "c": (2, 1, 1, 5, 50.0, 20.0), "c,q": (3, 2, 2, 5, 66.7, 40.0)}


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1, x) for x in range(1, 12)], "x double, y double, i int")
    assert tuple(stats.trend(df, "x", "y").first()) == pytest.approx((2.0, 1.0))
    assert tuple(stats.pearson(df.limit(2), "x", "y").first()) == (2, None)
    assert stats.log_correlation(df, "x", "y").first().significant
    assert stats.extremes(df, "x", "i", 10).count() == 11


def test_only_parts_that_differ_are_compared_row_by_row(spark, rows):
    left = spark.range(2000).select("id", (F.col("id") % 7).cast("string").alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    right = left.withColumn("v", F.when(F.col("id") == 5, "x").otherwise(F.col("v"))).filter("id <> 9").unionByName(left.filter("id < 3"))
    found = quality.two_way_except(left, right)
    assert rows(found) == [("only_in_left", 5, "5", 5), ("only_in_left", 9, "2", None), ("only_in_right", 5, "x", 5)]
    assert rows(quality.two_way_except(left, right, parts=1)) == rows(found)
    assert quality.two_way_except(left, left.repartition(3)).count() == 0
