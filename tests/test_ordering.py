import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import ordering, programme


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, values with many ties."""
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.randrange(200) / 4) for i in range(6000)]
    return data, spark.createDataFrame(data, "k string, i long, v double")


def test_exact_percentiles(skewed):
    data, df = skewed
    got = ordering.exact_percentiles(df, ["k"], "v", {"a": 0.05, "m": 0.5, "z": 0.95}).collect()
    for key, *cuts in got:
        values = [v for k, _, v in data if k == key]
        assert cuts == pytest.approx(list(np.percentile(values, [5, 50, 95])))
    assert len(got) == len({k for k, _, _ in data})
    whole = ordering.exact_percentiles(df, [], "v", {"m": 0.5}).first()[0]
    assert whole == pytest.approx(np.percentile([v for _, _, v in data], 50))


def test_percentiles_keep_the_null_group_and_odd_values(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), float(rng.randrange(50)) ** 3 - 9) for _ in range(3000)]
    data += [("n", 1, float("nan")), ("n", 1, 2.0), ("n", 1, 4.0), ("one", None, 7.5), ("none", 1, None)]
    df = spark.createDataFrame(data, "k string, j int, v double").repartition(7)
    probs = {"a": 0.0, "b": 0.31, "c": 0.5, "z": 1.0}
    for sketch in (20, 10_000):
        got = {(r.k, r.j): tuple(r[2:]) for r in ordering.exact_percentiles(df, ["k", "j"], "v", probs, sketch).collect()}
        groups = {}
        for k, j, v in data:
            if v is not None:
                groups.setdefault((k, j), []).append(v)
        assert set(got) == set(groups)
        for g, values in groups.items():
            if g[0] != "n":
                assert got[g] == pytest.approx(tuple(np.percentile(values, [0, 31, 50, 100])))
        assert got["n", 1][0] == 2.0 and got["n", 1][2] == 4.0 and np.isnan(got["n", 1][3])


def test_a_place_outside_its_bracket_is_found_by_counting(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 1000).cast("double").alias("v"))
    true = ordering.F.percentile_approx
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda c, asked, accuracy: true(c, [0.0] * len(asked), accuracy))
    got = {r.k: r.m for r in ordering.exact_percentiles(df, ["k"], "v", {"m": 0.5}).collect()}
    rows = df.collect()
    assert got == {k: pytest.approx(np.percentile([r.v for r in rows if r.k == k], 50)) for k in range(3)}


def test_null_keys_have_a_previous_row(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), (None, 3, 6), ("a", 1, 1), ("a", 2, 1)], "k string, i int, v int")
    got = {(r.k, r.i): (r.p, r.f) for r in ordering.with_previous(df, ["k"], ["i"], "v", "p", first="f").collect()}
    assert got == {(None, 1): (None, True), (None, 2): (5, False), (None, 3): (6, False), ("a", 1): (None, True), ("a", 2): (1, False)}
    kept = programme.append_on_change(df, ["k"], ["i"], "v")
    assert sorted((r.k or "", r.i) for r in kept.collect()) == [("", 1), ("", 2), ("a", 1)]


def test_bounded_percentiles(skewed):
    data, df = skewed
    for key, cuts in ordering.bounded_percentiles(df, ["k"], "v", [0.1, 0.9], "p").collect():
        assert cuts == pytest.approx(list(np.percentile([v for k, _, v in data if k == key], [10, 90])))


def test_numbered_is_row_number(skewed):
    data, df = skewed
    got = {i: p for _, i, _, p in ordering.numbered(df, F.desc("v"), F.asc("i")).collect()}
    wanted = {i: n for n, (_, i, _) in enumerate(sorted(data, key=lambda r: (-r[2], r[1])), start=1)}
    assert got == wanted


def test_ranked_shares_positions(skewed):
    data, df = skewed
    got = {(v, p) for _, _, v, p in ordering.ranked(df, "v").select("k", "i", "v", "position").collect()}
    values = [v for _, _, v in data]
    assert got == {(v, 1 + sum(x > v for x in values)) for v in set(values)}


def test_with_previous_and_append_on_change(skewed):
    data, df = skewed
    got = {i: (p, f) for _, i, _, p, f in ordering.with_previous(df, ["k"], ["i"], "v", "p", first="f").select("k", "i", "v", "p", "f").collect()}
    last, wanted, kept = {}, {}, set()
    for k, i, v in sorted(data, key=lambda r: r[1]):
        wanted[i] = (last.get(k), k not in last)
        if k not in last or last[k] != v:
            kept.add(i)
        last[k] = v
    assert got == wanted
    assert {r.i for r in programme.append_on_change(df, ["k"], ["i"], "v").collect()} == kept


def test_top_per_group_prunes_before_the_shuffle(skewed):
    _, df = skewed
    top = ordering.top_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_rate_in_force(spark):
    rates = spark.createDataFrame([("2012-07", 400.0), ("2023-02", 700.0)], "since string, v double")
    spans = spark.createDataFrame(
        [(1, "2022-07-01", "2023-06-30"), (2, "2010-01-15", "2010-03-01"), (3, "2023-02-28", "2023-02-28")],
        "i int, a string, b string",
    ).selectExpr("i", "CAST(a AS DATE) AS a", "CAST(b AS DATE) AS b")
    got = programme.rate_in_force(spans, "a", "b", rates, "since", "v", "amount").orderBy("i")
    assert [float(r.amount) for r in got.collect()] == [7 * 400 + 5 * 700, 1200, 700]


def test_rates_of_several_series_with_many_changes(spark):
    chance = random.Random(9)
    months = [f"{y}-{m:02}" for y in range(1700, 2020) for m in range(1, 13)]
    rates = {s: sorted(chance.sample(months, n)) for s, n in (("a", 3000), ("b", 1), ("c", 40))}
    value = {(s, m): chance.randrange(1, 999) for s, each in rates.items() for m in each}
    spans = [(i, chance.choice(["a", "b", "c", "d", None]), *(f"{chance.randrange(1690, 2030)}-{chance.randrange(1, 13):02}-11" for _ in "xy")) for i in range(300)]
    df = spark.createDataFrame([*spans, (300, "a", None, "2000-01-01"), (301, "a", "2000-01-01", None)], "i int, s string, a string, b string")
    df = df.withColumns({c: F.col(c).cast("date") for c in "ab"})
    given = spark.createDataFrame([(s, m, float(v)) for (s, m), v in value.items()], "s string, since string, v double")

    def slow(series, start, end):
        if series not in rates or start is None or end is None:
            return None
        total = 0
        for month in range(int(start[:4]) * 12 + int(start[5:7]) - 1, int(end[:4]) * 12 + int(end[5:7])):
            name = f"{month // 12}-{month % 12 + 1:02}"
            past = [m for m in rates[series] if m <= name]
            total += value[series, past[-1] if past else rates[series][0]]
        return total

    got = programme.rate_in_force(df, "a", "b", given, "since", "v", "amount", "s")
    assert got.columns == [*df.columns, "amount"]
    assert {r.i: r.amount and float(r.amount) for r in got.collect()} == {i: slow(s, a, b) for i, s, a, b in [*spans, (300, "a", None, ""), (301, "a", "", None)]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
