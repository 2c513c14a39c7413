import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohorts, consolidate, resolve, score


def test_outcome_metrics_edges(spark):
    """`>=` at the maximum, suppression below k, shares of 0 when no graduate is timed."""
    data = [("A", "FORMATURA", p, 8.0, 10.0, 12.0) for p in (8, 10, 12, 13, None)] + [("A", "EVASAO", 3, 8.0, 10.0, 12.0)] * 2
    data += [("B", "ATIVO", None, 8.0, 10.0, 12.0)] * 5 + [("C", "FORMATURA", 9, 8.0, 10.0, 12.0)] * 4
    df = spark.createDataFrame(data, "course string, outcome string, permanence int, minimum double, ideal double, maximum double")
    cells = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    got = {r.course: r for r in cohorts.outcome_metrics(cells, "course").collect()}
    assert set(got) == {"A", "B"}
    a = got["A"]
    assert (a.total, a.graduates, a.dropouts) == (7, 5, 2)
    assert (a.within_minimum_pct, a.within_ideal_pct, a.above_ideal_pct, a.at_maximum_pct) == (25.0, 50.0, 50.0, 50.0)
    assert (a.mean_terms, a.median_terms, a.mean_delay) == (10.75, 11.0, 0.75)
    b = got["B"]
    assert (b.graduation_pct, b.within_ideal_pct, b.mean_terms) == (0.0, 0.0, None)


def test_maturity_uses_all_rows(spark):
    df = spark.createDataFrame([(2010, 1), (2012, 1), (2020, 0)], "y int, ok int")
    assert [r.y for r in cohorts.mature(df.filter("ok = 1"), "y", 8, universe=df).orderBy("y").collect()] == [2010, 2012]
    assert cohorts.mature(df.filter("ok = 1"), "y", 8).count() == 0


def test_risk_index_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    delay, drop = np.round(rng.normal(1, 3, 90), 2), np.round(rng.uniform(5, 95, 90), 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(delay, drop))], "i int, mean_delay double, dropout_pct double")
    got = [r.risk_index for r in score.risk_index(df).orderBy("i").collect()]

    def scaled(x):
        s = np.clip(x, np.percentile(x, 5), np.percentile(x, 95))
        return (s - s.min()) / (s.max() - s.min() + 1e-6)

    wanted = np.round((0.3 * scaled(np.maximum(delay, 0)) + 0.7 * scaled(drop)) * 100, 1)
    assert got == pytest.approx(list(wanted))
    classes = score.risk_class(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "risk_index double"))
    assert [r.risk_class for r in classes.orderBy("risk_index").collect()] == [
        "RETENÇÃO BAIXA", "RETENÇÃO MÉDIA", "RETENÇÃO ALTA", "RETENÇÃO CRÍTICA"]


def test_panel_is_kept_only_for_the_same_load(spark):
    current = spark.createDataFrame([("A", 90.0), ("B", 10.0), ("ENGENHARIA", 50.0)], "course string, risk_index double")
    panel = score.critical_panel(current, "course", ("ENGENHARIA",))
    for source, origin in ((panel, "panel"), (panel.withColumn("risk_index", F.col("risk_index") + 1), "rebuilt")):
        got = score.panel_or_current(source, current, "course", "risk_index", ("ENGENHARIA",), ["course", "risk_index"])
        assert [tuple(r) for r in got.orderBy("position").collect()] == [(1, "A", 90.0, origin), (2, "B", 10.0, origin)]


def test_offers_and_mixed(spark, rows):
    df = spark.createDataFrame(
        [("A", "MATUTINO", "UNB GAMA", "BACHAREL"), ("A", "NOTURNO", "CEILANDIA", "LICENCIADO"), ("B", None, None, None), ("C", "VESPERTINO", "X", "BACHAREL")],
        "name string, shift string, campus string, degree string",
    )
    assert rows(consolidate.offers(df, "name", "shift", "campus")) == [
        ("A", "DIURNO E NOTURNO", "MULTICAMPUS"), ("B", "DIURNO", "DARCY RIBEIRO"), ("C", "DIURNO", "DARCY RIBEIRO")]
    assert rows(consolidate.mixed_keys(df, "name", "degree")) == [("A",)]


def test_area_is_inherited_only_when_all_agree(spark, rows):
    known = spark.createDataFrame([("X - A", "EXATAS"), ("X - B", "EXATAS"), ("Y - A", "EXATAS"), ("Y - B", "HUMANAS"), ("Z - A - B", "SAUDE")], "name string, area string")
    bases = spark.createDataFrame([(n,) for n in ("X", "Y", "Z", "Z - A", "", "X - A", "W")], "name string")
    assert rows(resolve.inherit_by_prefix(bases, known, "name", "area")) == [("X", "EXATAS"), ("Z", "SAUDE"), ("Z - A", "SAUDE")]


def test_latest_non_null_keeps_old_values(spark, rows):
    df = spark.createDataFrame([(1, "2022", "IE", "x"), (1, "2023", None, "y"), (2, "2022", "FT", "z")], "id int, v string, unit string, name string")
    assert rows(consolidate.latest_non_null(df, "id", ["unit", "name"], "v", "current")) == [(1, "IE", "y", True), (2, "FT", "z", False)]


def test_rule_usage_orders_by_use(spark, rows):
    df = spark.createDataFrame([("B",), ("B",), ("A",)], "c string")
    rules = spark.createDataFrame([("A", "X", 0), ("B", "Y", 1), ("N", "Z", 2)], "origin string, target string, place int")
    got = resolve.rule_usage(df, rules, "c", "origin", "place").select("position", "origin", "rows")
    assert rows(got) == [(1, "B", 2), (2, "A", 1), (3, "N", 0)]
