"""Every registered query against its SQL on the smallest tables, and the shape of some plans."""

import duckdb
import pytest

from check import rows_of
from cohortlens.plans.catalog import PLANS
from cohortlens.plans.registry import TABLES
from cohortlens.session import workspace

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", PLANS)
def test_query(spark, duck, name):
    with workspace(spark):
        df = PLANS[name].run(spark, FOLDER)
        mine = rows_of(df.columns, df.collect())
    if PLANS[name].oracle is None:
        assert mine[0]
        return
    result = duck.execute(PLANS[name].oracle)
    assert mine == rows_of([c[0] for c in result.description], result.fetchall())


def physical(spark, name):
    return PLANS[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = physical(spark, "filter_scan")
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(l_qu" in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_no_cartesian_product_anywhere(spark):
    for name in ("risk_class", "cross_limits", "prefix_inherit", "hybrid_rrf", "vector_topk", "asof_rate_sum"):
        plan = physical(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
