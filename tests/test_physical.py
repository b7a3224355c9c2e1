"""What the plans must not, and must, contain."""

import pytest
from __spark_entry__ import oracle_sql, queries
from conftest import SF

QUERIES = queries()
#: Queries that train at full settings before they have a plan; tests/test_trained.py runs them.
TRAINED = {"bundle_same"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - TRAINED))
def test_no_cross_joins_and_no_row_udfs(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert banned not in text


def test_columns_are_pruned(spark):
    text = plan(QUERIES["provider_cost"](spark, SF))
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double,l_discount:double>" in text
    assert "struct<c_custkey:bigint,c_mktsegment:string>" in text


def test_history_sorts_once(spark):
    """Previous cost and trailing mean share one window, hence one sort."""
    from carespend.queries import history

    text = plan(history(spark, SF).select("prev_month_cost", "cost_3m_avg"))
    assert text.count("Window [") == 1 and text.count("Sort [") == 1


def test_one_pass_gives_all_driver_averages(spark):
    from carespend.operators.aggregates import driver_averages
    from carespend.queries import fixed

    assert plan(driver_averages(fixed(spark, SF))).count("lineitem.parquet") == 1


def test_share_reuses_the_grouped_shuffle(spark):
    df = QUERIES["member_share"](spark, SF)
    df.collect()
    assert "ReusedExchange" in plan(df) and "Window" not in plan(df)


def test_minimum_and_maximum_month_are_read_together(spark):
    """Two scalar subqueries over the same rows become one, so the staged panel is scanned twice in all."""
    df = QUERIES["time_split"](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "mergedValue" in text
