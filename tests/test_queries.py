"""Every registered query against its SQL, on the smallest test tables."""

import pytest
from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences
from conftest import SF

from carespend import oracles

QUERIES, SQL = queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(SQL) - {"bundle_same"}))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(SQL[name]).df()
    assert len(want) > 0
    assert differences(got, want) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["year", "specialty", "utilization", "provider_mix", "unit_cost", "er_utilization"]
    assert df.count() > 0


def test_shares_add_up(spark, sf):
    rows = QUERIES["top_drivers"](spark, sf).collect()
    assert abs(sum(r["share"] for r in rows) - 100) < 0.05
    rows = QUERIES["drug_cost_share"](spark, sf).collect()
    assert abs(sum(r["share"] for r in rows) - 100) < 0.05


def test_first_index_is_100(spark, sf):
    first = QUERIES["driver_trend"](spark, sf).orderBy("year").first()
    assert set(first[1:]) == {100.0}
