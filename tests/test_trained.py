"""Queries that train at full settings, on the smallest test tables."""

from __spark_entry__ import queries
from compare import connect, differences
from conftest import SF

from carespend import oracles


def test_a_saved_bundle_predicts_the_same(spark):
    got = queries()["bundle_same"](spark, SF).toPandas()
    want = connect(SF).execute(oracles.oracle_sql()["bundle_same"]).df()
    assert len(want) > 0
    assert differences(got, want) == ""
