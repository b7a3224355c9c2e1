"""Registered queries of the text operators against their SQL, over whole test tables."""

import duckdb
import pytest
from compare import differences

from carespend.llm.queries import oracle_sql, queries

TABLES = ["documents", "benchmark", "conversations"]
QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()
    assert len(want) > 0
    assert differences(got, want) == ""
