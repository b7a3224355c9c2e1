"""Tables that are replaced version by version."""

import uuid

import pytest
from pyspark.sql import functions as F

from carespend.session import shared_path
from carespend.sources import io


@pytest.fixture
def place(spark):
    return f"versioned_{uuid.uuid4().hex[:8]}", shared_path(spark, "versions")


def test_a_failed_write_leaves_the_old_rows(spark, place):
    name, path = place
    io.replace_table(spark.range(100).withColumn("year", F.col("id") % 3), name, path, ["year"])
    bad = spark.range(1000).withColumn("year", F.when(F.col("id") == 999, F.raise_error(F.lit("stopped half-way")).cast("long")).otherwise(F.col("id") % 3))
    with pytest.raises(Exception, match="stopped half-way"):
        io.replace_table(bad.repartition(8), name, path, ["year"])
    assert spark.table(name).count() == 100 and len(io.versions(spark, path)) == 1


def test_a_table_is_replaced_from_itself(spark, place):
    name, path = place
    io.replace_table(spark.range(10), name, path)
    for turn in range(3):
        io.replace_table(spark.table(name).where(F.col("id") != turn), name, path)
    assert sorted(r["id"] for r in spark.table(name).collect()) == [3, 4, 5, 6, 7, 8, 9]


def test_readers_keep_their_files_until_versions_are_dropped(spark, place):
    name, path = place
    io.replace_table(spark.range(5), name, path)
    reader = spark.table(name)
    io.replace_table(spark.range(7).withColumn("more", F.lit("x")), name, path)
    assert reader.count() == 5 and spark.table(name).columns == ["id", "more"]
    assert len(io.versions(spark, path)) == 2
    assert len(io.drop_versions(spark, path)) == 1 and len(io.versions(spark, path)) == 1
    assert spark.table(name).count() == 7
    assert io.drop_versions(spark, path) == []


def test_types_empty_tables_and_pruning(spark, place):
    name, path = place
    df = spark.createDataFrame([(1, "a", 2020), (2, None, 2021), (3, "c", None)], "id int, `odd name` string, year int")
    io.replace_table(df, name, path, ["year"])
    assert spark.table(name).schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, spark.table(name).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    plan = spark.table(name).where("year = 2020").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    io.replace_table(df.limit(0), name, path, ["year"])
    assert spark.table(name).count() == 0
    assert io.versions(spark, path + "-none") == []
