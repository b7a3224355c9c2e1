import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from carespend import session
from carespend.sources import fixture, io
from carespend.sources.schema import CLAIMS


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text("Unnamed: 0,month,member_id,age,bmi,extra\n0,2024-01-01,m1,40,x,1\n1,bad,m2,,22.5,2\n")
    df = io.read_claims(spark, str(path), "csv")
    assert df.columns == CLAIMS.names
    a, b = df.orderBy("member_id").collect()
    assert (a["month"], a["age"], a["bmi"], a["drug_cost"]) == (dt.date(2024, 1, 1), 40, None, None)
    assert (b["month"], b["age"], b["bmi"]) == (None, None, 22.5)


def test_write_replaces_and_prunes(spark, sf, tmp_path):
    path = str(tmp_path / "claims")
    df = fixture.claims(spark, sf)
    io.write_claims(df, path)
    io.write_claims(df, path)
    back = io.read_claims(spark, path, schema=None)
    assert back.count() == df.count()
    plan = back.where("year = 1998").select("age")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<age:int>" in plan


def test_bucketed_table_saves_the_shuffle(spark, sf):
    spark.sql("DROP TABLE IF EXISTS claims_bucketed")
    io.write_claims(fixture.claims(spark, sf), table="claims_bucketed", bucket_by="member_id", buckets=4)
    df = io.read_table(spark, "claims_bucketed")
    plan = df.groupBy("member_id").agg(F.sum("drug_cost"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert df.count() == fixture.claims(spark, sf).count()
    spark.sql("DROP TABLE claims_bucketed")


def test_bucketing_needs_a_table(spark, sf, tmp_path):
    with pytest.raises(ValueError):
        io.write_claims(fixture.claims(spark, sf), str(tmp_path), bucket_by="member_id", buckets=4)


def test_parallel_database_reads_need_all_bounds(spark):
    with pytest.raises(ValueError):
        io.read_table(spark, "claims", url="jdbc:none:", partitionColumn="age")


def test_records(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text(json.dumps({"member_id": "m1", "age": 50}) + "\n" + json.dumps({"prediction_month": "2027-06"}) + "\n")
    a, b = io.read_records(spark, str(path)).orderBy(F.col("age").desc()).collect()
    assert (a["member_id"], a["age"], a["prediction_month"]) == ("m1", 50, None)
    assert b["prediction_month"] == "2027-06"


def test_sql_leaves_no_view_behind(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert io.run_sql({"t": df}, "SELECT sum(a) AS s FROM {t}").first()[0] == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_pyspark")]


def test_series(spark):
    df = spark.createDataFrame([(2021, 2.0), (2020, None)], "year int, v double")
    assert tuple(io.as_series(df, "year", "v").first()) == ([2020, 2021], [None, 2.0])


def test_report(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([("a, b", 1.5)], "line string, amount double")
    io.write_report(df, path)
    assert tuple(spark.read.option("header", True).csv(path).first()) == ("a, b", "1.5")


def test_stage_and_spread(spark, sf):
    df = io.stage(spark.range(100).coalesce(1), "numbers")
    assert df.count() == 100
    assert io.spread(df).rdd.getNumPartitions() >= 8
    wide = spark.range(0, 100, 1, 50)
    assert io.spread(wide) is wide


def test_shared_root_is_the_clusters_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_root(spark) == named
    assert session.shared_path(spark, "x").startswith(named + "/x-")


def test_fixture_grain(spark, sf):
    claims = fixture.claims(spark, sf)
    panel = fixture.panel(claims)
    assert panel.count() == panel.select("member_id", "month").distinct().count()
    months = fixture.member_months(claims)
    assert months.count() == panel.count()
    assert set(months.columns) == set(CLAIMS.names)


def test_numbers_written_otherwise(spark, tmp_path):
    path = str(tmp_path / "claims.csv")
    (tmp_path / "claims.csv").write_text("member_id,age,diabetes,bmi\n7,45.0,1,31.5\n8,72,0.0,x\n9,4.5,,\n")
    rows = io.read_claims(spark, path, "csv", bad_fields="bad").orderBy("member_id").collect()
    assert [(r["age"], r["diabetes"], r["bmi"], sorted(r["bad"])) for r in rows] == [
        (45, 1, 31.5, []),
        (72, 0, None, ["bmi"]),
        (None, None, None, ["age"]),
    ]


def test_record_numbers_as_text(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text(
        '{"age": 72.0, "bmi": "31.5", "hospital_admissions": 4.0}\n{"age": "72", "bmi": 31, "hospital_admissions": "4"}\n{"age": "old"}\n{}\n'
    )
    rows = io.read_records(spark, str(path), bad_fields="bad")
    got = sorted(map(str, rows.select("age", "bmi", "hospital_admissions", "bad").collect()))
    assert got == sorted(
        [
            "Row(age=72, bmi=31.5, hospital_admissions=4, bad=[])",
            "Row(age=72, bmi=31.0, hospital_admissions=4, bad=[])",
            "Row(age=None, bmi=None, hospital_admissions=None, bad=['age'])",
            "Row(age=None, bmi=None, hospital_admissions=None, bad=[])",
        ]
    )


def test_staged_files_are_deleted_on_request(spark, monkeypatch):
    """Those of this application that were staged since, and no others."""
    from pathlib import Path

    monkeypatch.setattr(session, "_staged", {})
    other = Path(session.shared_root(spark)) / "of-others"
    other.mkdir()
    kept = io.stage(spark.range(3), "kept")
    paths = [Path(p) for ps in session._staged.values() for p in ps]
    assert kept.count() == 3 and len(paths) == 1 and paths[0].is_dir()
    session.drop_staged(spark)
    assert not paths[0].exists() and other.is_dir() and session._staged == {}
