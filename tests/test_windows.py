import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carespend.operators import aggregates, lookup, windows


def months(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


SCHEMA = "member_id int, month date, record_id int, monthly_medical_cost double, previous_year_medical_cost double"


def test_history_does_not_cross_members(spark):
    rows = [(m, months(i), i, v, 120.0 * m) for i, (m, v) in enumerate([(1, 1.0), (1, 2.0), (1, 3.0), (2, 10.0), (2, 20.0)])]
    out = windows.cost_history(spark.createDataFrame(rows, SCHEMA)).orderBy("record_id").collect()
    assert [r["prev_month_cost"] for r in out] == [10.0, 1.0, 2.0, 20.0, 10.0]
    assert [r["cost_3m_avg"] for r in out] == [10.0, 1.0, 1.5, 20.0, 10.0]


def test_single_operators_agree_with_both(spark):
    rows = [(i % 3, months(i), i, float(i * i), 12.0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    both = windows.cost_history(df).orderBy("record_id").collect()
    one = windows.prev_cost(df).orderBy("record_id").collect()
    avg = windows.trailing_mean(df).orderBy("record_id").collect()
    assert [r["prev_month_cost"] for r in both] == [r["prev_month_cost"] for r in one]
    assert [r["cost_3m_avg"] for r in both] == [r["cost_3m_avg"] for r in avg]


def brute_force(rows, n=3):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    want = {}
    for key, group in by.items():
        for i, r in enumerate(group):
            before = [g[3] for g in group[max(0, i - n) : i]] if key is not None else []
            known = [v for v in before if v is not None]
            prior = None if r[4] is None else r[4] / 12
            prev = before[-1] if before and before[-1] is not None else prior
            want[r[2]] = (prev, sum(known) / len(known) if known else prior)
    return want


@pytest.mark.parametrize("hot_rows", [None, 1, 7, 40, 10_000])
def test_hot_members_match_brute_force(spark, hot_rows):
    """Member 1 holds a third of the rows, and some rows share a month or have no member or cost."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        member = 1 if i % 3 == 0 else rng.choice([None, *range(2, 60)])
        cost = None if rng.random() < 0.1 else float(rng.randrange(1000))
        rows.append((member, months(rng.randrange(8)), i, cost, rng.choice([None, 1200.0])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = windows.cost_history(df, order=("month", "record_id"), hot_rows=hot_rows).collect()
    want = brute_force(rows)
    assert len(out) == len(rows)
    for r in out:
        prev, avg = want[r["record_id"]]
        assert r["prev_month_cost"] == prev
        assert r["cost_3m_avg"] == pytest.approx(avg) if avg is not None else r["cost_3m_avg"] is None


def test_many_hot_members_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(windows, "MAX_HOT_KEYS", 1)
    rows = [(i % 4, months(i // 4), i, float(i), 12.0) for i in range(80)]
    out = windows.cost_history(spark.createDataFrame(rows, SCHEMA), order=("month", "record_id"), hot_rows=5).collect()
    want = brute_force(rows)
    assert all((r["prev_month_cost"], r["cost_3m_avg"]) == want[r["record_id"]] for r in out) and len(out) == 80


def test_copies_of_one_row_are_split(spark):
    rows = [(1, months(0), 0, 5.0, 12.0)] * 200 + [(2, months(0), 0, 7.0, 12.0)]
    out = windows.cost_history(spark.createDataFrame(rows, SCHEMA), order=("month", "record_id"), hot_rows=20)
    got = out.groupBy("member_id", "prev_month_cost", "cost_3m_avg").count().collect()
    assert {tuple(r) for r in got} == {(1, 1.0, 1.0, 1), (1, 5.0, 5.0, 199), (2, 1.0, 1.0, 1)}


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i % 5, months(i // 5), i, float(i), 12.0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = windows.cost_history(df.coalesce(1)).orderBy("record_id").collect()
    b = windows.cost_history(df.repartition(13)).orderBy("record_id").collect()
    assert a == b


def test_index_with_zero_baseline(spark):
    df = spark.createDataFrame([(2020, 0.0, 4.0), (2021, 5.0, 5.0)], "year int, v double, w double")
    out = aggregates.index_to_first(df, "year", ["v", "w"]).orderBy("year").collect()
    assert [tuple(r) for r in out] == [(2020, 100.0, 100.0), (2021, 100.0, 125.0)]


def test_growth_and_share(spark):
    df = spark.createDataFrame([(2020, 10.0), (2021, 12.0), (2022, 9.0)], "year int, v double")
    out = aggregates.growth(df, "year", "v").orderBy("year").collect()
    assert [r["growth_pct"] for r in out] == [None, 20.0, -25.0]
    shares = aggregates.share_of_total(df, "v").agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(100)


def test_null_keys_are_left_out_of_shares_but_kept_in_means(spark):
    df = spark.createDataFrame([("a", 30.0), (None, 60.0), ("b", 10.0)], "category string, monthly_medical_cost double")
    shares = {r[0]: r[1] for r in aggregates.share_by(df, "category").collect()}
    assert shares == {"a": 75.0, "b": 25.0}
    assert {r[0] for r in aggregates.mean_by(df, "category").collect()} == {"a", "b", None}


def test_share_of_nothing_is_empty(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", -1.0)], "category string, monthly_medical_cost double")
    assert aggregates.share_by(df, "category").count() == 0


def test_missing_columns_in_driver_trend(spark):
    df = spark.createDataFrame([("2020-01-01", "4"), ("2021-01-01", None), ("bad", "9")], "month string, unit_cost string")
    out = aggregates.driver_trend(df).orderBy("year").collect()
    assert [tuple(r) for r in out] == [(2020, 100.0, 100.0, 100.0, 100.0, 100.0), (2021, 100.0, 100.0, 100.0, 0.0, 100.0)]


def test_top_drivers_fallback(spark):
    cols = "drug_cost double, doctor_visits int, hospital_admissions int, emergency_visits int, specialist_visits int, "
    cols += "lab_tests int, medication_count int, site_of_care string, monthly_medical_cost double, "
    cols += "provider_mix_index double, unit_cost double, generic_rate double"
    df = spark.createDataFrame([(-1.0, 0, 0, 0, 0, 0, 0, "Outpatient", 5.0, 0.0, None, 1.0)], cols)
    got = {r["driver"]: r["share"] for r in aggregates.top_drivers(df).collect()}
    assert got == aggregates.FALLBACK_SHARES
    impact = {r["driver"]: r["impact"] for r in aggregates.driver_impact(df).collect()}
    assert impact["unit"] == 0.0 and impact["generic"] == pytest.approx(-0.1)


def test_latest(spark):
    df = spark.createDataFrame([(1, months(0), 5), (1, months(2), 6), (2, months(1), 7)], "member_id int, month date, x int")
    assert lookup.latest(df, ["month"]).first()["x"] == 6
    assert {r["member_id"]: r["x"] for r in lookup.latest(df, ["month"], by=["member_id"]).collect()} == {1: 6, 2: 7}


def test_lookup_default_and_size_check(spark):
    df = spark.createDataFrame([(1,), (9,)], "k int")
    dim = spark.createDataFrame([(1, "one")], "k int, name string")
    got = {r["k"]: r["name"] for r in lookup.lookup(df, dim, "k", {"name": "other"}).collect()}
    assert got == {1: "one", 9: "other"}
    large = spark.range(lookup.MAP_LIMIT + 1).withColumnRenamed("id", "k")
    assert lookup.bounded(large) is large
    with pytest.raises(ValueError):
        lookup.map_lookup(F.col("k"), dict.fromkeys(range(lookup.MAP_LIMIT + 1), 1), 0)


def test_align_series(spark):
    a = spark.createDataFrame([(2024, 5.0), (2025, 6.0)], "year int, value double")
    f = spark.createDataFrame([(2025, 9.0), (2026, 10.0)], "year int, value double")
    out = [tuple(r) for r in lookup.align_series(a, f).orderBy("year").collect()]
    assert out == [(2024, 5.0, None), (2025, 6.0, 6.0), (2026, None, 10.0)]
