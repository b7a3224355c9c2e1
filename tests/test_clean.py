import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from carespend.functions import clean, features
from carespend.sources.schema import RECORD_DEFAULTS


def test_lenient_parsing(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "12.5"), ("bad", "3"), ("", "x"), (None, None), ("2024-02-30", "NaN")],
        "month string, monthly_medical_cost string",
    )
    out = clean.parse_numbers(clean.parse_dates(df, ["month"]), ["monthly_medical_cost"]).collect()
    assert [r[0] for r in out] == [dt.date(2024, 1, 1), None, None, None, None]
    assert [r[1] for r in out] == [12.5, 3.0, None, None, None]
    kept = clean.drop_null(clean.parse_dates(df, ["month"]), ["month", "monthly_medical_cost"])
    assert kept.count() == 1


def test_strict_parsing_fails(spark):
    df = spark.createDataFrame([("bad",)], "month string")
    with pytest.raises(PySparkException):
        clean.parse_dates(df, ["month"], strict=True).collect()


def test_fill(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, 3.0)], "a double, b double")
    out = clean.fill(df, {"a": F.col("b"), "c": 7}).collect()
    assert [tuple(r) for r in out] == [(2.0, 2.0, 7), (1.0, 3.0, 7)]


def test_impute_defaults_covers_every_input(spark):
    df = spark.createDataFrame([("m1", None, "High"), ("m2", 30, None)], "member_id string, age int, stress_level string")
    a, b = clean.impute_defaults(df).collect()
    assert (a["age"], a["stress_level"]) == (45, "High")
    assert (b["age"], b["stress_level"]) == (30, "Low")
    for c, v in RECORD_DEFAULTS.items():
        if c not in ("age", "stress_level"):
            assert a[c] == v and b[c] == v
    assert len(RECORD_DEFAULTS) == 32


def test_fix_categories_is_exact(spark):
    df = spark.createDataFrame(
        [("generic", "in patient"), ("High Cost Specialty", "In Patient"), ("GENERIC", None)],
        "drug_category string, site_of_care string",
    )
    out = [tuple(r) for r in clean.fix_categories(df).collect()]
    assert out == [("Generic", "Inpatient"), ("High-Cost Specialty", "In Patient"), ("GENERIC", None)]


def test_columns_by_type_and_role(spark):
    df = spark.createDataFrame(
        [("r", "m", dt.date(2024, 1, 1), "Male", 1, 2.0, 3.0)],
        "record_id string, member_id string, month date, gender string, age int, bmi double, monthly_medical_cost double",
    )
    assert clean.numeric_columns(df) == ["age", "bmi", "monthly_medical_cost"]
    assert clean.feature_columns(df) == ["age", "bmi"]


def test_conform_order_and_fill(spark):
    df = spark.createDataFrame([("k", "5", None)], "id string, b string, c double")
    out = clean.conform(df, ["a", "b", "c"], keep=["id"])
    assert out.columns == ["id", "a", "b", "c"]
    assert tuple(out.first()) == ("k", 0.0, 5.0, 0.0)


def test_cap_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (None,)], "v double")
    assert [r[0] for r in clean.cap_at(df, "v", 5.0).collect()] == [1.0, 5.0, None]


def test_generic_offset_threshold(spark):
    df = spark.createDataFrame([(0.7, 100.0), (0.71, 100.0), (75.0, 100.0), (None, 100.0)], "generic_rate double, drug_cost double")
    assert [r[0] for r in df.select(clean.generic_offset()).collect()] == [0.0, 10.0, 10.0, 0.0]
    assert [r[0] for r in df.select(clean.generic_offset(70)).collect()] == [0.0, 0.0, 10.0, 0.0]


def test_specialty_flag(spark):
    df = spark.createDataFrame([("HIGH-Cost Specialty drugs",), ("High Cost Specialty",), (None,)], "drug_category string")
    assert [r[0] for r in df.select(features.specialty_flag()).collect()] == [1.0, 0.0, 0.0]


def test_two_utilizations_treat_null_differently(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert [r[0] for r in df.select(features.utilization_total(["a", "b"])).collect()] == [1.0, 5.0]
    assert [r[0] for r in df.select(features.utilization_sum(["a", "b"])).collect()] == [None, 5]


@pytest.mark.parametrize(
    "text,year,month,want",
    [
        ("2027-06", None, None, (2027, 6)),
        (" 2028-1 ", None, None, (2028, 1)),
        ("2027-13", None, None, (2027, 13)),
        ("2027-06-15", None, None, (2027, 6)),
        ("x-y", "2030", "4", (2027, 1)),
        ("abc", "2030", "4", (2030, 4)),
        ("abc", None, None, (2027, 1)),
        ("abc", "2030", "2024-01-01", (2027, 1)),
        (None, "2030", "4", (2027, 1)),
        ("-5", None, None, (2027, 1)),
    ],
)
def test_period(spark, text, year, month, want):
    df = spark.createDataFrame([(text, year, month)], "p string, y string, m string")
    y, m = features.period("p", F.col("y"), F.col("m"))
    assert tuple(df.select(y, m).first()) == want


def test_time_index_starts_at_first_month(spark):
    df = spark.createDataFrame([(dt.date(2022, 11, 1),), (dt.date(2024, 2, 1),)], "month date")
    out = features.date_features(df).orderBy("month").collect()
    assert [(r["time_index"], r["quarter"], r["month_num"]) for r in out] == [(0, 4, 11), (15, 1, 2)]


def test_ratios_with_a_zero_denominator_are_null(spark):
    one = spark.createDataFrame([(-1, -1.0, -1.0)], "medication_count int, pharmacy_spend double, previous_year_medical_cost double")
    r = features.clinical_features(clean.impute_defaults(one)).first()
    assert r["cost_per_med"] is None and r["drug_spend_ratio"] is None and r["rx_burden_ratio"] is None


def test_feature_values(spark):
    """Worked out by hand from the default record."""
    r = features.clinical_features(clean.impute_defaults(spark.createDataFrame([("m",)], "member_id string")), serving=True).first()
    want = {
        "comorbidity_score": 0,
        "cardio_metabolic_risk": 0,
        "utilization_score": 3 + 2 * 2 + 0 * 4 + 1 * 6,
        "cost_per_med": 5000 / 4,
        "drug_spend_ratio": 500 / 5001,
        "rx_burden_ratio": 5000 / 60001,
        "oon_exposure": 6000,
        "oop_exposure": 12000,
        "inpatient_intensity": 2000,
        "provider_risk_index": 1.1,
        "active_lifestyle_score": 1.3,
        "bmi_age_interaction": 1.1 * 0.9,
        "cardio_hypertension": 0,
    }
    for c, v in want.items():
        assert r[c] == pytest.approx(v), c


def test_dates_of_one_pattern(spark):
    df = spark.createDataFrame([("31/12/2024",), ("2024-12-31",), (None,)], "d string")
    got = clean.parse_dates(df, ["d"], fmt="dd/MM/yyyy").collect()
    assert [str(r["d"]) for r in got] == ["2024-12-31", "None", "None"]


def written(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, d string")


def test_mixed_dates(spark):
    texts = ["2024-03-05", "2024-12-31", "31/12/2023", "01/02/2023", " 5/6/2022 ", "12-25-2021", "3-4-2021", "Mar 7, 2020", "8 Apr 2019", "20180910", "2017-11", "junk", "", None, "99/99/2020"]
    rows = clean.parse_mixed_dates(written(spark, texts), "d").orderBy("k").collect()
    assert [r["d"] and r["d"].isoformat() for r in rows] == [
        "2024-03-05", "2024-12-31", "2023-12-31", "2023-02-01", "2022-06-05", "2021-12-25", "2021-03-04", "2020-03-07", "2019-04-08", "2018-09-10", "2017-11-01", None, None, None, None,
    ]
    assert not any(r["d_ambiguous"] for r in rows)


def test_days_and_months_that_cannot_be_told_apart(spark):
    df = written(spark, ["01/02/2023", "03/04/2023", "2023-01-02"])
    shapes = {r["shape"]: r for r in clean.date_shapes(df, "d").collect()}
    assert shapes["9/9/9999"]["ambiguous"] and shapes["9/9/9999"]["format"] == "d/M/yyyy" and not shapes["9999-9-9"]["ambiguous"]
    rows = clean.parse_mixed_dates(df, "d").orderBy("k").collect()
    assert [r["d_ambiguous"] for r in rows] == [True, True, False] and rows[0]["d"].isoformat() == "2023-02-01"
    # the same day and month read alike either way
    alike = clean.date_shapes(written(spark, ["01/01/2023", "02/02/2023"]), "d").first()
    assert not alike["ambiguous"]


def test_known_shapes_serve_new_rows(spark):
    shapes = clean.date_shapes(written(spark, ["12/31/2023", "01/02/2023"]), "d")
    rows = clean.parse_mixed_dates(written(spark, ["03/04/2023", "2020-01-01"]), "d", shapes=shapes).orderBy("k").collect()
    assert rows[0]["d"].isoformat() == "2023-03-04" and rows[1]["d"] is None
    assert clean.parse_mixed_dates(written(spark, ["x"]).limit(0), "d").collect() == []
