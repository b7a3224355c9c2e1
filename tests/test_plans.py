import pytest
from pyspark.sql import functions as F

from carespend.plans import advice, forecast, kpis, scenario


def years(spark, *ys):
    return spark.createDataFrame([(y,) for y in ys], "year int")


def test_projected_years(spark):
    out = {r["year"]: r for r in forecast.project_years(years(spark, 2024, 2026, 2027, 2028, 2030, 2031, 2035)).collect()}
    assert [out[y]["projected_cr"] for y in (2026, 2027, 2028, 2030)] == [10.8, 12.8, 14.5, 18.6]
    assert out[2024]["projected_cr"] == round(10.8 / 1.114**2, 2)
    assert out[2031]["projected_cr"] == round(10.8 * 1.114**5, 2) == 18.53
    assert out[2035]["projected_cr"] == round(10.8 * 1.114**9, 2)
    assert out[2024]["growth_pct"] == out[2026]["growth_pct"] == 9.2
    assert out[2027]["growth_pct"] == 11.4 and out[2027]["growth_of_totals_pct"] == 18.52
    before = 10.8 * 1.114**8
    assert out[2035]["growth_pct"] == round((out[2035]["projected_cr"] - before) / before * 100, 2)
    assert (out[2028]["lower_cr"], out[2028]["upper_cr"]) == (13.48, 15.52)
    assert (out[2035]["lower_cr"], out[2035]["upper_cr"]) == (
        round(out[2035]["projected_cr"] * 0.93, 2),
        round(out[2035]["projected_cr"] * 1.07, 2),
    )
    assert [out[y]["risk"] for y in (2024, 2026, 2027, 2030, 2031)] == ["HIGH", "MODERATE", "HIGH", "CRITICAL", "CRITICAL"]
    assert [out[y]["action"] for y in (2024, 2031)] == ["Action Required", "Long-Range Overrun Alert"]


def test_months_of_a_year(spark):
    out = forecast.project_months(forecast.project_years(years(spark, 2027))).orderBy("month_num").collect()
    assert len(out) == 13
    total, january = out[0], out[1]
    assert january["forecast"] == 0.92 and january["lower"] == 0.86 and january["upper"] == 0.99
    assert total["forecast"] == 12.8
    assert total["lower"] == pytest.approx(sum(r["lower"] for r in out[1:]))
    assert sum(forecast.MONTH_SHARES) == pytest.approx(0.9915)


def test_period_adjustment(spark):
    df = spark.createDataFrame(
        [("2027-06", 100.0), ("2027-13", 100.0), ("x-y", 100.0), ("2025-12", 100.0)], "prediction_month string, prediction double"
    )
    out = forecast.adjust_period(df).collect()
    assert [r["prediction_period"] for r in out] == ["2027-06", "2027-13", "2027-01", "2025-12"]
    want = [100 * 1.114 * 0.9937, 100 * 1.114, 100 * 1.114 * 0.8625, 100 / 1.114 * 1.0875]
    assert [r["adjusted_cost"] for r in out] == pytest.approx(want)


def test_scenario_defaults(spark):
    df = spark.createDataFrame([("default",)], "scenario string")
    r = scenario.evaluate_scenarios(df).first()
    savings = 12.8 * (0.10 * 0.5 + 0.05 * 0.35 + 0.03 * 0.4 + 0.08 * 0.08)
    assert r["savings"] == pytest.approx(savings)
    assert r["scenario_forecast"] == pytest.approx(12.8 - savings)
    assert r["budget_status"] == "BUDGET OVERRUN RISK"


def test_scenario_floor_and_linearity(spark):
    levers = "specialty_drug er inpatient generic site_of_care provider_mix".split()
    rows = [("all", *[100.0] * 6), ("one", *[1.0] * 6), ("two", *[2.0] * 6), ("none", *[0.0] * 6)]
    df = spark.createDataFrame(rows, "scenario string, " + ", ".join(f"{c} double" for c in levers))
    out = {r["scenario"]: r for r in scenario.evaluate_scenarios(df).collect()}
    assert out["all"]["scenario_forecast"] == 0.0 and out["all"]["savings_pct"] == pytest.approx(178)
    assert out["two"]["savings"] == pytest.approx(2 * out["one"]["savings"])
    assert out["none"]["scenario_forecast"] == 12.8


def test_presets(spark):
    table = {r["scenario"]: r for r in scenario.presets(spark).collect()}
    assert list(table) == ["balanced", "rx", "diversion", "reset"]
    one = spark.createDataFrame([(1,)], "k int")
    got = {r["scenario"]: r for r in scenario.with_presets(one).collect()}
    for name, row in table.items():
        assert all(got[name][c] == row[c] for c in scenario.PRESET_LEVERS)
    out = {r["scenario"]: r for r in scenario.client_scenarios(scenario.with_presets(one)).collect()}
    want = 12.8 * (0.12 * 0.5 + 0.10 * 0.25 + 0.10 * 0.35 + 0.08 * 0.2 + 0.10 * 0.08)
    assert out["balanced"]["savings"] == pytest.approx(want)
    assert out["balanced"]["budget_status"] == "WITHIN BUDGET"
    assert out["reset"]["scenario_forecast"] == 12.8


def test_report_lines(spark):
    df = scenario.with_presets(spark.createDataFrame([(1,)], "k int"), ["balanced"])
    out = scenario.scenario_report(df).orderBy("position").collect()
    assert [r["line"] for r in out[:5]] == list(scenario.REPORT_TITLES.values())
    savings = [0.12 * 0.32, 0.10 * 0.16, 0.10 * 0.27, 0.08 * 0.14, 0.10 * 0.08]
    assert [r["amount_cr"] for r in out[:5]] == pytest.approx([12.8 * s for s in savings])
    assert [r["amount_cr"] for r in out[5:]] == pytest.approx(
        [11.5, 12.8, 12.8 * sum(savings), 12.8 * (1 - sum(savings)), 12.8 * (1 - sum(savings)) - 11.5]
    )


def test_budget_variance_of_the_reference_figures(spark):
    df = spark.createDataFrame([(12.8, 11.5), (11.0, 11.5)], "forecast_cr double, budget_cr double")
    a, b = scenario.budget_variance(df).collect()
    assert a["variance_cr"] == pytest.approx(1.3) and round(a["variance_pct"], 1) == 11.3
    assert a["risk_status"].startswith("HIGH RISK") and b["risk_status"] == "WITHIN BUDGET"
    assert b["containment_needed_cr"] == 0.0


def test_budget_risk_gives_the_table_labels(spark):
    df = spark.createDataFrame([(r[1], r[5]) for r in forecast.YEAR_TABLE], "total double, risk string")
    out = df.select("risk", kpis.budget_risk(F.col("total"), F.lit(11.5)).alias("got")).collect()
    assert all(r["risk"] == r["got"] for r in out)


def test_advisor_horizon(spark):
    out = {r["year"]: r for r in forecast.advisor_horizon(years(spark, 2026, 2030, 2040)).collect()}
    assert out[2026]["max_savings_cr"] == 1.55 and out[2030]["site_of_care_lakh"] == 55.8
    assert out[2040]["max_savings_cr"] == 1.85
    assert all(r["savings_pct"] == pytest.approx(14.4, abs=0.06) for r in out.values())


def test_tier_edges(spark):
    df = spark.createDataFrame([(15000.0,), (15000.01,), (30000.0,), (30000.01,), (None,)], "cost double")
    assert [r[0] for r in df.select(advice.cost_tier("cost")).collect()] == ["low", "moderate", "moderate", "high", None]


def test_attribution(spark):
    cols = "pharmacy_spend double, drug_category string, hospital_admissions int, emergency_visits int, diabetes int, "
    cols += "hypertension int, heart_disease int, asthma int, out_of_network_rate double, physical_activity string, daily_steps int"
    rows = [
        (4000.0, "Specialty", 0, 0, 0, 0, 0, 0, 15.0, "Low", 7999),
        (4000.01, None, 1, 0, 0, 0, 0, 1, 15.1, "Low", 8000),
        (0.0, "Generic", 0, 0, 0, 0, 0, 0, 0.0, None, None),
    ]
    out = [r["tags"] for r in advice.attribution(spark.createDataFrame(rows, cols)).collect()]
    assert out[0] == ["Specialty Rx & Pharmacy Load"]
    assert out[1] == list(advice.TAGS.values())
    assert out[2] == []


def test_advice_filters(spark):
    df = spark.createDataFrame([(1, "high"), (2, "low")], "id int, tier string")
    table = advice.catalog(spark)
    assert advice.advise(df, table).count() == 5
    assert advice.advise(df, table, driver="utilization").count() == 2
    assert advice.advise(df, table, priority="low").count() == 2
    assert advice.advise(df, table, priority="low", tier="high").count() == 0


def test_tier_savings(spark):
    got = {r["tier"]: r["max_saving"] for r in advice.tier_savings(advice.catalog(spark)).collect()}
    assert got == {"high": 17600, "moderate": 9200, "low": 3100}


def test_alert_levels(spark):
    df = spark.createDataFrame([(1, "a", 85.0), (1, "b", 90.0), (2, "a", 10.0), (3, "b", 60.0)], "year int, driver string, score double")
    out = {r["year"]: r for r in kpis.alert(df).collect()}
    assert [out[y]["alert_level"] for y in (1, 2, 3)] == ["CRITICAL", "NORMAL", "HIGH"]
    assert out[1]["top_driver"] == "b"


def test_results_are_ordered(spark, sf):
    from carespend.operators import aggregates
    from carespend.queries import raw

    claims = raw(spark, sf)
    means = [r["avg_cost"] for r in aggregates.mean_by(claims, "site_of_care").collect()]
    assert means == sorted(means, reverse=True) and len(means) > 1
    shares = [r["share"] for r in aggregates.share_by(claims, "drug_category").collect()]
    assert shares == sorted(shares, reverse=True) and len(shares) > 1
    for df in (aggregates.cost_trend(claims), aggregates.macro_annual(claims)):
        got = [r["year"] for r in df.collect()]
        assert got == sorted(got) and len(got) > 1
