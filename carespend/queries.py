"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.functions import clean, features
from carespend.ml import boosting, conformal, encode, ensemble, evaluate, pipeline, scoring, search, split
from carespend.ml.quantile import QuantileForest
from carespend.operators import aggregates, lookup, order, profile, quantiles, windows
from carespend.plans import advice, forecast, kpis, scenario
from carespend.session import shared_path
from carespend.sources import fixture, io
from carespend.sources.schema import CATEGORICAL, TARGET

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

# The order years end in 2001; these shifts bring them to the years the projections speak of.
TO_PROJECTION = 30
TO_HISTORY = 24

# Rows of one member above which its history is cut into runs.


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.claims(spark, sf)


def fixed(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fix_categories(raw(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return fixture.panel(raw(spark, sf))


def staged_panel(spark: SparkSession, sf: str) -> DataFrame:
    """For queries that read the panel more than once."""
    return io.stage(panel(spark, sf), "panel")


def history(spark: SparkSession, sf: str) -> DataFrame:
    # A member has one panel row per month, so its window is small.
    return windows.cost_history(panel(spark, sf), hot_rows=None)  # a row per member and month


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def day(c: str = "month") -> Column:
    return F.col(c).cast("string").alias(c)


def yearly_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregates.macro_annual(raw(spark, sf)), total_cr=4)


# --- sources and sinks ---------------------------------------------------------------


@query
def csv_scan(spark, sf):
    """Claims written as CSV, whole numbers as ``45.0``, and read back with the fixed schema."""
    path = shared_path(spark, "claims-csv")
    raw(spark, sf).withColumn("medication_count", F.col("medication_count").cast("double")).write.option("header", True).csv(path)
    schema = T.StructType([f for f in raw(spark, sf).schema.fields])
    df = io.read_claims(spark, path, "csv", schema)
    out = df.groupBy("site_of_care", "insurance_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("medication_count").alias("medications"),
        F.sum(TARGET).alias("total"),
    )
    return rounded(out, total=2)


@query
def table_roundtrip(spark, sf):
    """Claims replaced as a table partitioned by year and read back."""
    path = shared_path(spark, "claims")
    io.write_claims(raw(spark, sf), path)
    # The written files hold the columns of the frame, so their own schema is read.
    df = io.read_claims(spark, path, schema=None)
    out = df.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("total"))
    return rounded(out, total=2)


@query
def catalog_table(spark, sf):
    """Full scan of a named table."""
    raw(spark, sf).createOrReplaceTempView("carespend_claims")
    df = io.read_table(spark, "carespend_claims")
    return df.groupBy("city_type").agg(F.count(F.lit(1)).alias("n"), F.max("age").alias("oldest"))


@query
def sql_text(spark, sf):
    return io.run_sql(
        {"claims": raw(spark, sf)},
        """SELECT provider_type, insurance_type, count(*) AS n, round(sum(drug_cost), 2) AS drug_cost
           FROM {claims} WHERE emergency_visits > 0 GROUP BY provider_type, insurance_type""",
    )


@query
def json_records(spark, sf):
    """Scoring records read from JSON lines; fields left out get their defaults."""
    path = shared_path(spark, "records")
    sent = raw(spark, sf).select(
        F.col("member_id").cast("string").alias("member_id"),
        F.when(F.col("member_id") % 4 != 0, F.col("bmi")).cast("string").alias("bmi"),
        F.col("medication_count").cast("double").alias("medication_count"),
        "drug_category",
        F.lit("2027-06").alias("prediction_month"),
    )
    sent.write.json(path)
    df = clean.impute_defaults(io.read_records(spark, path))
    return df.groupBy("drug_category", "prediction_month").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("bmi"), 6).alias("avg_bmi"),
        F.sum("age").alias("ages"),
        F.sum("medication_count").alias("medications"),
    )


@query
def report_csv(spark, sf):
    """The scenario report written as CSV and read back as text."""
    path = shared_path(spark, "report")
    io.write_report(scenario_report(spark, sf), path)
    df = spark.read.option("header", True).csv(path)
    return df.groupBy("scenario", "section", "line").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("amount_cr").try_cast("double")), 4).alias("amount")
    )


@query
def column_series(spark, sf):
    """Yearly counts as parallel arrays, shown as text."""
    grouped = raw(spark, sf).groupBy(F.year("month").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    s = io.as_series(grouped, "year", "n")
    return s.select(
        F.array_join(F.col("year").cast("array<string>"), ",").alias("years"),
        F.array_join(F.col("n").cast("array<string>"), ",").alias("counts"),
    )


# --- cleaning and scalar functions ---------------------------------------------------


def text_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with month and cost as text, some of which does not parse."""
    o = fixture.table(spark, sf, "orders")
    date = F.col("o_orderdate").cast("date").cast("string")
    month = F.when(F.col("o_custkey") % 7 == 0, "bad").when(F.col("o_custkey") % 7 == 1, "").otherwise(date)
    cost = F.when(F.col("o_orderkey") % 11 == 0, "n/a").when(
        F.col("o_orderkey") % 11 != 1, F.col("o_totalprice").cast("string")
    )
    return o.select(month.alias("month"), cost.alias(TARGET), F.col("o_orderpriority").alias("drug_category"))


@query
def parse_lenient(spark, sf):
    df = clean.parse_numbers(clean.parse_dates(text_orders(spark, sf), ["month"]), [TARGET])
    kept = clean.drop_null(df, ["month", TARGET])
    out = kept.groupBy(F.year("month").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("avg_cost"))
    return rounded(out, avg_cost=4)


@query
def parse_strict(spark, sf):
    df = fixture.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("month"))
    return clean.parse_dates(df, ["month"], strict=True).groupBy(day()).agg(F.count(F.lit(1)).alias("n"))


@query
def fill_values(spark, sf):
    """Nulls filled with 0 and from another column."""
    df = text_orders(spark, sf)
    df = clean.parse_numbers(df, [TARGET]).withColumn("other", F.length("drug_category").cast("double"))
    df = clean.fill(df.withColumn("zeroed", F.col(TARGET)), {"zeroed": 0.0, TARGET: F.col("other"), "absent": 1.5})
    out = df.groupBy("drug_category").agg(
        F.sum("zeroed").alias("zeroed"), F.sum(TARGET).alias("filled"), F.sum("absent").alias("absent")
    )
    return rounded(out, zeroed=2, filled=2)


@query
def clean_categories(spark, sf):
    keys = ["insurance_type", "site_of_care", "provider_type", "drug_category"]
    return fixed(spark, sf).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query
def impute_defaults(spark, sf):
    df = raw(spark, sf).select(
        "member_id",
        F.when(F.col("member_id") % 4 != 0, F.col("bmi")).alias("bmi"),
        "site_of_care",
        "drug_category",
        F.when(F.col("member_id") % 3 != 0, F.col("daily_steps")).alias("daily_steps"),
    )
    return clean.impute_defaults(df).select(
        "member_id", "bmi", "site_of_care", "drug_category", "daily_steps", "age", "sleep_hours", "unit_cost"
    )


@query
def conform_columns(spark, sf):
    """Columns in a fixed order; absent ones are 0."""
    df = raw(spark, sf).select("member_id", "age", F.when(F.col("age") > 50, F.col("bmi")).alias("bmi"))
    return clean.conform(df, ["bmi", "time_index", "age"], keep=["member_id"])


@query
def winsorised_cost(spark, sf):
    # Staged, as the quantile is found in several passes.
    df = io.stage(raw(spark, sf).select("member_id", day(), TARGET), "costs")
    return rounded(quantiles.winsorise(df, TARGET), monthly_medical_cost=4)


@query
def date_features(spark, sf):
    df = features.date_features(staged_panel(spark, sf))
    return df.select("member_id", day(), "year", "month_num", "quarter", "time_index")


@query
def features_clinical(spark, sf):
    df = fixed(spark, sf)
    out = features.clinical_features(df, serving=True).withColumns(
        {
            "utilization_total": features.utilization_total(),
            "monthly_prior": features.monthly_prior(),
            "specialty_flag": features.specialty_flag(),
        }
    )
    return out.select("member_id", day(), *[c for c in out.columns if c not in df.columns])


# --- aggregates ----------------------------------------------------------------------


@query
def cost_trend_yearly(spark, sf):
    return rounded(aggregates.cost_trend(raw(spark, sf)), avg_cost=2)


@query
def driver_trend(spark, sf):
    return rounded(aggregates.driver_trend(fixed(spark, sf)), **{c: 2 for c in aggregates.TREND_SIGNALS})


@query
def drug_cost_share(spark, sf):
    return rounded(aggregates.share_by(fixed(spark, sf), "drug_category"), share=2)


@query
def site_of_care_cost(spark, sf):
    out = aggregates.mean_by(fixed(spark, sf), "site_of_care")
    return rounded(out, avg_cost=2).withColumn("site_of_care", clean.label("site_of_care"))


@query
def provider_cost(spark, sf):
    return rounded(aggregates.mean_by(fixed(spark, sf), "provider_type"), avg_cost=2)


@query
def drug_cost_mean(spark, sf):
    return rounded(aggregates.mean_by(fixed(spark, sf), "drug_category"), avg_cost=2)


@query
def monthly_cost(spark, sf):
    return rounded(aggregates.mean_by(raw(spark, sf), day()), avg_cost=2)


@query
def top_drivers(spark, sf):
    return rounded(aggregates.top_drivers(fixed(spark, sf)), share=2)


@query
def driver_impact(spark, sf):
    return rounded(aggregates.driver_impact(fixed(spark, sf)), impact=2)


@query
def macro_annual(spark, sf):
    return yearly_totals(spark, sf)


@query
def global_stats(spark, sf):
    v = F.col(TARGET)
    out = aggregates.global_stats(
        raw(spark, sf), {"lowest": F.min(v), "highest": F.max(v), "first_month": F.min("month").cast("string")}
    )
    return rounded(out, lowest=4, highest=4)


@query
def distinct_years(spark, sf):
    return aggregates.years(raw(spark, sf))


@query
def yoy_kpi(spark, sf):
    out = kpis.kpis(raw(spark, sf), budget=60.0)
    return rounded(out, total_cr=4, yoy_growth_pct=4, forecast_cr=4, lower_cr=4, upper_cr=4)


@query
def pressure_score(spark, sf):
    return rounded(kpis.pressure(fixed(spark, sf)), score=4)


# --- windows, latest, top-k ----------------------------------------------------------


@query
def prev_month_cost(spark, sf):
    return windows.prev_cost(panel(spark, sf), hot_rows=None).select("member_id", day(), TARGET, "prev_month_cost")


@query
def rolling_3m(spark, sf):
    return windows.trailing_mean(panel(spark, sf), hot_rows=None).select("member_id", day(), TARGET, "cost_3m_avg")


def _order_history(spark, sf, hot_rows):
    orders, customers = fixture.table(spark, sf, "orders"), fixture.table(spark, sf, "customer")
    df = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_custkey").alias("member_id"),
        F.col("o_orderdate").cast("date").alias("month"),
        F.col("o_orderkey").alias("record_id"),
        F.col("o_totalprice").alias(TARGET),
        (F.abs("c_acctbal") * 12).alias("previous_year_medical_cost"),
    )
    # Staged, as the sizes of the members are counted first.
    out = windows.cost_history(io.stage(df, "orders"), order=("month", "record_id"), hot_rows=hot_rows)
    return out.select("record_id", "member_id", day(), "prev_month_cost", F.round("cost_3m_avg", 6).alias("cost_3m_avg"))


@query
def order_history(spark, sf):
    """Previous order value per customer at order grain, where one customer may hold most orders."""
    return _order_history(spark, sf, windows.HOT_ROWS)


@query
def order_history_hot(spark, sf):
    """The same with customers of more than 20 orders cut into runs."""
    return _order_history(spark, sf, 20)


@query
def latest_record(spark, sf):
    return lookup.latest(panel(spark, sf), ["month", "member_id"]).select("member_id", day(), TARGET)


@query
def latest_per_member(spark, sf):
    return lookup.latest(panel(spark, sf), ["month"], by=["member_id"]).select("member_id", day(), TARGET)


@query
def top_members(spark, sf):
    totals = rounded(aggregates.sum_by(raw(spark, sf), "member_id"), total_cost=2)
    return lookup.top_k(totals, "total_cost", 15)


# --- profiling -----------------------------------------------------------------------


@query
def overview(spark, sf):
    return profile.overview(raw(spark, sf)).drop("type")


@query
def null_profile(spark, sf):
    return profile.null_profile(raw(spark, sf))


@query
def describe_cost(spark, sf):
    cols = [TARGET, "drug_cost", "generic_rate"]
    out = profile.describe(io.stage(raw(spark, sf).select(*cols), "described"), cols)
    return rounded(out, **{c: 4 for c in ("mean", "std", "min", "p25", "p50", "p75", "max")})


@query
def duplicates(spark, sf):
    return profile.duplicates(fixture.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query
def duplicate_claims(spark, sf):
    return profile.duplicates(raw(spark, sf))


@query
def duplicate_rows(spark, sf):
    """How often the claims attributes of a member repeat: all repeated rows with their copies."""
    df = raw(spark, sf).select("member_id", "site_of_care", "provider_type", "drug_category")
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query
def most_repeated(spark, sf):
    """The attributes that most claims share, whoever they belong to."""
    return profile.duplicate_sample(raw(spark, sf).select("site_of_care", "provider_type", "drug_category", "city_type"), 5)


@query
def numeric_summary(spark, sf):
    """Sum of every column that is numeric by type."""
    df = raw(spark, sf)
    cols = clean.numeric_columns(df)
    one = df.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    return rounded(one.unpivot([], cols, "column_name", "total"), total=2)


@query
def driver_profile(spark, sf):
    """The candidate drivers with the number of claims that have a value for them."""
    known = profile.overview(raw(spark, sf)).select("column_name", "non_null")
    return profile.driver_list(spark).join(known, "column_name").select("driver", "column_name", "non_null")


@query
def member_share(spark, sf):
    """Each member's share of all cost, for any number of members."""
    totals = rounded(aggregates.sum_by(raw(spark, sf), "member_id"), total_cost=4)
    return rounded(aggregates.share_of_total(totals, "total_cost"), share=8)


@query
def histogram(spark, sf):
    costs = io.stage(raw(spark, sf).select(TARGET), "costs")
    return rounded(profile.histogram(costs), bin_start=4)


@query
def scatter_admissions(spark, sf):
    return profile.scatter_bins(raw(spark, sf), "hospital_admissions")


@query
def scatter_emergency(spark, sf):
    return profile.scatter_bins(raw(spark, sf), "emergency_visits")


CORRELATED = [
    "age",
    "bmi",
    "diabetes",
    "doctor_visits",
    "hospital_admissions",
    "emergency_visits",
    "medication_count",
    "out_of_network_rate",
    "pharmacy_spend",
    "unit_cost",
    "drug_cost",
    "thin_spend",
    TARGET,
]


@query
def corr_matrix(spark, sf):
    # thin_spend is null in some rows, so its pairs use fewer rows.
    df = raw(spark, sf).withColumn("thin_spend", F.when(F.col("age") > 40, F.col("pharmacy_spend")))
    df = io.stage(df.select(*CORRELATED), "correlated")
    return rounded(profile.correlations(df, CORRELATED), corr=6)


# --- forecast, scenario, advice ------------------------------------------------------


def horizon_years(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.years(raw(spark, sf)).select((F.col("year") + TO_PROJECTION).alias("year"))


@query
def forecast_years(spark, sf):
    return forecast.project_years(horizon_years(spark, sf))


@query
def forecast_months(spark, sf):
    return forecast.project_months(forecast.project_years(horizon_years(spark, sf)))


@query
def forecast_from_actuals(spark, sf):
    out = forecast.project_from(yearly_totals(spark, sf), "year", "total_cr", 5)
    return rounded(out, forecast_cr=4, lower_cr=4, upper_cr=4)


@query
def actual_vs_forecast(spark, sf):
    yearly = io.stage(yearly_totals(spark, sf), "yearly")
    actual = yearly.select((F.col("year") + TO_HISTORY).alias("year"), F.col("total_cr").alias("value"))
    ahead = forecast.project_years(yearly.select((F.col("year") + TO_PROJECTION + 1).alias("year")))
    return forecast.actual_vs_forecast(actual, ahead.select("year", F.col("projected_cr").alias("value")))


def period_rows(df: DataFrame) -> DataFrame:
    """Claims with the period to predict as text, some of it malformed."""
    m = F.col("member_id") % 50
    text = F.format_string("%04d-%02d", F.year("month") + TO_PROJECTION, F.month("month"))
    period = F.when(m == 0, "abc").when(m == 1, "2027-13").when(m == 2, "x-y").when(m != 3, text)
    return df.select(
        "member_id",
        F.col(TARGET).alias("prediction"),
        period.alias("prediction_month"),
        F.when(F.col("member_id") % 100 == 0, "2029").alias("year"),
        F.when(F.col("member_id") % 200 == 0, "5").alias("month"),
    )


@query
def time_adjusted(spark, sf):
    out = forecast.adjust_period(period_rows(raw(spark, sf)))
    return rounded(out, trend_multiplier=3, season_factor=3).select(
        "member_id", "prediction_period", "trend_multiplier", "season_factor", "adjusted_cost"
    )


def member_levers(df: DataFrame) -> DataFrame:
    """A scenario per member, with levers read off the member's own mix of claims."""

    def pct(condition: Column) -> Column:
        return F.count_if(condition) * 100.0 / F.count(F.lit(1))

    return df.groupBy(F.col("member_id").alias("scenario")).agg(
        pct(F.col("drug_category") == "High-Cost Specialty").alias("specialty_drug"),
        pct(F.col("emergency_visits") > 0).alias("er"),
        pct(F.col("hospital_admissions") > 0).alias("inpatient"),
        F.when(F.col("scenario") % 10 != 0, pct(F.col("drug_category") == "Generic")).alias("generic"),
        pct(F.col("site_of_care") == "Outpatient").alias("site_of_care"),
        pct(F.col("provider_type") == "Specialist").alias("provider_mix"),
    )


@query
def scenario_eval(spark, sf):
    return rounded(
        scenario.evaluate_scenarios(member_levers(fixed(spark, sf))),
        scenario_forecast=4,
        savings=4,
        savings_pct=4,
        budget_variance=4,
    )


@query
def scenario_client(spark, sf):
    return rounded(
        scenario.client_scenarios(member_levers(fixed(spark, sf))),
        scenario_forecast=4,
        savings=4,
        savings_pct=4,
        budget_variance=4,
    )


def budgeted_years(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly totals, with the year before as the budget (the first year has its own)."""
    df = kpis.previous(yearly_totals(spark, sf), "year", "total_cr", "before")
    return df.select("year", "total_cr", F.coalesce("before", "total_cr").alias("budget_cr"))


@query
def scenario_presets(spark, sf):
    levers = scenario.with_presets(budgeted_years(spark, sf))
    out = scenario.client_scenarios(levers, base="total_cr", budget="budget_cr", keep=("year", "scenario"))
    return rounded(out, scenario_forecast=4, savings=4, savings_pct=4, budget_variance=4)


@query
def scenario_report(spark, sf):
    levers = scenario.with_presets(budgeted_years(spark, sf))
    out = scenario.scenario_report(levers, base="total_cr", budget="budget_cr", keep=("year", "scenario"))
    return rounded(out, setting_pct=4, weight_pct=4, amount_cr=4)


def variance(spark: SparkSession, sf: str) -> DataFrame:
    df = budgeted_years(spark, sf).withColumnRenamed("total_cr", "forecast_cr")
    return scenario.budget_variance(df)


@query
def budget_variance(spark, sf):
    return rounded(variance(spark, sf), variance_cr=4, variance_pct=4, containment_needed_cr=4)


@query
def budget_drivers(spark, sf):
    by_year = fixed(spark, sf).withColumn("year", F.year("month"))
    out = scenario.driver_contributions(variance(spark, sf), aggregates.top_drivers(by_year, ["year"]))
    return rounded(out.select("year", "driver", "share", "impact_lakh"), share=4, impact_lakh=4)


@query
def pressure_alert(spark, sf):
    return rounded(kpis.alert(kpis.pressure(fixed(spark, sf)), limit=50.0), overall_score=4, top_score=4)


@query
def advisor_horizon(spark, sf):
    return rounded(forecast.advisor_horizon(horizon_years(spark, sf)), savings_pct=4)


@query
def cost_tier(spark, sf):
    df = raw(spark, sf).withColumn("tier", advice.cost_tier(TARGET))
    out = df.groupBy("tier", "city_type").agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("total"))
    return rounded(out, total=2)


@query
def attribution_tags(spark, sf):
    df = advice.attribution(fixed(spark, sf))
    return df.select("member_id", day(), F.array_join("tags", "|").alias("tags"))


@query
def recommendations(spark, sf):
    df = panel(spark, sf).select("member_id", day(), advice.cost_tier(TARGET).alias("tier"))
    out = advice.advise(df, advice.catalog(spark))
    return out.select("member_id", "month", "tier", "priority", "driver", "title", "saving_lo", "saving_hi")


@query
def recommendations_filtered(spark, sf):
    df = panel(spark, sf).select("member_id", day(), advice.cost_tier(TARGET).alias("tier"))
    out = advice.advise(df, advice.catalog(spark), driver="utilization")
    return out.select("member_id", "month", "tier", "title", "pct_lo", "pct_hi")


@query
def tier_savings(spark, sf):
    rows = panel(spark, sf).groupBy(advice.cost_tier(TARGET).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    out = lookup.lookup(rows, advice.tier_savings(advice.catalog(spark)), "tier")
    return out.select("tier", "n", "max_saving", (F.col("n") * F.col("max_saving")).alias("potential"))


@query
def season_lookup(spark, sf):
    """A dimension join with a default for keys it does not have."""
    rows = raw(spark, sf).groupBy(F.quarter("month").alias("month_num")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("month_num", F.col("month_num") * 4)
    dim = spark.createDataFrame(list(forecast.SEASON.items()), "month_num int, factor double")
    return lookup.lookup(rows, dim, "month_num", {"factor": 1.0})


# --- model inputs and results that SQL can check -------------------------------------


@query
def one_hot(spark, sf):
    df = io.stage(fixed(spark, sf).select("member_id", day(), *CATEGORICAL), "categories")
    return encode.OneHotDropFirst.fit(df).transform(df).drop(*CATEGORICAL)


@query
def scaled(spark, sf):
    cols = ["age", "bmi", "pharmacy_spend", "unit_cost", "drug_cost"]
    rows = io.stage(raw(spark, sf).select("member_id", "month", *cols), "to-scale")
    train, _ = split.time_split(rows)
    out = encode.Scale.fit(train, cols).transform(rows.select("member_id", day(), *cols))
    return rounded(out, **{c: 6 for c in cols})


@query
def time_split(spark, sf):
    dated = features.date_features(staged_panel(spark, sf))
    return dated.select("member_id", day(), "time_index", split.is_holdout(dated).alias("holdout"))


@query
def time_folds(spark, sf):
    """Rows and months of each expanding-window fold."""
    dated = io.stage(features.date_features(staged_panel(spark, sf)), "dated")
    out = None
    for i, (train, valid) in enumerate(split.time_folds(dated), 1):
        for part, rows in (("fit", train), ("validate", valid)):
            one = rows.agg(
                F.lit(i).alias("fold"),
                F.lit(part).alias("part"),
                F.count(F.lit(1)).alias("n"),
                F.max("time_index").alias("last_index"),
            )
            out = one if out is None else out.unionByName(one)
    return out


@query
def metrics(spark, sf):
    """How well last month's cost predicts this month's."""
    df = history(spark, sf).withColumns(
        {"lo": F.col("prev_month_cost") * 0.5, "hi": F.col("prev_month_cost") * 1.5}
    )
    out = evaluate.evaluate(df, TARGET, "prev_month_cost", "lo", "hi")
    return rounded(out, r2=6, rmse=4, mae=4, mape=4, coverage=4)


@query
def voting(spark, sf):
    out = ensemble.vote(history(spark, sf), {"prev_month_cost": 1.0, "cost_3m_avg": 3.0})
    return out.select("member_id", day(), "prediction")


@query
def band(spark, sf):
    factor = lookup.map_lookup(F.month("month"), forecast.SEASON, 1.0)
    base = F.col("prev_month_cost")
    q = {"q10": base * 0.7, "q90": F.when(F.col("member_id") % 9 != 0, base * 0.72)}
    df = history(spark, sf).withColumns({"factor": factor, **q})
    df = df.withColumn("adjusted_cost", F.col("cost_3m_avg") * F.col("factor"))
    out = scoring.band(df, factor="factor")
    return out.select("member_id", day(), "lower", "upper")


@query
def log_inversion(spark, sf):
    df = history(spark, sf).withColumn("prediction", F.log1p("prev_month_cost"))
    out = scoring.invert_log(df, True)
    return out.select("member_id", day(), F.round("prediction", 4).alias("prediction"))


@query
def ridge_fit(spark, sf):
    """The stack's ridge on the two history inputs of the member panel."""
    fitted = ensemble.fit_ridge(io.stage(history(spark, sf), "history"), ["prev_month_cost", "cost_3m_avg"])
    row = (round(fitted.intercept, 2), *(round(w, 4) for w in fitted.weights.values()))
    return spark.createDataFrame([row], "intercept double, prev_weight double, avg_weight double")


# --- model training and scoring (row checks only) ------------------------------------

_bundles: dict[tuple[str, str], scoring.Bundle] = {}
_frames: dict[tuple[str, str], DataFrame] = {}


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The featured rows, staged once per application and data set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _frames:
        # Staged, because fitting the cap reads the rows several times.
        months = io.stage(fixture.member_months(raw(spark, sf)), "member-months")
        _frames[key] = io.stage(scoring.training_frame(months, hot_rows=None), "training")
        io.unstage(months)
    return _frames[key]


def design_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, encode.Design]:
    frame = training_rows(spark, sf)
    train = frame.where(~F.col("holdout"))
    numeric = clean.feature_columns(frame, drop=("record_id", "member_id", "month", TARGET, "holdout"))
    design = encode.Design.fit(train, numeric)
    keep = ["record_id", "member_id", "time_index", TARGET]
    return design.transform(io.spread(train), keep), design.transform(frame.where("holdout"), keep), design


def bundle(spark: SparkSession, sf: str) -> scoring.Bundle:
    """One trained bundle per application and data set."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _bundles:
        _bundles[key] = scoring.train_bundle(training_rows(spark, sf))
    return _bundles[key]


@query
def forest_predictions(spark, sf):
    train, test, _ = design_rows(spark, sf)
    model = ensemble.fit(ensemble.forest(), train)
    return model.transform(test).select("record_id", TARGET, "prediction")


@query
def boosted_predictions(spark, sf):
    train, test, _ = design_rows(spark, sf)
    model = ensemble.fit(ensemble.boosted(), train)
    return model.transform(test).select("record_id", TARGET, "prediction")


@query
def binned_boosted_predictions(spark, sf):
    train, test, _ = design_rows(spark, sf)
    model = ensemble.fit(ensemble.binned_boosted(), train)
    return model.transform(test).select("record_id", TARGET, "prediction")


@query
def stack_predictions(spark, sf):
    b = bundle(spark, sf)
    frame = training_rows(spark, sf).where("holdout")
    return scoring.predict(b, frame, ["record_id", TARGET])


@query
def voting_predictions(spark, sf):
    bases = bundle(spark, sf).model.bases
    voters = ensemble.Voting({"rf": bases["rf"], "gb": bases["gb"]}, {"rf": 1.0, "gb": 3.0})
    rows = bundle(spark, sf).design.transform(training_rows(spark, sf).where("holdout"), ["record_id", TARGET])
    return voters.transform(rows).drop("features")


@query
def quantile_bands(spark, sf):
    train, test, _ = design_rows(spark, sf)
    model = QuantileForest().fit(train)
    return model.transform(test).select("record_id", TARGET, "q10", "q90")


@query
def feature_importances(spark, sf):
    b = bundle(spark, sf)
    return evaluate.importances(b.model.bases["rf"], b.design.names, spark)


@query
def parameter_search(spark, sf):
    """Settings drawn for both learners, with their error over the time folds."""
    train, _, _ = design_rows(spark, sf)
    learners = {
        "forest": (ensemble.forest, search.FOREST_SPACE, search.FOREST_DRAWS),
        "boosted": (ensemble.boosted, search.BOOSTED_SPACE, search.BOOSTED_DRAWS),
    }
    out = None
    for name, (make, space, n) in learners.items():
        table, _ = search.random_search(make, train, space, n)
        table = table.withColumn("learner", F.lit(name)).withColumn("setting", F.to_json("setting"))
        out = table if out is None else out.unionByName(table)
    return out


@query
def batch_score(spark, sf):
    """Every member-month scored for the same month of a projected year, with the member's claims as history."""
    months = io.stage(fixture.member_months(raw(spark, sf)), "member-months")
    asked = F.format_string("%04d-%02d", F.year("month") + TO_PROJECTION, F.month("month"))
    return scoring.score(bundle(spark, sf), months.withColumn("prediction_month", asked).drop("month", TARGET), months)


@query
def forecast_latest(spark, sf):
    return scoring.forecast_latest(bundle(spark, sf), fixture.member_months(raw(spark, sf)))


@query
def bundle_roundtrip(spark, sf):
    """Predictions of a bundle that was saved and loaded again."""
    path = shared_path(spark, "bundle")
    scoring.save_bundle(bundle(spark, sf), spark, path)
    frame = training_rows(spark, sf).where("holdout")
    return scoring.predict(scoring.load_bundle(spark, path), frame, ["record_id", TARGET])


@query
def bundle_same(spark, sf):
    """Whether each holdout row gets the same prediction from a bundle that was saved and loaded again."""
    path = shared_path(spark, "bundle")
    trained = bundle(spark, sf)
    scoring.save_bundle(trained, spark, path)
    frame = io.stage(training_rows(spark, sf).where("holdout"), "holdout")
    before = scoring.predict(trained, frame, ["record_id"]).select("record_id", F.col("prediction").alias("p"), F.col("q10").alias("a"))
    after = scoring.predict(scoring.load_bundle(spark, path), frame, ["record_id"])
    same = F.col("p").eqNullSafe(F.col("prediction")) & F.col("a").eqNullSafe(F.col("q10"))
    return before.join(after, "record_id").select("record_id", same.alias("same"))


# --- orders over whole tables, bands by tier, sparse inputs, versions, date shapes -----


@query
def rolling_over_table(spark, sf):
    """The trailing mean over the whole table in the order of members and months, in runs of a few thousand rows."""
    out = order.rolling_over_table(panel(spark, sf), run_rows=4000)
    return rounded(out.select("member_id", day(), "cost_3m_avg"), cost_3m_avg=6)


@query
def position_folds(spark, sf):
    """Rows and bounds of expanding folds by position in the order of members and months."""
    folds = order.position_folds(panel(spark, sf), ["member_id", "month"], run_rows=4000)
    out = folds.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("member_id").alias("first_member"), F.max("member_id").alias("last_member"), F.sum(TARGET).alias("total"))
    return rounded(out, total=2)


@query
def conformal_bands(spark, sf):
    """Bands around last month's cost, calibrated by tier on the months before the holdout and measured on the holdout."""
    rows = io.stage(history(spark, sf).withColumn("tier", advice.cost_tier("prev_month_cost")), "history")
    before, after = split.time_split(rows)
    band = conformal.fit_band(before, "tier", "prev_month_cost", share=0.8)
    inside = conformal.coverage(band.transform(after, "prev_month_cost"), "tier")
    return rounded(band.table.join(inside, "tier", "left"), width=4)


@query
def sparse_inputs(spark, sf):
    """The places of the categories of each claim in its sparse vector, the member being one of them."""
    rows = io.stage(fixed(spark, sf).select("member_id", day(), "drug_category", "site_of_care", "age"), "categories")
    design = encode.SparseDesign.fit(rows, ["age"], ["member_id", "drug_category", "site_of_care"])
    found = design.transform(rows, ["member_id", "month"])
    entries = F.col("features").cast("string")
    listed = F.from_json(F.regexp_extract(entries, r"^\(\d+,(\[[^\]]*\])", 1), "array<int>")
    out = found.select("member_id", "month", F.explode(listed).alias("place")).where(F.col("place") > 0)
    return out.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("member_id").alias("members"))


@query
def table_replaced(spark, sf):
    """A table replaced by rows computed from itself, its old version kept until it is dropped."""
    path, name = shared_path(spark, "claims-versions"), f"carespend_replaced_{uuid.uuid4().hex[:8]}"
    first = raw(spark, sf).withColumn("year", F.year("month")).select("member_id", "year", "drug_category", TARGET)
    io.replace_table(first, name, path, ["year"])
    io.replace_table(spark.table(name).where("drug_category IS NOT NULL"), name, path, ["year"])
    out = spark.table(name).groupBy("year", "drug_category").agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("total"))
    kept = len(io.versions(spark, path))
    return rounded(out.withColumn("versions", F.lit(kept)), total=2)


def written_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as text, written in four ways, some of them not at all."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    ways = {0: "yyyy-MM-dd", 1: "dd/MM/yyyy", 2: "MMM d, yyyy", 3: "M-d-yyyy"}
    text = F.when(key % 50 == 0, F.lit("unknown"))
    for k, way in ways.items():
        text = text.when(key % 4 == k, F.date_format(date, way))
    return fixture.table(spark, sf, "orders").select(key.alias("order_key"), text.alias("written"))


@query
def parse_mixed(spark, sf):
    rows = io.stage(written_dates(spark, sf), "written-dates")
    out = clean.parse_mixed_dates(rows, "written")
    return out.select("order_key", day("written"), F.col("written_ambiguous").alias("ambiguous"))


@query
def date_shapes(spark, sf):
    """How the dates of a column are written, and by which format each shape is read."""
    return clean.date_shapes(written_dates(spark, sf), "written")


@query
def scatter_points(spark, sf):
    """Points of cost against admissions, the same ones wherever rows lie."""
    cost = F.round(F.col(TARGET) * 10000).cast("long")
    out = profile.scatter_points(raw(spark, sf), "hospital_admissions", [F.col("member_id"), F.col("month"), F.col("doctor_visits"), cost], k=20)
    return rounded(out, y=4)


@query
def first_rows(spark, sf):
    """The first claims by member, month and cost."""
    cols = ["member_id", "month", TARGET, "doctor_visits", "medication_count"]
    return rounded(profile.head(raw(spark, sf).select(cols), cols, 5).withColumn("month", F.col("month").cast("string")), **{TARGET: 4})


# --- boosting that SQL can check, and quantiles -----------------------------------------


def tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Claims per member and month with inputs of few values."""
    rows = features.date_features(staged_panel(spark, sf))
    inputs = [F.col(c).cast("double") for c in ("time_index", "month_num", "quarter")] + [(F.col("member_id") % 17).cast("double")]
    return rows.select("member_id", "month", TARGET, array_to_vector(F.array(*inputs)).alias("features"))


@query
def leafwise_tree(spark, sf):
    """The leaves of one leaf-wise tree: rows and mean cost of each."""
    rows = io.stage(tree_rows(spark, sf), "tree-rows")
    model = boosting.Boosting(boosting.Settings(rounds=1, rate=1.0, leaves=6, least=20)).fit(rows)
    placed = model.leaves(model.transform(rows), "leaf")
    out = placed.groupBy(F.col("leaf")[0].alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.min("prediction").alias("mean_cost"))
    return rounded(out.drop("leaf"), mean_cost=1)


@query
def boosted_quantiles(spark, sf):
    """P10 and P90 of the holdout by boosted quantiles."""
    train, test, _ = design_rows(spark, sf)
    return boosting.QuantileBoosting().fit(train).transform(test).select("record_id", TARGET, "q10", "q90")


@query
def pipeline_same(spark, sf):
    """Whether each holdout row gets the same scores from a small fitted pipeline and from the one loaded again."""
    frame = training_rows(spark, sf)
    numeric = clean.feature_columns(frame, drop=("record_id", "member_id", "month", TARGET, "holdout"))
    stack = ensemble.Stacked({"rf": ensemble.forest(trees=4, depth=5), "gb": ensemble.boosted(rounds=4, rate=0.3)}, cv=2)
    made = pipeline.scoring_pipeline(numeric, stack, QuantileForest(params={"trees": 3, "depth": 4}))
    fitted = made.fit(io.stage(frame.where(~F.col("holdout")), "train"))
    path = shared_path(spark, "pipeline")
    fitted.write().overwrite().save(path)
    rows = io.stage(frame.where("holdout"), "holdout")
    scores = ["prediction", "q10", "q90"]
    before = fitted.transform(rows).select("record_id", F.struct(*scores).alias("a"))
    after = PipelineModel.load(path).transform(rows).select("record_id", F.struct(*scores).alias("b"))
    return before.join(after, "record_id").select("record_id", (F.col("a").eqNullSafe(F.col("b")) & F.col("a.q10").isNotNull()).alias("same"))


def fixed_bundle(months: DataFrame) -> scoring.Bundle:
    """A bundle whose model is a known formula: nine tenths of last month's cost, a tenth of the mean, and 12 a month."""
    inputs = ["prev_month_cost", "cost_3m_avg", "time_index"]
    plain = encode.Scale([f"x_{c}" for c in inputs], {f"x_{c}": 0.0 for c in inputs}, {f"x_{c}": 1.0 for c in inputs})
    design = encode.Design(inputs, encode.OneHotDropFirst([], {}), plain)
    model = ensemble.StackedModel({"linear": ensemble.FixedLinear((0.9, 0.1, 12.0))}, ensemble.Ridge(0.0, {"p_linear": 1.0}))
    return scoring.Bundle(design, model, first_month=months.agg(F.min("month").cast("string")).first()[0])


@query
def linear_score(spark, sf):
    """Every member-month scored for its month of a projected year by a known formula, with the member's claims as history."""
    months = io.stage(fixture.member_months(raw(spark, sf)), "member-months")
    asked = F.format_string("%04d-%02d", F.year("month") + TO_PROJECTION, F.month("month"))
    out = scoring.score(fixed_bundle(months), months.withColumn("prediction_month", asked).drop("month", TARGET), months)
    return rounded(out.select("record_id", "prediction_period", "prediction", "adjusted_cost", "lower", "upper"), prediction=3, adjusted_cost=2, lower=2, upper=2)


@query
def linear_latest(spark, sf):
    """The newest record's cost by the same formula, from its own month and its member's earlier claims."""
    months = io.stage(fixture.member_months(raw(spark, sf)), "member-months")
    return rounded(scoring.forecast_latest(fixed_bundle(months), months), predicted_cost=3)
