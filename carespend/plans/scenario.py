"""What-if scenarios: levers times weights, against a budget. Amounts are in crore."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_FORECAST = 12.80
BUDGET = 11.50

# Share of spend that each lever (in percent) acts on.
WEIGHTS = {
    "specialty_drug": 0.50,
    "er": 0.35,
    "inpatient": 0.40,
    "generic": 0.08,
    "site_of_care": 0.25,
    "provider_mix": 0.20,
}

# Lever settings used where a scenario does not give one.
LEVER_DEFAULTS = {
    "specialty_drug": 10.0,
    "er": 5.0,
    "inpatient": 3.0,
    "generic": 8.0,
    "site_of_care": 0.0,
    "provider_mix": 0.0,
}

# The weights that the exported report uses instead, with the lever's title.
REPORT_WEIGHTS = {
    "specialty_drug": 0.32,
    "site_of_care": 0.16,
    "er": 0.27,
    "provider_mix": 0.14,
    "generic": 0.08,
}
REPORT_TITLES = {
    "specialty_drug": "Specialty Drug Reduction",
    "site_of_care": "Site-of-Care Redirection",
    "er": "ER Avoidable Utilization",
    "provider_mix": "Provider Mix & Unit Cost",
    "generic": "Generic & Biosimilar Adoption",
}

# Preset name and its specialty, site, ER, provider and generic settings.
PRESETS = [
    ("balanced", 12.0, 10.0, 10.0, 8.0, 10.0),
    ("rx", 22.0, 5.0, 5.0, 5.0, 15.0),
    ("diversion", 8.0, 18.0, 20.0, 8.0, 5.0),
    ("reset", 0.0, 0.0, 0.0, 0.0, 0.0),
]
PRESET_LEVERS = ["specialty_drug", "site_of_care", "er", "provider_mix", "generic"]


def presets(spark: SparkSession) -> DataFrame:
    schema = "scenario string, " + ", ".join(f"{c} double" for c in PRESET_LEVERS)
    return spark.createDataFrame(PRESETS, schema)


def with_presets(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Each row once per preset, with its levers; generated in the row, without a join."""
    chosen = [p for p in PRESETS if names is None or p[0] in set(names)]
    options = F.array(
        *[
            F.struct(
                F.lit(p[0]).alias("scenario"),
                *[F.lit(v).alias(c) for c, v in zip(PRESET_LEVERS, p[1:])],
            )
            for p in chosen
        ]
    )
    return df.select("*", F.inline(options))


def _lever(df: DataFrame, c: str, defaults: Mapping[str, float]) -> Column:
    default = F.lit(float(defaults.get(c, 0.0)))
    return F.coalesce(F.col(c).cast("double"), default) if c in df.columns else default


def _amount(df: DataFrame, value: str | float) -> Column:
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def evaluate_scenarios(
    levers: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    base: str | float = BASE_FORECAST,
    budget: str | float = BUDGET,
    defaults: Mapping[str, float] = LEVER_DEFAULTS,
    keep: Iterable[str] = ("scenario",),
) -> DataFrame:
    """Savings, forecast and budget outcome of every scenario row: one projection, any number of rows.

    ``base`` and ``budget`` are amounts or column names. Savings may exceed the base; the
    forecast does not fall below 0.
    """
    b, limit = _amount(levers, base), _amount(levers, budget)
    savings = None
    for c, w in weights.items():
        part = b * (_lever(levers, c, defaults) / 100) * w
        savings = part if savings is None else savings + part
    out = levers.select(*keep, b.alias("current_forecast"), savings.alias("savings"), limit.alias("budget"))
    forecast = F.greatest(F.lit(0.0), F.col("current_forecast") - F.col("savings"))
    out = out.withColumn("scenario_forecast", forecast)
    return out.select(
        *keep,
        "current_forecast",
        "scenario_forecast",
        "savings",
        F.when(F.col("current_forecast") != 0, F.col("savings") / F.col("current_forecast") * 100).alias("savings_pct"),
        "budget",
        (F.col("scenario_forecast") - F.col("budget")).alias("budget_variance"),
        F.when(F.col("scenario_forecast") <= F.col("budget"), "WITHIN BUDGET")
        .otherwise("BUDGET OVERRUN RISK")
        .alias("budget_status"),
    )


def client_scenarios(levers: DataFrame, **options: object) -> DataFrame:
    """The five-lever variant: no inpatient term, and levers that are not given count as 0."""
    weights = {c: w for c, w in WEIGHTS.items() if c != "inpatient"}
    return evaluate_scenarios(levers, weights=weights, defaults={}, **options)


def scenario_report(
    levers: DataFrame,
    weights: Mapping[str, float] = REPORT_WEIGHTS,
    base: str | float = BASE_FORECAST,
    budget: str | float = BUDGET,
    keep: Iterable[str] = ("scenario",),
) -> DataFrame:
    """Long rows per scenario: each lever with setting, weight and saving, then the summary lines."""
    keep = list(keep)
    b, limit = _amount(levers, base), _amount(levers, budget)
    staged = levers.select(*keep, b.alias("_base"), limit.alias("_budget"), *[
        _lever(levers, c, {}).alias(f"_l_{c}") for c in weights
    ])

    def saving(c: str, w: float) -> Column:
        return F.col(f"_l_{c}") / 100 * w * F.col("_base")

    total = None
    for c, w in weights.items():
        total = saving(c, w) if total is None else total + saving(c, w)
    staged = staged.withColumn("_total", total)
    staged = staged.withColumn("_spend", F.greatest(F.lit(0.0), F.col("_base") - F.col("_total")))
    none = F.lit(None).cast("double")
    outcome = F.when(F.col("_spend") <= F.col("_budget"), "BUDGET PROTECTED").otherwise("BUDGET AT RISK")

    def line(position: int, section: str, name: str, setting: Column, weight: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(section).alias("section"),
            F.lit(name).alias("line"),
            setting.alias("setting_pct"),
            weight.alias("weight_pct"),
            amount.alias("amount_cr"),
        )

    lines = [
        line(i, "lever", REPORT_TITLES.get(c, c), F.col(f"_l_{c}"), F.lit(w * 100), saving(c, w))
        for i, (c, w) in enumerate(weights.items(), 1)
    ]
    pct = F.when(F.col("_base") != 0, F.col("_total") / F.col("_base") * 100)
    summary = [
        ("Approved Budget Ceiling", none, F.col("_budget")),
        ("Baseline Uncontained Forecast", none, F.col("_base")),
        ("Total Policy Net Savings", pct, F.col("_total")),
        ("Projected Scenario Spend", none, F.col("_spend")),
        ("Variance from Budget Ceiling", none, F.col("_spend") - F.col("_budget")),
    ]
    lines += [
        line(len(weights) + i, "summary", name, share, none, amount) for i, (name, share, amount) in enumerate(summary, 1)
    ]
    return staged.select(*keep, outcome.alias("outcome"), F.inline(F.array(*lines)))


def budget_variance(df: DataFrame, forecast: str = "forecast_cr", budget: str = "budget_cr") -> DataFrame:
    """How far a forecast is from its budget, and what has to be contained."""
    gap = F.col(forecast) - F.col(budget)
    return df.withColumns(
        {
            "variance_cr": gap,
            "variance_pct": F.when(F.col(budget) != 0, gap / F.col(budget) * 100),
            "risk_status": F.when(gap > 0, "HIGH RISK - BUDGET BREACH PREDICTED").otherwise("WITHIN BUDGET"),
            "containment_needed_cr": F.greatest(gap, F.lit(0.0)),
        }
    )


def driver_contributions(variance: DataFrame, shares: DataFrame, by: Iterable[str] = ("year",)) -> DataFrame:
    """Spread each variance over the cost drivers by their share, in lakh (a hundredth of a crore)."""
    return variance.join(shares, list(by)).withColumn("impact_lakh", F.col("variance_cr") * F.col("share"))
