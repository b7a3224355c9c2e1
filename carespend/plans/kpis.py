"""Headline figures, cost pressure and alerts, computed from the claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carespend.operators.aggregates import TREND_SIGNALS, driver_trend, growth, macro_annual
from carespend.plans.forecast import RANGE_LOWER, RANGE_UPPER, TREND_RATE

# Our rule: a forecast within budget is moderate; more than 40 % above it is critical.
CRITICAL_RATIO = 1.4


def budget_risk(forecast: Column, budget: Column) -> Column:
    return (
        F.when(forecast <= budget, "MODERATE").when(forecast <= budget * CRITICAL_RATIO, "HIGH").otherwise("CRITICAL")
    )


def kpis(df: DataFrame, budget: float | None = None, rate: float = TREND_RATE) -> DataFrame:
    """Per year: total, growth on the year before, next year's forecast with its band, and its risk.

    The risk compares the forecast with ``budget`` (in crore), or with the year's own total.
    """
    yearly = growth(macro_annual(df), "year", "total_cr", "yoy_growth_pct")
    forecast = F.col("total_cr") * (1.0 + rate)
    limit = F.lit(float(budget)) if budget is not None else F.col("total_cr")
    return yearly.select(
        "year",
        "total_cr",
        "yoy_growth_pct",
        forecast.alias("forecast_cr"),
        (forecast * RANGE_LOWER).alias("lower_cr"),
        (forecast * RANGE_UPPER).alias("upper_cr"),
        budget_risk(forecast, limit).alias("risk"),
    )


def pressure(df: DataFrame) -> DataFrame:
    """Per year and driver, a score from 0 to 100: half its index to the first year, so no change is 50."""
    score = {c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(c) / 2)) for c in TREND_SIGNALS}
    scored = driver_trend(df).select("year", *[s.alias(c) for c, s in score.items()])
    return scored.unpivot(["year"], TREND_SIGNALS, "driver", "score")


def alert(scores: DataFrame, limit: float = 60.0, critical: float = 80.0) -> DataFrame:
    """Per year: the overall score, its level, and the driver with the highest score."""
    overall = scores.groupBy("year").agg(
        F.avg("score").alias("overall_score"),
        F.max("score").alias("top_score"),
        F.max_by("driver", F.struct("score", "driver")).alias("top_driver"),
    )
    level = (
        F.when(F.col("overall_score") >= critical, "CRITICAL").when(F.col("overall_score") >= limit, "HIGH").otherwise("NORMAL")
    )
    return overall.withColumns(
        {
            "alert_level": level,
            "message": F.when(level == "NORMAL", "Cost pressure is within limits").otherwise(
                F.concat(F.lit("Emerging cost pressure in "), F.col("top_driver"))
            ),
        }
    )


def previous(df: DataFrame, order: str, col: str, name: str) -> DataFrame:
    """The value of the row before; for grouped results."""
    return df.withColumn(name, F.lag(col).over(Window.orderBy(order)))
