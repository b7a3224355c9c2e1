"""Row-wise features, defined once for training and for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carespend.functions.clean import number
from carespend.sources.schema import PRIOR_YEAR, UTILIZATION


def date_features(df: DataFrame, col: str = "month", start: Column | None = None) -> DataFrame:
    """Year, month number, quarter, and months since ``start`` (the first month of ``df`` if not given).

    The first month is read by a scalar subquery, so no join or driver round trip is needed.
    """
    first = start if start is not None else df.agg(F.min(col)).scalar()
    return df.withColumns(
        {
            "year": F.year(col),
            "month_num": F.month(col),
            "quarter": F.quarter(col),
            "time_index": (F.year(col) - F.year(first)) * 12 + (F.month(col) - F.month(first)),
        }
    )


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def clinical_features(df: DataFrame, serving: bool = False) -> DataFrame:
    """Risk, utilization, spend and exposure scores. ``serving`` adds the two that only scoring uses.

    A ratio whose denominator is 0, which takes a negative count or amount, is null.
    """
    prior = _d(PRIOR_YEAR)
    out = {
        "comorbidity_score": _d("diabetes") + _d("hypertension") + _d("heart_disease") + _d("asthma"),
        "cardio_metabolic_risk": _d("diabetes") * _d("hypertension") * (_d("bmi") / 25),
        "utilization_score": _d("doctor_visits")
        + _d("specialist_visits") * 2
        + _d("emergency_visits") * 4
        + _d("hospital_admissions") * 6,
        "cost_per_med": F.try_divide(_d("pharmacy_spend"), _d("medication_count") + 1),
        "drug_spend_ratio": F.try_divide(_d("drug_cost"), _d("pharmacy_spend") + 1),
        "rx_burden_ratio": F.try_divide(_d("pharmacy_spend"), prior + 1),
        "oon_exposure": _d("out_of_network_rate") / 100 * prior,
        "oop_exposure": (100 - _d("insurance_coverage_percent")) / 100 * prior,
        "inpatient_intensity": _d("average_length_of_stay_days") * _d("unit_cost"),
        "provider_risk_index": _d("provider_mix_index") * (_d("out_of_network_rate") / 10),
        "active_lifestyle_score": (_d("daily_steps") / 5000) * (_d("sleep_hours") / 7),
    }
    if serving:
        out["bmi_age_interaction"] = (_d("bmi") / 25) * (_d("age") / 50)
        out["cardio_hypertension"] = _d("heart_disease") * _d("hypertension")
    return df.withColumns(out)


def specialty_flag(c: str = "drug_category") -> Column:
    """1.0 for a high-cost specialty drug, matched in any letter case; null is 0."""
    return F.coalesce(F.lower(c).contains("high-cost specialty").cast("double"), F.lit(0.0))


def utilization_total(columns: list[str] | None = None, available: list[str] | None = None) -> Column:
    """Visits and counts added up; what is null or does not parse counts as 0."""
    total = F.lit(0.0)
    for c in columns or UTILIZATION:
        if available is None or c in available:
            total = total + F.coalesce(number(c), F.lit(0.0))
    return total


def utilization_sum(columns: list[str]) -> Column:
    """Visits and counts added up; null if any of them is null, as in SQL arithmetic."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total


def monthly_prior(c: str = PRIOR_YEAR) -> Column:
    return F.col(c) / 12


def crore(c: Column) -> Column:
    """Rupees to crore."""
    return c / 10_000_000


def period(c: str | Column, year: Column | None = None, month: Column | None = None) -> tuple[Column, Column]:
    """Year and month from text such as ``2027-06``.

    Text without a dash falls back to ``year`` and ``month`` (2027 and 1 if null); if
    either part is not a whole number the period is January 2027. Months are not checked.
    """
    text = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("2027-01")))
    parts = F.split(text, "-")
    dashed = text.contains("-")

    def whole(value: Column) -> Column:
        return value.cast("string").try_cast("int")

    def other(value: Column | None, default: int) -> Column:
        if value is None:
            return F.lit(default)
        return F.when(value.isNull(), default).otherwise(whole(value))

    y = F.when(dashed, whole(F.get(parts, F.lit(0)))).otherwise(other(year, 2027))
    m = F.when(dashed, whole(F.get(parts, F.lit(1)))).otherwise(other(month, 1))
    bad = y.isNull() | m.isNull()
    return F.when(bad, 2027).otherwise(y), F.when(bad, 1).otherwise(m)
