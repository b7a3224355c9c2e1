"""Risk tiers, attribution tags and savings recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carespend.operators.lookup import bounded

HIGH_ABOVE, MODERATE_ABOVE = 30000, 15000

# Priority, tier, driver, title, lowest and highest saving (rupees a month),
# lowest and highest saving (percent).
CATALOG = [
    ("high", "high", "specialty", "Switch to Quality Generic Alternatives for Costly Medicines", 3500, 6000, 4, 7),
    ("high", "high", "site_of_care", "Choose Day-Care Clinics Over Overnight Hospital Stays", 2800, 5200, 3, 6),
    ("high", "high", "utilization", "Personal Nurse Support for High-Need Patients", 3200, 6400, 4, 8),
    ("medium", "moderate", "utilization", "Free 24/7 Doctor Phone & Video Advice", 1500, 3000, 2, 4),
    ("medium", "moderate", "provider_mix", "Visit Top-Rated Partner Doctors & Hospitals", 2000, 3800, 3, 5),
    ("medium", "moderate", "specialty", "3-Month Home Delivery for Daily Medications", 1200, 2400, 2, 4),
    ("low", "low", "utilization", "Smart Blood Pressure & Sugar Health Tracking", 800, 1600, 2, 3),
    ("low", "low", "unit_cost", "Pre-Payment Hospital Bill Verification", 500, 1500, 1, 3),
]
CATALOG_SCHEMA = (
    "priority string, tier string, driver string, title string, saving_lo int, saving_hi int, pct_lo int, pct_hi int"
)

# The tags in the order they are shown.
TAGS = {
    "pharmacy": "Specialty Rx & Pharmacy Load",
    "acute": "Acute Care Utilization",
    "chronic": "Chronic Disease Complexity",
    "network": "Out-of-Network Exposure",
    "active": "Active Lifestyle Benefit",
}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def cost_tier(c: str | Column) -> Column:
    """high above 30000, moderate above 15000, else low; a null cost has no tier."""
    cost = F.col(c) if isinstance(c, str) else c
    return (
        F.when(cost.isNull(), F.lit(None).cast("string"))
        .when(cost > HIGH_ABOVE, "high")
        .when(cost > MODERATE_ABOVE, "moderate")
        .otherwise("low")
    )


def attribution(df: DataFrame, name: str = "tags") -> DataFrame:
    """Add the array of spend drivers that apply to each record."""
    chronic = None
    for c in ("diabetes", "hypertension", "heart_disease", "asthma"):
        chronic = F.col(c) == 1 if chronic is None else chronic | (F.col(c) == 1)
    rules = {
        "pharmacy": (F.col("pharmacy_spend") > 4000) | (F.col("drug_category") == "Specialty"),
        "acute": (F.col("hospital_admissions") >= 1) | (F.col("emergency_visits") >= 1),
        "chronic": chronic,
        "network": F.col("out_of_network_rate") > 15,
        "active": (F.col("physical_activity") == "High") | (F.col("daily_steps") >= 8000),
    }
    return df.withColumn(name, F.array_compact(F.array(*[F.when(rule, TAGS[k]) for k, rule in rules.items()])))


def advise(
    df: DataFrame,
    advice: DataFrame,
    priority: str = "all",
    tier: str = "all",
    driver: str = "all",
) -> DataFrame:
    """Join each row's ``tier`` to the catalog entries for it, after the optional filters.

    The catalog is filtered before the join and broadcast once its size is checked, so a tier
    that holds most rows does not become one task.
    """
    for c, wanted in (("priority", priority), ("tier", tier), ("driver", driver)):
        if wanted != "all":
            advice = advice.where(F.col(c) == wanted)
    return df.join(bounded(advice), "tier")


def tier_savings(advice: DataFrame) -> DataFrame:
    """The largest monthly saving per tier: the upper bounds added up."""
    return advice.groupBy("tier").agg(
        F.sum("saving_hi").alias("max_saving"), F.sum("saving_lo").alias("min_saving"), F.count(F.lit(1)).alias("options")
    )
