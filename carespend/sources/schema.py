"""The claims table: one row per member per month."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
}

# Column order and types of the claims table.
CLAIM_COLUMNS = [
    ("record_id", "string"),
    ("member_id", "string"),
    ("month", "date"),
    ("age", "int"),
    ("bmi", "double"),
    ("gender", "string"),
    ("smoking_status", "string"),
    ("physical_activity", "string"),
    ("stress_level", "string"),
    ("diabetes", "int"),
    ("hypertension", "int"),
    ("heart_disease", "int"),
    ("asthma", "int"),
    ("daily_steps", "int"),
    ("sleep_hours", "double"),
    ("doctor_visits", "int"),
    ("hospital_admissions", "int"),
    ("emergency_visits", "int"),
    ("specialist_visits", "int"),
    ("lab_tests", "int"),
    ("medication_count", "int"),
    ("average_length_of_stay_days", "double"),
    ("insurance_type", "string"),
    ("insurance_coverage_percent", "double"),
    ("city_type", "string"),
    ("previous_year_medical_cost", "double"),
    ("out_of_network_rate", "double"),
    ("generic_rate", "double"),
    ("pharmacy_spend", "double"),
    ("site_of_care", "string"),
    ("provider_type", "string"),
    ("provider_mix_index", "double"),
    ("unit_cost", "double"),
    ("drug_category", "string"),
    ("drug_cost", "double"),
    ("monthly_medical_cost", "double"),
]

CLAIMS = T.StructType([T.StructField(n, _TYPES[t]) for n, t in CLAIM_COLUMNS])

# Scoring input: the claims columns plus what a caller may send about the period.
RECORDS = T.StructType(
    [T.StructField(n, _TYPES[t]) for n, t in CLAIM_COLUMNS if n not in ("month", "monthly_medical_cost")]
    + [T.StructField(n, T.StringType()) for n in ("prediction_month", "year", "month")]
)

TARGET = "monthly_medical_cost"
PRIOR_YEAR = "previous_year_medical_cost"
IDS = ["record_id", "member_id", "month"]
INDEX_COLUMN = "Unnamed: 0"

# The categorical inputs, in model order.
CATEGORICAL = [
    "gender",
    "smoking_status",
    "physical_activity",
    "stress_level",
    "insurance_type",
    "city_type",
    "site_of_care",
    "provider_type",
    "drug_category",
]

# Spellings that cleaning maps to the canonical label.
CATEGORY_FIXES = {
    "insurance_type": {"private": "Private"},
    "site_of_care": {"in patient": "Inpatient"},
    "provider_type": {"hospital": "Hospital"},
    "drug_category": {"generic": "Generic", "High Cost Specialty": "High-Cost Specialty"},
}

# What a scoring record gets where an input is absent or null.
RECORD_DEFAULTS = {
    "age": 45,
    "bmi": 27.5,
    "gender": "Male",
    "smoking_status": "Never",
    "physical_activity": "Moderate",
    "stress_level": "Low",
    "diabetes": 0,
    "hypertension": 0,
    "heart_disease": 0,
    "asthma": 0,
    "daily_steps": 6500,
    "sleep_hours": 7.0,
    "doctor_visits": 3,
    "hospital_admissions": 1,
    "emergency_visits": 0,
    "specialist_visits": 2,
    "lab_tests": 4,
    "medication_count": 3,
    "average_length_of_stay_days": 2.0,
    "insurance_type": "Private",
    "insurance_coverage_percent": 80.0,
    "city_type": "Urban",
    "previous_year_medical_cost": 60000.0,
    "out_of_network_rate": 10.0,
    "generic_rate": 75.0,
    "pharmacy_spend": 5000.0,
    "site_of_care": "Outpatient",
    "provider_type": "Hospital",
    "provider_mix_index": 1.1,
    "unit_cost": 1000.0,
    "drug_category": "Generic",
    "drug_cost": 500.0,
}

# The six visit and count columns that make up utilization.
UTILIZATION = [
    "doctor_visits",
    "hospital_admissions",
    "emergency_visits",
    "specialist_visits",
    "lab_tests",
    "medication_count",
]
