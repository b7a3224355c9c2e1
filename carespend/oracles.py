"""SQL that gives the same result as each registered query, written for another engine."""

from __future__ import annotations

CLAIMS = """
claims AS (
SELECT o.o_custkey AS member_id,
       CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
       l.l_extendedprice * (1 - l.l_discount) AS monthly_medical_cost,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Emergency' WHEN '2-HIGH' THEN 'Inpatient'
            WHEN '3-MEDIUM' THEN 'in patient' WHEN '5-LOW' THEN 'Outpatient' END AS site_of_care,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Hospital' WHEN 'MACHINERY' THEN 'hospital'
            WHEN 'AUTOMOBILE' THEN 'Clinic' ELSE 'Specialist' END AS provider_type,
       CASE p.p_type WHEN 'PROMO' THEN 'High-Cost Specialty' WHEN 'LARGE' THEN 'High Cost Specialty'
            WHEN 'MEDIUM' THEN 'Brand' WHEN 'SMALL' THEN 'generic' WHEN 'ECONOMY' THEN 'Generic' END AS drug_category,
       CASE l.l_returnflag WHEN 'A' THEN 'Private' WHEN 'N' THEN 'private' ELSE 'Government' END AS insurance_type,
       CASE c.c_nationkey % 4 WHEN 0 THEN 'Metro' WHEN 1 THEN 'Urban' WHEN 2 THEN 'Semi-Urban' ELSE 'Rural' END AS city_type,
       CASE o.o_custkey % 2 WHEN 0 THEN 'Male' ELSE 'Female' END AS gender,
       CASE o.o_custkey % 3 WHEN 0 THEN 'Never' WHEN 1 THEN 'Former' ELSE 'Current' END AS smoking_status,
       CASE c.c_nationkey % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Moderate' ELSE 'High' END AS physical_activity,
       CASE c.c_nationkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Moderate' ELSE 'Low' END AS stress_level,
       CAST(20 + o.o_custkey % 60 AS INT) AS age,
       CAST(18 + o.o_custkey % 20 AS DOUBLE) AS bmi,
       CASE WHEN o.o_custkey % 5 = 0 THEN 1 ELSE 0 END AS diabetes,
       CASE WHEN o.o_custkey % 3 = 0 THEN 1 ELSE 0 END AS hypertension,
       CASE WHEN o.o_custkey % 7 = 0 THEN 1 ELSE 0 END AS heart_disease,
       CASE WHEN o.o_custkey % 11 = 0 THEN 1 ELSE 0 END AS asthma,
       CAST(2000 + (o.o_custkey % 10) * 1000 AS INT) AS daily_steps,
       CAST(5 + o.o_custkey % 5 AS DOUBLE) AS sleep_hours,
       l.l_linenumber AS doctor_visits,
       CASE WHEN o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS hospital_admissions,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS emergency_visits,
       CAST(p.p_size % 5 AS INT) AS specialist_visits,
       CAST(p.p_size % 10 AS INT) AS lab_tests,
       CAST(l.l_quantity AS INT) AS medication_count,
       l.l_linenumber * 0.5E0 AS average_length_of_stay_days,
       CAST(60 + (o.o_custkey % 5) * 10 AS DOUBLE) AS insurance_coverage_percent,
       abs(c.c_acctbal) * 12 AS previous_year_medical_cost,
       l.l_tax * 200 AS out_of_network_rate,
       l.l_discount * 1000 AS generic_rate,
       l.l_extendedprice * 0.1E0 AS pharmacy_spend,
       1 + l.l_tax AS provider_mix_index,
       l.l_extendedprice / l.l_quantity AS unit_cost,
       p.p_retailprice AS drug_cost
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
     JOIN customer c ON o.o_custkey = c.c_custkey
     JOIN part p ON l.l_partkey = p.p_partkey)"""

FIXED = """,
fixed AS (
SELECT * REPLACE (
       CASE insurance_type WHEN 'private' THEN 'Private' ELSE insurance_type END AS insurance_type,
       CASE site_of_care WHEN 'in patient' THEN 'Inpatient' ELSE site_of_care END AS site_of_care,
       CASE provider_type WHEN 'hospital' THEN 'Hospital' ELSE provider_type END AS provider_type,
       CASE drug_category WHEN 'generic' THEN 'Generic' WHEN 'High Cost Specialty' THEN 'High-Cost Specialty'
            ELSE drug_category END AS drug_category)
FROM claims)"""

PANEL = """,
panel AS (
SELECT member_id, month, round(sum(monthly_medical_cost), 4) AS monthly_medical_cost,
       max(previous_year_medical_cost) AS previous_year_medical_cost
FROM claims GROUP BY member_id, month)"""

HISTORY = """,
history AS (
SELECT member_id, month, monthly_medical_cost,
       coalesce(lag(monthly_medical_cost) OVER w, previous_year_medical_cost / 12) AS prev_month_cost,
       coalesce(avg(monthly_medical_cost) OVER (PARTITION BY member_id ORDER BY month
                    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), previous_year_medical_cost / 12) AS cost_3m_avg
FROM panel WINDOW w AS (PARTITION BY member_id ORDER BY month))"""

YEARLY = """,
yearly AS (
SELECT CAST(year(month) AS INT) AS year, round(sum(monthly_medical_cost) / 1e7, 4) AS total_cr
FROM claims GROUP BY year(month))"""

BUDGETED = """,
budgeted AS (
SELECT year, total_cr, coalesce(lag(total_cr) OVER (ORDER BY year), total_cr) AS budget_cr FROM yearly)"""

SIGNALS = """,
signals AS (
SELECT CAST(year(month) AS INT) AS year,
       avg(CASE WHEN lower(drug_category) LIKE '%high-cost specialty%' THEN 1e0 ELSE 0e0 END) AS specialty,
       avg(CAST(doctor_visits + hospital_admissions + emergency_visits + specialist_visits + lab_tests
                + medication_count AS DOUBLE)) AS utilization,
       avg(provider_mix_index) AS provider_mix,
       avg(unit_cost) AS unit_cost,
       avg(CAST(emergency_visits AS DOUBLE)) AS er_utilization
FROM fixed GROUP BY year(month)),
trend AS (
SELECT year,
       CASE WHEN first(specialty) OVER w <= 0 THEN 100e0 ELSE specialty / first(specialty) OVER w * 100 END AS specialty,
       CASE WHEN first(utilization) OVER w <= 0 THEN 100e0 ELSE utilization / first(utilization) OVER w * 100 END AS utilization,
       CASE WHEN first(provider_mix) OVER w <= 0 THEN 100e0 ELSE provider_mix / first(provider_mix) OVER w * 100 END AS provider_mix,
       CASE WHEN first(unit_cost) OVER w <= 0 THEN 100e0 ELSE unit_cost / first(unit_cost) OVER w * 100 END AS unit_cost,
       CASE WHEN first(er_utilization) OVER w <= 0 THEN 100e0 ELSE er_utilization / first(er_utilization) OVER w * 100 END AS er_utilization
FROM signals WINDOW w AS (ORDER BY year))"""

SCORES = """,
scores AS (
SELECT year, driver, least(100e0, greatest(0e0, idx / 2)) AS score
FROM (UNPIVOT trend ON specialty, utilization, provider_mix, unit_cost, er_utilization INTO NAME driver VALUE idx))"""

# The reference figures of the projected years, and what follows for other years.
PROJECTED = """,
given(year, total, growth, lo, hi, risk, action) AS (VALUES
       (2026, 10.80e0, 9.20e0, 10.10e0, 11.50e0, 'MODERATE', 'Within Guardrails'),
       (2027, 12.80e0, 11.40e0, 11.90e0, 13.70e0, 'HIGH', 'Action Required'),
       (2028, 14.50e0, 13.28e0, 13.48e0, 15.52e0, 'HIGH', 'Early Levers Required'),
       (2029, 16.40e0, 13.10e0, 15.25e0, 17.55e0, 'CRITICAL', 'Severe Overrun Risk'),
       (2030, 18.60e0, 13.41e0, 17.30e0, 19.90e0, 'CRITICAL', 'Critical Budget Alert')),
asked AS (SELECT DISTINCT CAST(year(month) + {shift} AS INT) AS year FROM claims),
totals AS (
SELECT y.year, coalesce(g.total, round(10.8e0 * pow(1.114e0, y.year - 2026), 2)) AS total
FROM (SELECT year FROM asked UNION SELECT year - 1 FROM asked) y LEFT JOIN given g USING (year)),
projected AS (
SELECT a.year, t.total AS projected_cr,
       coalesce(g.growth, CASE WHEN a.year > 2026
           THEN round((t.total - 10.8e0 * pow(1.114e0, a.year - 2027)) / (10.8e0 * pow(1.114e0, a.year - 2027)) * 100, 2)
           ELSE 9.2e0 END) AS growth_pct,
       round((t.total - b.total) / b.total * 100, 2) AS growth_of_totals_pct,
       coalesce(g.lo, round(t.total * 0.93e0, 2)) AS lower_cr,
       coalesce(g.hi, round(t.total * 1.07e0, 2)) AS upper_cr,
       coalesce(g.risk, CASE WHEN a.year >= 2029 THEN 'CRITICAL' ELSE 'HIGH' END) AS risk,
       coalesce(g.action, CASE WHEN a.year > 2030 THEN 'Long-Range Overrun Alert' ELSE 'Action Required' END) AS action
FROM asked a JOIN totals t ON t.year = a.year JOIN totals b ON b.year = a.year - 1 LEFT JOIN given g ON g.year = a.year)"""

SEASON = """,
season(m, f) AS (VALUES (1, 0.8625e0), (2, 0.8906e0), (3, 0.9187e0), (4, 0.9469e0), (5, 0.975e0), (6, 0.9937e0),
       (7, 1.0125e0), (8, 1.0312e0), (9, 1.05e0), (10, 1.0594e0), (11, 1.0687e0), (12, 1.0875e0))"""

LEVERS = """,
levers AS (
SELECT member_id AS scenario,
       count(*) FILTER (drug_category = 'High-Cost Specialty') * 100e0 / count(*) AS specialty_drug,
       count(*) FILTER (emergency_visits > 0) * 100e0 / count(*) AS er,
       count(*) FILTER (hospital_admissions > 0) * 100e0 / count(*) AS inpatient,
       CASE WHEN member_id % 10 <> 0 THEN count(*) FILTER (drug_category = 'Generic') * 100e0 / count(*) END AS generic,
       count(*) FILTER (site_of_care = 'Outpatient') * 100e0 / count(*) AS site_of_care,
       count(*) FILTER (provider_type = 'Specialist') * 100e0 / count(*) AS provider_mix
FROM fixed GROUP BY member_id)"""

PRESETS = """,
presets(scenario, specialty_drug, site_of_care, er, provider_mix, generic) AS (VALUES
       ('balanced', 12e0, 10e0, 10e0, 8e0, 10e0), ('rx', 22e0, 5e0, 5e0, 5e0, 15e0),
       ('diversion', 8e0, 18e0, 20e0, 8e0, 5e0), ('reset', 0e0, 0e0, 0e0, 0e0, 0e0)),
yearly_presets AS (SELECT * FROM budgeted, presets)"""

REPORT = """,
savings AS (
SELECT *, specialty_drug / 100 * 0.32e0 * total_cr AS s1, site_of_care / 100 * 0.16e0 * total_cr AS s2,
       er / 100 * 0.27e0 * total_cr AS s3, provider_mix / 100 * 0.14e0 * total_cr AS s4,
       generic / 100 * 0.08e0 * total_cr AS s5 FROM yearly_presets),
summed AS (SELECT *, s1 + s2 + s3 + s4 + s5 AS saved, greatest(0e0, total_cr - (s1 + s2 + s3 + s4 + s5)) AS spend FROM savings),
report AS (
SELECT year, scenario, CASE WHEN spend <= budget_cr THEN 'BUDGET PROTECTED' ELSE 'BUDGET AT RISK' END AS outcome,
       unnest([
       {'position': 1, 'section': 'lever', 'line': 'Specialty Drug Reduction', 'setting_pct': specialty_drug, 'weight_pct': 32e0, 'amount_cr': s1},
       {'position': 2, 'section': 'lever', 'line': 'Site-of-Care Redirection', 'setting_pct': site_of_care, 'weight_pct': 16e0, 'amount_cr': s2},
       {'position': 3, 'section': 'lever', 'line': 'ER Avoidable Utilization', 'setting_pct': er, 'weight_pct': 27e0, 'amount_cr': s3},
       {'position': 4, 'section': 'lever', 'line': 'Provider Mix & Unit Cost', 'setting_pct': provider_mix, 'weight_pct': 14e0, 'amount_cr': s4},
       {'position': 5, 'section': 'lever', 'line': 'Generic & Biosimilar Adoption', 'setting_pct': generic, 'weight_pct': 8e0, 'amount_cr': s5},
       {'position': 6, 'section': 'summary', 'line': 'Approved Budget Ceiling', 'setting_pct': NULL, 'weight_pct': NULL, 'amount_cr': budget_cr},
       {'position': 7, 'section': 'summary', 'line': 'Baseline Uncontained Forecast', 'setting_pct': NULL, 'weight_pct': NULL, 'amount_cr': total_cr},
       {'position': 8, 'section': 'summary', 'line': 'Total Policy Net Savings', 'setting_pct': saved / total_cr * 100, 'weight_pct': NULL, 'amount_cr': saved},
       {'position': 9, 'section': 'summary', 'line': 'Projected Scenario Spend', 'setting_pct': NULL, 'weight_pct': NULL, 'amount_cr': spend},
       {'position': 10, 'section': 'summary', 'line': 'Variance from Budget Ceiling', 'setting_pct': NULL, 'weight_pct': NULL, 'amount_cr': spend - budget_cr}
       ], recursive := true)
FROM summed)"""

CATALOG = """,
catalog(priority, tier, driver, title, saving_lo, saving_hi, pct_lo, pct_hi) AS (VALUES
       ('high', 'high', 'specialty', 'Switch to Quality Generic Alternatives for Costly Medicines', 3500, 6000, 4, 7),
       ('high', 'high', 'site_of_care', 'Choose Day-Care Clinics Over Overnight Hospital Stays', 2800, 5200, 3, 6),
       ('high', 'high', 'utilization', 'Personal Nurse Support for High-Need Patients', 3200, 6400, 4, 8),
       ('medium', 'moderate', 'utilization', 'Free 24/7 Doctor Phone & Video Advice', 1500, 3000, 2, 4),
       ('medium', 'moderate', 'provider_mix', 'Visit Top-Rated Partner Doctors & Hospitals', 2000, 3800, 3, 5),
       ('medium', 'moderate', 'specialty', '3-Month Home Delivery for Daily Medications', 1200, 2400, 2, 4),
       ('low', 'low', 'utilization', 'Smart Blood Pressure & Sugar Health Tracking', 800, 1600, 2, 3),
       ('low', 'low', 'unit_cost', 'Pre-Payment Hospital Bill Verification', 500, 1500, 1, 3))"""

TIER = "CASE WHEN monthly_medical_cost > 30000 THEN 'high' WHEN monthly_medical_cost > 15000 THEN 'moderate' ELSE 'low' END"

TEXT_ORDERS = """
text_orders AS (
SELECT CASE o_custkey % 7 WHEN 0 THEN 'bad' WHEN 1 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS month,
       CASE o_orderkey % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS cost,
       o_orderpriority AS drug_category
FROM orders)"""

AVERAGES = """
       greatest(coalesce(avg(drug_cost), 0), 0) AS specialty,
       greatest(coalesce(avg(doctor_visits + hospital_admissions + emergency_visits + specialist_visits + lab_tests
                             + medication_count), 0), 0) AS utilization,
       greatest(coalesce(avg(CASE WHEN site_of_care = 'Inpatient' THEN monthly_medical_cost ELSE 0 END), 0), 0) AS site,
       greatest(coalesce(avg(provider_mix_index), 0), 0) AS provider,
       greatest(coalesce(avg(unit_cost), 0), 0) AS unit"""

NAMED = [
    "member_id", "month", "monthly_medical_cost", "site_of_care", "provider_type", "drug_category", "insurance_type",
    "city_type", "gender", "smoking_status", "physical_activity", "stress_level", "age", "bmi", "diabetes",
    "hypertension", "heart_disease", "asthma", "daily_steps", "sleep_hours", "doctor_visits", "hospital_admissions",
    "emergency_visits", "specialist_visits", "lab_tests", "medication_count", "average_length_of_stay_days",
    "insurance_coverage_percent", "previous_year_medical_cost", "out_of_network_rate", "generic_rate",
    "pharmacy_spend", "provider_mix_index", "unit_cost", "drug_cost",
]

TEXT = {
    "month", "site_of_care", "provider_type", "drug_category", "insurance_type", "city_type", "gender", "smoking_status",
    "physical_activity", "stress_level",
}

CORRELATED = [
    "age", "bmi", "diabetes", "doctor_visits", "hospital_admissions", "emergency_visits", "medication_count",
    "out_of_network_rate", "pharmacy_spend", "unit_cost", "drug_cost", "thin_spend", "monthly_medical_cost",
]


def _with(text: str, *parts: str) -> str:
    # A text that starts with a comma goes on with the list of named queries.
    return "WITH " + CLAIMS.strip() + "".join(parts) + "\n" + text.strip()


def _scenario(source: str, keep: str, base: str, budget: str, savings: str) -> str:
    return f"""
SELECT {keep}, {base} AS current_forecast, round(greatest(0e0, {base} - savings), 4) AS scenario_forecast,
       round(savings, 4) AS savings, round(savings / {base} * 100, 4) AS savings_pct, {budget} AS budget,
       round(greatest(0e0, {base} - savings) - {budget}, 4) AS budget_variance,
       CASE WHEN greatest(0e0, {base} - savings) <= {budget} THEN 'WITHIN BUDGET' ELSE 'BUDGET OVERRUN RISK' END AS budget_status
FROM (SELECT *, {savings} AS savings FROM {source})"""


def _terms(base: str, weights: list[tuple[str, str]]) -> str:
    return " + ".join(f"{base} * ({lever} / 100) * {w}" for lever, w in weights)


_ALL_LEVERS = [
    ("specialty_drug", "0.5e0"),
    ("er", "0.35e0"),
    ("inpatient", "0.4e0"),
    ("coalesce(generic, 8e0)", "0.08e0"),
    ("site_of_care", "0.25e0"),
    ("provider_mix", "0.2e0"),
]
_CLIENT_LEVERS = [
    ("specialty_drug", "0.5e0"),
    ("er", "0.35e0"),
    ("coalesce(generic, 0e0)", "0.08e0"),
    ("site_of_care", "0.25e0"),
    ("provider_mix", "0.2e0"),
]


def _describe(cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
       round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM claims"""
        for c in cols
    )


def _overview() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS non_null, count(*) AS row_count FROM claims"
        for i, c in enumerate(NAMED)
    )


def _nulls() -> str:
    total = " + ".join(f"(count(*) - count({c}))" for c in NAMED)
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, CAST({total} AS BIGINT) AS total_nulls FROM claims"
        for c in NAMED
    )


def _correlations() -> str:
    pairs = [
        f"""SELECT '{a}' AS x, '{b}' AS y, round(corr(a, b), 6) AS corr
            FROM (SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM thin) WHERE a IS NOT NULL AND b IS NOT NULL"""
        for a in CORRELATED
        for b in CORRELATED
    ]
    return "\nUNION ALL\n".join(pairs)


_THIN = """,
thin AS (SELECT *, CASE WHEN age > 40 THEN pharmacy_spend END AS thin_spend FROM claims)"""

_INDEXED = """,
bounds AS (SELECT min(month) AS first_month, max(month) AS last_month FROM {source}),
indexed AS (
SELECT s.*, CAST((year(month) - year(first_month)) * 12 + month(month) - month(first_month) AS INT) AS time_index,
       CAST((year(last_month) - year(first_month)) * 12 + month(last_month) - month(first_month) AS INT) AS last_index
FROM {source} s, bounds)"""


def _one_hot() -> str:
    values = {
        "gender": ["Male"],
        "smoking_status": ["Former", "Never"],
        "physical_activity": ["Low", "Moderate"],
        "stress_level": ["Low", "Moderate"],
        "insurance_type": ["Private"],
        "city_type": ["Rural", "Semi-Urban", "Urban"],
        "site_of_care": ["Inpatient", "Outpatient", None],
        "provider_type": ["Hospital", "Specialist"],
        "drug_category": ["Generic", "High-Cost Specialty", None],
    }
    out = []
    for c, vs in values.items():
        for v in vs:
            test = f"{c} IS NULL" if v is None else f"{c} = '{v}'"
            out.append(f"CASE WHEN {test} THEN 1e0 ELSE 0e0 END AS \"{c}_{'nan' if v is None else v}\"")
    return "SELECT member_id, CAST(month AS VARCHAR) AS month,\n       " + ",\n       ".join(out) + "\nFROM fixed"


def _scaled() -> str:
    cols = ["age", "bmi", "pharmacy_spend", "unit_cost", "drug_cost"]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    out = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in cols)
    return f"""
SELECT member_id, CAST(month AS VARCHAR) AS month, {out}
FROM indexed, (SELECT {stats} FROM indexed WHERE time_index < last_index - 3)"""


def _leafwise(splits: int, least: int) -> str:
    """Best-first growth, a common table expression per split: of all leaves, inputs and cuts the one of the greatest gain."""
    inputs = ["time_index", "month(month)", "quarter(month)", "member_id % 17"]
    parts = [
        ",\nr0 AS (SELECT monthly_medical_cost AS y, monthly_medical_cost - avg(monthly_medical_cost) OVER () AS g, 0 AS leaf, "
        + ", ".join(f"CAST({x} AS DOUBLE) AS f{k}" for k, x in enumerate(inputs))
        + " FROM indexed)"
    ]
    for k in range(splits):
        long = " UNION ALL ".join(f"SELECT leaf, {f} AS f, f{f} AS v, g FROM r{k}" for f in range(len(inputs)))
        parts.append(
            f"""
c{k} AS (SELECT leaf, f, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER a AS n, sum(s) OVER a AS s
      FROM (SELECT leaf, f, v, count(*) AS n, sum(g) AS s FROM ({long}) GROUP BY leaf, f, v) WINDOW w AS (PARTITION BY leaf, f ORDER BY v), a AS (PARTITION BY leaf, f)),
b{k} AS (SELECT leaf AS node, f, v FROM c{k} WHERE nl >= {least} AND n - nl >= {least}
      ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n DESC, leaf, f, v LIMIT 1),
r{k + 1} AS (SELECT y, g, {", ".join(f"f{f}" for f in range(len(inputs)))},
      CASE WHEN leaf <> node THEN leaf WHEN [{", ".join(f"f{f}" for f in range(len(inputs)))}][f + 1] <= v THEN {2 * k + 1} ELSE {2 * k + 2} END AS leaf FROM r{k}, b{k})"""
        )
    return ",".join(parts) + f"\nSELECT count(*) AS n, round(avg(y), 1) AS mean_cost FROM r{splits} GROUP BY leaf"


def _time_folds() -> str:
    return """,
months AS (SELECT time_index, row_number() OVER (ORDER BY time_index) - 1 AS pos, count(*) OVER () AS total
           FROM (SELECT DISTINCT time_index FROM indexed)),
folds AS (SELECT i AS fold, total - (4 - i) * (total // 4) AS start, total // 4 AS size
          FROM range(1, 4) t(i), (SELECT DISTINCT total FROM months))
SELECT CAST(fold AS INT) AS fold, part, count(*) AS n, max(time_index) AS last_index
FROM (SELECT fold, time_index, CASE WHEN pos < start THEN 'fit' WHEN pos < start + size THEN 'validate' END AS part
      FROM folds, months JOIN indexed USING (time_index))
WHERE part IS NOT NULL GROUP BY fold, part"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    o["csv_scan"] = _with(
        """
SELECT site_of_care, insurance_type, count(*) AS n, CAST(sum(medication_count) AS BIGINT) AS medications,
       round(sum(monthly_medical_cost), 2) AS total
FROM claims GROUP BY site_of_care, insurance_type"""
    )
    o["table_roundtrip"] = _with(
        """
SELECT CAST(year(month) AS INT) AS year, count(*) AS n, round(sum(monthly_medical_cost), 2) AS total
FROM claims GROUP BY year(month)"""
    )
    o["catalog_table"] = _with("SELECT city_type, count(*) AS n, max(age) AS oldest FROM claims GROUP BY city_type")
    o["sql_text"] = _with(
        """
SELECT provider_type, insurance_type, count(*) AS n, round(sum(drug_cost), 2) AS drug_cost
FROM claims WHERE emergency_visits > 0 GROUP BY provider_type, insurance_type"""
    )
    o["json_records"] = _with(
        """
SELECT coalesce(drug_category, 'Generic') AS drug_category, '2027-06' AS prediction_month, count(*) AS n,
       round(avg(CASE WHEN member_id % 4 <> 0 THEN bmi ELSE 27.5e0 END), 6) AS avg_bmi, CAST(sum(45) AS BIGINT) AS ages,
       CAST(sum(medication_count) AS BIGINT) AS medications
FROM claims GROUP BY 1"""
    )
    o["report_csv"] = _with(
        """
SELECT scenario, section, line, count(*) AS n, round(sum(round(amount_cr, 4)), 4) AS amount
FROM report GROUP BY scenario, section, line""",
        YEARLY, BUDGETED, PRESETS, REPORT,
    )
    o["column_series"] = _with(
        """
SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years, string_agg(CAST(n AS VARCHAR), ',' ORDER BY year) AS counts
FROM (SELECT year(month) AS year, count(*) AS n FROM claims GROUP BY 1)"""
    )

    o["parse_lenient"] = f"""
WITH {TEXT_ORDERS.strip()}
SELECT CAST(year(TRY_CAST(month AS DATE)) AS INT) AS year, count(*) AS n, round(avg(TRY_CAST(cost AS DOUBLE)), 4) AS avg_cost
FROM text_orders WHERE TRY_CAST(month AS DATE) IS NOT NULL AND TRY_CAST(cost AS DOUBLE) IS NOT NULL GROUP BY 1"""
    o["parse_strict"] = """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS month, count(*) AS n FROM orders GROUP BY 1"""
    o["fill_values"] = f"""
WITH {TEXT_ORDERS.strip()}
SELECT drug_category, round(sum(coalesce(TRY_CAST(cost AS DOUBLE), 0)), 2) AS zeroed,
       round(sum(coalesce(TRY_CAST(cost AS DOUBLE), length(drug_category))), 2) AS filled, sum(1.5e0) AS absent
FROM text_orders GROUP BY drug_category"""
    o["clean_categories"] = _with(
        """
SELECT insurance_type, site_of_care, provider_type, drug_category, count(*) AS n FROM fixed GROUP BY ALL""",
        FIXED,
    )
    o["impute_defaults"] = _with(
        """
SELECT member_id, CASE WHEN member_id % 4 <> 0 THEN bmi ELSE 27.5e0 END AS bmi,
       coalesce(site_of_care, 'Outpatient') AS site_of_care, coalesce(drug_category, 'Generic') AS drug_category,
       CASE WHEN member_id % 3 <> 0 THEN daily_steps ELSE 6500 END AS daily_steps,
       45 AS age, 7e0 AS sleep_hours, 1000e0 AS unit_cost FROM claims"""
    )
    o["conform_columns"] = _with(
        """
SELECT member_id, CASE WHEN age > 50 THEN bmi ELSE 0e0 END AS bmi, 0e0 AS time_index, CAST(age AS DOUBLE) AS age FROM claims"""
    )
    o["winsorised_cost"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, round(least(monthly_medical_cost, cap), 4) AS monthly_medical_cost
FROM claims, (SELECT quantile_cont(monthly_medical_cost, 0.995) AS cap FROM claims)"""
    )
    o["date_features"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, CAST(year(month) AS INT) AS year, CAST(month(month) AS INT) AS month_num,
       CAST(quarter(month) AS INT) AS quarter, time_index FROM indexed""",
        PANEL,
        _INDEXED.format(source="panel"),
    )
    o["features_clinical"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month,
       CAST(diabetes + hypertension + heart_disease + asthma AS DOUBLE) AS comorbidity_score,
       diabetes * hypertension * (bmi / 25) AS cardio_metabolic_risk,
       CAST(doctor_visits + specialist_visits * 2 + emergency_visits * 4 + hospital_admissions * 6 AS DOUBLE) AS utilization_score,
       pharmacy_spend / (medication_count + 1) AS cost_per_med,
       drug_cost / (pharmacy_spend + 1) AS drug_spend_ratio,
       pharmacy_spend / (previous_year_medical_cost + 1) AS rx_burden_ratio,
       out_of_network_rate / 100 * previous_year_medical_cost AS oon_exposure,
       (100 - insurance_coverage_percent) / 100 * previous_year_medical_cost AS oop_exposure,
       average_length_of_stay_days * unit_cost AS inpatient_intensity,
       provider_mix_index * (out_of_network_rate / 10) AS provider_risk_index,
       (daily_steps / 5000) * (sleep_hours / 7) AS active_lifestyle_score,
       (bmi / 25) * (age / 50) AS bmi_age_interaction,
       CAST(heart_disease * hypertension AS DOUBLE) AS cardio_hypertension,
       CAST(doctor_visits + hospital_admissions + emergency_visits + specialist_visits + lab_tests
            + medication_count AS DOUBLE) AS utilization_total,
       previous_year_medical_cost / 12 AS monthly_prior,
       CASE WHEN lower(drug_category) LIKE '%high-cost specialty%' THEN 1e0 ELSE 0e0 END AS specialty_flag
FROM fixed""",
        FIXED,
    )

    o["cost_trend_yearly"] = _with(
        """
SELECT CAST(year(month) AS INT) AS year, round(avg(monthly_medical_cost), 2) AS avg_cost FROM claims GROUP BY 1"""
    )
    o["driver_trend"] = _with(
        """
SELECT year, round(specialty, 2) AS specialty, round(utilization, 2) AS utilization, round(provider_mix, 2) AS provider_mix,
       round(unit_cost, 2) AS unit_cost, round(er_utilization, 2) AS er_utilization FROM trend""",
        FIXED,
        SIGNALS,
    )
    o["drug_cost_share"] = _with(
        """
SELECT drug_category, round(sum(monthly_medical_cost) / sum(sum(monthly_medical_cost)) OVER () * 100, 2) AS share
FROM fixed WHERE drug_category IS NOT NULL GROUP BY drug_category""",
        FIXED,
    )
    for name, key, shown in (
        ("site_of_care_cost", "site_of_care", "coalesce(site_of_care, 'Unknown')"),
        ("provider_cost", "provider_type", "provider_type"),
        ("drug_cost_mean", "drug_category", "drug_category"),
    ):
        o[name] = _with(
            f"SELECT {shown} AS {key}, round(avg(monthly_medical_cost), 2) AS avg_cost FROM fixed GROUP BY fixed.{key}", FIXED
        )
    o["monthly_cost"] = _with(
        "SELECT CAST(month AS VARCHAR) AS month, round(avg(monthly_medical_cost), 2) AS avg_cost FROM claims GROUP BY month"
    )
    o["top_drivers"] = _with(
        f"""
SELECT driver, round(v / sum(v) OVER () * 100, 2) AS share
FROM (UNPIVOT (SELECT {AVERAGES} FROM fixed) ON specialty, utilization, site, provider, unit INTO NAME driver VALUE v)""",
        FIXED,
    )
    o["driver_impact"] = _with(
        """
SELECT driver, round(v, 2) AS impact
FROM (UNPIVOT (SELECT avg(drug_cost) AS specialty,
       avg(doctor_visits + emergency_visits + hospital_admissions + specialist_visits) AS utilization,
       avg(CASE WHEN site_of_care = 'Inpatient' THEN monthly_medical_cost ELSE 0 END) AS site,
       avg(provider_mix_index) AS provider, avg(unit_cost) AS unit,
       avg(CASE WHEN generic_rate > 0.7e0 THEN drug_cost * 0.1e0 ELSE 0 END) AS generic FROM fixed)
  ON specialty, utilization, site, provider, unit, generic INTO NAME driver VALUE v)""",
        FIXED,
    )
    o["macro_annual"] = _with("SELECT year, total_cr FROM yearly", YEARLY)
    o["global_stats"] = _with(
        """
SELECT round(min(monthly_medical_cost), 4) AS lowest, round(max(monthly_medical_cost), 4) AS highest,
       CAST(min(month) AS VARCHAR) AS first_month FROM claims"""
    )
    o["distinct_years"] = _with("SELECT DISTINCT CAST(year(month) AS INT) AS year FROM claims")
    o["yoy_kpi"] = _with(
        """
SELECT year, round(t, 4) AS total_cr, round((t - lag(t) OVER (ORDER BY year)) / lag(t) OVER (ORDER BY year) * 100, 4) AS yoy_growth_pct,
       round(t * 1.114e0, 4) AS forecast_cr, round(t * 1.114e0 * 0.93e0, 4) AS lower_cr, round(t * 1.114e0 * 1.07e0, 4) AS upper_cr,
       CASE WHEN t * 1.114e0 <= 60 THEN 'MODERATE' WHEN t * 1.114e0 <= 60 * 1.4e0 THEN 'HIGH' ELSE 'CRITICAL' END AS risk
FROM (SELECT CAST(year(month) AS INT) AS year, sum(monthly_medical_cost) / 1e7 AS t FROM claims GROUP BY 1)"""
    )
    o["pressure_score"] = _with("SELECT year, driver, round(score, 4) AS score FROM scores", FIXED, SIGNALS, SCORES)

    o["prev_month_cost"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, monthly_medical_cost, prev_month_cost FROM history""",
        PANEL,
        HISTORY,
    )
    o["rolling_3m"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, monthly_medical_cost, cost_3m_avg FROM history""",
        PANEL,
        HISTORY,
    )
    o["order_history"] = """
SELECT o_orderkey AS record_id, o_custkey AS member_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS month,
       coalesce(lag(o_totalprice) OVER w, abs(c_acctbal) * 12 / 12) AS prev_month_cost,
       round(coalesce(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey
                          ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), abs(c_acctbal) * 12 / 12), 6) AS cost_3m_avg
FROM orders JOIN customer ON o_custkey = c_custkey
WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)"""
    o["order_history_hot"] = o["order_history"]
    o["latest_record"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, monthly_medical_cost FROM panel ORDER BY panel.month DESC, member_id DESC LIMIT 1""",
        PANEL,
    )
    o["latest_per_member"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, monthly_medical_cost
FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY month DESC) AS r FROM panel) WHERE r = 1""",
        PANEL,
    )
    o["top_members"] = _with(
        """
SELECT member_id, round(sum(monthly_medical_cost), 2) AS total_cost FROM claims GROUP BY member_id
ORDER BY total_cost DESC LIMIT 15"""
    )

    o["overview"] = _with(_overview())
    o["null_profile"] = _with(_nulls())
    o["describe_cost"] = _with(_describe(["monthly_medical_cost", "drug_cost", "generic_rate"]))
    o["duplicates"] = """
SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
    o["duplicate_claims"] = _with(
        """
SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM claims GROUP BY """
        + ", ".join(NAMED)
        + ")"
    )
    o["duplicate_rows"] = _with(
        """
SELECT member_id, site_of_care, provider_type, drug_category, count(*) AS copies FROM claims
GROUP BY member_id, site_of_care, provider_type, drug_category HAVING count(*) > 1"""
    )
    o["most_repeated"] = _with(
        """
SELECT site_of_care, provider_type, drug_category, city_type, count(*) AS copies FROM claims
GROUP BY site_of_care, provider_type, drug_category, city_type HAVING count(*) > 1
ORDER BY copies DESC, site_of_care NULLS FIRST, provider_type NULLS FIRST, drug_category NULLS FIRST, city_type NULLS FIRST LIMIT 5"""
    )
    numeric = [c for c in NAMED if c not in TEXT]
    o["numeric_summary"] = _with(
        "\nUNION ALL\n".join(f"SELECT '{c}' AS column_name, round(sum(CAST({c} AS DOUBLE)), 2) AS total FROM claims" for c in numeric)
    )
    o["driver_profile"] = _with(
        "\nUNION ALL\n".join(
            f"SELECT '{d}' AS driver, '{c}' AS column_name, count({c}) AS non_null FROM claims"
            for d, c in (
                ("Specialty / Drug Category", "drug_category"),
                ("Site of Care", "site_of_care"),
                ("Provider Type", "provider_type"),
                ("Hospital Admissions", "hospital_admissions"),
                ("Emergency Visits", "emergency_visits"),
            )
        )
    )
    o["member_share"] = _with(
        """
SELECT member_id, total_cost, round(total_cost / sum(total_cost) OVER () * 100, 8) AS share
FROM (SELECT member_id, round(sum(monthly_medical_cost), 4) AS total_cost FROM claims GROUP BY member_id)"""
    )
    o["histogram"] = _with(
        """,
span AS (SELECT min(monthly_medical_cost) AS lo, max(monthly_medical_cost) AS hi FROM claims),
placed AS (SELECT CAST(least(floor((monthly_medical_cost - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n
           FROM claims, span GROUP BY 1)
SELECT CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 50), 4) AS bin_start, coalesce(n, 0) AS n
FROM range(50) t(i) CROSS JOIN span LEFT JOIN placed ON placed.bin = i"""
    )
    for name, x in (("scatter_admissions", "hospital_admissions"), ("scatter_emergency", "emergency_visits")):
        o[name] = _with(
            f"""
SELECT {x} AS x, CAST(floor(monthly_medical_cost / 5000) AS BIGINT) AS y_bin, count(*) AS n FROM claims GROUP BY 1, 2"""
        )
    o["corr_matrix"] = _with(_correlations(), _THIN)

    projected = PROJECTED.replace("{shift}", "30")
    o["forecast_years"] = _with("SELECT * FROM projected", projected)
    o["forecast_months"] = _with(
        """,
shares(month_num, share) AS (VALUES (1, 0.0719e0), (2, 0.0742e0), (3, 0.0766e0), (4, 0.0789e0), (5, 0.0813e0), (6, 0.0828e0),
       (7, 0.0844e0), (8, 0.0859e0), (9, 0.0875e0), (10, 0.0883e0), (11, 0.0891e0), (12, 0.0906e0)),
monthly AS (SELECT year, month_num, round(projected_cr * share, 2) AS forecast FROM projected, shares),
bounded AS (SELECT *, round(forecast * 0.935e0, 2) AS lower, round(forecast * 1.076e0, 2) AS upper FROM monthly)
SELECT year, month_num, forecast, lower, upper FROM bounded
UNION ALL
SELECT year, 0, max(projected_cr), round(sum(lower), 2), round(sum(upper), 2) FROM bounded JOIN projected USING (year) GROUP BY year""",
        projected,
    )
    o["forecast_from_actuals"] = _with(
        """
SELECT year AS from_year, CAST(year + step AS INT) AS year, round(total_cr * pow(1.114e0, step), 4) AS forecast_cr,
       round(total_cr * pow(1.114e0, step) * 0.93e0, 4) AS lower_cr, round(total_cr * pow(1.114e0, step) * 1.07e0, 4) AS upper_cr
FROM yearly, range(1, 6) t(step)""",
        YEARLY,
    )
    o["actual_vs_forecast"] = _with(
        """,
actuals AS (SELECT CAST(year + 24 AS INT) AS year, total_cr FROM yearly)
SELECT year, a.total_cr AS actual,
       CASE WHEN year = (SELECT max(year) FROM actuals) THEN a.total_cr ELSE p.projected_cr END AS forecast
FROM actuals a FULL JOIN projected p USING (year)""",
        YEARLY,
        PROJECTED.replace("{shift}", "31"),
    )
    o["time_adjusted"] = _with(
        """,
asked AS (
SELECT member_id, monthly_medical_cost AS cost,
       CASE WHEN member_id % 200 = 0 THEN 2029 WHEN member_id % 100 = 0 THEN 2029
            WHEN member_id % 50 IN (0, 2, 3) THEN 2027 WHEN member_id % 50 = 1 THEN 2027 ELSE year(month) + 30 END AS y,
       CASE WHEN member_id % 200 = 0 THEN 5 WHEN member_id % 50 IN (0, 2, 3) THEN 1
            WHEN member_id % 50 = 1 THEN 13 ELSE month(month) END AS m
FROM claims)
SELECT member_id, printf('%04d-%02d', y, m) AS prediction_period, round(pow(1.114e0, y - 2026), 3) AS trend_multiplier,
       round(coalesce(f, 1e0), 3) AS season_factor, cost * pow(1.114e0, y - 2026) * coalesce(f, 1e0) AS adjusted_cost
FROM asked LEFT JOIN season USING (m)""",
        SEASON,
    )
    o["scenario_eval"] = _with(
        _scenario("levers", "scenario", "12.8e0", "11.5e0", _terms("12.8e0", _ALL_LEVERS)), FIXED, LEVERS
    )
    o["scenario_client"] = _with(
        _scenario("levers", "scenario", "12.8e0", "11.5e0", _terms("12.8e0", _CLIENT_LEVERS)), FIXED, LEVERS
    )
    o["scenario_presets"] = _with(
        _scenario("yearly_presets", "year, scenario", "total_cr", "budget_cr", _terms("total_cr", _CLIENT_LEVERS)),
        YEARLY,
        BUDGETED,
        PRESETS,
    )
    o["scenario_report"] = _with(
        """
SELECT year, scenario, outcome, position, section, line, round(setting_pct, 4) AS setting_pct,
       round(weight_pct, 4) AS weight_pct, round(amount_cr, 4) AS amount_cr FROM report""",
        YEARLY, BUDGETED, PRESETS, REPORT,
    )
    o["budget_variance"] = _with(
        """
SELECT year, total_cr AS forecast_cr, budget_cr, round(total_cr - budget_cr, 4) AS variance_cr,
       round((total_cr - budget_cr) / budget_cr * 100, 4) AS variance_pct,
       CASE WHEN total_cr > budget_cr THEN 'HIGH RISK - BUDGET BREACH PREDICTED' ELSE 'WITHIN BUDGET' END AS risk_status,
       round(greatest(total_cr - budget_cr, 0e0), 4) AS containment_needed_cr FROM budgeted""",
        YEARLY,
        BUDGETED,
    )
    o["budget_drivers"] = _with(
        f""",
shares AS (
SELECT year, driver, v / sum(v) OVER (PARTITION BY year) * 100 AS share
FROM (UNPIVOT (SELECT CAST(year(month) AS INT) AS year, {AVERAGES} FROM fixed GROUP BY year(month))
      ON specialty, utilization, site, provider, unit INTO NAME driver VALUE v))
SELECT year, driver, round(share, 4) AS share, round((total_cr - budget_cr) * share, 4) AS impact_lakh
FROM shares JOIN budgeted USING (year)""",
        FIXED,
        YEARLY,
        BUDGETED,
    )
    o["pressure_alert"] = _with(
        """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, driver DESC) AS r FROM scores),
overall AS (SELECT year, avg(score) AS overall_score, max(score) AS top_score, max(driver) FILTER (r = 1) AS top_driver
            FROM ranked GROUP BY year),
leveled AS (SELECT *, CASE WHEN overall_score >= 80 THEN 'CRITICAL' WHEN overall_score >= 50 THEN 'HIGH' ELSE 'NORMAL' END AS alert_level
            FROM overall)
SELECT year, round(overall_score, 4) AS overall_score, round(top_score, 4) AS top_score, top_driver, alert_level,
       CASE WHEN alert_level = 'NORMAL' THEN 'Cost pressure is within limits' ELSE 'Emerging cost pressure in ' || top_driver END AS message
FROM leveled""",
        FIXED, SIGNALS, SCORES,
    )
    o["advisor_horizon"] = _with(
        """,
savings(year, max_savings_cr, top_driver_lakh, site_of_care_lakh, spend) AS (VALUES (2026, 1.55e0, 54e0, 32.5e0, 10.8e0),
       (2027, 1.85e0, 64e0, 38.5e0, 12.8e0), (2028, 2.09e0, 72.5e0, 43.5e0, 14.5e0), (2029, 2.36e0, 82e0, 49.2e0, 16.4e0),
       (2030, 2.68e0, 93e0, 55.8e0, 18.6e0)),
asked AS (SELECT DISTINCT CAST(year(month) + 30 AS INT) AS year FROM claims)
SELECT a.year, max_savings_cr, top_driver_lakh, site_of_care_lakh, round(max_savings_cr / spend * 100, 4) AS savings_pct
FROM asked a JOIN savings s ON s.year = CASE WHEN a.year BETWEEN 2026 AND 2030 THEN a.year ELSE 2027 END"""
    )
    o["cost_tier"] = _with(
        f"""
SELECT {TIER} AS tier, city_type, count(*) AS n, round(sum(monthly_medical_cost), 2) AS total FROM claims GROUP BY 1, 2"""
    )
    o["attribution_tags"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, concat_ws('|',
       CASE WHEN pharmacy_spend > 4000 OR drug_category = 'Specialty' THEN 'Specialty Rx & Pharmacy Load' END,
       CASE WHEN hospital_admissions >= 1 OR emergency_visits >= 1 THEN 'Acute Care Utilization' END,
       CASE WHEN diabetes = 1 OR hypertension = 1 OR heart_disease = 1 OR asthma = 1 THEN 'Chronic Disease Complexity' END,
       CASE WHEN out_of_network_rate > 15 THEN 'Out-of-Network Exposure' END,
       CASE WHEN physical_activity = 'High' OR daily_steps >= 8000 THEN 'Active Lifestyle Benefit' END) AS tags
FROM fixed""",
        FIXED,
    )
    o["recommendations"] = _with(
        f"""
SELECT member_id, CAST(month AS VARCHAR) AS month, tier, priority, driver, title, saving_lo, saving_hi
FROM (SELECT *, {TIER} AS tier FROM panel) JOIN catalog USING (tier)""",
        PANEL,
        CATALOG,
    )
    o["recommendations_filtered"] = _with(
        f"""
SELECT member_id, CAST(month AS VARCHAR) AS month, tier, title, pct_lo, pct_hi
FROM (SELECT *, {TIER} AS tier FROM panel) JOIN catalog USING (tier) WHERE driver = 'utilization'""",
        PANEL,
        CATALOG,
    )
    o["tier_savings"] = _with(
        f"""
SELECT tier, n, max_saving, n * max_saving AS potential
FROM (SELECT {TIER} AS tier, count(*) AS n FROM panel GROUP BY 1)
     JOIN (SELECT tier, CAST(sum(saving_hi) AS BIGINT) AS max_saving FROM catalog GROUP BY tier) USING (tier)""",
        PANEL,
        CATALOG,
    )
    o["season_lookup"] = _with(
        """
SELECT month_num, n, coalesce(f, 1e0) AS factor
FROM (SELECT CAST(quarter(month) * 4 AS INT) AS month_num, count(*) AS n FROM claims GROUP BY 1) LEFT JOIN season ON m = month_num""",
        SEASON,
    )

    o["one_hot"] = _with(_one_hot(), FIXED)
    o["scaled"] = _with(_scaled(), _INDEXED.format(source="claims"))
    o["time_split"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, time_index, time_index >= last_index - 3 AS holdout FROM indexed""",
        PANEL,
        _INDEXED.format(source="panel"),
    )
    o["bundle_same"] = _with(
        """
SELECT member_id || '/' || CAST(month AS VARCHAR) AS record_id, true AS same FROM indexed WHERE time_index >= last_index - 3""",
        PANEL,
        _INDEXED.format(source="panel"),
    )
    o["ridge_fit"] = _with(
        """,
m AS (SELECT count(*) AS n, avg(monthly_medical_cost) AS y, avg(prev_month_cost) AS x1, avg(cost_3m_avg) AS x2,
             var_pop(prev_month_cost) * count(*) + 1 AS a, var_pop(cost_3m_avg) * count(*) + 1 AS d,
             covar_pop(prev_month_cost, cost_3m_avg) * count(*) AS b,
             covar_pop(prev_month_cost, monthly_medical_cost) * count(*) AS r1,
             covar_pop(cost_3m_avg, monthly_medical_cost) * count(*) AS r2 FROM history),
w AS (SELECT *, (r1 * d - r2 * b) / (a * d - b * b) AS w1, (r2 * a - r1 * b) / (a * d - b * b) AS w2 FROM m)
SELECT round(y - w1 * x1 - w2 * x2, 2) AS intercept, round(w1, 4) AS prev_weight, round(w2, 4) AS avg_weight FROM w""",
        PANEL,
        HISTORY,
    )
    o["time_folds"] = _with(_time_folds(), PANEL, _INDEXED.format(source="panel"))
    o["metrics"] = _with(
        """
SELECT count(*) AS n, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse,
       round(avg(abs(y - p)), 4) AS mae, round(avg(abs((y - p) / nullif(y, 0))) * 100, 4) AS mape,
       round(avg(CASE WHEN y BETWEEN p * 0.5e0 AND p * 1.5e0 THEN 1e0 ELSE 0e0 END) * 100, 4) AS coverage
FROM (SELECT monthly_medical_cost AS y, prev_month_cost AS p FROM history)""",
        PANEL,
        HISTORY,
    )
    o["voting"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, (prev_month_cost * 1e0 + cost_3m_avg * 3e0) / 4e0 AS prediction FROM history""",
        PANEL,
        HISTORY,
    )
    o["band"] = _with(
        """,
scaled AS (
SELECT member_id, month, cost_3m_avg * f AS point, greatest(0e0, prev_month_cost * 0.7e0 * f) AS lower,
       CASE WHEN member_id % 9 <> 0 THEN prev_month_cost * 0.72e0 * f END AS high
FROM history JOIN season ON m = month(month))
SELECT member_id, CAST(month AS VARCHAR) AS month, lower,
       CASE WHEN high IS NULL THEN point * 1.15e0 ELSE greatest(lower * 1.05e0, high) END AS upper FROM scaled""",
        PANEL, HISTORY, SEASON,
    )
    o["log_inversion"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, round(exp(ln(1 + prev_month_cost)) - 1, 4) AS prediction FROM history""",
        PANEL,
        HISTORY,
    )
    o["rolling_over_table"] = _with(
        """,
shifted AS (SELECT *, lag(monthly_medical_cost) OVER (PARTITION BY member_id ORDER BY month) AS before FROM panel)
SELECT member_id, CAST(month AS VARCHAR) AS month,
       round(coalesce(avg(before) OVER (ORDER BY member_id, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), previous_year_medical_cost / 12), 6) AS cost_3m_avg
FROM shifted""",
        PANEL,
    )
    o["position_folds"] = _with(
        """,
placed AS (SELECT *, row_number() OVER (ORDER BY member_id, month) - 1 AS pos, count(*) OVER () AS total FROM panel),
folds AS (SELECT p.*, CAST(i AS INT) AS fold, total - (4 - i) * (total // 4) AS start FROM placed p, range(1, 4) t(i))
SELECT fold, part, count(*) AS n, min(member_id) AS first_member, max(member_id) AS last_member, round(sum(monthly_medical_cost), 2) AS total
FROM (SELECT *, CASE WHEN pos < start THEN 'fit' WHEN pos < start + total // 4 THEN 'validate' END AS part FROM folds)
WHERE part IS NOT NULL GROUP BY fold, part""",
        PANEL,
    )
    o["conformal_bands"] = _with(
        f"""{_INDEXED.format(source="history")},
t AS (SELECT {TIER.replace("monthly_medical_cost", "prev_month_cost")} AS tier, monthly_medical_cost AS y, prev_month_cost AS p,
             time_index >= last_index - 3 AS held FROM indexed),
d AS (SELECT tier, abs(y - p) AS d, row_number() OVER (PARTITION BY tier ORDER BY abs(y - p)) AS r, count(*) OVER (PARTITION BY tier) AS n FROM t WHERE NOT held),
w AS (SELECT tier, n, CAST(ceil((n + 1) * 0.8e0 - 1e-9) AS BIGINT) AS rank, max(CASE WHEN r = CAST(ceil((n + 1) * 0.8e0 - 1e-9) AS BIGINT) THEN d END) AS width
      FROM d GROUP BY tier, n),
c AS (SELECT t.tier, count(*) AS rows, count(*) FILTER (y >= greatest(0, coalesce(p - width, 0)) AND coalesce(y <= p + width, true)) AS inside
      FROM t LEFT JOIN w USING (tier) WHERE held GROUP BY t.tier)
SELECT tier, n, rank, round(width, 4) AS width, rows, inside FROM w LEFT JOIN c USING (tier)""",
        PANEL, HISTORY,
    )
    o["sparse_inputs"] = _with(
        """,
e AS (SELECT member_id, month, c, v FROM (
        SELECT member_id, month, 0 AS c, CAST(member_id AS VARCHAR) AS v FROM fixed UNION ALL
        SELECT member_id, month, 1, drug_category FROM fixed UNION ALL SELECT member_id, month, 2, site_of_care FROM fixed)),
k AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v NULLS LAST) - 1 AS r, count(*) OVER (PARTITION BY c) AS size FROM (SELECT DISTINCT c, v FROM e)),
b AS (SELECT c, sum(size - 1) OVER (ORDER BY c) - (size - 1) AS base FROM (SELECT DISTINCT c, size FROM k))
SELECT CAST(1 + base + r - 1 AS INT) AS place, count(*) AS n, count(DISTINCT member_id) AS members
FROM e JOIN k ON e.c = k.c AND e.v IS NOT DISTINCT FROM k.v JOIN b ON b.c = e.c WHERE r > 0 GROUP BY 1""",
        FIXED,
    )
    o["table_replaced"] = _with(
        """
SELECT CAST(year(month) AS INT) AS year, drug_category, count(*) AS n, round(sum(monthly_medical_cost), 2) AS total, 2 AS versions
FROM claims WHERE drug_category IS NOT NULL GROUP BY 1, 2"""
    )
    o["parse_mixed"] = """
SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS written, false AS ambiguous
FROM orders"""
    o["date_shapes"] = """
WITH w AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                       WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%b %-d, %Y')
                       ELSE strftime(o_orderdate, '%-m-%-d-%Y') END AS t,
                  CASE WHEN o_orderkey % 50 <> 0 THEN ['yyyy-M-d', 'd/M/yyyy', 'MMM d, yyyy', 'M-d-yyyy'][CAST(o_orderkey % 4 + 1 AS INT)] END AS format FROM orders)
SELECT regexp_replace(regexp_replace(regexp_replace(t, '[0-9]', '9', 'g'), '[A-Za-z]+', 'a', 'g'), '\\b99\\b', '9', 'g') AS shape, count(*) AS rows, format,
       CASE WHEN format IS NULL THEN 0 ELSE count(*) END AS parsed, false AS ambiguous
FROM w GROUP BY 1, format"""
    o["scatter_points"] = _with(
        """,
h AS (SELECT hospital_admissions AS x, monthly_medical_cost AS y, CAST(floor(monthly_medical_cost / 5000) AS BIGINT) AS y_bin,
             md5('points|' || member_id || '|' || CAST(month AS VARCHAR) || '|' || doctor_visits || '|' || CAST(round(monthly_medical_cost * 10000) AS BIGINT)) AS h FROM claims)
SELECT x, round(y, 4) AS y, y_bin FROM (SELECT *, row_number() OVER (PARTITION BY x, y_bin ORDER BY h, y) AS k FROM h) WHERE k <= 20"""
    )
    o["first_rows"] = _with(
        """
SELECT member_id, CAST(month AS VARCHAR) AS month, round(monthly_medical_cost, 4) AS monthly_medical_cost, doctor_visits, medication_count
FROM claims ORDER BY member_id, claims.month, claims.monthly_medical_cost, doctor_visits, medication_count LIMIT 5"""
    )
    o["leafwise_tree"] = _with(_leafwise(5, 20), PANEL, _INDEXED.format(source="panel"))
    o["pipeline_same"] = o["bundle_same"]
    o["linear_score"] = _with(
        """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY month DESC) AS r FROM panel),
recent AS (SELECT member_id, max(CASE WHEN r = 1 THEN monthly_medical_cost END) AS last, avg(monthly_medical_cost) AS mean FROM ranked WHERE r <= 3 GROUP BY member_id),
p AS (SELECT member_id || '/' || CAST(s.month AS VARCHAR) AS record_id, year(s.month) + 30 AS y, month(s.month) AS m,
             last * 0.9e0 + mean * 0.1e0 + (time_index + 360) * 12e0 AS prediction
      FROM indexed s JOIN recent USING (member_id)),
a AS (SELECT *, pow(1.114e0, y - 2026) * coalesce(f, 1e0) AS scale FROM p LEFT JOIN season USING (m))
SELECT record_id, printf('%04d-%02d', y, m) AS prediction_period, round(prediction, 3) AS prediction, round(prediction * scale, 2) AS adjusted_cost,
       round(prediction * scale * 0.85e0, 2) AS lower, round(prediction * scale * 1.15e0, 2) AS upper
FROM a""",
        PANEL, _INDEXED.format(source="panel"), SEASON,
    )
    o["linear_latest"] = _with(
        """
SELECT CAST(year(month) AS INT) AS latest_year, round(prev_month_cost * 0.9e0 + cost_3m_avg * 0.1e0 + time_index * 12e0, 3) AS predicted_cost
FROM indexed ORDER BY month DESC, member_id || '/' || CAST(month AS VARCHAR) DESC LIMIT 1""",
        PANEL, HISTORY, _INDEXED.format(source="history"),
    )
    return o
