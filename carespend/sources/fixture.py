"""A claims view over the order tables, for tests and registered queries.

There is no public claims file, so order lines stand in for claims. The values are
synthetic and carry no medical meaning; null and misspelt categories are on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carespend.sources.io import spread


def _case(c: str, mapping: dict, default: str | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(c) == k, v) if out is None else out.when(F.col(c) == k, v)
    return out.otherwise(default) if default is not None else out


def _cycle(key: Column, labels: list[str]) -> Column:
    """``labels[key % len(labels)]``."""
    out = F.lit(labels[-1])
    for i, label in list(enumerate(labels))[:-1]:
        out = F.when(key % len(labels) == i, label).otherwise(out)
    return out


# Known types, so that opening a table does not read a file footer first.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims at order-line grain (no record key: order lines repeat)."""
    lines, orders, customers, parts = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part")
    )
    lines = spread(lines)
    # No broadcast hints: the sizes of these tables decide, at run time, how they join.
    rows = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    member, nation = F.col("o_custkey"), F.col("c_nationkey")

    def every(n: int) -> Column:
        return F.when(member % n == 0, 1).otherwise(0)

    return rows.select(
        member.alias("member_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("monthly_medical_cost"),
        _case(
            "o_orderpriority",
            {"1-URGENT": "Emergency", "2-HIGH": "Inpatient", "3-MEDIUM": "in patient", "5-LOW": "Outpatient"},
        ).alias("site_of_care"),
        _case(
            "c_mktsegment",
            {"BUILDING": "Hospital", "MACHINERY": "hospital", "AUTOMOBILE": "Clinic"},
            "Specialist",
        ).alias("provider_type"),
        _case(
            "p_type",
            {
                "PROMO": "High-Cost Specialty",
                "LARGE": "High Cost Specialty",
                "MEDIUM": "Brand",
                "SMALL": "generic",
                "ECONOMY": "Generic",
            },
        ).alias("drug_category"),
        _case("l_returnflag", {"A": "Private", "N": "private"}, "Government").alias("insurance_type"),
        _cycle(nation, ["Metro", "Urban", "Semi-Urban", "Rural"]).alias("city_type"),
        _cycle(member, ["Male", "Female"]).alias("gender"),
        _cycle(member, ["Never", "Former", "Current"]).alias("smoking_status"),
        _cycle(nation, ["Low", "Moderate", "High"]).alias("physical_activity"),
        F.when(nation % 5 == 0, "High").when(nation % 5 == 1, "Moderate").otherwise("Low").alias("stress_level"),
        (20 + member % 60).cast("int").alias("age"),
        (18 + member % 20).cast("double").alias("bmi"),
        every(5).alias("diabetes"),
        every(3).alias("hypertension"),
        every(7).alias("heart_disease"),
        every(11).alias("asthma"),
        (2000 + (member % 10) * 1000).cast("int").alias("daily_steps"),
        (5 + member % 5).cast("double").alias("sleep_hours"),
        F.col("l_linenumber").alias("doctor_visits"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0).alias("hospital_admissions"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("emergency_visits"),
        (F.col("p_size") % 5).cast("int").alias("specialist_visits"),
        (F.col("p_size") % 10).cast("int").alias("lab_tests"),
        F.col("l_quantity").cast("int").alias("medication_count"),
        (F.col("l_linenumber") * 0.5).alias("average_length_of_stay_days"),
        (60 + (member % 5) * 10).cast("double").alias("insurance_coverage_percent"),
        (F.abs("c_acctbal") * 12).alias("previous_year_medical_cost"),
        (F.col("l_tax") * 200).alias("out_of_network_rate"),
        (F.col("l_discount") * 1000).alias("generic_rate"),
        (F.col("l_extendedprice") * 0.1).alias("pharmacy_spend"),
        (1 + F.col("l_tax")).alias("provider_mix_index"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_cost"),
        F.col("p_retailprice").alias("drug_cost"),
    )


def panel(rows: DataFrame) -> DataFrame:
    """Cost per member and month: the grain that windows need.

    A member has at most one row per calendar month here, so a window over one member
    is small however many claims that member has.
    """
    return rows.groupBy("member_id", "month").agg(
        F.round(F.sum("monthly_medical_cost"), 4).alias("monthly_medical_cost"),
        F.max("previous_year_medical_cost").alias("previous_year_medical_cost"),
    )


# The labels of each category in the view, in alphabetical order.
LABELS = {
    "site_of_care": ["Emergency", "Inpatient", "Outpatient", "in patient"],
    "provider_type": ["Clinic", "Hospital", "Specialist", "hospital"],
    "drug_category": ["Brand", "Generic", "High Cost Specialty", "High-Cost Specialty", "generic"],
    "insurance_type": ["Government", "Private", "private"],
    "city_type": ["Metro", "Rural", "Semi-Urban", "Urban"],
    "gender": ["Female", "Male"],
    "smoking_status": ["Current", "Former", "Never"],
    "physical_activity": ["High", "Low", "Moderate"],
    "stress_level": ["High", "Low", "Moderate"],
}


def _last_label(c: str) -> Column:
    """The alphabetically last label of a group. Labels are compared by number, as an aggregate
    that keeps text would sort the rows instead of hashing them."""
    labels = F.array(*[F.lit(v) for v in LABELS[c]])
    return F.get(labels, F.max(F.array_position(labels, F.col(c))).cast("int") - 1).alias(c)


def member_months(rows: DataFrame) -> DataFrame:
    """All claims columns at one row per member and month, with a record key; used for training."""
    add = ["doctor_visits", "hospital_admissions", "emergency_visits", "specialist_visits", "lab_tests"]
    add += ["medication_count"]
    mean = ["average_length_of_stay_days", "out_of_network_rate", "generic_rate", "provider_mix_index", "unit_cost"]
    money = ["pharmacy_spend", "drug_cost", "monthly_medical_cost"]
    rest = [c for c in rows.columns if c not in {*add, *mean, *money, *LABELS, "member_id", "month"}]
    grouped = rows.groupBy("member_id", "month").agg(
        *[F.sum(c).alias(c) for c in add],
        *[F.round(F.avg(c), 4).alias(c) for c in mean],
        *[F.round(F.sum(c), 4).alias(c) for c in money],
        *[F.max(c).alias(c) for c in rest],
        *[_last_label(c) for c in LABELS],
    )
    return grouped.withColumn("record_id", F.concat_ws("/", "member_id", "month"))
