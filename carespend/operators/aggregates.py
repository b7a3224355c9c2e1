"""Grouped and global aggregates, shares, indexes and growth."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carespend.functions.clean import generic_offset, inpatient_cost, number
from carespend.functions.features import crore, specialty_flag, utilization_sum, utilization_total
from carespend.sources.schema import TARGET, UTILIZATION

# Shares shown when no driver has any cost.
FALLBACK_SHARES = {
    "specialty": 32.0,
    "utilization": 27.0,
    "site": 16.0,
    "provider": 14.0,
    "unit": 11.0,
}

TREND_SIGNALS = ["specialty", "utilization", "provider_mix", "unit_cost", "er_utilization"]


def mean_by(df: DataFrame, key: str | Column, value: str = TARGET, name: str = "avg_cost") -> DataFrame:
    """Mean per key, greatest first."""
    grouped = df.groupBy(key).agg(F.avg(value).alias(name))
    return grouped.orderBy(F.desc(name), grouped.columns[0])


def sum_by(
    df: DataFrame, key: str | Column, value: str = TARGET, scale: float = 1, name: str = "total_cost"
) -> DataFrame:
    total = F.sum(value)
    return df.groupBy(key).agg((total / scale if scale != 1 else total).alias(name))


def cost_trend(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Mean cost per year, over the rows whose month and cost both parse."""
    rows = df.select(F.year(F.col("month").try_cast("date")).alias("year"), number(value).alias("v"))
    return rows.na.drop().groupBy("year").agg(F.avg("v").alias("avg_cost")).orderBy("year")


def driver_signals(df: DataFrame, key: Column) -> DataFrame:
    """Per key, the mean of five cost-driver signals; null signals count as 0."""
    have = df.columns

    def signal(c: str) -> Column:
        return F.coalesce(number(c), F.lit(0.0)) if c in have else F.lit(0.0)

    rows = df.select(
        key.alias("year"),
        (specialty_flag() if "drug_category" in have else F.lit(0.0)).alias("specialty"),
        utilization_total(available=have).alias("utilization"),
        signal("provider_mix_index").alias("provider_mix"),
        signal("unit_cost").alias("unit_cost"),
        signal("emergency_visits").alias("er_utilization"),
    )
    return rows.where(F.col("year").isNotNull()).groupBy("year").agg(*[F.avg(c).alias(c) for c in TREND_SIGNALS])


def index_to_first(df: DataFrame, order: str, cols: Iterable[str]) -> DataFrame:
    """Each column as an index with its first row = 100; a baseline of 0 or less gives 100 throughout.

    For grouped results: the window has no partition key, so its rows pass one task.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for c in cols:
        base = F.first(c).over(w)
        out[c] = F.when(base <= 0, 100.0).otherwise(F.col(c) / base * 100)
    return df.withColumns(out)


def driver_trend(df: DataFrame) -> DataFrame:
    """The five driver signals by year, as indexes to the first year."""
    yearly = driver_signals(df, F.year(F.col("month").try_cast("date")))
    return index_to_first(yearly, "year", TREND_SIGNALS)


def share_of_total(df: DataFrame, col: str, name: str = "share", by: Iterable[str] = ()) -> DataFrame:
    """Each row's percentage of the total, or of the total of its ``by`` group.

    The grand total is a scalar subquery over the same grouped rows, whose shuffle is reused,
    so the rows stay distributed. Totals per group use a window and are for grouped results.
    """
    by = list(by)
    total = F.sum(col).over(Window.partitionBy(*by)) if by else df.agg(F.sum(col)).scalar()
    return df.withColumn(name, F.col(col) / total * 100)


def share_by(df: DataFrame, key: str, value: str = TARGET, name: str = "share") -> DataFrame:
    """Percentage of the grand total per key, greatest first. Null keys are left out; no rows if the total is not positive."""
    rows = df.select(key, number(value).alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    grouped = rows.groupBy(key).agg(F.sum("v").alias("v"))
    total = grouped.agg(F.sum("v")).scalar()
    return grouped.where(total > 0).select(key, (F.col("v") / total * 100).alias(name)).orderBy(F.desc(name), key)


def driver_averages(df: DataFrame, by: Iterable[str] = (), threshold: float = 0.70) -> DataFrame:
    """Every average behind driver shares and driver impact, in one pass over the claims.

    ``utilization`` adds six counts and ``visits`` only four. A row in which any of them is
    null does not take part in that average.
    """
    visits = ["doctor_visits", "emergency_visits", "hospital_admissions", "specialist_visits"]
    return df.groupBy(*by).agg(
        F.avg("drug_cost").alias("specialty"),
        F.avg(utilization_sum(UTILIZATION)).alias("utilization"),
        F.avg(utilization_sum(visits)).alias("visits"),
        F.avg(inpatient_cost()).alias("site"),
        F.avg("provider_mix_index").alias("provider"),
        F.avg("unit_cost").alias("unit"),
        F.avg(generic_offset(threshold)).alias("generic"),
    )


def top_drivers(
    df: DataFrame, by: Iterable[str] = (), fallback: Mapping[str, float] = FALLBACK_SHARES
) -> DataFrame:
    """Five drivers with their percentage of the summed averages, one row each (per ``by``)."""
    by = list(by)
    averages = driver_averages(df, by).select(
        *by, *[F.greatest(F.coalesce(F.col(d), F.lit(0.0)), F.lit(0.0)).alias(d) for d in fallback]
    )
    total = None
    for d in fallback:
        total = F.col(d) if total is None else total + F.col(d)
    shares = averages.select(
        *by, *[F.when(total > 0, F.col(d) / total * 100).otherwise(float(v)).alias(d) for d, v in fallback.items()]
    )
    return shares.unpivot(by, list(fallback), "driver", "share")


def driver_impact(df: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Six average driver values, one row each; null is 0."""
    averages = driver_averages(df, threshold=threshold)
    columns = {
        "specialty": "specialty",
        "utilization": "visits",
        "site": "site",
        "provider": "provider",
        "unit": "unit",
        "generic": "generic",
    }
    one = averages.select([F.coalesce(F.col(c), F.lit(0.0)).alias(n) for n, c in columns.items()])
    return one.unpivot([], list(columns), "driver", "impact")


def macro_annual(df: DataFrame) -> DataFrame:
    """Total cost per year in crore, by year."""
    return df.groupBy(F.year("month").alias("year")).agg(crore(F.sum(TARGET)).alias("total_cr")).orderBy("year")


def global_stats(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """A one-row frame of global aggregates, for use through ``scalar()`` or on its own."""
    return df.agg(*[a.alias(n) for n, a in aggs.items()])


def years(df: DataFrame, col: str = "month") -> DataFrame:
    """The distinct years, ascending."""
    return df.select(F.year(F.col(col).try_cast("date")).alias("year")).na.drop().distinct().orderBy("year")


def growth(df: DataFrame, order: str, col: str, name: str = "growth_pct") -> DataFrame:
    """Percentage change from the row before; for grouped results."""
    before = F.lag(col).over(Window.orderBy(order))
    return df.withColumn(name, F.when(before != 0, (F.col(col) - before) / before * 100))
