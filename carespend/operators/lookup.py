"""Latest rows, top rows, lookups and series alignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup table is small by contract; beyond this many entries join it as a table instead.
MAP_LIMIT = 1000


def bounded(dim: DataFrame, rows: int = MAP_LIMIT) -> DataFrame:
    """``dim`` marked for broadcast if it has at most ``rows`` rows; unmarked, so shuffled, beyond."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def latest(df: DataFrame, order: Iterable[str], by: Iterable[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` values: one for the table, or one per ``by``.

    Per group this is an aggregate, which is reduced before the shuffle, not a window.
    """
    order = list(order)
    if by is None:
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(1)
    by = list(by)
    top = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(top).select("_row.*")


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` rows with the greatest values; among equal ones the other columns decide, smallest first."""
    return df.orderBy(F.col(col).desc(), *[F.col(f"`{c}`") for c in df.columns if c != col]).limit(k)


def map_lookup(key: Column, mapping: Mapping, default: object) -> Column:
    """A constant table as an expression: no join, no shuffle."""
    if len(mapping) > MAP_LIMIT:
        raise ValueError("too many entries for an expression; join a table instead")
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), F.lit(default))


def lookup(df: DataFrame, dim: DataFrame, key: str, default: Mapping[str, object] | None = None) -> DataFrame:
    """Left join to a dimension table, with defaults where it has no row.

    ``dim`` is broadcast only after its row count is checked.
    """
    out = df.join(bounded(dim), key, "left")
    if not default:
        return out
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in default.items()})


def align_series(actual: DataFrame, forecast: DataFrame, key: str = "year") -> DataFrame:
    """Actual and forecast side by side on ``key``; null where a side has no value.

    The last actual value is repeated as that year's forecast so that the two lines meet.
    Each input has columns ``key`` and ``value``.
    """
    a = actual.select(key, F.col("value").alias("actual"))
    f = forecast.select(key, F.col("value").alias("forecast"))
    last = a.agg(F.max(key)).scalar()
    joined = a.join(f, key, "full")
    return joined.withColumn("forecast", F.when(F.col(key) == last, F.col("actual")).otherwise(F.col("forecast")))
