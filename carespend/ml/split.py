"""Splits along time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_holdout(df: DataFrame, holdout: int = 3, month: str = "month") -> Column:
    """True for the last months, from ``holdout`` before the last one on (so holdout + 1 months)."""

    def ordinal(c: Column) -> Column:
        return F.year(c) * 12 + F.month(c)

    return ordinal(F.col(month)) >= ordinal(df.agg(F.max(month)).scalar()) - holdout


def time_split(df: DataFrame, holdout: int = 3, month: str = "month") -> tuple[DataFrame, DataFrame]:
    """Rows before the holdout months, and the holdout. Rows without a month are in neither."""
    late = is_holdout(df, holdout, month)
    return df.where(~late), df.where(late)


def fold_bounds(df: DataFrame, n: int = 3, index: str = "time_index") -> list[tuple[int, int]]:
    """First and last month of each of ``n`` equal blocks of months, the last ones of the table."""
    # One value per month, so this is small.
    months = sorted(r[0] for r in df.select(index).where(F.col(index).isNotNull()).distinct().collect())
    size = len(months) // (n + 1)
    if size == 0:
        raise ValueError(f"{len(months)} months are too few for {n} folds")
    starts = [len(months) - (n - i) * size for i in range(n)]
    return [(months[a], months[a + size - 1]) for a in starts]


def time_folds(df: DataFrame, n: int = 3, index: str = "time_index") -> Iterator[tuple[DataFrame, DataFrame]]:
    """Expanding windows: fit on the months before each of ``n`` equal blocks, validate on the block."""
    for first, end in fold_bounds(df, n, index):
        yield (
            df.where(F.col(index) < first),
            df.where((F.col(index) >= first) & (F.col(index) <= end)),
        )
