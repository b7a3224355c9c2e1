"""Joins whose small side is broadcast only after its size was checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carespend.sources.io import stage

#: Rows of at most a few dozen bytes each that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stage narrow rows, and mark them for broadcast if there are at most ``rows``; a larger frame is joined by shuffling."""
    kept = stage(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept
