"""Split-conformal bands: how far costs lie from predictions, by exact ranks within each tier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carespend.sources.io import stage
from carespend.sources.schema import TARGET

#: Bins of an interval in each pass, and rows of an interval that are ranked at the end.
BINS, FEW = 4096, 20_000
#: Groups up to which their intervals are broadcast.
BROADCAST_GROUPS = 100_000


def ranked_values(df: DataFrame, group: str, value: str, ranks: DataFrame) -> DataFrame:
    """``group, rank, value``: of each group the value at its rank, from 1, as ``ranks`` (``group, rank``) says.

    Groups may hold any share of the rows: each pass counts values in bins between the bounds
    of the interval that holds the rank, and the next one looks inside that bin only, until few
    rows are left to be sorted. Ranks beyond a group's rows give no row. ``df`` is read several
    times; groups and values must not be null.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    bounds = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    spans = ranks.select(F.col(group).alias("g"), "rank").join(bounds, "g").where("rank BETWEEN 1 AND n")
    spans = stage(spans.select("g", "rank", "lo", "hi", "n", F.lit(0).cast("long").alias("below")), "spans")
    found = []
    while True:
        found.append(spans.where("lo = hi").select("g", "rank", F.col("lo").alias("v")))
        open_spans = spans.where("lo < hi")
        groups = open_spans.count()
        if not groups:
            break

        def inside(some: DataFrame) -> DataFrame:
            some = F.broadcast(some) if groups <= BROADCAST_GROUPS else some  # noqa: B023
            return rows.join(some, "g").where("v BETWEEN lo AND hi")

        few = inside(open_spans.where(F.col("n") <= FEW))
        place = F.col("below") + F.row_number().over(Window.partitionBy("g", "rank").orderBy("v"))
        found.append(stage(few.withColumn("place", place).where("place = rank").select("g", "rank", "v"), "ranked"))
        many = inside(open_spans.where(F.col("n") > FEW))
        bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        counts = many.groupBy("g", "rank", "below", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bin"))  # a row per bin
        narrowed = counts.withColumn("upto", upto).where("rank <= upto AND rank > upto - n")
        spans = stage(narrowed.select("g", "rank", "lo", "hi", "n", (F.col("upto") - F.col("n")).alias("below")), "spans")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select(F.col("g").alias(group), "rank", F.col("v").alias(value))


@dataclass
class ConformalBand:
    """Half-widths by tier: ``tier, n, rank, width``; a tier with too few rows for its level has no width."""

    table: DataFrame
    tier: str
    share: float

    def transform(self, df: DataFrame, point: str = "prediction") -> DataFrame:
        """Add ``lower`` and ``upper`` around ``point``. The lower bound is at least 0; without a width there is no upper one."""
        widths = self.table.select(self.tier, F.col("width").alias("_width"))
        out = df.join(widths, self.tier, "left")  # a row per tier: the planner broadcasts it by its size
        lower = F.greatest(F.lit(0.0), F.coalesce(F.col(point) - F.col("_width"), F.lit(0.0)))
        return out.select(*df.columns, lower.alias("lower"), (F.col(point) + F.col("_width")).alias("upper"))


def fit_band(calibration: DataFrame, tier: str, point: str = "prediction", label: str = TARGET, share: float = 0.8) -> ConformalBand:
    """The band that holds at least ``share`` of new costs in each tier, if they come as the calibration rows do.

    The width of a tier is the ``ceil((n + 1) * share)``-th smallest distance between cost and
    point among its ``n`` rows. Tiers must follow from what is known at prediction. Rows
    without a tier, point or label take no part.
    """
    away = F.abs(F.col(label) - F.col(point))
    rows = calibration.select(tier, away.alias("width")).where(F.col(tier).isNotNull() & F.col("width").isNotNull())
    rows = stage(rows, "distances")
    sizes = rows.groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
    # the small subtraction keeps (n + 1) * share from stepping over a whole number by rounding
    ranks = stage(sizes.withColumn("rank", F.ceil((F.col("n") + 1) * share - 1e-9).cast("long")), "ranks")
    widths = ranked_values(rows, tier, "width", ranks)
    table = ranks.join(widths.drop("rank"), tier, "left").select(tier, "n", "rank", "width")
    return ConformalBand(stage(table, "widths"), tier, share)


def coverage(df: DataFrame, tier: str, label: str = TARGET) -> DataFrame:
    """``tier, rows, inside``: rows of each tier and how many costs lie in their band; a bound that is absent holds any cost."""
    y = F.col(label)
    within = (y >= F.col("lower")) & F.coalesce(y <= F.col("upper"), F.lit(True))
    return df.where(F.col(tier).isNotNull() & y.isNotNull()).groupBy(tier).agg(F.count(F.lit(1)).alias("rows"), F.count_if(within).alias("inside"))
