"""Connected components of links that may be too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carespend.sources.io import stage


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``u, component``: for each end of the links ``u, v`` the least end that it is connected to.

    Stars are built by turns: every node first sends its larger neighbours to its least one,
    then its smaller ones, until nothing changes. Neighbours are never gathered, only their
    minimum; each turn is staged, so a lost executor costs part of one turn.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    edges, before = stage(both.distinct(), "links"), None
    while True:
        large = edges.join(_least(edges), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = stage(small.where("u <> v").distinct(), "stars")
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return stars.select("u", F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
        before = state
        edges = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
