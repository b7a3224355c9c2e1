"""Profiling a claims table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.functions.clean import number, numeric_columns
from carespend.operators.quantiles import Span, quantiles_within
from carespend.sources.io import stage
from carespend.sources.schema import TARGET

#: Hashes of repeated rows up to which they are broadcast.
BROADCAST_HASHES = 1_000_000

# The candidate cost drivers to look at, and the column behind each.
CANDIDATE_DRIVERS = [
    ("Specialty / Drug Category", "drug_category"),
    ("Site of Care", "site_of_care"),
    ("Provider Type", "provider_type"),
    ("Hospital Admissions", "hospital_admissions"),
    ("Emergency Visits", "emergency_visits"),
]


def _missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def overview(df: DataFrame) -> DataFrame:
    """Per column: position, type, non-null count and the row count, in one pass."""
    fields = df.schema.fields
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(~_missing(f)).alias(f"{i}") for i, f in enumerate(fields)],
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"`{i}`").alias("non_null"),
            F.col("_rows").alias("row_count"),
        )
        for i, f in enumerate(fields)
    ]
    return one.select(F.inline(F.array(*entries)))


def describe(df: DataFrame, cols: Iterable[str] = (TARGET,)) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of each column."""
    cols = list(cols)
    stats = df.agg(
        *[
            F.struct(
                F.count(number(c)).alias("n"),
                F.avg(number(c)).alias("mean"),
                F.stddev_samp(number(c)).alias("std"),
                F.min(number(c)).alias("min"),
                F.max(number(c)).alias("max"),
            ).alias(c)
            for c in cols
        ]
    ).first()
    spans = [Span(c, stats[c]["min"], stats[c]["max"], stats[c]["n"]) for c in cols if stats[c]["n"]]
    quartiles = quantiles_within(df, spans, (0.25, 0.5, 0.75))
    rows = []
    for c in cols:
        s = stats[c]
        rows.append((c, s["n"], s["mean"], s["std"], s["min"], *quartiles.get(c, [None] * 3), s["max"]))
    schema = "column_name string, n long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    return df.sparkSession.createDataFrame(rows, schema)


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of each column, and the total over all columns."""
    fields = df.schema.fields
    one = df.agg(*[F.count_if(_missing(f)).alias(f.name) for f in fields])
    entries = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").alias("nulls")) for f in fields]
    total = None
    for f in fields:
        total = F.col(f"`{f.name}`") if total is None else total + F.col(f"`{f.name}`")
    return one.select(total.alias("total_nulls"), F.inline(F.array(*entries))).select(
        "column_name", "nulls", "total_nulls"
    )


def head(df: DataFrame, order: Iterable[str], k: int = 5) -> DataFrame:
    """The first ``k`` rows in an order; nulls come first."""
    return df.orderBy(*order).limit(k)


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row that are equal for equal rows; 0.0 and -0.0 are equal, as they are in groups."""
    values = [F.col(f"`{f.name}`") + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *reversed(values))]


def hash_counts(df: DataFrame, hashes: Callable[[DataFrame], list[Column]] = row_hashes) -> DataFrame:
    """``key, n``: each pair of hashes that several rows have with its rows, and a null key with all other rows."""
    names = ["_hash_0", "_hash_1"]
    counts = df.select(*[h.alias(c) for c, h in zip(names, hashes(df), strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    return stage(counts.groupBy(F.when(F.col("_n") > 1, F.struct(*names)).alias("key")).agg(F.sum("_n").alias("n")), "repeated-hashes")


def repeated_rows(df: DataFrame, hashes: Callable[[DataFrame], list[Column]] = row_hashes, counts: DataFrame | None = None) -> DataFrame:
    """Each distinct row that occurs more than once, with its ``copies``.

    Only hashes of all rows are shuffled at first; ``counts`` are those of ``hash_counts``, if they
    are there already. Rows whose hash occurs once cannot repeat and stay where they are; the
    others are compared as a whole, so hashes that meet by chance do no harm. ``df`` is read
    twice, or once where no hash repeats. Above ``BROADCAST_HASHES`` repeated hashes these meet
    the rows by a shuffle of all rows.
    """
    names = ["_hash_0", "_hash_1"]
    often = (hash_counts(df, hashes) if counts is None else counts).where("key IS NOT NULL").select("key.*")
    n = often.count()
    if not n:
        return df.limit(0).withColumn("copies", F.lit(0).cast("long"))
    hashed = df.withColumns(dict(zip(names, hashes(df), strict=True)))
    often = F.broadcast(often) if n <= BROADCAST_HASHES else often
    rows = hashed.join(often, names, "left_semi").drop(*names)
    return rows.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicates(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row; rows that occur once are not moved, and rows are counted along with their hashes."""
    found = hash_counts(df)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    counts = repeated_rows(df, counts=found).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))
    return counts.select(total.alias("row_count"), "duplicate_rows")


def duplicate_sample(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` distinct rows that occur most often, more than once, with how often; ties in column order."""
    return repeated_rows(df).orderBy(F.desc("copies"), *[F.col(f"`{c}`") for c in df.columns]).limit(k)


def histogram(df: DataFrame, col: str = TARGET, bins: int = 50) -> DataFrame:
    """Counts in equal bins between the minimum and the maximum; the last bin is closed. Empty bins show 0."""
    v = F.col("v")
    values = df.select(number(col).alias("v")).where(v.isNotNull())
    span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("span")).scalar()
    placed = values.withColumn("s", span)
    lo, hi = F.col("s.lo"), F.col("s.hi")
    # A single value gets a bin of width 1 around it, as histograms usually do.
    lo, hi = F.when(hi > lo, lo).otherwise(lo - 0.5), F.when(hi > lo, hi).otherwise(hi + 0.5)
    bin_ = F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first(lo).alias("lo"), F.first(hi).alias("hi")
    )
    # One row holding the counts by bin, from which every bin is listed.
    one = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.max("lo").alias("lo"), F.max("hi").alias("hi")
    ).where("lo IS NOT NULL")
    width = (F.col("hi") - F.col("lo")) / bins
    listed = one.select("m", "lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return listed.select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"),
        F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)).alias("n"),
    )


def scatter_bins(df: DataFrame, x: str, y: str = TARGET, y_width: float = 5000.0) -> DataFrame:
    """Points of ``y`` against ``x``, counted in cells: each ``x`` value by steps of ``y``."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).alias("x"), F.floor(F.col(y) / y_width).cast("long").alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def scatter_points(df: DataFrame, x: str, key: Iterable[Column], y: str = TARGET, y_width: float = 5000.0, k: int = 20, seed: str = "points") -> DataFrame:
    """Points to draw: of each cell (an ``x`` value by steps of ``y``) the ``k`` rows with the least keyed hash.

    ``key`` tells rows apart. The choice is repeatable, does not depend on how rows are dealt,
    and that of two tables together follows from their own. Each task passes on ``k`` rows of a
    cell at most. Returns ``x, y, y_bin``; rows without ``x`` or ``y`` take no part.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in key]))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(F.col(x).alias("x"), F.col(y).alias("y"), F.floor(F.col(y) / y_width).cast("long").alias("y_bin"), hashed.alias("_h"))
    place = F.row_number().over(Window.partitionBy("x", "y_bin").orderBy("_h", "y"))
    return rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_h", "_place")


def correlations(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns, over the rows where both are present.

    Each batch of rows is reduced to the sums behind all pairs by matrix products, and these
    small matrices are added up in Spark; values are centred first, to keep precision.
    """
    cols = list(cols or numeric_columns(df))
    p = len(cols)
    values = df.select([number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    # Any centre near the data will do, so it need not be exact.
    centre = values.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(p)]).first()
    shift = np.array([0.0 if m is None else m for m in centre])
    upper_i, upper_j = np.triu_indices(p)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sx, sy, sxx, syy, sxy = (np.zeros((p, p)) for _ in range(6))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            here = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            n += here.T @ here
            first, square = x.T @ here, (x * x).T @ here
            sx += first
            sy += first.T
            sxx += square
            syy += square.T
            sxy += x.T @ x
        at = (upper_i, upper_j)
        yield pd.DataFrame(
            {
                "i": upper_i,
                "j": upper_j,
                "n": n[at],
                "sx": sx[at],
                "sy": sy[at],
                "sxx": sxx[at],
                "syy": syy[at],
                "sxy": sxy[at],
            }
        )

    parts = values.mapInPandas(
        reduce, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    r = F.when((n > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    names = F.array(*[F.lit(c) for c in cols])
    pairs = sums.select("i", "j", r.alias("r"))
    both = F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")), F.struct(F.col("j").alias("a"), F.col("i").alias("b")))
    ends = F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)
    return pairs.select("r", F.explode(ends).alias("e")).select(
        F.get(names, F.col("e.a")).alias("x"), F.get(names, F.col("e.b")).alias("y"), F.col("r").alias("corr")
    )


def driver_list(spark: SparkSession) -> DataFrame:
    """The candidate drivers as a table."""
    return spark.createDataFrame(CANDIDATE_DRIVERS, "driver string, column_name string")
