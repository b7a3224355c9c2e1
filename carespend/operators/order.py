"""Positions and earlier rows in one order over a whole table.

A window without a key would take all rows into one task. Here rows are dealt by ranges into
consecutive runs; each run is numbered on its own, positions follow from the sizes of the runs
before it, and the first rows of a run get what lies before them from the ends of earlier runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carespend.functions.features import monthly_prior
from carespend.sources.io import stage
from carespend.sources.schema import PRIOR_YEAR, TARGET

#: Rows of a run, about.
RUN_ROWS = 1_000_000

_RUN, _TIE, _AT, _SIZE = "_run", "_tie", "_at", "_size"


def positions(df: DataFrame, order: Iterable[str], name: str = "position", run_rows: int = RUN_ROWS) -> DataFrame:
    """Add each row's place in the order of the whole table, from 0. Nulls come first; equal rows keep some order."""
    return _placed(df, list(order), name, run_rows).drop(_RUN, _TIE, _AT, _SIZE)


def _placed(df: DataFrame, order: list[str], name: str, run_rows: int) -> DataFrame:
    # Rows read back from files always come in the same order, so a task that runs again numbers them alike.
    numbered = stage(df, "to-order").withColumn(_TIE, F.monotonically_increasing_id())
    runs = max(1, -(-numbered.count() // run_rows))
    cut = stage(numbered.repartitionByRange(runs, *order, _TIE).withColumn(_RUN, F.spark_partition_id()), "ordered-runs")
    sizes, offset, before = cut.groupBy(_RUN).agg(F.count(F.lit(1)).alias(_SIZE)).orderBy(_RUN).collect(), 0, []  # one row per run
    for r in sizes:
        before.append((r[_RUN], r[_SIZE], offset))
        offset += r[_SIZE]
    offsets = df.sparkSession.createDataFrame(before, f"{_RUN} int, {_SIZE} long, _offset long")
    at = F.row_number().over(Window.partitionBy(_RUN).orderBy(*order, _TIE))
    placed = cut.withColumn(_AT, at).join(F.broadcast(offsets), _RUN)
    return placed.withColumn(name, F.col("_offset") + F.col(_AT) - 1).drop("_offset")


def earlier(df: DataFrame, order: Iterable[str], values: Iterable[str], n: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """Add ``_before_1`` to ``_before_n``: the values, as a struct, of the rows that many places before in the whole table."""
    order, value, pos = list(order), F.struct(*values), "_position"
    placed = stage(_placed(df, order, pos, run_rows), "placed")
    within = Window.partitionBy(_RUN).orderBy(pos)
    lagged = placed.withColumns({f"_before_{k}": F.lag(value, k).over(within) for k in range(1, n + 1)})
    # At most n rows at each end of each run.
    ends = placed.where(F.col(_AT) > F.col(_SIZE) - n).select(F.col(pos).alias("_from"), value.alias("_value"))
    starts = placed.where(F.col(_AT) <= n).select(F.col(pos).alias("_to"), F.col(_AT).alias("_first"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
    carried = starts.where(F.col("_k") >= F.col("_first")).withColumn("_from", F.col("_to") - F.col("_k")).join(ends, "_from")
    carried = carried.groupBy("_to").agg(*[F.max(F.when(F.col("_k") == k, F.col("_value"))).alias(f"_carried_{k}") for k in range(1, n + 1)])
    joined = lagged.join(F.broadcast(carried), F.col(pos) == F.col("_to"), "left")
    filled = [F.coalesce(F.col(f"_before_{k}"), F.col(f"_carried_{k}")).alias(f"_before_{k}") for k in range(1, n + 1)]
    return joined.select(*df.columns, *filled)


def rolling_over_table(
    df: DataFrame, key: str = "member_id", order: Iterable[str] = ("month",), value: str = TARGET, prior: str = PRIOR_YEAR, n: int = 3, run_rows: int = RUN_ROWS
) -> DataFrame:
    """Add ``cost_3m_avg``: the mean of the previous costs that this row and the ``n - 1`` rows before it have.

    A row's previous cost is its member's, one row earlier; the mean runs over the table in the
    order of members, so the first rows of a member also take in the last ones of the member
    before. Rows without any fall back to a twelfth of last year's cost. ``trailing_mean`` in
    ``windows`` keeps to the member.
    """
    out = earlier(df, [key, *order], [key, value], n, run_rows)

    def previous(k: int) -> Column:
        """The previous cost of the row ``k`` places before."""
        here = F.col(key) if k == 0 else F.col(f"_before_{k}")[key]
        row = F.col(f"_before_{k + 1}")
        return F.when(row[key] == here, row[value])

    known = [previous(k) for k in range(n - 1, -1, -1)]
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in known), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in known), F.lit(0.0))
    mean = F.when(count > 0, total / count)
    return out.withColumn("cost_3m_avg", F.coalesce(mean, monthly_prior(prior))).drop(*(f"_before_{k}" for k in range(1, n + 1)))


def position_folds(df: DataFrame, order: Iterable[str], n: int = 3, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows of ``n`` expanding folds by position: ``fold, part`` (``fit`` or ``validate``) beside the columns of ``df``.

    The last ``n`` blocks of a ``n + 1``-th of the rows are validated, each by what lies before it.
    """
    placed = stage(positions(df, order, "_position", run_rows), "positions")
    total = placed.count()
    size = total // (n + 1)
    if size == 0:
        raise ValueError(f"{total} rows are too few for {n} folds")
    starts = [(i + 1, total - (n - i) * size) for i in range(n)]
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).cast("long").alias("start")) for i, a in starts])
    each = placed.select(*df.columns, "_position", F.inline(folds))
    part = F.when(F.col("_position") < F.col("start"), "fit").when(F.col("_position") < F.col("start") + size, "validate")
    return each.withColumn("part", part).where("part IS NOT NULL").drop("_position", "start")
