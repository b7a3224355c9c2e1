"""Per-member history: the costs that come before each row of a member.

Rows of one member are ordered and looked at a few rows back. As long as a member has few
rows (one per month) a window per member does this. Where one member may hold a large part
of the table, pass ``hot_rows``: members above that many rows are cut into consecutive runs,
each run is handled on its own, and the last rows of a run are carried into the next one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carespend.functions.features import monthly_prior
from carespend.sources.io import stage
from carespend.sources.schema import PRIOR_YEAR, TARGET

# Beyond this many hot keys their list is joined by a shuffle instead of a broadcast.
# A key of more rows is cut into runs. Pass ``hot_rows=None`` where keys are known to be small.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000

_RUN, _TIE, _POS, _SIZE = "_run", "_tie", "_pos", "_size"


def _names(n: int) -> list[str]:
    return [f"_before_{k}" for k in range(1, n + 1)]


def _plain(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    # Rows without a key belong to no group; the hash spreads them over many partitions.
    spread = F.when(F.col(key).isNull(), F.xxhash64(*order, value))
    w = Window.partitionBy(key, spread).orderBy(*order)
    return df.withColumns(
        {name: F.when(F.col(key).isNotNull(), F.lag(value, k).over(w)) for k, name in enumerate(_names(n), 1)}
    )


def _in_runs(hot: DataFrame, runs: int, key: str, order: list[str], value: str, n: int) -> DataFrame:
    names = _names(n)
    # Rows read back from files always come in the same order, so their numbers stay the same
    # if a task runs again. The number makes the order total, and lets equal rows be cut apart.
    numbered = stage(hot, "hot-members").withColumn(_TIE, F.monotonically_increasing_id())
    cut = numbered.repartitionByRange(runs, key, *order, _TIE).withColumn(_RUN, F.spark_partition_id())
    cut = stage(cut, "hot-runs")
    in_run = Window.partitionBy(key, _RUN)
    w = in_run.orderBy(*order, _TIE)
    placed = cut.withColumns(
        {
            _POS: F.row_number().over(w),
            _SIZE: F.count(F.lit(1)).over(in_run),
            **{name: F.lag(value, k).over(w) for k, name in enumerate(names, 1)},
        }
    )
    # At most n rows of each run go on; a member has no more of them than n times the runs.
    tails = placed.where(F.col(_POS) > F.col(_SIZE) - n).select(key, _RUN, _POS, F.col(value).alias("_v"))
    over_runs = Window.partitionBy(key).orderBy(_RUN, _POS)
    carried = (
        tails.withColumns({f"_carry_{k}": F.lag("_v", k).over(over_runs) for k in range(1, n + 1)})
        .withColumn("_first", F.row_number().over(Window.partitionBy(key, _RUN).orderBy(_POS)) == 1)
        .where("_first")
        .select(key, _RUN, *[f"_carry_{k}" for k in range(1, n + 1)])
    )
    joined = placed.join(carried, [key, _RUN], "left")
    filled = {}
    for k, name in enumerate(names, 1):
        # Row p of a run finds its k-th predecessor in the run if p > k, else k-p+1 rows
        # before the run starts.
        before = F.col(name)
        for p in range(1, k + 1):
            before = F.when(F.col(_POS) == p, F.col(f"_carry_{k - p + 1}")).otherwise(before)
        filled[name] = before
    return joined.select(*hot.columns, *[c.alias(name) for name, c in filled.items()])


def with_before(
    df: DataFrame, key: str, order: Iterable[str], value: str, n: int, hot_rows: int | None = None
) -> DataFrame:
    """Add the values of the ``n`` rows before each row of the same key as ``_before_1`` … ``_before_n``.

    With ``hot_rows`` the rows are read several times, so give a stored frame.
    """
    order = list(order)
    if hot_rows is None:
        return _plain(df, key, order, value, n)
    # Rows without a key have no predecessors and need no shuffle.
    none = F.lit(None).cast(df.schema[value].dataType)
    alone = df.where(F.col(key).isNull()).withColumns({name: none for name in _names(n)})
    df = df.where(F.col(key).isNotNull())
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot_keys = stage(sizes.where(F.col("_rows") > hot_rows), "hot-keys")
    total, keys = hot_keys.agg(F.sum("_rows"), F.count(F.lit(1))).first()
    if not keys:
        return _plain(df, key, order, value, n).unionByName(alone)
    flags = hot_keys.select(key, F.lit(True).alias("_hot"))
    marked = df.join(F.broadcast(flags) if keys <= MAX_HOT_KEYS else flags, key, "left").select(*df.columns, "_hot")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot")
    hot = marked.where(F.col("_hot")).drop("_hot")
    runs = max(2, -(-total // hot_rows))
    known = _plain(rest, key, order, value, n).unionByName(_in_runs(hot, runs, key, order, value, n))
    return known.unionByName(alone)


def _mean_of(names: list[str]) -> Column:
    """Mean of the values that are not null, oldest first; null if all are."""
    total, count = F.lit(0.0), F.lit(0)
    for c in reversed(names):
        total = total + F.coalesce(F.col(c), F.lit(0.0))
        count = count + F.when(F.col(c).isNotNull(), 1).otherwise(0)
    return F.when(count > 0, total / count)


def cost_history(
    df: DataFrame,
    key: str = "member_id",
    order: Iterable[str] = ("month",),
    value: str = TARGET,
    prior: str = PRIOR_YEAR,
    n: int = 3,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add the member's previous cost and the mean of up to ``n`` previous costs, in one sort.

    Both fall back to a twelfth of the previous year's cost. The mean is over the member's
    own rows only and looks back by rows, not by calendar months.
    """
    names = _names(n)
    out = with_before(df, key, order, value, n, hot_rows).withColumns(
        {
            "prev_month_cost": F.coalesce(F.col(names[0]), monthly_prior(prior)),
            "cost_3m_avg": F.coalesce(_mean_of(names), monthly_prior(prior)),
        }
    )
    return out.drop(*names)


def prev_cost(
    df: DataFrame,
    key: str = "member_id",
    order: Iterable[str] = ("month",),
    value: str = TARGET,
    prior: str = PRIOR_YEAR,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``prev_month_cost``: the member's cost one row earlier, else a twelfth of last year's."""
    out = with_before(df, key, order, value, 1, hot_rows)
    return out.withColumn("prev_month_cost", F.coalesce("_before_1", monthly_prior(prior))).drop("_before_1")


def trailing_mean(
    df: DataFrame,
    key: str = "member_id",
    order: Iterable[str] = ("month",),
    value: str = TARGET,
    prior: str = PRIOR_YEAR,
    n: int = 3,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add ``cost_3m_avg``: the mean of up to ``n`` earlier costs, else a twelfth of last year's."""
    names = _names(n)
    out = with_before(df, key, order, value, n, hot_rows)
    return out.withColumn("cost_3m_avg", F.coalesce(_mean_of(names), monthly_prior(prior))).drop(*names)
