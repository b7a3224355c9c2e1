"""Orders over whole tables against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carespend.operators import order
from carespend.sources.schema import PRIOR_YEAR, TARGET


def claims(spark, seed, rows=90, members=12):
    rng = np.random.default_rng(seed)
    keys = [(int(m), int(t)) for m in range(members) for t in range(40)]
    chosen = [keys[k] for k in rng.choice(len(keys), rows, replace=False)]
    data = [(m, dt.date(2020 + t // 12, t % 12 + 1, 1), None if rng.random() < 0.1 else float(rng.integers(1, 1000)), 1200.0) for m, t in chosen]
    df = spark.createDataFrame(data, f"member_id long, month date, {TARGET} double, {PRIOR_YEAR} double")
    pdf = pd.DataFrame(data, columns=["member_id", "month", TARGET, PRIOR_YEAR]).sort_values(["member_id", "month"]).reset_index(drop=True)
    return df, pdf


@pytest.mark.parametrize("run_rows", [1, 2, 7, 1000])
def test_positions(spark, run_rows):
    df, pdf = claims(spark, 1)
    got = order.positions(df, ["member_id", "month"], "p", run_rows).orderBy("p").toPandas()
    assert got["p"].tolist() == list(range(len(pdf)))
    assert got[["member_id", "month"]].equals(pdf[["member_id", "month"]])


def test_equal_rows_get_places_of_their_own(spark):
    df = spark.createDataFrame([(1,)] * 20 + [(None,)] * 5 + [(2,)], "a int")
    got = order.positions(df, ["a"], "p", 4).orderBy("p").collect()
    assert [r["a"] for r in got] == [None] * 5 + [1] * 20 + [2] and [r["p"] for r in got] == list(range(26))
    assert order.positions(df.limit(0), ["a"]).collect() == []


@pytest.mark.parametrize("run_rows", [1, 2, 5, 1000])
def test_rolling_is_the_pandas_expression(spark, run_rows):
    """Previous cost by member, then a rolling mean over the whole sorted table, as pandas does it."""
    df, pdf = claims(spark, run_rows)
    before = pdf.groupby("member_id")[TARGET].shift(1)
    want = before.rolling(3, min_periods=1).mean().fillna(pdf[PRIOR_YEAR] / 12)
    got = order.rolling_over_table(df, run_rows=run_rows).orderBy("member_id", "month").toPandas()
    assert got["cost_3m_avg"].tolist() == pytest.approx(want.tolist())
    assert got.columns.tolist() == [*df.columns, "cost_3m_avg"]


def test_no_window_over_the_whole_table(spark):
    df, _ = claims(spark, 3)
    text = order.rolling_over_table(df, run_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("rows", [4, 23, 40])
def test_folds_by_position(spark, rows):
    """Sizes and borders of scikit-learn's time series split."""
    df = spark.range(rows).select((F.col("id") * 7 % rows if rows % 7 else F.col("id")).alias("k"))
    got = order.position_folds(df, ["k"], 3, run_rows=5).toPandas()
    size, ks = rows // 4, sorted(r[0] for r in df.collect())
    for fold in range(1, 4):
        start = rows - (4 - fold) * size
        part = got[got["fold"] == fold]
        assert sorted(part[part["part"] == "fit"]["k"]) == ks[:start]
        assert sorted(part[part["part"] == "validate"]["k"]) == ks[start : start + size]
    with pytest.raises(ValueError):
        order.position_folds(df.limit(3), ["k"])
