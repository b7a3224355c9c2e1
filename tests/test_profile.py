import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from carespend.operators import profile, quantiles


@pytest.mark.parametrize("bins,small", [(4096, 20_000), (8, 10), (3, 1)])
def test_exact_quantiles_match_pandas(spark, monkeypatch, bins, small):
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = random.Random(bins)
    values = [rng.lognormvariate(0, 3) for _ in range(300)] + [7.0] * 200 + [-1e-9, -5e8, 1e12]
    rng.shuffle(values)
    rows = [(v,) for v in values] + [(None,), (math.nan,)]
    df = spark.createDataFrame(rows, "v double").repartition(4)
    qs = [0, 0.005, 0.25, 0.5, 0.75, 0.995, 1]
    want = pd.Series(values).quantile(qs).tolist()
    assert quantiles.exact_quantiles(df, "v", qs) == pytest.approx(want, rel=1e-12)


def test_quantiles_of_little(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.5]) == [None]
    df = spark.createDataFrame([(3.0,)], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.5, 0.9]) == [3.0, 3.0]
    df = spark.createDataFrame([(3.0,), (math.inf,)], "v double")
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, "v", [0.5])


def test_winsorise_caps_the_maximum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)] + [(None,)], "v double")
    out = quantiles.winsorise(df, "v", 0.995).toPandas()["v"]
    assert out.max() == pytest.approx(pd.Series(range(1000)).quantile(0.995))
    assert out.isna().sum() == 1


def test_describe_matches_pandas(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 20)
    rng = np.random.default_rng(0)
    data = pd.DataFrame({"a": rng.normal(size=500), "b": rng.integers(0, 4, 500).astype(float)})
    got = profile.describe(spark.createDataFrame(data), ["a", "b"]).toPandas().set_index("column_name")
    want = data.describe()
    for c in ("a", "b"):
        for mine, theirs in (("n", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("max", "max")):
            assert got.loc[c, mine] == pytest.approx(want.loc[theirs, c])


def test_nulls_and_overview(spark):
    df = spark.createDataFrame([(1, None, math.nan), (2, "x", 1.0)], "a int, b string, c double")
    got = {r["column_name"]: (r["nulls"], r["total_nulls"]) for r in profile.null_profile(df).collect()}
    assert got == {"a": (0, 2), "b": (1, 2), "c": (1, 2)}
    rows = profile.overview(df).orderBy("position").collect()
    assert [(r["column_name"], r["type"], r["non_null"], r["row_count"]) for r in rows] == [
        ("a", "int", 2, 2),
        ("b", "string", 1, 2),
        ("c", "double", 1, 2),
    ]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None)] * 3 + [(1, "x"), (2, "x"), (2, "x")], "a int, b string")
    assert tuple(profile.duplicates(df).first()) == (6, 3)
    assert {tuple(r) for r in profile.duplicate_sample(df).collect()} == {(1, None, 3), (2, "x", 2)}
    assert tuple(profile.duplicates(df.limit(0)).first()) == (0, 0)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.append(rng.gamma(2.0, 100.0, 2000), 5000.0)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = [r["n"] for r in profile.histogram(df, "v", 50).orderBy("bin").collect()]
    assert got == np.histogram(values, 50)[0].tolist()
    flat = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert [r["n"] for r in profile.histogram(flat, "v", 4).orderBy("bin").collect()] == np.histogram([2.0] * 4, 4)[0].tolist()


def test_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(400, 4)) + 1e6, columns=list("abcd"))
    data["b"] = data["a"] * 2 + rng.normal(size=400)
    data.loc[data.index % 3 == 0, "c"] = np.nan
    data["e"] = 1.0
    data["f"] = np.nan
    got = profile.correlations(spark.createDataFrame(data).repartition(3)).toPandas().pivot(index="x", columns="y", values="corr")
    want = data.corr()
    for x in "abcd":
        for y in "abcd":
            assert got.loc[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)
    assert math.isnan(got.loc["a", "e"]) and math.isnan(got.loc["f", "b"]) and math.isnan(got.loc["f", "f"])


def test_driver_list(spark):
    assert profile.driver_list(spark).count() == 5


def repeated(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (2, None, 1.0), (2, None, 1.0), (2, None, 1.0), (3, "b", float("nan")), (3, "b", float("nan")), (4, "c", 2.0), (None, None, None), (1, "b", 0.0)]
    return spark.createDataFrame(rows, "a int, b string, c double").repartition(4)


def counted(df):
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return sorted((str(tuple(r)) for r in grouped.collect()))


@pytest.mark.parametrize("collide", [False, True])
def test_repeated_rows_are_compared_as_a_whole(spark, collide):
    """The same rows whether hashes tell rows apart or all of them meet."""
    df = repeated(spark)
    hashes = (lambda d: [F.lit(1), F.col("a") * 0]) if collide else profile.row_hashes
    got = sorted(str(tuple(r)) for r in profile.repeated_rows(df, hashes).collect())
    assert got == counted(df) and len(got) == 3


def test_unique_rows_stay_where_they_are(spark, monkeypatch):
    df = spark.range(2000).withColumn("text", F.repeat(F.col("id").cast("string"), 20)).union(spark.createDataFrame([(5, "5" * 20)], "id long, text string"))
    assert tuple(profile.duplicates(df).first()) == (2001, 1)
    for limit in (10**6, 0):  # known hashes are broadcast, or meet the rows by a shuffle
        monkeypatch.setattr(profile, "BROADCAST_HASHES", limit)
        assert [tuple(r) for r in profile.repeated_rows(df).collect()] == [(5, "5" * 20, 2)]
        moved = profile.repeated_rows(df)._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in moved) == (limit == 0) or limit == 0


def test_scatter_points_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("x"), (F.col("id") * 7 % 20000).cast("double").alias("y"), "id")
    take = lambda d: sorted(map(tuple, profile.scatter_points(d, "x", [F.col("id")], "y", 5000.0, 4).collect()))
    got = take(df)
    assert got == take(df.repartition(13)) == take(df.orderBy(F.desc("id")).coalesce(1))
    cells = {}
    for x, _, cell in got:
        cells[x, cell] = cells.get((x, cell), 0) + 1
    assert set(cells.values()) == {4} and len(cells) == 12
    # those of all rows are among those of each half
    halves = take(df.where("id % 2 = 0")) + take(df.where("id % 2 = 1"))
    assert set(got) <= set(halves)
    other = sorted(map(tuple, profile.scatter_points(df, "x", [F.col("id")], "y", 5000.0, 4, "again").collect()))
    assert other != got


def test_head(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "a int")
    assert [r["a"] for r in profile.head(df, ["a"], 3).collect()] == [None, 1, 2]


def test_rows_are_counted_along_with_their_hashes(spark):
    """Where nothing repeats, the rows are read once; otherwise twice."""
    for copies, passes in ((1, 1), (2, 2)):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        rows = [(i, None if i % 5 == 0 else f"v{i}") for i in range(30)] + [(7, "v7")] * (copies - 1)
        df = spark.createDataFrame(rows, "a int, b string").mapInArrow(counted, "a int, b string")
        assert [tuple(r) for r in profile.duplicates(df).collect()] == [(len(rows), copies - 1)]
        assert read.value == passes * len(rows)
