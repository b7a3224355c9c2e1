"""Conformal bands against sorting, and their coverage of new rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from carespend.ml import conformal


def rows(spark, seed, n):
    rng = np.random.default_rng(seed)
    tier = rng.choice(["low", "moderate", "high"], n, p=[0.8, 0.19, 0.01])
    spread = {"low": 100.0, "moderate": 700.0, "high": 4000.0}
    p = rng.uniform(1000, 50_000, n)
    y = p + rng.normal(size=n) * np.array([spread[t] for t in tier])
    return spark.createDataFrame([(str(t), float(a), float(b)) for t, a, b in zip(tier, p, y, strict=True)], "tier string, p double, y double")


@pytest.mark.parametrize("few, bins", [(20_000, 4096), (5, 4), (1, 3)])
def test_ranked_values(spark, monkeypatch, few, bins):
    """With and without passes over bins, with ties, one value, and ranks out of reach."""
    monkeypatch.setattr(conformal, "FEW", few)
    monkeypatch.setattr(conformal, "BINS", bins)
    rng = np.random.default_rng(few)
    data = [("a", float(v)) for v in rng.normal(size=300)] + [("b", float(v)) for v in rng.integers(0, 4, 200)] + [("c", 7.0)] * 50 + [("d", 1.5)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    asked = [("a", 1), ("a", 150), ("a", 300), ("a", 301), ("b", 1), ("b", 77), ("b", 200), ("c", 25), ("d", 1), ("d", 0), ("e", 1)]
    got = conformal.ranked_values(df, "g", "v", spark.createDataFrame(asked, "g string, rank long")).collect()
    values = {g: sorted(v for h, v in data if h == g) for g in "abcde"}
    want = [(g, r, values[g][r - 1]) for g, r in asked if 1 <= r <= len(values[g])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_widths_are_the_ranked_distances(spark):
    df = rows(spark, 1, 3000)
    band = conformal.fit_band(df, "tier", "p", "y", 0.8)
    away = {}
    for r in df.collect():
        away.setdefault(r["tier"], []).append(abs(r["y"] - r["p"]))
    for r in band.table.collect():
        k = math.ceil((len(away[r["tier"]]) + 1) * 0.8)
        assert (r["n"], r["rank"]) == (len(away[r["tier"]]), k)
        assert r["width"] == sorted(away[r["tier"]])[k - 1]


def test_new_rows_are_covered_in_each_tier(spark):
    band = conformal.fit_band(rows(spark, 2, 20_000), "tier", "p", "y", 0.8)
    got = conformal.coverage(band.transform(rows(spark, 3, 20_000), "p"), "tier", "y").collect()
    assert {r["tier"] for r in got} == {"low", "moderate", "high"}
    for r in got:
        # both samples vary, by about sqrt(0.16 / n) each
        assert r["inside"] / r["rows"] == pytest.approx(0.8, abs=4 * math.sqrt(2 * 0.16 / r["rows"]))


def test_too_few_rows_give_no_upper_bound(spark):
    few = spark.createDataFrame([("low", 10.0, 12.0), ("low", 10.0, 11.0), (None, 1.0, 2.0), ("high", None, 2.0)], "tier string, p double, y double")
    band = conformal.fit_band(few, "tier", "p", "y", 0.8)
    assert [tuple(r) for r in band.table.collect()] == [("low", 2, 3, None)]
    out = band.transform(few, "p")
    assert out.columns == ["tier", "p", "y", "lower", "upper"]
    assert all(r["lower"] == 0 and r["upper"] is None for r in out.where("tier = 'low'").collect())
    assert tuple(conformal.coverage(out, "tier", "y").where("tier = 'low'").first()) == ("low", 2, 2)
    assert band.transform(few.where("tier = 'low'").limit(0), "p").collect() == []


def test_the_lower_bound_is_not_negative(spark):
    df = spark.createDataFrame([("low", 10.0, 10.0 + k) for k in range(20)], "tier string, p double, y double")
    out = conformal.fit_band(df, "tier", "p", "y", 0.9).transform(df, "p").agg(F.min("lower"), F.max("upper")).first()
    assert tuple(out) == (0.0, 28.0)
