"""The registered model queries fit the operators' defaults and search the full ranges."""

import pytest

from carespend import queries
from carespend.ml import ensemble, scoring, search
from carespend.ml.boosting import Forest, QuantileBoosting, Settings


class Asked(Exception):
    pass


@pytest.mark.parametrize("name, make", [("forest_predictions", ensemble.forest), ("boosted_predictions", ensemble.boosted), ("binned_boosted_predictions", ensemble.binned_boosted)])
def test_single_learners(spark, sf, monkeypatch, name, make):
    asked = []

    def fit(est, df):
        asked.append(est)
        raise Asked

    monkeypatch.setattr(queries, "design_rows", lambda *_: (None, None, None))
    monkeypatch.setattr(ensemble, "fit", fit)
    with pytest.raises(Asked):
        queries.queries()[name](spark, sf)
    assert asked == [make()]


def test_defaults():
    """The settings that the work asks for."""
    assert ensemble.forest() == Forest(300, 13, 3)
    assert ensemble.boosted().settings == Settings(300, 0.05, None, 4, 4, 0.85)
    assert ensemble.binned_boosted().settings == Settings(300, 0.05, 31, None, 8)
    assert QuantileBoosting() == QuantileBoosting((0.1, 0.9), Settings(200, 0.06, 31, None, 20))


def test_bundle_and_bands(spark, sf, monkeypatch):
    asked = []
    monkeypatch.setattr(queries, "_bundles", {})
    monkeypatch.setattr(queries, "training_rows", lambda *_: "rows")
    monkeypatch.setattr(scoring, "train_bundle", lambda *a, **k: asked.append((a, k)))
    queries.bundle(spark, sf)
    assert asked == [(("rows",), {})]

    def bands(**options):
        asked.append(options)
        raise Asked

    monkeypatch.setattr(queries, "design_rows", lambda *_: (None, None, None))
    monkeypatch.setattr(queries, "QuantileForest", bands)
    with pytest.raises(Asked):
        queries.queries()["quantile_bands"](spark, sf)
    assert asked[-1] == {}


def test_search(spark, sf, monkeypatch):
    asked = []

    def record(make, df, space, n):
        asked.append((make, space, n))
        return spark.createDataFrame([(1, 0.0, {"a": 1.0})], "rank int, rmse double, setting map<string,double>"), {}

    monkeypatch.setattr(queries, "design_rows", lambda *_: (None, None, None))
    monkeypatch.setattr(search, "random_search", record)
    assert queries.queries()["parameter_search"](spark, sf).count() == 2
    assert asked == [(ensemble.forest, search.FOREST_SPACE, search.FOREST_DRAWS), (ensemble.boosted, search.BOOSTED_SPACE, search.BOOSTED_DRAWS)]


def test_training_rows_are_staged_once(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "_frames", {})
    assert queries.training_rows(spark, sf) is queries.training_rows(spark, sf)
