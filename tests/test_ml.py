import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carespend.ml import encode, ensemble, evaluate, scoring, search, split
from carespend.ml.boosting import QuantileBoosting, Settings
from carespend.ml.quantile import QuantileForest
from carespend.sources.schema import TARGET

TINY = {"rf": {"trees": 5, "depth": 4}, "gb": {"rounds": 4, "rate": 0.3}, "hist_gb": {"rounds": 4, "leaves": 8, "rate": 0.3}}


def claims(spark, members=60, months=12):
    """Claims whose cost follows from the inputs, with a row per member and month."""
    rng = np.random.default_rng(3)
    rows = []
    for m in range(members):
        for t in range(months):
            age, spend = int(rng.integers(20, 80)), float(rng.uniform(100, 9000))
            site = ["Inpatient", "Outpatient", "in patient", None][int(rng.integers(4))]
            visits = int(rng.integers(0, 6))
            cost = 2000 + 40 * age + 1.5 * spend + 900 * visits + rng.normal() * 200
            rows.append((f"{m}/{t}", f"m{m}", dt.date(2023 + t // 12, t % 12 + 1, 1), age, spend, visits, site, float(cost)))
    schema = "record_id string, member_id string, month date, age int, pharmacy_spend double, doctor_visits int, "
    schema += "site_of_care string, monthly_medical_cost double"
    df = spark.createDataFrame(rows, schema)
    from carespend.functions.clean import impute_defaults

    site = df.withColumnRenamed("site_of_care", "_site")
    return impute_defaults(site).drop("site_of_care").withColumnRenamed("_site", "site_of_care")


@pytest.fixture(scope="module")
def frame(spark):
    return scoring.training_frame(claims(spark)).cache()


@pytest.fixture(scope="module")
def bundle(frame):
    return scoring.train_bundle(frame, scoring.default_bases(TINY), QuantileBoosting(settings=Settings(rounds=20, rate=0.2, leaves=6)))


def test_one_hot_drops_the_first_and_zeroes_the_unknown(spark):
    fit = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "g string")
    enc = encode.OneHotDropFirst.fit(fit, ["g"])
    assert enc.names() == ["g_b", "g_c", "g_nan"]
    new = spark.createDataFrame([("a",), ("b",), ("zzz",), (None,)], "g string")
    out = [tuple(r)[1:] for r in enc.transform(new).collect()]
    assert out == [(0, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 1)]


def test_too_many_categories_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError):
        encode.OneHotDropFirst.fit(spark.range(5).select(F.col("id").cast("string").alias("g")), ["g"])


def test_scale_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    out = encode.Scale.fit(df, ["a", "b"]).transform(df).toPandas()
    a = np.array([1.0, 2.0, 4.0])
    assert out["a"].tolist() == pytest.approx(((a - a.mean()) / a.std()).tolist())
    assert out["b"].tolist() == [0.0, 0.0, 0.0]


def test_split_holds_out_four_months(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1),) for m in range(1, 13)], "month date")
    train, test = split.time_split(df)
    assert train.count() == 8 and test.agg(F.min("month")).first()[0] == dt.date(2024, 9, 1)


def test_time_folds_expand(spark):
    df = spark.range(9).select(F.col("id").cast("int").alias("time_index"))
    got = [([r[0] for r in a.collect()], [r[0] for r in b.collect()]) for a, b in split.time_folds(df, 3)]
    assert [len(a) for a, _ in got] == [3, 5, 7] and [b for _, b in got] == [[3, 4], [5, 6], [7, 8]]
    with pytest.raises(ValueError):
        list(split.time_folds(df.limit(2), 3))


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    x[:, 2] = x[:, 0] + 0.01 * x[:, 2]
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    ridge = ensemble.fit_ridge(df, ["a", "b", "c"], "y", 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert list(ridge.weights.values()) == pytest.approx(w.tolist(), rel=1e-8)
    assert ridge.intercept == pytest.approx(y.mean() - x.mean(0) @ w)


def test_vote(spark):
    df = spark.createDataFrame([(2.0, 6.0)], "a double, b double")
    assert ensemble.vote(df, {"a": 1, "b": 3}).first()["prediction"] == 5.0


def vectors(spark, n=120):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        a, b = rng.uniform(0, 1, 2)
        rows.append((f"m{i % 20}", Vectors.dense([a, b]), float(10 * a - 5 * b + rng.normal() * 0.1)))
    return spark.createDataFrame(rows, ["member_id", "features", TARGET])


def test_voting_model(spark):
    df = vectors(spark)
    models = {"rf": ensemble.forest(**TINY["rf"]).fit(df), "gb": ensemble.boosted(**TINY["gb"]).fit(df)}
    out = ensemble.Voting(models, {"rf": 1, "gb": 3}).transform(df)
    assert out.columns == [*df.columns, "prediction"]
    a = models["rf"].transform(df).agg(F.avg("prediction")).first()[0]
    b = models["gb"].transform(df).agg(F.avg("prediction")).first()[0]
    assert out.agg(F.avg("prediction")).first()[0] == pytest.approx((a + 3 * b) / 4)


def test_out_of_fold_covers_each_row_once_by_models_that_did_not_see_it(spark):
    from concurrent.futures import ThreadPoolExecutor

    df = vectors(spark)
    seen = []

    class Probe:
        """Stands for a learner: predicts the fold numbers that it was fitted on."""

        def fit(self, rows):
            folds = sorted({r[0] for r in rows.select("_fold").distinct().collect()})
            seen.append(folds)
            return self.Model(folds)

        class Model:
            predictionCol = "p"

            def __init__(self, folds):
                self.folds = folds

            def copy(self, names):
                self.name = names["p"]
                return self

            def transform(self, rows):
                return rows.withColumn(self.name, F.lit(float(sum(10**f for f in self.folds))))

    stack = ensemble.Stacked({"probe": Probe()}, cv=3)
    folded = stack.with_folds(df)
    with ThreadPoolExecutor(1) as pool:
        oof = stack.out_of_fold(folded, pool).collect()
    assert len(oof) == df.count()
    everything = 111.0
    assert all(r["p_probe"] == everything - 10 ** r["_fold"] for r in oof)
    members = {}
    for r in oof:
        members.setdefault(r["member_id"], set()).add(r["_fold"])
    assert all(len(f) == 1 for f in members.values())


def test_quantile_forest(spark):
    df = vectors(spark, 400)
    model = QuantileForest(params={"trees": 10, "depth": 4, "least": 15}).fit(df)
    out = model.transform(df).toPandas()
    assert (out["q10"] <= out["q90"]).all()
    inside = ((out[TARGET] >= out["q10"]) & (out[TARGET] <= out["q90"])).mean()
    assert 0.6 < inside <= 1.0


@pytest.fixture(scope="module")
def quantile_forest(spark):
    learner = QuantileForest(qs=(0.1, 0.5, 0.9), params={"trees": 3, "depth": 3, "least": 20}, bins=5000)
    return learner.fit(vectors(spark, 300))


def test_leaf_quantiles_match_pandas(spark, quantile_forest):
    """With more bins than rows, the quantiles in a leaf are those of its labels."""
    df, model = vectors(spark, 300), quantile_forest
    rows = model.forest.leaves(df, "leaf").select("leaf", TARGET).toPandas()
    width = rows[TARGET].max() - rows[TARGET].min()
    table = {(r["tree"], r["leaf"]): np.array(r["q"]) for r in model.table.collect()}
    assert len(table) == model.n_leaves
    for tree in range(3):
        for leaf, group in rows.groupby(rows["leaf"].map(lambda a: int(a[tree])))[TARGET]:
            want = group.quantile([0.1, 0.5, 0.9], interpolation="lower").to_numpy()
            above = group.quantile([0.1, 0.5, 0.9], interpolation="higher").to_numpy()
            got = table[tree, leaf]
            assert (got >= want - 0.02 * width).all() and (got <= above + 0.02 * width).all()


def test_leaf_table_is_joined_at_any_size(spark, quantile_forest, monkeypatch):
    """Broadcast or shuffled, the quantiles are the means of the leaves' ones, and nothing comes to the driver."""
    from carespend.ml import quantile

    df, model = vectors(spark, 300), quantile_forest
    table = {(r["tree"], r["leaf"]): np.array(r["q"]) for r in model.table.collect()}
    rows = model.forest.leaves(df, "leaf").select(TARGET, "leaf").collect()
    want = {r[TARGET]: np.mean([table[t, leaf] for t, leaf in enumerate(r["leaf"])], axis=0) for r in rows}
    for limit, join in ((10**6, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(quantile, "BROADCAST_LEAVES", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        monkeypatch.setattr(DataFrame, "collect", lambda *_: pytest.fail("collected"))
        out = model.transform(df)
        monkeypatch.undo()
        assert join in out._jdf.queryExecution().executedPlan().toString()
        got = {r[TARGET]: (r["q10"], r["q50"], r["q90"]) for r in out.collect()}
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert len(got) == len(want) and all(got[y] == pytest.approx(tuple(q)) for y, q in want.items())


def test_metrics(spark):
    df = spark.createDataFrame(
        [(10.0, 12.0, 9.0, 13.0), (20.0, 19.0, 21.0, 25.0), (0.0, 1.0, 0.0, 1.0)], "y double, p double, lo double, hi double"
    )
    r = evaluate.evaluate(df, "y", "p", "lo", "hi").first()
    assert r["n"] == 3 and r["rmse"] == pytest.approx(2**0.5) and r["mae"] == pytest.approx(4 / 3)
    assert r["mape"] == pytest.approx((0.2 + 0.05) / 2 * 100)
    assert r["r2"] == pytest.approx(1 - 6 / 200)
    assert r["coverage"] == pytest.approx(200 / 3)


def test_search_space_and_order(spark):
    drawn = search.draw(search.BOOSTED_SPACE, search.BOOSTED_DRAWS)
    assert len(drawn) == 10 and drawn == search.draw(search.BOOSTED_SPACE, 10)
    assert all(2 <= d["depth"] < 5 and 0.7 <= d["subsample"] <= 1.0 for d in drawn)
    df = vectors(spark).withColumn("time_index", (F.monotonically_increasing_id() % 8).cast("int"))
    space = {"trees": ("int", 2, 5), "depth": ("int", 1, 5)}
    table, best = search.random_search(ensemble.forest, df, space, 3)
    rows = table.orderBy("rank").collect()
    assert [r["rmse"] for r in rows] == sorted(r["rmse"] for r in rows)
    assert rows[0]["setting"]["depth"] == best["depth"]


def test_search_scores_models_of_earlier_months(spark):
    """Each score is the mean error over the folds of models that saw the months before; the winner can be fitted anew."""
    df = vectors(spark).withColumn("time_index", (F.monotonically_increasing_id() % 8).cast("int")).cache()
    space = {"rounds": ("int", 2, 6), "depth": ("int", 1, 4), "rate": ("float", 0.1, 0.5)}
    learner, table = search.tuned(ensemble.boosted, df, space, 3)
    rows = table.orderBy("rank").collect()
    assert rows[0]["setting"]["rounds"] == learner.settings.rounds and rows[0]["setting"]["rate"] == learner.settings.rate
    errors = []
    for train, valid in split.time_folds(df):
        out = learner.fit(train).transform(valid)
        errors.append(evaluate.evaluate(out).first()["rmse"])
    assert rows[0]["rmse"] == pytest.approx(np.mean(errors), rel=0.05)  # bins are cut on all months there


def test_training_frame(frame):
    assert frame.where("holdout").agg(F.count_distinct("month")).first()[0] == 4
    late = frame.where("holdout").agg(F.min("month")).first()[0]
    assert frame.where(~F.col("holdout")).agg(F.max("month")).first()[0] < late
    assert not {"bmi_age_interaction", "cardio_hypertension"} & set(frame.columns)
    assert frame.where("site_of_care = 'in patient'").count() == 0


def test_bundle_beats_the_mean(frame, bundle):
    m = bundle.metrics
    assert m["n"] == frame.where("holdout").count()
    assert m["r2"] > 0.5 and 50 < m["coverage"] <= 100
    assert len(bundle.top_features) == 15
    # The spend ratio is a function of the spend alone here, so either may come first.
    assert {"pharmacy_spend", "drug_spend_ratio"} == {f for f, _ in bundle.top_features[:2]}
    assert "holdout" not in bundle.design.numeric


def test_scoring_a_batch(spark, bundle):
    rows = [("r1", "m1", 30, 100.0, "2027-06"), ("r2", "m2", None, None, None), ("r3", "m3", 70, 9000.0, "2026-08")]
    records = spark.createDataFrame(rows, "record_id string, member_id string, age int, pharmacy_spend double, prediction_month string")
    out = {r["record_id"]: r for r in scoring.score(bundle, records).collect()}
    assert out["r1"]["prediction_period"] == "2027-06" and out["r2"]["prediction_period"] == "2027-01"
    assert out["r1"]["adjusted_cost"] == pytest.approx(out["r1"]["prediction"] * 1.114 * 0.9937)
    assert out["r3"]["prediction"] > out["r1"]["prediction"]
    for r in out.values():
        assert 0 <= r["lower"] and r["upper"] >= r["lower"] * 1.05 - 1e-9


def test_band_without_quantiles(spark):
    df = spark.createDataFrame([(100.0,)], "adjusted_cost double")
    r = scoring.band(df).first()
    assert (r["lower"], r["upper"]) == (85.0, pytest.approx(115.0))
    df = spark.createDataFrame([(100.0, -5.0, 1.0, 2.0), (100.0, 90.0, 91.0, 2.0)], "adjusted_cost double, q10 double, q90 double, k double")
    a, b = scoring.band(df, factor="k").collect()
    assert (a["lower"], a["upper"]) == (0.0, 2.0)
    assert (b["lower"], b["upper"]) == (180.0, pytest.approx(189.0))


def test_log_target(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "prediction double, q10 double")
    assert tuple(scoring.invert_log(df, True).first()) == (0.0, pytest.approx(np.e - 1))
    assert scoring.invert_log(df, False) is df


def test_saved_bundle_predicts_the_same(spark, frame, bundle):
    from carespend.session import shared_path

    path = shared_path(spark, "bundle")
    scoring.save_bundle(bundle, spark, path)
    loaded = scoring.load_bundle(spark, path)
    rows = frame.where("holdout")
    a = scoring.predict(bundle, rows, ["record_id"]).orderBy("record_id").collect()
    b = scoring.predict(loaded, rows, ["record_id"]).orderBy("record_id").collect()
    assert a == b and len(a) > 0
    assert loaded.metrics == bundle.metrics and loaded.design == bundle.design


def test_latest_record_forecast(spark, bundle):
    r = scoring.forecast_latest(bundle, claims(spark)).first()
    assert r["latest_year"] == 2023 and r["predicted_cost"] > 0


def test_served_inputs_are_the_trained_ones(spark, sf):
    """A record scored for a month, with its member's claims until then, has the inputs that training gave the same row."""
    from carespend.queries import raw
    from carespend.sources import fixture, io

    months = io.stage(fixture.member_months(raw(spark, sf)), "member-months")
    frame = scoring.training_frame(months, hot_rows=None)
    first = months.agg(F.min("month").cast("string")).first()[0]
    cap = frame.agg(F.max("monthly_medical_cost")).first()[0]
    bundle = scoring.Bundle(None, None, first_month=first, cap=cap)
    last = months.agg(F.max("month")).first()[0]
    inputs = ["year", "month_num", "quarter", "time_index", "prev_month_cost", "cost_3m_avg", "comorbidity_score", "oon_exposure"]
    trained = frame.where(F.col("month") == F.lit(last)).select("member_id", *inputs).orderBy("member_id").collect()
    records = months.where(F.col("month") == F.lit(last)).withColumn("prediction_month", F.date_format("month", "yyyy-MM")).drop("month", "monthly_medical_cost")
    served = scoring.with_inputs(bundle, records, months.where(F.col("month") < F.lit(last)))
    got = served.select("member_id", *inputs).orderBy("member_id").collect()
    assert len(got) == len(trained) > 0
    for a, b in zip(got, trained, strict=True):
        assert [x if x is None else round(float(x), 6) for x in a] == [x if x is None else round(float(x), 6) for x in b]


def test_model_without_bundle(spark, tmp_path):
    rows = [(float(x), "a" if x % 2 else "b", float(2 * x)) for x in range(40)]
    df = spark.createDataFrame(rows, "x double, gender string, monthly_medical_cost double")
    design = encode.Design.fit(df, ["x"], ["gender"])
    fitted = ensemble.fit(ensemble.forest(trees=3, depth=3), design.transform(df, ["monthly_medical_cost"]))
    path = f"{tmp_path}/model"
    fitted.save(spark, path)
    with pytest.raises(ValueError):
        scoring.load_bundle(spark, path)
    loaded = scoring.load_bundle(spark, path, design)
    got = scoring.predict(loaded, df, ["x"]).select("x", "prediction").orderBy("x").collect()
    want = fitted.transform(design.transform(df, ["x"])).select("x", "prediction").orderBy("x").collect()
    assert [round(r["prediction"], 9) for r in got] == [round(r["prediction"], 9) for r in want]


def test_sparks_own_models_still_serve(spark, tmp_path):
    """A model of Spark ML in a stack, and alone on disk."""
    from pyspark.ml.regression import RandomForestRegressor

    rows = [(f"m{x % 7}", float(x), "a" if x % 2 else "b", float(2 * x)) for x in range(60)]
    df = spark.createDataFrame(rows, "member_id string, x double, gender string, monthly_medical_cost double")
    design = encode.Design.fit(df, ["x"], ["gender"])
    learner = RandomForestRegressor(numTrees=3, maxDepth=3, labelCol=TARGET, seed=1)
    train = design.transform(df, ["member_id", TARGET])
    stack = ensemble.Stacked({"spark": learner, "gb": ensemble.boosted(rounds=3)}).fit(train)
    assert set(stack.meta.weights) == {"p_spark", "p_gb"}
    fitted = ensemble.fit(learner, train)
    fitted.write().save(f"{tmp_path}/model")
    loaded = scoring.load_bundle(spark, f"{tmp_path}/model", design)
    assert scoring.predict(loaded, df, ["x"]).count() == 60
    bundle = scoring.Bundle(design, stack, QuantileForest(params={"trees": 2, "depth": 2, "least": 3}).fit(train))
    scoring.save_bundle(bundle, spark, f"{tmp_path}/bundle")
    again = scoring.load_bundle(spark, f"{tmp_path}/bundle")
    assert sorted(map(tuple, scoring.predict(again, df, ["x"]).collect())) == sorted(map(tuple, scoring.predict(bundle, df, ["x"]).collect()))


def test_sparse_design_is_the_dense_one(spark):
    """The same entries as one column per category, without centring."""
    from pyspark.ml.functions import vector_to_array

    fit = spark.createDataFrame([("b", 1.0, "x"), ("a", 2.0, "x"), (None, 4.0, "x"), ("c", 5.0, "x")], "g string, n double, one string")
    design = encode.SparseDesign.fit(fit, ["n"], ["g", "one"])
    assert design.size == 4 and design.sizes == {"g": 4, "one": 1}
    new = spark.createDataFrame([(1, "a", 3.0), (2, "b", 3.0), (3, "zzz", None), (4, None, 0.0), (5, "c", 1.0)], "k int, g string, n double")
    out = {r["k"]: r["f"] for r in design.transform(new, ["k"]).select("k", vector_to_array("features").alias("f")).collect()}
    dense = encode.OneHotDropFirst.fit(fit, ["g"])
    for r in dense.transform(new).collect():
        assert out[r["k"]][1:] == [r[c] for c in dense.names()]
        assert out[r["k"]][0] == pytest.approx(((r["n"] or 0.0) - design.scaler.mean["n"]) / design.scaler.std["n"])
    absent = design.transform(new.select("k", "n"), ["k"]).select(vector_to_array("features").alias("f")).first()["f"]
    assert absent[1:] == [0.0, 0.0, 0.0]


def test_a_column_of_a_hundred_thousand_categories(spark, monkeypatch):
    df = spark.range(100_000).select("id", F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("g"), F.col("id").cast("double").alias("n"))
    design = encode.SparseDesign.fit(df, ["n"], ["g"])
    assert design.size == 100_000
    for limit in (10**6, 10):
        monkeypatch.setattr(encode, "BROADCAST_VALUES", limit)
        rows = {r["id"]: r["features"] for r in design.transform(df.where("id IN (0, 1, 99999)"), ["id"]).collect()}
        assert rows[0].indices.tolist() == [0] and rows[1].indices.tolist() == [0, 1] and rows[99999].indices.tolist() == [0, 99_999]
        assert rows[1].size == 100_000


def test_boosting_takes_sparse_vectors(spark):
    df = spark.range(400).select(F.col("id").cast("string").substr(-1, 1).alias("g"), F.col("id").cast("double").alias("n"), ((F.col("id") % 10) * 100.0).alias(TARGET))
    design = encode.SparseDesign.fit(df, ["n"], ["g"])
    rows = design.transform(df, [TARGET])
    out = ensemble.binned_boosted(rounds=10, rate=0.5).fit(rows).transform(rows)
    assert evaluate.evaluate(out).first()["r2"] > 0.99


def test_a_fitted_pipeline_is_saved_and_loaded_as_one(spark, frame, tmp_path):
    """Encoder, stack and either band as stages of a PipelineModel."""
    from pyspark.ml import PipelineModel

    from carespend.functions.clean import feature_columns
    from carespend.ml.pipeline import scoring_pipeline

    numeric = feature_columns(frame, drop=("record_id", "member_id", "month", TARGET, "holdout"))
    rows = frame.where("holdout")
    for k, learner in enumerate((QuantileForest(params={"trees": 3, "depth": 3}), QuantileBoosting(settings=Settings(rounds=4, leaves=4, rate=0.3)))):
        stack = ensemble.Stacked({"rf": ensemble.forest(trees=3, depth=3), "gb": ensemble.boosted(rounds=3)}, cv=2)
        fitted = scoring_pipeline(numeric, stack, learner).fit(frame.where(~F.col("holdout")))
        fitted.write().overwrite().save(f"{tmp_path}/{k}")
        loaded = PipelineModel.load(f"{tmp_path}/{k}")
        assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
        scores = ["record_id", "prediction", "q10", "q90"]
        a, b = (sorted(map(tuple, m.transform(rows).select(scores).collect())) for m in (fitted, loaded))
        assert a == b and len(a) == rows.count()
