"""Training frame, fitted bundle, its storage, and batch scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carespend.functions.clean import cap_at, drop_null, feature_columns, fix_categories, impute_defaults
from carespend.functions.features import clinical_features, date_features, monthly_prior, period
from carespend.ml.boosting import Band, Boosted, QuantileBoosting
from carespend.ml.encode import Design, OneHotDropFirst, Scale
from carespend.ml.ensemble import Ridge, Stacked, StackedModel, binned_boosted, boosted, forest
from carespend.ml.evaluate import evaluate, importances
from carespend.ml.quantile import QuantileForest, QuantileForestModel
from carespend.ml.split import is_holdout
from carespend.operators.lookup import latest
from carespend.operators.quantiles import exact_quantiles
from carespend.operators.windows import HOT_ROWS, cost_history
from carespend.plans.forecast import adjust_period
from carespend.session import small_methods
from carespend.sources.io import read_meta, spread, stage, write_meta
from carespend.sources.schema import IDS, TARGET

#: Spark's own models, which a bundle can hold as well.
_KINDS = {"forest": RandomForestRegressionModel, "boosted": GBTRegressionModel}


def training_frame(claims: DataFrame, q: float = 0.995, fit_on: str = "train", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Cleaned claims with every training feature, a time index and a holdout flag.

    The cost cap is fitted on the months before the holdout, or on all rows with
    ``fit_on="all"``. Pass ``hot_rows=None`` where members are known to have a row per month.
    """
    dated = date_features(fix_categories(claims))
    marked = dated.withColumn("holdout", is_holdout(dated))
    cap = exact_quantiles(marked if fit_on == "all" else marked.where(~F.col("holdout")), TARGET, [q])[0]
    capped = cap_at(marked, TARGET, cap)
    order = [c for c in ("month", "record_id") if c in capped.columns]
    return clinical_features(cost_history(capped, order=order, hot_rows=hot_rows))


Quantiles = Band | QuantileForestModel


@dataclass
class Bundle:
    """Everything needed to score new records."""

    design: Design
    model: StackedModel
    quantiles: Quantiles | None = None
    log_target: bool = False
    #: The first month of the training rows, from which months are counted, and their greatest cost.
    first_month: str | None = None
    cap: float | None = None
    metrics: dict = field(default_factory=dict)
    top_features: list = field(default_factory=list)


def default_bases(small: dict | None = None) -> dict[str, object]:
    """The three base learners; ``small`` overrides settings by learner."""
    small = small or {}
    return {
        "rf": forest(**small.get("rf", {})),
        "gb": boosted(**small.get("gb", {})),
        "hist_gb": binned_boosted(**small.get("hist_gb", {})),
    }


def train_bundle(
    frame: DataFrame,
    bases: dict[str, object] | None = None,
    quantiles: QuantileBoosting | QuantileForest | None = None,
    cv: int = 3,
    log_target: bool = False,
    parallelism: int = 4,
) -> Bundle:
    """Fit encoder, scaler, stack and quantiles on the rows before the holdout; measure on the holdout.

    ``quantiles`` is the learner of the band: boosted quantiles unless told otherwise. Rows without a cost or a month take part in neither.
    """
    spark = frame.sparkSession
    numeric = feature_columns(frame, drop=(*IDS, TARGET, "Unnamed: 0", "holdout"))
    # Read once for the encoder, once for the scaler and often for the models.
    source = stage(drop_null(frame, [TARGET]), "training")
    train = source.where(~F.col("holdout"))
    design = Design.fit(train, numeric)
    keep = [c for c in ("member_id", TARGET) if c in frame.columns]
    fit_rows = design.transform(spread(train), keep)
    if log_target:
        fit_rows = fit_rows.withColumn(TARGET, F.log1p(TARGET))
    fit_rows = fit_rows.persist(StorageLevel.MEMORY_AND_DISK)
    with small_methods(spark):
        fit_rows.count()  # kept before both read it
    learners = (Stacked(bases or default_bases(), cv=cv, parallelism=parallelism), quantiles or QuantileBoosting())
    with ThreadPoolExecutor(2) as pool:
        stack, bands = pool.map(lambda learner: learner.fit(fit_rows), learners)
    known = source.agg(F.min("month").cast("string") if "month" in source.columns else F.lit(None), F.max(TARGET)).first()
    bundle = Bundle(design, stack, bands, log_target, known[0], known[1])
    test = design.transform(source.where("holdout"), keep)
    scored = invert_log(bands.transform(stack.transform(test)), log_target)
    row = evaluate(scored, TARGET, "prediction", "q10", "q90").first()
    bundle.metrics = {k: row[k] for k in ("n", "r2", "rmse", "mae", "mape", "coverage")}
    for model in stack.bases.values():
        if isinstance(model, RandomForestRegressionModel) or getattr(model, "share", 1) < 1:
            top = importances(model, design.names, spark).limit(15).collect()
            bundle.top_features = [(r["feature"], r["importance"]) for r in top]
            break
    fit_rows.unpersist()
    return bundle


def invert_log(df: DataFrame, flag: bool, cols: tuple[str, ...] = ("prediction", "q10", "q90")) -> DataFrame:
    """Undo a log1p target in every prediction column."""
    if not flag:
        return df
    return df.withColumns({c: F.expm1(c) for c in cols if c in df.columns})


def band(
    df: DataFrame,
    point: str = "adjusted_cost",
    q_lo: str = "q10",
    q_hi: str = "q90",
    factor: str | None = None,
) -> DataFrame:
    """Add ``lower`` and ``upper``: the scaled quantiles, or 15 % around the point where there is none.

    The lower bound is at least 0 and the upper at least 5 % above the lower.
    """
    scale = F.col(factor) if factor else F.lit(1.0)
    have = df.columns
    low = F.col(point) * 0.85
    if q_lo in have:
        low = F.coalesce(F.greatest(F.lit(0.0), F.col(q_lo) * scale), low)
    out = df.withColumn("lower", low)
    high = F.col(point) * 1.15
    if q_hi in have:
        high = F.when(F.col(q_hi).isNotNull(), F.greatest(F.col("lower") * 1.05, F.col(q_hi) * scale)).otherwise(high)
    return out.withColumn("upper", high)


def serving_features(records: DataFrame) -> DataFrame:
    """Scoring inputs with defaults, canonical categories and the row-wise features."""
    return clinical_features(fix_categories(impute_defaults(records)), serving=True)


def recent_costs(claims: DataFrame, n: int = 3, cap: float | None = None) -> DataFrame:
    """``member_id, prev_month_cost, cost_3m_avg`` as they are for a record after all of a member's claims."""
    order = [F.desc(c) for c in ("month", "record_id") if c in claims.columns]
    value = F.least(F.col(TARGET), F.lit(cap)) if cap is not None else F.col(TARGET)
    last = claims.select("member_id", value.alias("_v"), F.row_number().over(Window.partitionBy("member_id").orderBy(*order)).alias("_r"))
    last = last.where((F.col("_r") <= n) & F.col("member_id").isNotNull())  # ranks beyond n are dropped before the shuffle
    newest = F.max(F.when(F.col("_r") == 1, F.col("_v")))
    return last.groupBy("member_id").agg(newest.alias("prev_month_cost"), F.avg("_v").alias("cost_3m_avg"))


def with_inputs(bundle: Bundle, records: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Every input the model was trained on: row-wise features, the calendar of the asked period, and the member's history.

    History comes from the claims given, else from the records themselves; without either it is
    a twelfth of last year's cost, as for a member's first claim.
    """
    out = serving_features(records)
    have = out.columns
    asked = period("prediction_month" if "prediction_month" in have else F.lit(None), *(F.col(c) if c in have else None for c in ("year", "month")))
    out = out.withColumn("_asked", F.make_date(F.greatest(F.lit(1), F.least(F.lit(9999), asked[0])), F.greatest(F.lit(1), F.least(F.lit(12), asked[1])), F.lit(1)))
    first = F.lit(bundle.first_month).cast("date") if bundle.first_month else F.col("_asked")
    out = date_features(out, "_asked", first).drop("_asked")
    if history is not None:
        known = recent_costs(history, cap=bundle.cap)
        out = out.drop("prev_month_cost", "cost_3m_avg").join(known, "member_id", "left")
    prior = monthly_prior()
    return out.withColumns({c: F.coalesce(F.col(c), prior) if c in out.columns else prior for c in ("prev_month_cost", "cost_3m_avg")})


def predict(bundle: Bundle, rows: DataFrame, keep: list[str]) -> DataFrame:
    """Predictions and quantiles of rows that already have their features."""
    out = bundle.model.transform(bundle.design.transform(rows, keep))
    if bundle.quantiles is not None:
        out = bundle.quantiles.transform(out)
    return invert_log(out.drop("features"), bundle.log_target)


def score(bundle: Bundle, records: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Score a batch of records: base cost, cost in the asked period, and its band.

    ``history`` holds the members' claims until then. ``year`` and ``month`` of the records, if
    any, are kept as they were sent.
    """
    asked = {c: f"_sent_{c}" for c in ("year", "month") if c in records.columns}
    keep = [c for c in ("record_id", "member_id", "prediction_month") if c in records.columns]
    sent = records.withColumns({v: F.col(k) for k, v in asked.items()})
    out = predict(bundle, with_inputs(bundle, sent, history), [*keep, *asked.values()])
    out = out.withColumnsRenamed({v: k for k, v in asked.items()})
    out = adjust_period(out).withColumn("_scale", F.col("trend_multiplier") * F.col("season_factor"))
    return band(out, factor="_scale").drop("_scale")


def forecast_latest(bundle: Bundle, claims: DataFrame) -> DataFrame:
    """The base prediction for the newest record of the table, from its own month and its member's earlier claims."""
    order = [c for c in ("month", "record_id") if c in claims.columns]
    own = claims.join(latest(claims, order).select("member_id"), "member_id", "left_semi") if "member_id" in claims.columns else claims
    if bundle.cap is not None:
        own = cap_at(own, TARGET, bundle.cap)
    newest = latest(cost_history(fix_categories(impute_defaults(own)), order=order, hot_rows=None), order)
    first = F.lit(bundle.first_month).cast("date") if bundle.first_month else None
    rows = clinical_features(date_features(newest, start=first))
    out = predict(bundle, rows, ["month"])
    return out.select(F.year("month").alias("latest_year"), F.col("prediction").alias("predicted_cost"))


def _kind(model) -> str:
    return "trees" if isinstance(model, Boosted) else next(k for k, cls in _KINDS.items() if isinstance(model, cls))


def _save(model, spark: SparkSession, path: str) -> None:
    if isinstance(model, Boosted):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)


def _load(kind: str, spark: SparkSession, path: str):
    return Boosted.load(spark, path) if kind == "trees" else _KINDS[kind].load(path)


def save_stack(model: StackedModel, spark: SparkSession, path: str) -> None:
    for name, base in model.bases.items():
        _save(base, spark, f"{path}/base-{name}")
    known = {"bases": [[n, _kind(m)] for n, m in model.bases.items()], "intercept": model.meta.intercept, "weights": model.meta.weights}
    write_meta(spark, f"{path}/stack", known)


def load_stack(spark: SparkSession, path: str) -> StackedModel:
    known = read_meta(spark, f"{path}/stack")
    bases = {n: _load(kind, spark, f"{path}/base-{n}") for n, kind in known["bases"]}
    return StackedModel(bases, Ridge(known["intercept"], known["weights"]))


def save_quantiles(q: Quantiles, spark: SparkSession, path: str) -> None:
    if isinstance(q, Band):
        for k, model in enumerate(q.models.values()):
            model.save(spark, f"{path}/quantile-{k}")
        write_meta(spark, f"{path}/quantiles", {"boosted": list(q.models)})
        return
    q.forest.save(spark, f"{path}/quantile-forest")
    q.table.write.mode("overwrite").parquet(f"{path}/quantile-leaves")
    write_meta(spark, f"{path}/quantiles", {"qs": list(q.qs), "leaves": q.n_leaves})


def load_quantiles(spark: SparkSession, path: str) -> Quantiles:
    known = read_meta(spark, f"{path}/quantiles")
    if "boosted" in known:
        return Band({q: Boosted.load(spark, f"{path}/quantile-{k}") for k, q in enumerate(known["boosted"])})
    table = spark.read.parquet(f"{path}/quantile-leaves")
    return QuantileForestModel(Boosted.load(spark, f"{path}/quantile-forest"), tuple(known["qs"]), table, known["leaves"])


def save_design(design: Design, spark: SparkSession, path: str) -> None:
    known = {"numeric": design.numeric, "vocabulary": design.encoder.vocabulary, "mean": design.scaler.mean, "std": design.scaler.std, "feature_names": design.names}
    write_meta(spark, f"{path}/design", known)


def load_design(spark: SparkSession, path: str) -> Design:
    known = read_meta(spark, f"{path}/design")
    encoder = OneHotDropFirst(list(known["vocabulary"]), known["vocabulary"])
    return Design(known["numeric"], encoder, Scale(list(known["mean"]), known["mean"], known["std"]))


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """Write models and metadata below ``path``, replacing what is there."""
    save_design(bundle.design, spark, path)
    save_stack(bundle.model, spark, path)
    if bundle.quantiles is not None:
        save_quantiles(bundle.quantiles, spark, path)
    meta = {
        "log_target": bundle.log_target,
        "first_month": bundle.first_month,
        "cap": bundle.cap,
        "metrics": bundle.metrics,
        "top_features": bundle.top_features,
        "quantiles": bundle.quantiles is not None,
    }
    write_meta(spark, f"{path}/meta", meta)


def _bare_model(spark: SparkSession, path: str, design: Design | None) -> Bundle | None:
    """A bundle around a single model, if that is what the path holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "meta")):
        return None
    if design is None:
        raise ValueError("a model without its bundle needs the design of its inputs")
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "ensemble")):
        return Bundle(design, StackedModel({"model": Boosted.load(spark, path)}, Ridge(0.0, {"p_model": 1.0})))
    kind = DefaultParamsReader.loadMetadata(path, spark)["class"].rsplit(".", 1)[-1]
    model = next(cls for cls in _KINDS.values() if cls.__name__ == kind).load(path)
    return Bundle(design, StackedModel({"model": model}, Ridge(0.0, {"p_model": 1.0})))


def load_bundle(spark: SparkSession, path: str, design: Design | None = None) -> Bundle:
    """What ``save_bundle`` wrote, or a single saved model, which has no band and needs a ``design``."""
    bare = _bare_model(spark, path, design)
    if bare is not None:
        return bare
    meta = read_meta(spark, f"{path}/meta")
    return Bundle(
        load_design(spark, path),
        load_stack(spark, path),
        load_quantiles(spark, path) if meta["quantiles"] else None,
        meta["log_target"],
        meta["first_month"],
        meta["cap"],
        meta["metrics"],
        [tuple(t) for t in meta["top_features"]],
    )
