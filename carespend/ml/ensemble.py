"""Base learners, voting and stacking."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carespend.ml.boosting import Boosting, Forest, Settings, fit_learners
from carespend.session import ensure_checkpoint_dir
from carespend.sources.schema import TARGET

SEED = 42


def forest(**params: object) -> Forest:
    """Random forest over all features at each split; 300 trees of depth 13 unless told otherwise."""
    return Forest(**{"seed": SEED, **params})


def boosted(**params: object) -> Boosting:
    """Gradient boosting; 300 rounds of depth 4 unless told otherwise."""
    options = {"rounds": 300, "rate": 0.05, "leaves": None, "depth": 4, "least": 4, "subsample": 0.85, "seed": SEED}
    return Boosting(Settings(**{**options, **params}))


def binned_boosted(**params: object) -> Boosting:
    """Leaf-wise gradient boosting; 300 rounds of up to 31 leaves of 8 rows unless told otherwise."""
    options = {"rounds": 300, "rate": 0.05, "leaves": 31, "depth": None, "least": 8, "seed": SEED}
    return Boosting(Settings(**{**options, **params}))


def fit(estimator, df: DataFrame):
    """Fit a learner; one of Spark's with the rows kept while the fit reads them repeatedly."""
    if hasattr(estimator, "fits") or df.is_cached:
        return estimator.fit(df)
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()


def _predict(model, df: DataFrame, name: str) -> DataFrame:
    return model.copy({model.predictionCol: name}).transform(df)


@dataclass
class Voting:
    """Weighted mean of the predictions of fitted models."""

    models: dict[str, object]
    weights: dict[str, float]

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = df
        for m, model in self.models.items():
            out = _predict(model, out, f"_p_{m}")
        return vote(out, {f"_p_{m}": self.weights[m] for m in self.models}, name).drop(
            *[f"_p_{m}" for m in self.models]
        )


def vote(df: DataFrame, weights: Mapping[str, float], name: str = "prediction") -> DataFrame:
    """Weighted mean of prediction columns."""
    total = None
    for c, w in weights.items():
        total = F.col(c) * w if total is None else total + F.col(c) * w
    return df.withColumn(name, total / sum(weights.values()))


@dataclass
class Ridge:
    intercept: float
    weights: dict[str, float]


def fit_ridge(df: DataFrame, cols: Iterable[str], label: str = TARGET, alpha: float = 1.0) -> Ridge:
    """Ridge regression with an intercept, in closed form.

    Spark adds up the products of the few input columns in one aggregate; only that small
    matrix is solved on the driver.
    """
    cols = list(cols)
    every = [*cols, label]
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(every)],
        *[
            F.covar_pop(every[i], every[j]).alias(f"c{i}_{j}")
            for i in range(len(cols))
            for j in range(i, len(every))
        ],
    ).first()
    n, p = stats["n"], len(cols)
    gram = np.array([[stats[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) * n
    right = np.array([stats[f"c{i}_{p}"] for i in range(p)]) * n
    w = np.linalg.solve(gram + alpha * np.eye(p), right)
    means = np.array([stats[f"m{i}"] for i in range(p)])
    return Ridge(float(stats[f"m{p}"] - means @ w), {c: float(x) for c, x in zip(cols, w)})


def apply_ridge(df: DataFrame, ridge: Ridge, name: str = "prediction") -> DataFrame:
    total = F.lit(ridge.intercept)
    for c, w in ridge.weights.items():
        total = total + F.col(c) * w
    return df.withColumn(name, total)


@dataclass(frozen=True)
class FixedLinear:
    """A linear model with given weights, for scoring by a formula that is known."""

    weights: tuple[float, ...]
    intercept: float = 0.0
    features: str = "features"
    predictionCol: str = "prediction"

    def copy(self, names: Mapping[str, str]) -> FixedLinear:
        return replace(self, predictionCol=names.get(self.predictionCol, self.predictionCol))

    def transform(self, df: DataFrame) -> DataFrame:
        values, total = vector_to_array(self.features), F.lit(self.intercept)
        for k, w in enumerate(self.weights):
            total = total + values[k] * w
        return df.withColumn(self.predictionCol, total)


@dataclass
class StackedModel:
    bases: dict[str, object]
    meta: Ridge

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = df
        for m, model in self.bases.items():
            out = _predict(model, out, f"p_{m}")
        return apply_ridge(out, self.meta, name).drop(*[f"p_{m}" for m in self.bases])


@dataclass
class Stacked:
    """Base learners whose out-of-fold predictions feed a ridge; the bases are then refitted on all rows.

    Folds are cut by a hash of ``fold_by``, so the rows of one member stay together.
    """

    bases: dict[str, object]
    alpha: float = 1.0
    cv: int = 3
    fold_by: tuple[str, ...] = ("member_id",)
    label: str = TARGET
    parallelism: int = 4

    def with_folds(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_fold", F.pmod(F.xxhash64(*self.fold_by), F.lit(self.cv)).cast("int"))

    def fit_folds(self, df: DataFrame, folds: list[int | None], pool: ThreadPoolExecutor) -> dict[tuple[str, int | None], object]:
        """Each base learner fitted without each of the folds (None: on all rows). The library's own learners are grown together."""
        own = [(m, est, fold) for m, est in self.bases.items() if hasattr(est, "fits") for fold in folds]
        rest = [(m, est, fold) for m, est in self.bases.items() if not hasattr(est, "fits") for fold in folds]
        fitted = fit_learners(df, [(est, fold, None) for _, est, fold in own], self.label, part="_fold") if own else []
        found = {(m, fold): model for (m, _, fold), model in zip(own, fitted, strict=True)}
        others = pool.map(lambda t: t[1].fit(df if t[2] is None else df.where(F.col("_fold") != t[2])), rest)
        return found | {(m, fold): model for (m, _, fold), model in zip(rest, others, strict=True)}

    def predicted(self, df: DataFrame, models: Mapping[tuple[str, int | None], object]) -> DataFrame:
        """Each row once, predicted by base learners that did not see its fold."""
        parts = None
        for fold in range(self.cv):
            part = df.where(F.col("_fold") == fold)
            for m in self.bases:
                part = _predict(models[m, fold], part, f"p_{m}")
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def out_of_fold(self, df: DataFrame, pool: ThreadPoolExecutor) -> DataFrame:
        return self.predicted(df, self.fit_folds(df, list(range(self.cv)), pool))

    def fit(self, df: DataFrame) -> StackedModel:
        ensure_checkpoint_dir(df.sparkSession)
        folded = self.with_folds(df)
        if not df.is_cached:
            folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            with ThreadPoolExecutor(self.parallelism) as pool:
                models = self.fit_folds(folded, [*range(self.cv), None], pool)
            meta = fit_ridge(self.predicted(folded, models), [f"p_{m}" for m in self.bases], self.label, self.alpha)
        finally:
            folded.unpersist()
        return StackedModel({m: models[m, None] for m in self.bases}, meta)
