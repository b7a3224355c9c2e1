"""One-hot encoding, scaling and the design matrix."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carespend.functions.clean import number
from carespend.operators.order import positions
from carespend.session import small_methods
from carespend.sources.io import stage
from carespend.sources.schema import CATEGORICAL

#: Columns that a frame can be given for categories; more of them go into sparse vectors (``SparseDesign``).
MAX_CATEGORIES = 10_000
#: Rows of a vocabulary up to which it is broadcast.
BROADCAST_VALUES = 500_000


@dataclass
class OneHotDropFirst:
    """0/1 columns per category seen in fitting, without the alphabetically first.

    Null is a category of its own, sorted last; a value not seen in fitting gets zeros.
    """

    cols: list[str]
    vocabulary: dict[str, list[str | None]]

    @classmethod
    def fit(cls, df: DataFrame, cols: Iterable[str] = tuple(CATEGORICAL)) -> OneHotDropFirst:
        cols = list(cols)
        pairs = (
            df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])))
            .distinct()
            .limit(MAX_CATEGORIES + 1)
            .collect()
        )
        if len(pairs) > MAX_CATEGORIES:
            raise ValueError(f"more than {MAX_CATEGORIES} categories are too many columns: use SparseDesign, which holds any number")
        seen: dict[str, list[str | None]] = {c: [] for c in cols}
        for c, v in pairs:
            seen[c].append(v)
        return cls(cols, {c: sorted(vs, key=lambda v: (v is None, v or "")) for c, vs in seen.items()})

    def names(self) -> list[str]:
        return [f"{c}_{'nan' if v is None else v}" for c in self.cols for v in self.vocabulary[c][1:]]

    def columns(self, available: Iterable[str]) -> dict[str, Column]:
        have = set(available)
        out = {}
        for c in self.cols:
            for v in self.vocabulary[c][1:]:
                name = f"{c}_{'nan' if v is None else v}"
                if c not in have:
                    out[name] = F.lit(0.0)
                elif v is None:
                    out[name] = F.col(c).isNull().cast("double")
                else:
                    out[name] = F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[x.alias(n) for n, x in self.columns(df.columns).items()])


@dataclass
class Scale:
    """Subtract the mean and divide by the population deviation; constant columns are only centred."""

    cols: list[str]
    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, cols: Iterable[str]) -> Scale:
        cols = list(cols)
        stats = df.agg(
            *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        mean = {c: float(stats[f"m{i}"] or 0.0) for i, c in enumerate(cols)}
        std = {c: float(stats[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(cols)}
        return cls(cols, mean, std)

    def scaled(self, c: str) -> Column:
        return (F.col(f"`{c}`") - self.mean[c]) / self.std[c]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.cols})


@dataclass
class Design:
    """From cleaned rows to a scaled feature vector: numeric inputs, then encoded categories."""

    numeric: list[str]
    encoder: OneHotDropFirst
    scaler: Scale

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.encoder.names()]

    @staticmethod
    def _plain(df: DataFrame, numeric: list[str], encoder: OneHotDropFirst, keep: Iterable[str]) -> DataFrame:
        have = set(df.columns)
        values = [
            F.coalesce(number(c), F.lit(0.0)).alias(f"x_{c}") if c in have else F.lit(0.0).alias(f"x_{c}")
            for c in numeric
        ]
        codes = [x.alias(f"x_{n}") for n, x in encoder.columns(have).items()]
        return df.select(*keep, *values, *codes)

    @classmethod
    def fit(cls, train: DataFrame, numeric: Iterable[str], categorical: Iterable[str] = tuple(CATEGORICAL)) -> Design:
        numeric = list(numeric)
        with small_methods(train.sparkSession):
            encoder = OneHotDropFirst.fit(train, categorical)
            plain = cls._plain(train, numeric, encoder, ())
            return cls(numeric, encoder, Scale.fit(plain, plain.columns))

    def transform(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        keep = list(keep)
        scaled = self.scaler.transform(self._plain(df, self.numeric, self.encoder, keep))
        inputs = [f"x_{n}" for n in self.names]
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(scaled).select(*keep, "features")


@dataclass
class SparseDesign:
    """Scaled numeric inputs and 0/1 categories of any number, as sparse vectors.

    ``vocabulary`` is a table: ``column, value, place``, the categories of a column in
    alphabetical order from 0, null last. The first one and values not seen in fitting have
    no entry. Categories are not centred, as that would fill the vectors.
    """

    numeric: list[str]
    categorical: list[str]
    scaler: Scale
    vocabulary: DataFrame
    sizes: dict[str, int]

    @classmethod
    def fit(cls, train: DataFrame, numeric: Iterable[str], categorical: Iterable[str] = tuple(CATEGORICAL)) -> SparseDesign:
        numeric, categorical = list(numeric), list(categorical)
        plain = train.select([F.coalesce(number(c), F.lit(0.0)).alias(c) for c in numeric])
        entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categorical])
        seen = train.select(F.inline(entries)).distinct().withColumn("_last", F.col("value").isNull())
        placed = stage(positions(seen, ["column", "_last", "value"], "position"), "vocabulary")
        bounds = {r["column"]: (r["a"], r["n"]) for r in placed.groupBy("column").agg(F.min("position").alias("a"), F.count(F.lit(1)).alias("n")).collect()}
        first = F.create_map(*[x for c, (a, _) in bounds.items() for x in (F.lit(c), F.lit(a))]) if bounds else None
        place = F.col("position") - first[F.col("column")] if bounds else F.col("position")
        table = stage(placed.select("column", "value", place.cast("int").alias("place")), "vocabulary")
        return cls(numeric, categorical, Scale.fit(plain, numeric), table, {c: bounds[c][1] if c in bounds else 0 for c in categorical})

    @property
    def size(self) -> int:
        return len(self.numeric) + sum(max(0, n - 1) for n in self.sizes.values())

    def places(self, df: DataFrame) -> DataFrame:
        """Add ``_place_<column>``: the category's number, or that of the first one where there is none."""
        out = df
        for c in self.categorical:
            own = self.vocabulary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("place").alias(f"_place_{c}"))
            own = F.broadcast(own) if self.sizes[c] <= BROADCAST_VALUES else own
            value = F.col(c).cast("string") if c in df.columns else F.lit("")
            out = out.join(own, value.eqNullSafe(F.col("_value")), "left").drop("_value") if c in df.columns else out.withColumn(f"_place_{c}", F.lit(0))
        return out.withColumns({f"_place_{c}": F.coalesce(f"_place_{c}", F.lit(0)) for c in self.categorical})

    def transform(self, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
        """The kept columns and ``features``: numeric inputs first, then the categories of each column but its first."""
        keep, have = list(keep), set(df.columns)
        numbers = [(F.coalesce(number(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(f"x_{c}") for c in self.numeric]
        used = [c for c in self.categorical if self.sizes[c] > 1]
        # Spark's encoder leaves out the last number of a column, so the first category takes that.
        turned = [F.when(F.col(f"_place_{c}") == 0, self.sizes[c] - 1).otherwise(F.col(f"_place_{c}") - 1).cast("double").alias(f"i_{c}") for c in used]
        rows = self.places(df).select(*keep, *numbers, *turned)
        rows = rows.withColumns({f"x_{c}": (F.col(f"`x_{c}`") - self.scaler.mean[c]) / self.scaler.std[c] for c in self.numeric})
        if used:
            known = rows.sparkSession.createDataFrame([tuple(float(self.sizes[c] - 1) for c in used)], ", ".join(f"`i_{c}` double" for c in used))
            encoder = OneHotEncoder(inputCols=[f"i_{c}" for c in used], outputCols=[f"v_{c}" for c in used], dropLast=True).fit(known)
            rows = encoder.transform(rows)
        inputs = [f"x_{c}" for c in self.numeric] + [f"v_{c}" for c in used]
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select(*keep, "features")
