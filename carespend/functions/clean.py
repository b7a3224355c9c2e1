"""Parsing, filling, imputing and canonicalising columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.sources.schema import CATEGORICAL, CATEGORY_FIXES, IDS, INDEX_COLUMN, RECORD_DEFAULTS, TARGET


def parse_dates(df: DataFrame, cols: Iterable[str], strict: bool = False, fmt: str | None = None) -> DataFrame:
    """Text to dates, ISO or of one pattern ``fmt``. What does not parse becomes null, or fails the query when ``strict``."""

    def parsed(c: str) -> Column:
        date = F.col(c).try_cast("date") if fmt is None else F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)).cast("date")
        if not strict:
            return date
        bad = F.raise_error(F.concat(F.lit(f"not a date in {c}: "), F.col(c).cast("string")))
        return F.when(F.col(c).isNotNull() & date.isNull(), bad).otherwise(date)

    return df.withColumns({c: parsed(c) for c in cols})


#: Ways to write a date, tried in this order where several fit equally well.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy/M/d",
    "d/M/yyyy",
    "M/d/yyyy",
    "d-M-yyyy",
    "M-d-yyyy",
    "d.M.yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "yyyyMMdd",
    "yyyy-M",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
)


def date_shape(text: Column) -> Column:
    """What a text looks like: numbers of one or two digits as 9, other digits as 9 each, runs of letters as a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), "[0-9]", "9"), "[A-Za-z]+", "a"), r"\b99\b", "9")


def date_shapes(df: DataFrame, col: str, formats: Iterable[str] = DATE_FORMATS) -> DataFrame:
    """How the texts of a column write dates: ``shape, rows, format, parsed, ambiguous``.

    One aggregate counts, for each shape, the rows that each format parses. The one that
    parses most is the shape's; so a day above 12 settles the order of day and month for
    all texts of its shape. Where another format parses as many rows, but into other dates,
    the shape is ``ambiguous`` and the first of them is taken. Shapes that no format parses
    have none.
    """
    formats = list(formats)
    text = F.trim(F.col(col).cast("string"))
    rows = df.select(text.alias("text"), date_shape(text).alias("shape")).where("text IS NOT NULL AND text <> ''")
    rows = rows.groupBy("shape", "text").agg(F.count(F.lit(1)).alias("n"))  # texts repeat, so each is parsed once per task
    dates = [F.try_to_timestamp("text", F.lit(f)).cast("date") for f in formats]
    counts = rows.groupBy("shape").agg(
        F.sum("n").alias("rows"),
        F.array(*[F.sum(F.when(d.isNotNull(), F.col("n")).otherwise(0)) for d in dates]).alias("parsed"),
        # rows on which the formats i < j differ
        F.array(*[F.sum(F.when(~dates[i].eqNullSafe(dates[j]), F.col("n")).otherwise(0)) for i in range(len(formats)) for j in range(i + 1, len(formats))]).alias("apart"),
    )
    most = F.array_max("parsed")
    best = (F.array_position("parsed", most) - 1).cast("int")
    number = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(len(formats)) for j in range(i + 1, len(formats)))}
    other = F.lit(False)
    for (i, j), k in number.items():
        other = other | ((F.col("best") == i) & (F.col("parsed")[j] == F.col("most")) & (F.col("apart")[k] > 0))
    found = counts.withColumns({"most": most, "best": best})
    named = F.element_at(F.array(*[F.lit(f) for f in formats]), F.col("best") + 1)
    return found.select("shape", "rows", F.when(F.col("most") > 0, named).alias("format"), F.col("most").alias("parsed"), (F.when(F.col("most") > 0, other).otherwise(F.lit(False))).alias("ambiguous"))


def parse_mixed_dates(df: DataFrame, col: str, formats: Iterable[str] = DATE_FORMATS, shapes: DataFrame | None = None) -> DataFrame:
    """Text to dates where a column mixes ways of writing them; each shape is read by the format ``date_shapes`` gives it.

    Adds ``<col>_ambiguous``: whether the order of day and month could not be settled. What
    does not parse becomes null. Pass ``shapes`` to read new rows as others were read.
    """
    formats = list(formats)
    known = (shapes if shapes is not None else date_shapes(df, col, formats)).where("format IS NOT NULL")
    known = known.select(F.col("shape").alias("_shape"), F.col("format").alias("_format"), F.col("ambiguous").alias("_ambiguous"))
    text = F.trim(F.col(col).cast("string"))
    # Shapes with a format are few, as formats fix all but the lengths of numbers; junk has none.
    out = df.withColumn("_own", date_shape(text)).join(known, F.col("_own") == F.col("_shape"), "left")
    date = F.coalesce(*[F.when(F.col("_format") == f, F.try_to_timestamp(text, F.lit(f)).cast("date")) for f in formats])
    flag = F.coalesce("_ambiguous", F.lit(False)) & date.isNotNull()
    return out.withColumns({f"{col}_ambiguous": flag, col: date}).drop("_own", "_shape", "_format", "_ambiguous")


def parse_numbers(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text to doubles; what does not parse becomes null."""
    return df.withColumns({c: number(c) for c in cols})


def number(c: str | Column) -> Column:
    """A double from any column; unparsable text and NaN count as null."""
    value = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(value), value)


def drop_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls by a constant or by another column's value; add the column if it is absent."""
    present = set(df.columns)
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v))
            if c in present
            else (v if isinstance(v, Column) else F.lit(v))
            for c, v in values.items()
        }
    )


def impute_defaults(df: DataFrame, defaults: Mapping[str, object] = RECORD_DEFAULTS) -> DataFrame:
    """Give every scoring input a value: the default where the column is absent or null."""
    return fill(df, defaults)


def conform(df: DataFrame, columns: Iterable[str], fill_value: float = 0.0, keep: Iterable[str] = ()) -> DataFrame:
    """Select ``columns`` as doubles in the given order, after ``keep``; absent or null is ``fill_value``."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[
            F.coalesce(number(c), F.lit(fill_value)).alias(c) if c in present else F.lit(fill_value).alias(c)
            for c in columns
        ],
    )


def fix_categories(df: DataFrame, fixes: Mapping[str, Mapping[str, str]] = CATEGORY_FIXES) -> DataFrame:
    """Map known misspellings, compared exactly, to the canonical label."""
    out = {}
    for c, mapping in fixes.items():
        if c not in df.columns:
            continue
        fixed = F.col(c)
        for wrong, right in mapping.items():
            fixed = F.when(F.col(c) == wrong, right).otherwise(fixed)
        out[c] = fixed
    return df.withColumns(out)


def cap_at(df: DataFrame, col: str, cap: float | Column | None) -> DataFrame:
    """Lower values above ``cap`` to it; nulls stay null."""
    if cap is None:
        return df
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    return df.withColumn(col, F.when(F.col(col) > limit, limit).otherwise(F.col(col)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(
    df: DataFrame,
    drop: Iterable[str] = (*IDS, TARGET, INDEX_COLUMN),
    categorical: Iterable[str] = CATEGORICAL,
) -> list[str]:
    """The model's numeric inputs: every column that is neither dropped nor categorical."""
    skip = {*drop, *categorical}
    return [c for c in df.columns if c not in skip]


def inpatient_cost(cost: str = TARGET, site: str = "site_of_care") -> Column:
    """The cost of inpatient rows, zero for the others."""
    return F.when(F.col(site) == "Inpatient", F.col(cost)).otherwise(0.0)


def generic_offset(threshold: float = 0.70, share: float = 0.10) -> Column:
    """A tenth of the drug cost where the generic rate is above ``threshold``.

    The threshold is in the unit of ``generic_rate``; pass 70 where the rate is a percentage.
    """
    return F.when(F.col("generic_rate") > threshold, F.col("drug_cost") * share).otherwise(0.0)


def label(c: str | Column, unknown: str = "Unknown") -> Column:
    """A group label for display."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(unknown))
