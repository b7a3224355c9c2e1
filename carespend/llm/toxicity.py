"""Toxicity from class-conditional Kneser-Ney models of letters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.llm.joins import sized
from carespend.llm.text import ALNUM_WORD, LOWER, column_bytes, slices
from carespend.sources.io import stage

#: Bytes of a gram: seven of context and the one that follows. A gram never reaches back beyond the start of its word.
ORDER = 8
DISCOUNT = 0.75
#: Likelihood ratio by which a gram must set the classes apart; below it both use the shared model.
EVIDENCE = 24.0
#: Fold of the labelled rows that fits the calibration; the others fit the grams meanwhile.
CALIBRATED, FOLDS = 1, 5
#: Grams that are broadcast at most, 16 bytes each; a larger model is joined by shuffling.
MODEL_ROWS = 2_000_000
#: Steps of the normalised log-likelihood ratio that calibration tells apart, and its range.
STEPS, RANGE = 2000, 1.0

_MASKS = np.array([(1 << (8 * (k + 1))) - 1 for k in range(ORDER)], np.uint64)


@dataclass
class Model:
    grams: DataFrame
    slope: float
    bias: float


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % FOLDS


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and gram of each letter of a word and of the end of each word.

    A gram packs up to ``ORDER`` bytes, from the blank before the word at the earliest.
    """
    low = LOWER[data]
    low[~ALNUM_WORD[low]] = 32
    seq = np.insert(low, np.repeat(offsets[:-1], 2), 32)  # a blank before and after each text
    rows = np.arange(len(offsets) - 1)
    text = np.insert(np.repeat(rows, np.diff(offsets)), np.repeat(offsets[:-1], 2), np.repeat(rows, 2))
    seq, text = np.append(seq, np.uint8(32)), np.append(text, len(offsets) - 2)
    blank = seq == 32
    kept = np.ones(len(seq), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    seq, text, blank = seq[kept], text[kept], blank[kept]
    at = np.arange(len(seq))
    last = np.maximum.accumulate(np.where(blank, at, 0))
    age = at - np.concatenate([[0], last[:-1]])
    packed = seq.astype(np.uint64)
    for width in (1, 2, 4):
        packed[width:] |= packed[:-width] << np.uint64(8 * width)
    packed &= _MASKS[np.minimum(age, ORDER - 1)]
    text[1:] = np.where(blank[1:], text[:-1], text[1:])  # the end of a word belongs to the word's text
    return text[1:], packed[1:]


def gram_counts(rows: DataFrame) -> DataFrame:
    """``gram, toxic, ordinary, toxic_fit, ordinary_fit`` over rows ``text, toxic, fit``."""
    names = ["gram", "toxic", "ordinary", "toxic_fit", "ordinary_fit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            toxic, fit = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            for a, b in slices(offsets):
                text, grams = text_grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                distinct, number = np.unique(grams, return_inverse=True)
                kind = (2 * toxic + fit)[a:b][text]
                table = np.bincount(4 * number + kind, minlength=4 * len(distinct)).reshape(-1, 4)
                columns = [distinct.view(np.int64), table[:, 2] + table[:, 3], table[:, 0] + table[:, 1], table[:, 3], table[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    counted = rows.select("text", "toxic", "fit").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _size(gram: str = "gram") -> Column:
    return F.ceil(F.length(F.hex(gram)) / 2).cast("int")


def _shorter(gram: str = "gram") -> Column:
    """The gram without its first byte."""
    return F.col(gram).bitwiseAND(F.expr(f"shiftleft(1L, 8 * (cast(ceil(length(hex({gram})) / 2) AS int) - 1)) - 1"))


def _context(gram: str = "gram") -> Column:
    return F.shiftrightunsigned(gram, 8)


def shared_backoff(grams: DataFrame) -> DataFrame:
    """``gram, shared``: the chance of each gram's last byte after its context less one byte, for both classes alike.

    Interpolated Kneser-Ney: every order counts the different bytes that come before a gram,
    and hands what it discounts to the next shorter one.
    """
    levels = [grams.select("gram")]
    for _ in range(ORDER - 1):
        longer = levels[-1].where(_size() > 1)
        levels.append(stage(longer.groupBy(_shorter().alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("n")), "continuations"))
    below = None
    for level in reversed(levels[1:]):
        totals = level.groupBy(_context().alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rated = level.withColumn("context", _context()).join(totals, "context")
        if below is None:
            rated = rated.withColumn("lower", F.lit(None).cast("double"))
        else:
            rated = rated.withColumn("rest", _shorter()).join(below.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest", "left")
        smoothed = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("lower")
        below = stage(rated.select("gram", F.when(_size() > 1, F.coalesce(smoothed, F.col("n") / F.col("total"))).otherwise(F.col("n") / F.col("total")).alias("p")), "backoff")
    shorter = grams.select("gram", _shorter().alias("rest"))
    return shorter.join(below.select(F.col("gram").alias("rest"), F.col("p").alias("shared")), "rest").select("gram", "shared")


def contrasts(counts: DataFrame, shared: DataFrame, toxic: str, ordinary: str, evidence: float) -> DataFrame:
    """``gram, llr``: log of toxic over ordinary chance, for grams whose counts set the classes apart."""
    seen = counts.select("gram", F.col(toxic).cast("double").alias("t"), F.col(ordinary).cast("double").alias("o"), _context().alias("context"))
    kinds = lambda c: F.count(F.when(F.col(c) > 0, 1)).cast("double")
    totals = seen.groupBy("context").agg(F.sum("t").alias("st"), F.sum("o").alias("so"), kinds("t").alias("kt"), kinds("o").alias("ko"))
    full = seen.where("t + o > 0").join(totals, "context").join(shared, "gram")
    chance = lambda n, s, k: F.when(F.col(s) == 0, F.col("shared")).otherwise(
        F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / F.col(s) + DISCOUNT * F.col(k) / F.col(s) * F.col("shared")
    )
    term = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    t, o, st, so = (F.col(c) for c in ("t", "o", "st", "so"))
    ratio = 2 * (
        term(t) + term(st - t) + term(o) + term(so - o) - term(st) - term(so) - term(t + o) - term(st + so - t - o) + term(st + so)
    )
    return full.where(ratio > evidence).select("gram", (F.log(chance("t", "st", "kt")) - F.log(chance("o", "so", "ko"))).alias("llr"))


def ratios(docs: DataFrame, grams: DataFrame, keep: list[str]) -> DataFrame:
    """``ratio``: the log-likelihood ratio of each text by its number of letters, besides the columns to ``keep``."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ratio", T.DoubleType())])
    if grams.count() > MODEL_ROWS:
        return _joined_ratios(docs, grams, keep)
    table = grams.toPandas()
    order = np.argsort(table["gram"].to_numpy(np.int64).view(np.uint64))
    model = docs.sparkSession.sparkContext.broadcast(
        (table["gram"].to_numpy(np.int64).view(np.uint64)[order], table["llr"].to_numpy(np.float64)[order])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = model.value
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            out = np.zeros(len(batch))
            for a, b in slices(offsets):
                text, grams = text_grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    hit = np.flatnonzero(known[at] == grams)
                    total = np.bincount(text[hit], weights=values[at[hit]], minlength=b - a)
                    out[a:b] = total / np.maximum(1, np.bincount(text, minlength=b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*keep, "ratio"])

    return docs.select("text", *keep).mapInArrow(run, schema)


def _joined_ratios(docs: DataFrame, grams: DataFrame, keep: list[str]) -> DataFrame:
    """The same for a model of any size: each text's grams meet the model in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for a, b in slices(offsets):
                text, grams = text_grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.bincount(text, minlength=b - a)
                order = np.lexsort((grams, text))
                text, grams = text[order], grams[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(text)))
                rows = np.concatenate([np.arange(b - a), text[first]])  # and a row for texts without grams
                columns = [np.concatenate([np.zeros(b - a, np.uint64), grams[first]]).view(np.int64), np.concatenate([np.zeros(b - a, np.int64), n]), size[rows]]
                held = pa.array(a + rows)
                yield pa.RecordBatch.from_arrays([*(c.take(held) for c in batch.columns[1:]), *map(pa.array, columns)], [*keep, "row", "gram", "n", "size"])

    keyed = docs.select("text", *keep, F.xxhash64("text").alias("row"))
    fields = [T.StructField(c, T.LongType()) for c in ("row", "gram", "n", "size")]
    each = keyed.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + fields))
    total = F.sum(F.coalesce(F.col("llr") * F.col("n"), F.lit(0.0)))
    summed = each.join(grams, "gram", "left").groupBy(*keep, "row", "size").agg(total.alias("_sum"), F.count(F.when(F.col("gram") == 0, 1)).alias("_rows"))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("_rows").cast("int")))
    once = F.greatest(F.col("_rows"), F.lit(1)) * F.greatest(F.col("size"), F.lit(1))
    return summed.select(*keep, (F.col("_sum") / once).alias("ratio"), repeated).drop("col")


def calibrate(rows: DataFrame) -> tuple[float, float]:
    """Slope and bias of a logistic curve over rows ``ratio, toxic``, from counts in a fixed number of steps.

    Without rows of both classes the slope is 0 and no text is toxic.
    """
    step = F.round(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("ratio"))) * STEPS).cast("int")
    table = rows.groupBy(step.alias("step"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.array([r["step"] / STEPS for r in table])
    y = np.array([float(r["toxic"]) for r in table])
    n = np.array([float(r["n"]) for r in table])
    if len(set(y.tolist())) < 2:
        return 0.0, -20.0
    scale = max(1e-6, float(np.sqrt(np.average(x**2, weights=n))))
    design, weights = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(100):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (n * (y - p)) - 1e-2 * weights
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step_by = np.linalg.solve(curve, slope)
        weights += np.clip(step_by, -2, 2)
        if np.abs(step_by).max() < 1e-8:
            break
    return float(weights[0] / scale), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", evidence: float = EVIDENCE) -> Model:
    """Models of toxic and ordinary texts from all labelled rows, and how to turn their ratio into a score.

    Both classes have counts of their own for full grams, and share all shorter ones. The curve
    is fitted on a fold whose grams the model did not see; the final model counts all folds.
    Labels other than 0 and 1 are ignored; a document labelled twice is toxic if once.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    marked = sized(marked, "labels")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = own.join(marked, "id").select("text", F.col("toxic").cast("int").alias("toxic"), (fold(F.col("id")) != CALIBRATED).alias("fit"))
    counts = stage(gram_counts(rows), "gram-counts")
    shared = stage(shared_backoff(counts), "shared-chances")
    trial = stage(contrasts(counts, shared, "toxic_fit", "ordinary_fit", evidence), "trial-grams")
    slope, bias = calibrate(ratios(rows.where("NOT fit"), trial, ["toxic"]))
    return Model(stage(contrasts(counts, shared, "toxic", "ordinary", evidence), "grams"), slope, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ratio, score, predicted`` for each row of ``docs``.

    ``ratio`` is the log-likelihood ratio by letters; ``score`` runs from 0 to 1 and
    ``predicted`` is 1 from 0.5 on. Null, empty and wordless texts have a ratio of 0. Rows that
    repeat an id are scored each. No rows give no rows; other columns are ignored, whatever
    their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rated = ratios(own, model.grams, ["doc_id"])
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("ratio") + F.lit(model.bias))))
    return rated.select("doc_id", "ratio", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
