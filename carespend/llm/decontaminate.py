"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carespend.llm.joins import sized
from carespend.sources.io import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What lies between words, upper-case letters being words as well.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a shared span that is always found.
WINDOW = 10
#: Words of the hashed grams; a span of ``WINDOW`` words holds ``WINDOW - GRAM + 1`` of them.
GRAM = 6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), "")


def _neighbours(df: DataFrame, left: str, right: str, shift: int, out: str, join) -> DataFrame:
    """``out``: each element of an array joined with the one ``shift`` places on in another, as far as both go."""
    size = F.greatest(F.lit(0), F.least(F.size(left), F.size(right) - shift))
    return df.withColumn(out, F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(shift + 1), size), join))


def _spanning(df: DataFrame, source: str, n: int, out: str, join, overlap: bool) -> DataFrame:
    """``out``: for each place of an array the join of the ``n`` elements from there, by doubling."""
    df, width, have = df.withColumn(out, F.col(source)), 1, {1: source}
    while 2 * width <= n:
        df = _neighbours(df, have[width], have[width], width, f"_{out}{2 * width}", join)
        width *= 2
        have[width] = f"_{out}{width}"
    if overlap and width < n:  # a minimum may count elements twice
        df = _neighbours(df, have[width], have[width], n - width, out, join)
    else:
        covered, last = width, have[width]
        for size in sorted(have, reverse=True):
            if covered + size <= n:
                df = _neighbours(df, last, have[size], covered, f"_{out}_{covered + size}", join)
                covered += size
                last = f"_{out}_{covered}"
        df = df.withColumn(out, F.col(last))
    return df


def fingerprints(df: DataFrame, length: int, out: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``out``: for each window of ``length`` words of ``_words`` the least hash of its grams.

    Neighbouring windows mostly share their least gram, which is the winnowing: distinct values
    are few, and equal windows have equal values wherever they occur. The hashes ignore case.
    """
    k = gram if length == window else length
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(F.lower(w))))
    df = _spanning(df, "_hashes", k, "grams", lambda a, b: F.xxhash64(a, b), overlap=False)
    return _spanning(df, "grams", length - k + 1, out, lambda a, b: F.least(a, b), overlap=True)


def item_windows(items: DataFrame, item_id: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``length, print, content, items``: the distinct windows of the benchmark and the items that hold each."""
    df = items.select(F.col(item_id).alias("item_id"), words(F.translate(text_col, UPPER, UPPER.lower())).alias("_words"))
    df = stage(df.where(F.size("_words") > 0).withColumn("length", F.least(F.size("_words"), F.lit(window))), "items")
    lengths = [r["length"] for r in df.select("length").distinct().collect()]  # at most ``window`` values
    found = [windows(df.where(F.col("length") == n), ["item_id"], n, window, gram) for n in lengths or [window]]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("length", "print", "content").agg(F.collect_set("item_id").alias("items"))


def windows(df: DataFrame, keys: list[str], length: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A row per window of ``length`` words: the keys, ``at, length, print, content``."""
    df = fingerprints(df, length, "_prints", window, gram)
    df = _spanning(df, "_words", length, "contents", lambda a, b: F.concat_ws(" ", a, b), overlap=False)
    pairs = F.zip_with("_prints", "contents", lambda p, c: F.struct(p.alias("print"), c.alias("content")))
    # outer, as a filter on the number of windows would be pushed down and compute them twice
    df = df.select(*keys, F.posexplode_outer(pairs).alias("at", "w")).where("at IS NOT NULL")
    return df.select(*keys, "at", F.lit(length).alias("length"), "w.print", "w.content")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """How much of each text lies inside passages of ``window`` words that a benchmark item holds too.

    Returns a row per distinct pair of id and text: ``doc_id, row, n_words, n_hit, items,
    contaminated``; ``row`` is a hash of the text, ``n_hit`` counts words inside any window of
    an item, ``items`` lists the items whose windows occur. An item of fewer words is one window.

    Fingerprints of all texts are joined with those of the benchmark. Only texts that share
    one are read again: there every window is compared word by word, so hits extend as far as
    the shared span does and chance matches drop out.

    Null texts and items have no words and match nothing. No benchmark leaves every text clean;
    no rows give no rows; other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    bench = stage(item_windows(items, item_id, item_text, window, gram), "benchmark-windows")
    lengths = sorted(r["length"] for r in bench.select("length").distinct().collect())
    prints = sized(bench.select("print").distinct(), "benchmark-prints")

    first = own.select("doc_id", "row", words(F.col("text")).alias("_words"))
    first = first.withColumn("n_words", F.size("_words").cast("long"))
    for n in lengths:
        first = fingerprints(first, n, f"_of{n}", window, gram)
    every = F.array_distinct(F.concat(*(F.col(f"_of{n}") for n in lengths))) if lengths else F.array().cast("array<bigint>")
    shared = first.select("doc_id", "row", "n_words", F.explode_outer(every).alias("p")).join(prints, F.col("p") == prints["print"], "left")
    # rows of a text are neighbours, so this is one row per text before it is shuffled
    counted = shared.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.max(F.col("print").isNotNull()).alias("shares"))
    counted = stage(counted, "texts")

    again = sized(counted.where("shares").select("doc_id", "row"), "texts-with-prints").alias("s")
    same = F.col("o.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("o.row") == F.col("s.row"))
    second = own.alias("o").join(again, same, "left_semi")
    second = second.select("doc_id", "row", words(F.translate("text", UPPER, UPPER.lower())).alias("_words"))
    contents = sized(bench.select("length", "content", "items"), "benchmark-contents", rows=200_000)
    parts = [windows(second, ["doc_id", "row"], n, window, gram).join(contents, ["length", "content"]) for n in lengths or [window]]
    spans = reduce(DataFrame.unionByName, parts).withColumn("span", F.struct("at", (F.col("at") + F.col("length")).alias("end")))
    grouped = spans.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    start = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("upto"))
    new = lambda a, s: F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], a["upto"]))
    grow = lambda a, s: F.struct((a["covered"] + new(a, s)).alias("covered"), F.greatest(a["upto"], s["end"]).alias("upto"))
    hits = grouped.select("doc_id", "row", F.aggregate("spans", start, grow)["covered"].alias("n_hit"), "items")
    found = counted.alias("c").join(hits.alias("h"), F.col("c.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("c.row") == F.col("h.row")), "left")
    return found.select(
        "c.doc_id",
        "c.row",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array()).alias("items"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )
