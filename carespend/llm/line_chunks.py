"""Removal of repeated multi-line chunks, and of repeated passages line by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carespend.llm.joins import sized
from carespend.sources.io import stage

#: One in so many line pairs ends a chunk.
MEAN_LINES = 4
#: Lines that a chunk needs to be removed.
LEAST_LINES = 2
_KEY = ["high", "low"]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame, mean_lines: int = MEAN_LINES) -> DataFrame:
    """``_text`` and ``_chunks``: an array of ``lines, text`` whose texts, joined by line feeds, are the whole text.

    A chunk ends after a line where the hash rolled over this line and the one before it is a
    multiple of ``mean_lines``. So boundaries depend on two lines only, and a passage moved to
    another place is cut at the same lines.
    """
    df = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_lines", F.split("_text", "\n", -1))
    df = df.withColumn("_hashes", F.transform("_lines", line_hash))
    rolled = lambda h, i: F.coalesce(F.get("_hashes", i - 1), F.lit(0)) * 31 + h
    last = lambda h, i: (rolled(h, i) % mean_lines == 0) | (i == F.size("_hashes") - 1)
    df = df.withColumn("_last", F.transform("_hashes", last))
    df = df.withColumn("_ends", F.array_compact(F.transform("_last", lambda x, i: F.when(x, i + 1))))
    # joined and split again at a mark that no text can hold, as slices would copy all lines each
    df = df.withColumn("_mark", F.concat(F.lit("\x01"), F.md5("_text"), F.lit("\x01")))
    joined = F.array_join(F.zip_with("_lines", "_last", lambda line, x: F.concat(line, F.when(x, F.col("_mark")).otherwise(F.lit("\n")))), "")
    texts = F.split(joined, F.col("_mark"), -1)
    begins = F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.size("_ends") - 1))
    sized_texts = F.zip_with(F.zip_with(begins, "_ends", lambda a, b: b - a), texts, lambda n, t: F.struct(n.alias("lines"), t.alias("text")))
    chunks = F.filter(sized_texts, lambda c: c["lines"].isNotNull())  # what follows the last mark is no chunk
    return df.withColumn("_chunks", chunks).drop("_lines", "_hashes", "_last", "_ends", "_mark")


def _occurrences(docs: DataFrame, mean_lines: int, least_lines: int) -> DataFrame:
    """A row per chunk that could be removed: ``doc_id, row, at, high, low, chunk``."""
    cut = with_chunks(docs, mean_lines).select("doc_id", F.xxhash64("_text").alias("row"), F.posexplode_outer("_chunks").alias("at", "c"))
    # outer, as a filter on the number of chunks would be pushed down and compute them twice
    return cut.where((F.col("c.lines") >= least_lines) & F.col("c.text").rlike(r"\S")).select(
        "doc_id", "row", "at", F.xxhash64("c.text").alias("high"), F.xxhash64(F.lit(1), "c.text").alias("low"), F.col("c.text").alias("chunk")
    )


def repeats(docs: DataFrame, mean_lines: int = MEAN_LINES, least_lines: int = LEAST_LINES) -> DataFrame:
    """``doc_id, row, ats``: for each text the chunks that also occur earlier, by id and place. ``row`` is a hash of the text."""
    later = F.struct("doc_id", "at") != F.col("first")
    removed = _later(lambda: _occurrences(docs, mean_lines, least_lines), later)
    return removed.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("ats"))


def _later(occurrences: Callable[[], DataFrame], later: Column, *more: str) -> DataFrame:
    """``doc_id, row, at`` and the columns ``more`` of occurrences that are ``later`` than the ``first`` of the same bytes.

    Hashes are counted first. Only what has a hash that repeats is gathered and compared as
    bytes, equal ones being merged before they are shuffled. Should two different texts share
    a hash, their occurrences are told apart by their bytes as well.
    """
    place = F.struct("doc_id", "at").alias("place")
    columns = ["doc_id", "row", "at", *more]
    narrow = stage(occurrences().select(*columns, *_KEY), "chunk-places")
    twice = sized(narrow.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*_KEY), "chunk-repeats")
    texts = occurrences().join(twice, _KEY)
    compared = stage(texts.select(*_KEY, "chunk", place).groupBy(*_KEY, "chunk").agg(F.min("place").alias("first")), "chunk-firsts")
    by_key = compared.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"))
    by_key = sized(by_key.where("texts = 1").select(*_KEY, "first"), "chunk-owners")
    removed = narrow.join(by_key, _KEY).where(later).select(*columns)
    mixed = compared.join(compared.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), _KEY, "left_semi")
    if not mixed.isEmpty():
        by_bytes = texts.join(mixed, [*_KEY, "chunk"]).where(later).select(*columns)
        removed = removed.unionByName(by_bytes)
    return removed


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    mean_lines: int = MEAN_LINES,
    least_lines: int = LEAST_LINES,
    carry: list[str] | None = None,
) -> DataFrame:
    """Texts without the multi-line chunks that occur earlier in the corpus: every chunk stays at its first place only.

    Returns a row per row of ``docs``: ``doc_id, text, n_lines, n_chunks, n_removed_chunks,
    n_removed_lines, was_null`` and, if asked for, the columns to ``carry`` in a struct
    ``carried``. Chunks of fewer than ``least_lines`` lines and chunks of white space
    stay. A text that loses all chunks is empty.

    Null text gives an empty one. Places are ordered by id, then by position; a null id comes
    before all others. Rows that repeat an id are one document: they lose the same chunks, and
    none to each other at the same place. No rows give no rows; other columns are ignored,
    whatever their names.
    """
    extra = [F.struct(*carry).alias("carried")] if carry else []
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    lost = sized(repeats(own.select("doc_id", "text"), mean_lines, least_lines), "chunk-removals").alias("l")
    cut = with_chunks(own, mean_lines).withColumn("_row", F.xxhash64("_text")).alias("d")
    joined = cut.join(lost, F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("_row") == F.col("l.row")), "left")
    gone = F.coalesce("ats", F.array().cast("array<int>"))
    joined = joined.select("d.*", gone.alias("_gone"), F.col("d.text").isNull().alias("was_null"))
    kept = F.filter("_chunks", lambda c, i: ~F.array_contains("_gone", i))
    lines = lambda chunks: F.aggregate(chunks, F.lit(0), lambda a, c: a + c["lines"])
    dropped = F.filter("_chunks", lambda c, i: F.array_contains("_gone", i))
    text = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda c: c["text"]), "\n"))
    return joined.select(
        "doc_id",
        text.alias("text"),
        lines(F.col("_chunks")).cast("long").alias("n_lines"),
        F.size("_chunks").cast("long").alias("n_chunks"),
        F.size("_gone").cast("long").alias("n_removed_chunks"),
        lines(dropped).cast("long").alias("n_removed_lines"),
        F.col("was_null"),
        *(["carried"] if carry else []),
    )


def _pairs(docs: DataFrame) -> DataFrame:
    """A row per two lines in a row: ``doc_id, row, at, upto, high, low, chunk``, ``at`` and ``upto`` being their places.

    Blank lines are not counted as lines; those between two lines belong to the pair, by number.
    """
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    numbered = F.transform(F.split("_text", "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    df = df.withColumn("_full", F.filter(numbered, lambda s: s["line"].rlike(r"\S")))
    pair = lambda a, b: F.struct(
        a["at"].alias("at"), b["at"].alias("upto"), F.concat(a["line"], F.repeat(F.lit("\n"), b["at"] - a["at"]), b["line"]).alias("text")
    )
    # no pair begins with the last line
    full, n = F.col("_full"), F.size("_full")
    pairs = F.zip_with(F.slice(full, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(full, F.lit(2), F.greatest(n - 1, F.lit(0))), pair)
    cut = df.select("doc_id", F.xxhash64("_text").alias("row"), F.explode(pairs).alias("c"))
    text = F.col("c.text")
    return cut.select("doc_id", "row", "c.at", "c.upto", F.xxhash64(text).alias("high"), F.xxhash64(F.lit(1), text).alias("low"), text.alias("chunk"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, row, places``: for each text its pairs of lines that also occur earlier, by id and place.

    A pair that overlaps its own first place, as in a run of equal lines, is no repeat.
    """
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at") <= F.col("first.at") + F.col("upto") - F.col("at"))
    return _later(lambda: _pairs(docs), ~own, "upto").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("at", "upto"))).alias("places"))


def passage_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Texts without the passages of two lines or more that occur earlier in the corpus, whole and line by line.

    Every line that is in a pair of adjacent lines which occurs earlier goes, so a repeated
    passage goes from its first to its last line, whatever its length and neighbours. Of what
    goes, every line stays at least at its first place. A single line that repeats between
    other neighbours stays; blank lines do not count as lines, and go if they are inside a pair.

    Returns a row per row of ``docs``: ``doc_id, text, n_lines, n_removed_lines, was_null`` and, if
    asked for, the columns to ``carry`` in a struct ``carried``; both counts are with blank lines.

    Null text gives an empty one. Places are ordered by id, then by position; a null id comes
    before all others. Rows that repeat an id are one document, as in ``line_dedup``. No rows
    give no rows; other columns are ignored, whatever their names.
    """
    extra = [F.struct(*carry).alias("carried")] if carry else []
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *extra)
    lost = sized(repeated_lines(own.select("doc_id", "text")), "passage-removals").alias("l")
    cut = own.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_row", F.xxhash64("_text")).alias("d")
    joined = cut.join(lost, F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("_row") == F.col("l.row")), "left")
    gone = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["upto"]))))
    joined = joined.select("d.*", F.coalesce(gone, F.array().cast("array<int>")).alias("_gone"), F.split("_text", "\n", -1).alias("_lines"))
    # the lines are named twice, as the optimizer would split the text anew for each line
    n = F.size("_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "_gone"), lambda i: F.get("_lines", i))
    return joined.select(
        "doc_id",
        F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n.cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed_lines"),
        F.col("text").isNull().alias("was_null"),
        *(["carried"] if carry else []),
    )
