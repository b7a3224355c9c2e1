"""Substring deduplication by words: anchors at the places of a difference cover, extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carespend.llm.joins import sized
from carespend.llm.text import SPACED_WORD, WordRuns, column_bytes, slices, word_hashes, word_spans
from carespend.sources.io import stage

#: Words of a passage that counts as repeated.
WINDOW = 50

#: Odd numbers that tell families of run hashes apart.
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_NO_ID = -(1 << 63)


def difference_cover(period: int) -> list[int]:
    """The least places of which any two residues modulo ``period`` have a pair at their distance.

    ``period`` is q * q + q + 1 for a prime power q (or 1, 3), so that every distance occurs once.
    """

    def grow(places: list[int], gaps: set[int]) -> list[int] | None:
        if len(gaps) == period - 1:
            return places
        for x in range(places[-1] + 1, period):
            new = {(x - y) % period for y in places} | {(y - x) % period for y in places}
            if len(new) == 2 * len(places) and not new & gaps:
                found = grow([*places, x], gaps | new)
                if found:
                    return found
        return None

    return grow([0], set())


def cover_of(window: int) -> tuple[int, list[int]]:
    """Words of an anchor, and for each word number modulo the period whether an anchor starts there.

    Two equal windows start at any two word numbers; within ``period`` words both come to
    a place of the cover at the same time, so an anchor of ``window - period + 1`` words
    that starts there lies inside both.
    """
    period = max(p for p in (1, 3, 7, 13, 21, 31, 57, 73, 91) if p == 1 or 8 * p <= 5 * window)
    places = difference_cover(period)
    return window - period + 1, [k in places for k in range(period)]


class Words:
    """The words of some texts: hashes, and for each its text and its number there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.text, self.starts, self.ends = word_spans(data, offsets, SPACED_WORD)
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))
        self.counts = np.diff(self.first)
        self.number = np.arange(len(self.text)) - self.first[self.text]

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    data, offsets = column_bytes(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def anchors(docs: DataFrame, window: int = WINDOW, prints_only: bool = False) -> DataFrame:
    """``print, context, key, sub, at``: the anchors of ``docs`` (``key, sub, text``).

    ``at`` is the number of an anchor's first word. ``print`` stands for its words, ``context``
    for all words of the windows that hold it, as far as the text goes. Texts shorter than a
    window have none. With ``prints_only``, each text's distinct prints alone.
    """
    width, cover = cover_of(window)
    starts_here, reach = np.array(cover), window - width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in _texts(batch, 2):
                size = words.counts[words.text]
                at = np.flatnonzero((size >= window) & (words.number <= size - width) & starts_here[words.number % len(starts_here)])
                runs = WordRuns(words.hashes(), 1 if not len(at) else width + 2 * reach, _FIRST)
                prints = runs.of(at, np.array(width))
                if prints_only:
                    order = np.lexsort((prints, words.text[at]))
                    text, prints = words.text[at][order], prints[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (text[1:] != text[:-1]) | (prints[1:] != prints[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(prints[new].view(np.int64))], ["print"])
                    continue
                left = np.minimum(words.number[at], reach)
                right = np.minimum(size[at], words.number[at] + window) - words.number[at]
                context = runs.of(at - left, left + right) + left.astype(np.uint64)
                row = pa.array(words.text[at] + a)
                columns = [pa.array(x.view(np.int64)) for x in (prints, context)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, batch.column(0).take(row), batch.column(1).take(row), pa.array(words.number[at].astype(np.int32))],
                    ["print", "context", "key", "sub", "at"],
                )

    kind = "print long" if prints_only else "print long, context long, key long, sub long, at int"
    return docs.select("key", "sub", "text").mapInArrow(run, kind)


def window_hashes(marked: DataFrame, window: int = WINDOW) -> DataFrame:
    """``one, two, key, sub, start``: every window around the anchors ``ats`` of texts ``key, sub, text, ats``."""
    width, _ = cover_of(window)
    reach = window - width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _texts(batch, 2):
                lists = batch.column(3).slice(a, b - a)
                at = lists.flatten().to_numpy() + np.repeat(words.first[:-1], lists.value_lengths().to_numpy())
                marks = np.zeros(len(words.text) + 1, np.int32)
                np.add.at(marks, np.maximum(at - reach, words.first[words.text[at]]), 1)
                np.add.at(marks, at + 1, -1)
                near = (np.cumsum(marks[:-1]) > 0) & (words.number <= words.counts[words.text] - window)
                start, hashes = np.flatnonzero(near), words.hashes()
                values = [WordRuns(hashes, window if len(start) else 1, t).of(start, np.array(window)) for t in (_FIRST, _SECOND)]
                row = pa.array(words.text[start] + a)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v.view(np.int64)) for v in values), batch.column(0).take(row), batch.column(1).take(row), pa.array(words.number[start].astype(np.int32))],
                    ["one", "two", "key", "sub", "start"],
                )

    return marked.select("key", "sub", "text", "ats").mapInArrow(run, "one long, two long, key long, sub long, start int")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, sub, begin, end``: words of texts ``key, sub, text`` in windows that a lesser key holds too; spans may overlap or go too far.

    Anchors that occur in one text only are dropped. Those with the same context are a class:
    every window around them is the same, so all but the texts of the least key are spans as a
    whole. Where the contexts of an anchor differ, the texts of each class's least key are
    read again, and each window around the anchor is compared as a whole.
    """
    width, _ = cover_of(window)
    reach = window - width
    repeated = anchors(docs, window, prints_only=True).groupBy("print").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    repeated = stage(repeated.select("print"), "repeated-anchors")
    found = stage(anchors(docs, window).join(repeated.hint("merge"), "print", "left_semi"), "anchors")
    classes = found.groupBy("print", "context").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = stage(classes, "contexts")
    variants = classes.groupBy("print").agg(F.count(F.lit(1)).alias("variants"))
    classes = classes.join(variants, "print").where("rows > 1 OR variants > 1").select("print", "context", "first", (F.col("variants") > 1).alias("differ"))
    met = found.join(classes.hint("merge"), ["print", "context"])
    met = stage(met.where("key > first OR differ").select("key", "sub", "at", (F.col("key") > F.col("first")).alias("copied")), "extended-anchors")
    whole = met.where("copied").select("key", "sub", F.greatest(F.lit(0), F.col("at") - reach).alias("begin"), (F.col("at") + window).alias("end"))

    lists = met.where("NOT copied").groupBy("key", "sub").agg(F.collect_list("at").alias("ats"))
    lists = stage(lists, "open-anchors")
    keys = sized(lists.select("key", "sub"), "open-texts")
    marked = docs.join(keys, ["key", "sub"], "left_semi").join(lists, ["key", "sub"])
    windows = stage(window_hashes(marked, window), "windows")
    sources = windows.groupBy("one", "two").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    sources = stage(sources.select("one", "two", "first"), "sources")
    later = windows.join(sources.hint("merge"), ["one", "two"]).where("key > first")
    return stage(whole.unionByName(later.select("key", "sub", F.col("start").alias("begin"), (F.col("start") + window).alias("end"))), "spans")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Texts without the words of passages of ``window`` words or more that a text with a lesser id holds too.

    Returns a row per row of ``docs``: ``doc_id, n_words, kept, spans``; ``kept`` holds the
    remaining words joined by a space, ``spans`` the maximal removed runs as ``begin, end`` in
    word numbers. Words are what lies between white space, unchanged. Passages are judged on the
    input, lie in one text, and are not removed for repeating within it.

    Texts that are equal as a whole are told by SHA-256 first and only one is searched; runs of
    words are equal if two 64-bit hashes are.

    Null and empty texts have no words. Ids are integers; a null id comes before all others.
    Rows that repeat an id lose nothing to each other, whether their texts are equal or not. No
    rows give no rows; other columns are ignored, whatever their names.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    own = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = stage(own.select("key", "digest"), "digests")
    copied = rows.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copied = sized(copied.select("digest", "first"), "copied-texts")
    ids = sized(rows.groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("key", F.lit(True).alias("several")), "repeated-ids")
    own = own.join(copied, "digest", "left").join(ids, "key", "left")
    # a number for the texts of an id that has several
    own = own.withColumn("sub", F.when(F.col("several"), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    own = own.select("doc_id", "key", "sub", "text", (F.coalesce("first", "key") < F.col("key")).alias("copy"))

    found = repeated_spans(own.where("NOT copy").select("key", "sub", "text"), window)
    lists = found.groupBy("key", "sub").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    keys = sized(found.select("key", "sub").distinct(), "texts-with-spans")
    touched = own.where("NOT copy").join(keys, ["key", "sub"], "left_semi").join(lists, ["key", "sub"]).select("doc_id", "text", "copy", "found")
    none = F.array().cast("array<struct<begin:int,end:int>>").alias("found")
    clean = own.join(keys.withColumn("hit", F.lit(True)), ["key", "sub"], "left").where("copy OR hit IS NULL").select("doc_id", "text", "copy", none)
    kind = own.schema["doc_id"].dataType.simpleString()
    cut = f"doc_id {kind}, n_words long, kept binary, spans array<struct<begin:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, words in _texts(batch, 1):
                lists = batch.column(3).slice(a, b - a)
                row = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                begin, end = (np.asarray(c) + words.first[row] for c in lists.flatten().flatten())
                marks = np.zeros(len(words.text) + 1, np.int32)
                np.add.at(marks, begin, 1)
                np.add.at(marks, np.minimum(end, words.first[row + 1]), -1)
                gone = np.cumsum(marks[:-1]) > 0
                gone |= (copies[a:b] & (words.counts >= window))[words.text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words.counts, pa.int64()), joined(words, ~gone), runs_of(words, gone)], ["doc_id", "n_words", "kept", "spans"]
                )

    return touched.unionByName(clean).mapInArrow(run, cut)


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Per text its kept words, joined by a space."""
    data, marks = words.data.copy(), np.zeros(len(words.data) + 1, np.int8)
    text, starts, ends = words.text[kept], words.starts[kept], words.ends[kept]
    gap = ends[:-1][text[1:] == text[:-1]]  # what follows a word is white space, so it can be the space
    data[gap] = 32
    marks[starts] += 1
    marks[ends] -= 1
    inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
    inside[gap] = True
    sizes = np.zeros(len(words.counts) + 1, np.int64)
    length = ends - starts
    length[:-1] += text[1:] == text[:-1]
    np.cumsum(np.bincount(text, weights=length, minlength=len(words.counts)).astype(np.int64), out=sizes[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(words.counts), [None, pa.py_buffer(sizes), pa.py_buffer(data[inside])]).cast(pa.binary())


def runs_of(words: Words, gone: np.ndarray) -> pa.Array:
    """Per text the maximal runs of removed words."""
    edge = words.number == 0
    begin = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
    end = np.flatnonzero(gone & np.concatenate([edge[1:] | ~gone[1:], [True]])) if len(gone) else begin
    pairs = pa.StructArray.from_arrays([pa.array(words.number[x].astype(np.int32) + d) for x, d in ((begin, 0), (end, 1))], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(words.text[begin], np.arange(len(words.counts) + 1)), pa.int32()), pairs)
