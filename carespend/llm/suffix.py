"""Removal of repeated byte strings by suffix sorting."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carespend.llm.joins import sized
from carespend.llm.text import SpanHash, column_bytes, mixed, slices
from carespend.operators.order import positions
from carespend.sources.io import stage

#: Bytes of a string that counts as repeated.
LENGTH = 100
#: Bytes of the grams whose least hash brings equal strings together.
GRAM = 32
#: A longer text is read in parts of so many bytes, which overlap.
PART = 1 << 18
#: Different runs with one print that are sorted in one task at most; more are told apart by longer prints first.
VARIANTS = 2000
#: Offsets of the least gram that share a longer print, at each step of telling apart; the last one leaves single windows.
CELLS = (16, 4, 1)
#: The most frequent prints, of so many rows at least, are dealt to several tasks each.
HEAVY_PRINTS, HEAVY_ROWS, SALTS = 1024, 1000, 64
#: Bytes that are sorted together, about; positions and word ranks must fit in 21 bits.
SORTED_BYTES = 1 << 19
_RANK_BITS = 21
_NO_ID = -(1 << 63)


# --- suffix sorting -------------------------------------------------------------------------


def word_ranks(codes: np.ndarray) -> np.ndarray:
    """The rank of the 8 codes from each position on; beyond the end there are zeros."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(4, codes.dtype)]).astype(np.int64)
    half = np.zeros(n, np.int64)
    for k in range(4):  # a code takes nine bits
        half = (half << 9) | padded[k : k + n]
    half = np.unique(half, return_inverse=True)[1]
    after = np.concatenate([half[4:] + 1, np.zeros(min(4, n), np.int64)])
    return np.unique((half << 32) | after, return_inverse=True)[1]


def smaller_than_next(codes: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; equal neighbours share the answer."""
    step = np.sign(np.diff(codes.astype(np.int32), append=-1))
    differs = np.where(step != 0, np.arange(len(codes)), len(codes) - 1)
    return step[np.minimum.accumulate(differs[::-1])[::-1]] > 0


def _sort_directly(chosen: np.ndarray, ranks: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by ``depth`` codes at least: three words to a key, only ties going on to the next key."""
    padded = np.concatenate([ranks + 1, np.zeros(depth + 64, np.int64)])
    group = np.zeros(len(chosen), np.int64)
    order = chosen
    tied = np.arange(len(chosen))
    for at in range(0, depth, 24):
        here = order[tied]
        key = (padded[here + at] << (2 * _RANK_BITS)) | (padded[here + at + 8] << _RANK_BITS) | padded[here + at + 16]
        by = np.lexsort((key, group[tied]))
        order[tied], key = here[by], key[by]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[tied][1:] != group[tied][:-1])
        first = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        group[tied] = first
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        tied = tied[~alone]
        if not len(tied):
            break
    return order


def suffix_order(codes: np.ndarray, depth: int, ranks: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in the order of their first ``depth`` codes, by two-stage sorting.

    Only suffixes smaller than their successors are sorted directly. Every other one follows
    from its successor: scanning buckets of first codes upwards, each sorted suffix puts the
    one before it at the next place of that one's bucket. Code 0 separates strings.
    """
    small = smaller_than_next(codes) & (codes > 0)
    direct = _sort_directly(np.flatnonzero(small), ranks, depth)
    first = codes[direct]
    held: dict[int, list[np.ndarray]] = {}
    out = []
    present = np.unique(codes)
    for code in present.tolist():
        if code == 0:
            bucket = np.flatnonzero(codes == 0)
        else:
            parts = []
            front = np.concatenate(held.pop(code)) if code in held else np.zeros(0, np.int64)
            while len(front):  # runs of one code: each turn adds the suffixes that are one longer
                parts.append(front)
                front = front[front > 0] - 1
                front = front[codes[front] == code]
            a, b = np.searchsorted(first, (code, code + 1))
            bucket = np.concatenate([*parts, direct[a:b]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[codes[before] > code]
        larger = codes[before]
        by = np.argsort(larger, kind="stable")
        before, larger = before[by], larger[by]
        cuts = np.flatnonzero(np.diff(larger)) + 1
        for part in np.split(before, cuts):
            if len(part):
                held.setdefault(int(codes[part[0]]), []).append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(order: np.ndarray, ranks: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order, whether it shares ``depth`` codes with the one before it."""
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for at in [*range(0, depth - 7, 8), depth - 8]:
        same &= ranks[a + at] == ranks[b + at]
    return np.concatenate([[False], same]) if len(order) else np.zeros(0, bool)


def first_windows(texts: list[bytes], places: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, whether each of its windows of ``length`` bytes also occurs at a lesser place.

    ``places`` has the place of each text's first window; the places of its windows follow on.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    codes[starts + sizes] = 0
    ranks = word_ranks(codes)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(codes)) - starts[owner]
    window = offset + length <= sizes[owner]
    order = suffix_order(codes, length, ranks)
    order = order[window[order]]
    begins = np.flatnonzero(~common_prefixes(order, ranks, length))
    place = places[owner[order]] + offset[order]
    least = np.repeat(np.minimum.reduceat(place, begins), np.diff(np.append(begins, len(order)))) if len(order) else place
    again = np.zeros(len(codes), bool)
    again[order] = place != least
    return [again[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


# --- runs of windows ------------------------------------------------------------------------


def _parts(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of parts of all texts; parts of one text overlap by ``length - 1`` bytes."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - length + 1) // PART))
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + k * PART
    return row, start, np.minimum(start + PART + length - 1, offsets[row + 1])


def least_after(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each ``n`` consecutive elements."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def text_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows whose first least gram is the same one: text, first window, windows, that gram's hash and one of all bytes.

    Equal windows have it at the same offset, so no window occurs twice in a run.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    spans = SpanHash(data)
    grams = spans.of_fixed(gram)
    prints = least_after(grams, length - gram + 1)
    starts = np.arange(len(prints))
    text = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + length <= offsets[text + 1]
    new = valid.copy()
    passed = grams[: len(prints) - 1] == prints[:-1]  # the first least gram is left behind
    new[1:] &= (prints[1:] != prints[:-1]) | (text[1:] != text[:-1]) | passed
    first = np.flatnonzero(new)
    held = np.concatenate([[0], np.cumsum(valid)])
    n = held[np.append(first[1:], len(valid))] - held[first]
    return text[first], first - offsets[text[first]], n, prints[first], spans.of(first, first + n + length - 1)


def runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``print, bytes_hash, key, start, n``: the runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            row, start, end = _parts(offsets, length)
            sizes = np.concatenate([[0], np.cumsum(end - start)])
            for a, b in slices(sizes, 2 * PART):
                part = np.concatenate([data[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])
                text, first, n, prints, hashes = text_runs(part, sizes[a : b + 1] - sizes[a], length, gram)
                where = row[a + text]
                columns = [prints.view(np.int64), hashes.view(np.int64), keys[where], first + start[a + text] - offsets[where], n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["print", "bytes_hash", "key", "start", "n"])

    return docs.select("key", "text").mapInArrow(run, "print long, bytes_hash long, key long, start long, n int")


def cut_texts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``print, key, start, n, variants, text`` for the runs in ``wanted``, with their bytes."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("print", "start", "n", "variants")).alias("runs"))
    ids = sized(wanted.select("key").distinct(), "keys-of-runs")
    joined = docs.join(ids, "key", "left_semi").dropDuplicates(["key"]).join(lists, "key").select("key", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found = batch.column(2)
            row = np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy())
            fields = dict(zip(("print", "start", "n", "variants"), found.flatten().flatten(), strict=True))
            start = offsets[row] + fields["start"].to_numpy()
            end = start + fields["n"].to_numpy() + length - 1
            whole = data.tobytes()
            for a in range(0, len(row), 20_000):
                b = min(len(row), a + 20_000)
                texts = [whole[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row[a:b])), *(fields[c].slice(a, b - a) for c in ("start", "n", "variants"))]
                yield pa.RecordBatch.from_arrays(
                    [fields["print"].slice(a, b - a), *columns, pa.array(texts, pa.binary())], ["print", "key", "start", "n", "variants", "text"]
                )

    return joined.mapInArrow(run, "print long, key long, start long, n int, variants long, text binary")


def _spans(again: np.ndarray, start: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that the marked windows cover."""
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    return start + np.flatnonzero(edge > 0), start + np.flatnonzero(edge < 0) + length - 1


def sorted_hits(cut: DataFrame, length: int) -> DataFrame:
    """``key, begin, end``: bytes of the given runs that an earlier one holds too.

    Equal windows have the same print, so runs are dealt by it; a task sorts the suffixes of
    many prints at a time.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[1] for r in rows], np.int64)
        starts = np.array([r[2] for r in rows], np.int64)
        _, rank = np.unique(keys, return_inverse=True)
        hits = first_windows([r[3] for r in rows], (rank.astype(np.int64) << 40) + starts, length)
        found = [_spans(h, s, length) for h, s in zip(hits, starts.tolist(), strict=True)]
        owner = np.repeat(keys, [len(f[0]) for f in found])
        columns = [owner, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORTED_BYTES and r[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3]) + 1
        if rows:
            yield flush(rows)

    parts = max(1, cut.sparkSession.sparkContext.defaultParallelism, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.select("print", "key", "start", "text").repartition(parts, "print").sortWithinPartitions("print")
    return dealt.mapInArrow(run, "key long, begin long, end long")


def finer_runs(hot: DataFrame, length: int, gram: int, cell: int) -> DataFrame:
    """The given runs cut by the offset of their least gram into cells, with prints of all bytes that a cell's windows share.

    Equal windows have the gram at the same offset, so they stay together; a longer print sets
    apart runs that have little more than the gram in common. No window is in two of the runs
    that come out, and there are at most ``length / cell`` from one.
    """
    names = ["print", "bytes_hash", "key", "start", "n", "anchor", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, starts, n, anchors = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:5])
            data, offsets = _binary(batch.column(5))
            spans = SpanHash(data)
            grams = spans.of_fixed(gram)
            owner = np.repeat(np.arange(len(batch)), np.diff(offsets))[: len(grams)]
            same = np.flatnonzero(grams == prints.view(np.uint64)[owner])
            first = same[np.minimum(np.searchsorted(same, offsets[:-1]), len(same) - 1)] - offsets[:-1] if len(same) else offsets[:-1]
            at = np.where(anchors >= 0, anchors - starts, first)
            low, high = at - n + 1, at
            cells = high // cell - low // cell + 1
            row = np.repeat(np.arange(len(batch)), cells)
            begin = (low[row] // cell + np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)) * cell
            end = np.minimum(begin + cell - 1, length - gram)
            low, high, at = np.maximum(low[row], begin), np.minimum(high[row], end), at[row]
            here = offsets[row] + at
            shared = spans.of(here - begin, here + length - end)
            longer = mixed(shared ^ mixed(prints.view(np.uint64)[row] + (begin * 128 + cell).astype(np.uint64)))
            size = high - low + 1
            a, b = here - high, here - high + size + length - 1
            whole = data.tobytes()
            texts = [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            columns = [longer.view(np.int64), spans.of(a, b).view(np.int64), keys[row], starts[row] + at - high, size, starts[row] + at]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), pa.array(texts, pa.binary())], names)

    return hot.select("print", "key", "start", "n", "anchor", "text").mapInArrow(
        run, "print long, bytes_hash long, key long, start long, n long, anchor long, text binary"
    )


def hot_hits(hot: DataFrame, length: int, gram: int) -> DataFrame | None:
    """``key, begin, end`` like ``sorted_hits``, for prints with very many different runs."""
    out = []
    for cell in CELLS:
        if hot.isEmpty():
            break
        finer = stage(finer_runs(hot, length, gram, cell), "finer-runs")
        classes = finer.groupBy("print", "bytes_hash").agg(
            F.min(F.struct("key", "start", "n", "anchor", "text")).alias("first"), F.count(F.lit(1)).alias("rows")
        )
        classes = stage(classes, "finer-classes")
        out.append(_copied(finer, classes, length))
        variants = classes.groupBy("print").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
        several = stage(classes.join(variants, "print").select("print", "first.*", "variants"), "finer-texts")
        out.append(sorted_hits(several.where(F.col("variants") <= VARIANTS), length))
        hot = several.where(F.col("variants") > VARIANTS)
    return reduce(DataFrame.unionByName, out) if out else None


def _copied(found: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """The bytes of all runs but the first of each class."""
    copies = classes.where("rows > 1").select("print", "bytes_hash", "first.key", "first.start")
    copies = copies.withColumnsRenamed({"key": "first_key", "start": "first_start"})
    later = found.join(copies, ["print", "bytes_hash"]).where("key <> first_key OR start <> first_start")
    return later.select("key", F.col("start").alias("begin"), (F.col("start") + F.col("n") + length - 1).alias("end"))


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key, begin, end``: bytes covered by strings of ``length`` bytes that also start earlier; spans may overlap.

    ``docs`` holds ``key, text``. Windows are cut into runs that share their least gram, and
    runs whose gram occurs once are dropped. Runs of the same bytes form a class: only its
    first run can hold a first occurrence, so the other ones are spans as a whole. The first
    runs of all classes with the same gram are sorted as suffixes; where they are very many,
    longer grams tell them apart first.
    """
    spark = docs.sparkSession
    every = runs(docs, length, gram)
    repeated = every.groupBy("print").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = stage(repeated, "repeated-prints")
    heavy = F.broadcast(repeated.where(F.col("rows") > HEAVY_ROWS).orderBy(F.desc("rows"), "print").limit(HEAVY_PRINTS).select(F.col("print").alias("heavy")))
    salted = F.col("print") == F.col("heavy")
    salt = F.when(F.col("heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int")).alias("salt")
    salts = F.when(F.col("heavy").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    wanted = repeated.join(heavy, salted, "left").select("print", F.explode(salts).alias("salt"))
    dealt = every.join(heavy, salted, "left").select("print", "bytes_hash", "key", "start", "n", salt)
    found = stage(dealt.join(wanted.hint("merge"), ["print", "salt"], "left_semi").drop("salt"), "repeated-runs")
    drop_shuffles(spark)
    classes = found.groupBy("print", "bytes_hash").agg(F.min(F.struct("key", "start", "n")).alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = stage(classes, "run-classes")
    several = classes.groupBy("print").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    whole = stage(_copied(found, classes, length), "copied-runs")
    drop_shuffles(spark)
    mixed_runs = classes.join(several, "print").select("print", "first.*", "variants")
    cut = stage(cut_texts(docs, mixed_runs, length), "run-texts")
    near = sorted_hits(cut.where(F.col("variants") <= VARIANTS), length)
    hot = hot_hits(cut.where(F.col("variants") > VARIANTS).withColumn("anchor", F.lit(-1).cast("long")), length, gram)
    spans = whole.unionByName(near)
    spans = stage(spans if hot is None else spans.unionByName(hot), "repeated-spans")
    drop_shuffles(spark)
    return spans


def with_places(docs: DataFrame) -> DataFrame:
    """``docs`` with a key per id and text: the id, or the place in the order of ids and texts where an id has several texts."""
    told = docs.withColumn("told", F.xxhash64("text"))
    rows = stage(told.select("key", "told"), "texts-of-ids")
    several = rows.groupBy("key").agg(F.min("told").alias("a"), F.max("told").alias("b")).where("a <> b")
    if not several.take(1):
        return docs
    placed = sized(positions(rows.distinct(), ["key", "told"], "place"), "places")
    return told.join(placed, ["key", "told"]).drop("key", "told").withColumnRenamed("place", "key").select(docs.columns)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Texts without the bytes of strings of ``length`` bytes that also start earlier, in a lesser id or before in the same text.

    Returns a row per row of ``docs``: ``doc_id, n_bytes, kept, spans``; ``kept`` holds the
    remaining UTF-8 bytes, ``spans`` the maximal removed runs as ``begin, end``. Strings are
    judged on the input and may overlap; none crosses texts.

    Null text counts as empty. Ids are integers; a null id comes before all others. Rows that
    repeat an id and its text are one document: they lose the same bytes and none to each
    other. Other rows that repeat an id are documents of their own, in the order of a hash. No
    rows give no rows; other columns are ignored, whatever their names.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    own = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = with_places(own)
    found = repeated_spans(own, length, gram)
    lists = found.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    ids = sized(found.select("key").distinct(), "keys-of-spans")
    touched = own.join(ids, "key", "left_semi").join(lists, "key").select("doc_id", "text", "found")
    clean = own.join(ids, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            marks = np.zeros(len(data) + 1, np.int32)
            lists = batch.column(2)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            begin, end = (offsets[row] + np.asarray(c) for c in lists.flatten().flatten())
            np.add.at(marks, np.minimum(begin, offsets[row + 1]), 1)
            np.add.at(marks, np.minimum(end, offsets[row + 1]), -1)
            gone = np.cumsum(marks[:-1]) > 0
            kept, spans = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                kept.append(data[a:b][~gone[a:b]].tobytes())
                spans.append([{"begin": x, "end": y} for x, y in zip(*map(np.ndarray.tolist, _spans(gone[a:b], 0, 1)), strict=True)])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            sizes = pa.array(np.diff(offsets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc_id", "n_bytes", "kept", "spans"])

    kind = own.select("doc_id").schema["doc_id"].dataType.simpleString()
    cut = touched.mapInArrow(run, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<begin:long,end:long>>")
    whole = F.encode("text", "UTF-8")
    return cut.unionByName(
        clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), whole.alias("kept"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))
    )
