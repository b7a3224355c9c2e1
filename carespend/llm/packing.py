"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.llm.text import LOWER, column_bytes, slices
from carespend.sources.io import stage

#: Tokens of a sequence.
SEQUENCE = 2048
#: Pieces that one task ranks at most, about.
RANKED = 1_000
#: Word forms of a generation; a worker remembers two of them, over all its tasks.
REMEMBERED = 320_000
#: Word forms that are encoded at a time.
TOGETHER = 2000


class Encoder:
    """Token ids of many texts, as little-endian 32-bit numbers.

    The tokenizer drops white space and splits a letter or digit from a full stop or comma
    after it, so a text may be cut there and each form be encoded once. Texts that hold the
    opening of a special token are encoded whole.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.before_point = np.zeros(256, bool)
        for low, high in ((48, 57), (65, 90), (97, 122)):
            self.before_point[low : high + 1] = True

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, forms: list[bytes]) -> None:
        for k in range(0, len(forms), TOGETHER):
            part = forms[k : k + TOGETHER]
            texts = [x.decode() for x in part]
            begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
            encoded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            at = np.array([a for a, _ in encoded.offsets], np.int64)
            ids, cuts = np.array(encoded.ids, "<u4").tobytes(), 4 * np.searchsorted(at, begins, "left")
            self.known.update((x, ids[a:b]) for x, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def forms(self, data: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
        """Per text, the forms it is cut into."""
        plain = np.ones(len(data), bool)  # lower-casing ahead is safe only among letters that compose with nothing
        wide = np.searchsorted(offsets, np.flatnonzero(data > 0xC8), "right") - 1
        for k in np.unique(wide):
            plain[offsets[k] : offsets[k + 1]] = False
        lowered = np.where(plain, LOWER[data], data)
        lowered[lowered == 10] = 32
        cut = np.flatnonzero(((data[1:] == 44) | (data[1:] == 46)) & self.before_point[data[:-1]] & plain[1:]) + 1
        cut = cut[~np.isin(cut, offsets)]
        spread = np.insert(lowered, cut, 32).tobytes()
        ends = (offsets + np.searchsorted(cut, offsets, "left")).tolist()
        return [spread[a:b].split(b" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        raw = data.tobytes()
        opened = [k for k in range(len(offsets) - 1) if raw.find(b"<|", offsets[k], offsets[k + 1]) >= 0] if b"<|" in raw else []
        cut = self.forms(data, offsets)
        for k in opened:
            cut[k] = []
        if len(self.known) > self.remembered:
            self.known, self.older = {b"": b""}, self.known
        new = set().union(*cut).difference(self.known)
        seen = new.intersection(self.older)
        self.known.update((x, self.older[x]) for x in seen)
        self.learn(list(new - seen))
        special = set(opened)
        for k, forms in enumerate(cut):
            yield self.whole(raw[offsets[k] : offsets[k + 1]]) if k in special else b"".join(map(self.known.__getitem__, forms))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder that this worker has for a vocabulary; Spark keeps workers, and so what was learned, over tasks."""
    digest = hashlib.sha256(vocabulary.encode()).hexdigest()
    if digest not in _ENCODERS:
        _ENCODERS.clear()  # one vocabulary at a time
        _ENCODERS[digest] = Encoder(vocabulary)
    _ENCODERS[digest].remembered = remembered
    return _ENCODERS[digest]


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """The tokens of each text and a closing id 0, cut into pieces of ``size`` tokens.

    ``vocabulary`` is the path of a tokenizer file; the driver reads it and sends its few
    megabytes along. A worker remembers ``remembered`` forms twice over, about 150 bytes each. Columns: ``doc_id, piece, start, length, ids_crc32``.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier stages have left in this worker
        encoder = encoder_of(content.value, remembered)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                rows, out = [], []
                part = data[offsets[a] : offsets[b]]
                for row, ids in enumerate(encoder.encode(part, offsets[a : b + 1] - offsets[a]), a):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[at : at + 4 * size]
                        rows.append(row)
                        out.append((piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                numbers = np.array(out, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers[0], pa.int32()), *map(pa.array, numbers[1:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def plan_slots(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths: ``length, rank, count, per_sequence, sequence, offset`` rows.

    Pieces of ``length`` with ranks from ``rank`` on fill consecutive sequences from
    ``sequence`` on at ``offset``, ``per_sequence`` to each. Sequences with the same history
    are handled as a group, so the work and the rows depend on the lengths alone: a length
    visits a group once at most and leaves two groups more at most.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    spaces: list[int] = []  # free tokens of open groups, ascending
    groups: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in groups:
                groups[space] = []
                insort(spaces, space)
            groups[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[k]
            else:
                space, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, size - space))
                rank, left = rank + full * each, left - full * each
                put(space - each * length, first, full)
            if left and full < n:
                rows.append((length, rank, left, left, first + full, size - space))
                put(space - left * length, first + full, 1)
                full, left = full + 1, 0
            put(space, first + full, n - full)
    return rows


def ranked(cut: DataFrame, counts: dict[int, int], per_task: int = RANKED) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0.

    A length with many pieces is split by hash into buckets, which are ranked apart and then
    moved by the sizes of the buckets before them.
    """
    spark = cut.sparkSession
    split = spark.createDataFrame([(n, -(-c // per_task)) for n, c in counts.items()], "length long, _buckets long")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_buckets"))
    dealt = cut.join(F.broadcast(split), "length").withColumn("_bucket", bucket).drop("_buckets")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    moved = sizes.select("length", "_bucket", before.alias("_before"))
    return (
        dealt.withColumn("_own", own)
        .join(moved, ["length", "_bucket"])
        .withColumn("rank", F.col("_own") + F.col("_before"))
        .drop("_own", "_before", "_bucket")
    )


def pack(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Place every text, as tokens with a closing id 0, into sequences of ``size`` tokens.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Only a histogram of at most ``size`` lengths comes to the driver; it plans slots for
    counts, and pieces take slots by their rank within their length.

    Null text counts as empty and gives the closing id alone. Rows that repeat an id are
    packed each. No rows give no rows; other columns are ignored, whatever their names.
    """
    cut = stage(pieces(docs, vocabulary, size, id_col, text_col, remembered), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = docs.sparkSession.createDataFrame(
        plan_slots(counts, size), "length long, _rank long, _count long, _each long, _sequence long, _offset long"
    )
    within = F.col("rank") - F.col("_rank")
    here = (ranked(cut, counts).alias("p")).join(
        F.broadcast(slots), (F.col("p.length") == slots["length"]) & (within >= 0) & (within < F.col("_count"))
    )
    return here.select(
        "doc_id",
        "piece",
        "start",
        "p.length",
        "ids_crc32",
        (F.col("_sequence") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + within % F.col("_each") * F.col("p.length")).cast("long").alias("offset"),
    )
