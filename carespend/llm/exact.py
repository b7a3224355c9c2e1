"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.llm.text import LOWER, column_bytes
from carespend.sources.io import stage

#: Counters of a Misra-Gries summary. It bounds the rows of every broadcast here.
CAPACITY = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the SHA-256 ``digest`` of each text after lower-casing A-Z; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            lowered = memoryview(LOWER[data])
            sums = [hashlib.sha256(lowered[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary())], ["doc_id", "digest"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def frequent(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most ``capacity`` values of the only column of ``keys``, among them every one that is frequent.

    Each task keeps a Misra-Gries summary; the summaries are added up and cut to the largest
    counters. The counters are lower bounds, so what is taken from here has to be counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            if len(held) > capacity:
                cut = nlargest(capacity + 1, held.values())[-1]
                held = Counter({k: n - cut for k, n in held.items() if n > cut})
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "n"])

    summed = keys.mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "digest").limit(capacity).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Which rows stay when texts that are equal, but for the case of A-Z, are reduced to the row with the largest id.

    Returns a row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.
    Frequent digests are found by Misra-Gries summaries and counted exactly; the winners (at
    most ``capacity`` rows) are broadcast and settle their rows without a shuffle. All other
    digests are grouped and joined by shuffling; none of them can be frequent.

    Null and empty texts are equal. Rows that repeat an id count in ``group_size`` and share
    the decision. A null id loses against any other; a group of null ids only keeps them all.
    No rows give no rows; other columns are ignored, whatever their names.
    """
    keys = stage(digests(docs, id_col, text_col), "digests")
    group = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    candidates = F.broadcast(frequent(keys.select("digest"), capacity))
    winners = stage(keys.join(candidates, "digest").groupBy("digest").agg(*group).where("group_size > 1"), "winners")
    rest = keys.join(F.broadcast(winners), "digest", "left_anti")
    settled = keys.join(F.broadcast(winners), "digest").unionByName(rest.join(rest.groupBy("digest").agg(*group), "digest"))
    return settled.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
