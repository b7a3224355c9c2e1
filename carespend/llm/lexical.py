"""Ranked lexical search: short posting lists are added up first, long ones are skipped through document at a time."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.llm.text import ALNUM_WORD, LOWER, column_bytes, distinct_words, slices, word_spans
from carespend.sources.io import stage

#: Terms of the items that are searched in one pass over the documents, about; more items take more passes.
BLOCK_TERMS = 200_000
#: A list is short if it holds at most this share of the documents at hand.
SHORT = 1 / 16
#: Documents that a task takes on before it raises its thresholds.
STRIDE = 2048
#: Postings that a task indexes at a time.
POSTINGS = 2_000_000

_NO_ID = np.iinfo(np.int64).max


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the words of all texts: text number, number among the distinct words, and these. A-Z are lower-cased."""
    lowered = LOWER[data]
    text, starts, ends = word_spans(lowered, offsets, ALNUM_WORD)
    return text, *distinct_words(lowered, starts, ends)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms, repeats`` of items ``item_id, text`` that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            text, code, words = terms(data, offsets)
            words = words.to_pylist()
            counts = [Counter() for _ in range(len(batch))]
            for t, c in zip(text.tolist(), code.tolist(), strict=True):
                counts[t][words[c]] += 1
            kinds = pa.list_(pa.binary()), pa.list_(pa.int64())
            columns = [pa.array([list(c.keys()) for c in counts], kinds[0]), pa.array([list(c.values()) for c in counts], kinds[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["item_id", "terms", "repeats"])

    fields = [T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("repeats", T.ArrayType(T.LongType()))]
    found = items.mapInArrow(run, T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), *fields]))
    return found.where(F.size("terms") > 0)


def forward(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts``: words of each document, and how often it holds each term of the vocabulary, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                text, code, words = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                own = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)[code]
                held = own >= 0
                pairs, counts = np.unique(text[held] * len(vocabulary) + own[held], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(b - a + 1) * len(vocabulary)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(vocabulary)), counts)]
                n = pa.array(np.bincount(text, minlength=b - a), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, *lists], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Best:
    """The best documents of an item so far."""

    k: int
    scores: np.ndarray
    ids: np.ndarray

    @property
    def least(self) -> int:
        """A document with a lower score cannot be among the best any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]


@dataclass
class Index:
    """Posting lists of some documents: of each term the documents, ascending, and their impacts."""

    ids: np.ndarray
    begins: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, length: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int) -> Index:
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(term, kind="stable")
        doc, tf = doc[order], tf[order]
        impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * length[doc])
        begins = np.zeros(n_terms + 1, np.int64)
        np.cumsum(np.bincount(term, minlength=n_terms), out=begins[1:])
        bounds = np.zeros(n_terms, np.int64)
        held = np.flatnonzero(np.diff(begins))
        if len(held):
            bounds[held] = np.maximum.reduceat(impacts, begins[held])
        return cls(ids, begins, doc, impacts, bounds)

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.begins[term], self.begins[term + 1]
        return self.docs[a:b], self.impacts[a:b]

    def search(self, term: np.ndarray, factor: np.ndarray, best: Best) -> None:
        """Add this index's best documents for an item whose terms count with the given factors.

        Short lists are added up, which leaves one iterator of documents and sums, bounded by
        the largest sum. Then documents are visited in order, a stride at a time: only the sums
        and those long lists whose bounds can reach the threshold together bring documents up;
        the other lists are asked for these documents alone, by binary search, and a document
        is dropped as soon as what it can still get does not reach the threshold.
        """
        n = self.begins[term + 1] - self.begins[term]
        term, factor, n = term[n > 0], factor[n > 0], n[n > 0]
        short = n <= SHORT * len(self.ids)
        sums = np.zeros(len(self.ids), np.int64)
        for t, w in zip(term[short].tolist(), factor[short].tolist(), strict=True):
            docs, impacts = self.list(t)
            sums[docs] += w * impacts  # a list names a document once
        summed = np.flatnonzero(sums)
        least = best.least
        if len(summed) >= best.k:  # sums are lower bounds of scores
            least = max(least, int(np.partition(sums[summed], len(summed) - best.k)[len(summed) - best.k]))
        bound = factor * self.bounds[term]
        order = np.argsort(bound[~short], kind="stable")
        lists = [(*self.list(t), w) for t, w in zip(term[~short][order].tolist(), factor[~short][order].tolist(), strict=True)]
        upto = np.concatenate([[0], np.cumsum(bound[~short][order])])  # what the lists below each one give at most
        if int(sums[summed].max(initial=0)) + upto[-1] < least:
            return
        for low in range(0, len(self.ids), STRIDE):
            high = min(low + STRIDE, len(self.ids))
            skipped = int(np.searchsorted(upto[1:], least, "left"))  # their bounds together stay below the threshold
            if skipped == len(lists):
                a, b = np.searchsorted(summed, (low, high))
                docs = summed[a:b]
                scores = sums[docs]
            else:
                dense = sums[low:high].copy()
                for held, impacts, w in lists[skipped:]:
                    a, b = np.searchsorted(held, (low, high))
                    dense[held[a:b] - low] += w * impacts[a:b]
                docs = np.flatnonzero(dense)
                scores = dense[docs]
                docs = docs + low
            for k in range(skipped - 1, -1, -1):
                alive = scores + upto[k + 1] >= least
                docs, scores = docs[alive], scores[alive]
                if not len(docs):
                    break
                held, impacts, w = lists[k]
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                scores = scores + np.where(held[at] == docs, w * impacts[at], 0)
            alive = scores >= least
            if alive.any():
                best.add(scores[alive], self.ids[docs[alive]])
                least = max(least, best.least)


def shard_hits(docs: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``item, doc_id, score``: of each item the ``k`` best documents of each task, which hold the best of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        best = {item: Best(k, empty, empty) for item, _, _ in items}
        for batch in batches:
            ids = pc.fill_null(batch.column(0), _NO_ID).to_numpy()
            length = 25 + (75 * batch.column(1).to_numpy() * n_docs) // max(1, n_words)
            sizes = batch.column(2).value_lengths().to_numpy()
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for a, b in slices(ends, POSTINGS):
                part = slice(ends[a], ends[b])
                index = Index.of(ids[a:b], length[a:b], sizes[a:b], term[part], tf[part], n_terms)
                for item, own, factor in items:
                    index.search(own, factor, best[item])
        for item, b in best.items():
            found = pa.array(b.ids, pa.int64(), mask=b.ids == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.ids), item, np.int64)), found, pa.array(b.scores)], ["item", "doc_id", "score"])

    return docs.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each item by rare shared terms, in integers throughout.

    Returns ``item_id, rank, doc_id, score``; documents without a shared term that counts do
    not appear, equal scores are ranked by ascending id. Documents are read once per block of
    items and reduced to the counts of the items' terms; statistics are those of all documents.
    Every task indexes its documents and keeps ``k`` of them per item, so what is ranked at
    the end is ``k`` rows per item and task.

    Ids of documents are integers; a row without one is ranked after others of its score. Null
    and empty texts have no terms: such items get no rows, such documents are not counted. Rows
    that repeat a document id are ranked each; rows that repeat an item id and its text are one
    item, other rows that repeat its id are ranked apart. No rows on either side give no rows;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    asked = stage(item_terms(asked), "item-terms")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_terms)
    out = None
    for number in range(blocks):
        # About ``block_terms`` terms: the number of blocks was chosen so.
        part = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == number).collect()
        vocabulary = sorted({bytes(t) for r in part for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        counted = stage(forward(own, vocabulary), "forward")
        n_docs, n_words = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
        weights = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(vocabulary))], np.int64)
        known = []
        for i, r in enumerate(part):
            term = np.array([place[bytes(t)] for t in r["terms"]], np.int64)
            factor = weights[term] * np.array(r["repeats"], np.int64)
            known.append((i, term[factor > 0], factor[factor > 0]))
        hits = shard_hits(counted, known, len(vocabulary), n_docs, n_words, k)
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        hits = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], T.StructType([T.StructField("item", T.LongType()), asked.schema["item_id"]]))
        ranked = hits.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = spark.createDataFrame([], T.StructType([asked.schema["item_id"], *(T.StructField(c, t) for c, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType())))]))
    return out
