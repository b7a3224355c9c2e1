"""Near-duplicate documents from an inverted join of MinHash signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carespend.llm.components import components
from carespend.llm.joins import sized
from carespend.llm.text import LOWER, SPACED_WORD, column_bytes, mixed, slices, word_hashes, word_spans
from carespend.sources.io import stage

#: Coordinates of a signature.
COORDINATES = 64
#: The chance that a pair at the threshold shares fewer coordinates than are asked for, at most.
MISSED = 1e-9
#: Members of a family that are compared with as many others in one task.
BLOCK = 256
#: Shingles that are hashed or counted at a time.
_STRIP = 8192

_rng = np.random.Generator(np.random.PCG64(11))
_TIMES = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)[:, None] | np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)[:, None]


def least_matches(percent: int) -> int:
    """The most coordinates that linked pairs share but for a chance of ``MISSED``, by the binomial tail."""
    p, tail = percent / 100, 0.0
    for shared in range(COORDINATES + 1):
        tail += math.comb(COORDINATES, shared) * p**shared * (1 - p) ** (COORDINATES - shared)
        if tail > MISSED:
            return max(1, shared)
    return COORDINATES


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; of all words together if there are fewer."""
    lowered = LOWER[data]
    text, starts, ends = word_spans(lowered, offsets, SPACED_WORD)
    hashes = word_hashes(lowered, starts, ends)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    rolled = hashes
    for shift in range(1, k):
        rolled = mixed(rolled[: len(hashes) - shift] * np.uint64(0xD6E8FEB86659FD93) + hashes[shift:]) if len(hashes) > shift else rolled[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mixed(np.array([whole]) + h)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), _STRIP):
        strip = ((shingles[None, a : a + _STRIP] ^ _FLIP) * _TIMES) >> np.uint64(32)
        np.minimum(least, strip.min(axis=1), out=least)
    return least.astype("<u4").tobytes()


def _each_text(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for a, b in slices(offsets):
            yield batch.column(0).slice(a, b - a), shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, class, signature``; texts of the same class have the same shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_text(batches, k):
            columns = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_shingles", "class", "signature"])

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("signature", T.BinaryType())]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields]))


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, class, shingles`` of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_text(batches, k):
            classes = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            values = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(classes, pa.binary()), pa.ListArray.from_arrays(ends, values)], ["doc_id", "class", "shingles"])

    fields = [T.StructField("class", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields]))


def postings(classes: DataFrame) -> DataFrame:
    """``posting, rep``: each document under every coordinate and value of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").astype(np.int64).reshape(-1, COORDINATES)
            rows = np.repeat(np.arange(len(batch)), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array((values + places).ravel()), batch.column(0).take(pa.array(rows))], ["posting", "rep"])

    schema = T.StructType([T.StructField("posting", T.LongType()), T.StructField("rep", classes.schema["rep"].dataType)])
    return classes.select("rep", "signature").mapInArrow(run, schema)


def prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """``posting, rep, alone``: postings that can bring a document together with another of ``matches`` shared coordinates.

    Two documents with that many matches share one of their rarest ``COORDINATES - matches + 1``
    coordinates, so the longest lists are skipped. Coordinates that a document has ``alone``
    are the rarest of all; one with too many of them has no partner.
    """
    posted = stage(postings(classes), "postings")
    lengths = posted.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = posted.join(lengths, "posting").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "posting"))).alias("lists"))
    shared = shared.withColumn("alone", COORDINATES - F.size("lists")).where(F.size("lists") >= matches)
    rarest = F.slice("lists", F.lit(1), F.lit(COORDINATES - matches + 1) - F.col("alone"))
    return shared.select("rep", "alone", F.explode(rarest).alias("l")).select("l.posting", "rep", "alone")


def collisions(pairs: DataFrame) -> DataFrame:
    """``pivot, rep, matches``: the coordinates that two signatures share; ``pairs`` holds ``pivot, rep, one, two``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, COORDINATES) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((one == two).sum(axis=1), pa.int32())], ["pivot", "rep", "matches"])

    kind = pairs.schema["rep"].dataType
    fields = [T.StructField("pivot", kind), T.StructField("rep", kind), T.StructField("matches", T.IntegerType())]
    return pairs.select("pivot", "rep", "one", "two").mapInArrow(run, T.StructType(fields))


def linked(inter, size_a, size_b, percent: int):
    """The exact test, for columns as well as for arrays."""
    return 100 * inter >= percent * (size_a + size_b - inter)


def _forest(found: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that connect as much as all found ones do."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in found.tolist():
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def block_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Index pairs of linked sets, one from each side."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    tokens, number = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    often = np.bincount(number, minlength=len(tokens)) > 1  # others are in one set only
    column = np.where(often, np.cumsum(often) - 1, -1)[number]
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    row, column = row[column >= 0], column[column >= 0]
    inter = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(often.sum()), _STRIP):
        a, b = np.searchsorted(column, (first, first + _STRIP))
        held = np.zeros((len(left) + len(right), min(_STRIP, int(often.sum()) - first)), np.float32)
        held[row[a:b], column[a:b] - first] = 1
        inter += held[: len(left)] @ held[len(left) :].T
    return np.argwhere(linked(inter.astype(np.int64), sizes[0][:, None], sizes[1][None, :], percent))


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` among members of a family of which one at least is not linked with its pivot.

    ``members`` holds ``pivot, rep, out``. Families are cut into blocks by hash; each pair of
    blocks with unlinked members is compared in a task of its own, which returns only as many
    links as connect what it found.
    """
    count = lambda c: F.count(F.when(c, 1))
    sizes = members.groupBy("pivot").agg(count(F.col("out")).alias("n_out"), count(~F.col("out")).alias("n_in")).where("n_out > 0 AND n_out + n_in > 1")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = members.join(sizes.select("pivot", blocks("n_out").alias("b_out"), blocks("n_in").alias("b_in")), "pivot")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("out"), F.col("b_out")).otherwise(F.col("b_in"))).cast("int")
    dealt = dealt.withColumn("own", own)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # an unlinked member meets the unlinked blocks and the linked ones, a linked member the unlinked ones
    task = lambda a, b, kind: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"))
    own = F.col("own")
    among = F.transform(upto(F.col("b_out")), lambda j: task(F.least(own, j), F.greatest(own, j), "out"))
    with_in = F.transform(upto(F.col("b_in")), lambda j: task(own, j, "in"))
    from_in = F.transform(upto(F.col("b_out")), lambda j: task(j, own, "in"))
    tasks = F.when(F.col("out"), F.concat(among, with_in)).otherwise(from_in)
    rows = dealt.select("pivot", "rep", "out", "own", F.explode(tasks).alias("t")).select("pivot", "rep", "out", "own", "t.*")
    rows = rows.join(sets, "rep")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, second, kind = (key[k].as_py() for k in (1, 2, 3))
        out, own = np.array(table["out"]), np.array(table["own"])
        values = [np.asarray(s.values) for s in table["shingles"]]
        left = np.flatnonzero(out & (own == first))
        right = np.flatnonzero(out & (own == second)) if kind == "out" else np.flatnonzero(~out)
        if len(left) and len(right):
            found = block_links([values[k] for k in left], [values[k] for k in right], percent)
            pairs = np.stack([left[found[:, 0]], right[found[:, 1]]], axis=1)
            chosen = np.array(_forest(pairs[pairs[:, 0] != pairs[:, 1]], len(values)), np.int64).reshape(-1, 2)
        else:
            chosen = np.zeros((0, 2), np.int64)
        reps = table["rep"].combine_chunks() if isinstance(table["rep"], pa.ChunkedArray) else table["rep"]
        return pa.table({"u": reps.take(pa.array(chosen[:, 0])), "v": reps.take(pa.array(chosen[:, 1]))})

    kind = members.schema["rep"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])
    return rows.select("pivot", "a", "b", "kind", "rep", "out", "own", "shingles").groupBy("pivot", "a", "b", "kind").applyInArrow(run, schema)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``percent`` between their sets of ``k``-word shingles.

    Returns a row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``, where
    ``component_id`` is the least id that is reachable over links and kept rows are those ids.

    Texts of the same shingle set are one class. Classes are posted under each coordinate and
    value of their signature; the longest lists of each are skipped. Lists are not paired off:
    all their members meet one pivot first. Where the signatures of the two share too few
    coordinates they are not linked; the others are compared on full sets. Members that are
    not linked with the pivot go on to be compared with the rest, block by block. Every link
    between members of a list is found, or its ends are connected already. A linked pair meets
    in no list, or is passed over by its count, with a chance of at most 1e-9 each.

    Text is split at white space and A-Z is lower-cased. A text of fewer words than ``k`` has
    one shingle; null, empty and blank texts have none and are linked with nothing, as are rows
    without an id. Rows that repeat an id are one document, whose texts are linked with each
    other and keep their other links. No rows give no rows; other columns are ignored, whatever
    their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(signatures(own, k), "signatures")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = usable.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    several = sized(several.select(F.col("doc_id").alias("least"), F.lit(True).alias("several")), "ids-of-several-texts")
    classes = usable.groupBy("class").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("rows"))
    # A class goes by its least id, or by a hash where that id has several texts.
    own_rep = F.when(F.col("several"), F.xxhash64("class")).otherwise(F.col("least").cast("long"))
    classes = stage(classes.join(several, "least", "left").select("class", "least", own_rep.alias("rep"), "signature", "rows"), "classes")
    matches = least_matches(percent)
    lists = stage(prefixes(classes, matches), "lists")
    pivots = lists.groupBy("posting").agg(F.min(F.struct("alone", "rep")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = lists.join(pivots.select("posting", F.col("p.rep").alias("pivot")), "posting").where("rep <> pivot")
    stars = stage(stars.select("pivot", "rep").distinct(), "stars-to-check")
    signs = classes.select("rep", F.col("signature").alias("two"))
    counted = stars.join(signs, "rep").join(classes.select(F.col("rep").alias("pivot"), F.col("signature").alias("one")), "pivot")
    counted = stage(collisions(counted), "collisions")

    met = sized(counted.select("rep").union(counted.select("pivot")).distinct(), "met")
    wanted = classes.select(F.col("least").alias("doc_id"), "class", "rep").join(met, "rep", "left_semi")
    wanted = sized(wanted, "wanted")
    texts = own.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = full_sets(texts, k).join(wanted, ["doc_id", "class"]).dropDuplicates(["rep"])
    sets = stage(sets.select("rep", "shingles"), "sets")

    size = lambda c: F.size(c).cast("long")
    likely = counted.where(F.col("matches") >= matches).drop("matches")
    pairs = likely.join(sets, "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("center")), "pivot")
    test = linked(size(F.array_intersect("shingles", "center")), size("shingles"), size("center"), percent)
    checked = pairs.select("pivot", "rep", (~test).alias("out"))
    checked = stage(checked.unionByName(counted.where(F.col("matches") < matches).select("pivot", "rep", F.lit(True).alias("out"))), "checked")
    direct = checked.where("NOT out").select(F.col("pivot").alias("u"), F.col("rep").alias("v"))
    reps = classes.select("class", "rep")
    own_texts = usable.join(several, F.col("doc_id") == F.col("least"), "left_semi").join(reps, "class")
    hubs = own_texts.groupBy("doc_id").agg(F.min("rep").alias("u"))
    same_id = own_texts.join(hubs, "doc_id").select("u", F.col("rep").alias("v")).where("u <> v").distinct()
    merged = components(direct.unionByName(family_links(checked, sets, percent)).unionByName(same_id))

    labels = merged.join(classes.select(F.col("rep").alias("u"), "least"), "u")
    labels = labels.join(labels.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    labels = stage(labels.select(F.col("u").alias("rep"), "component_id"), "labels")
    named = classes.where("rows > 1").select("class", "rep", "least").unionByName(classes.where("rows = 1").select("class", "rep", "least").join(labels.select("rep"), "rep", "left_semi"))
    named = named.join(labels, "rep", "left").select("class", F.coalesce("component_id", "least").alias("found"))
    usable_class = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class"))
    out = signed.withColumn("class", usable_class).join(named, "class", "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
