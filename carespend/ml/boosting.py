"""Boosted and bagged leaf-wise trees over binned features, for many fits at once."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carespend.ml import kernel
from carespend.ml.trees import LEAST_GAIN, Growth, Histogram, Layout, Node, Tree, best_first, from_records, grow_rows, to_records
from carespend.session import small_methods
from carespend.sources.io import read_meta, stage, unstage, write_meta
from carespend.sources.schema import TARGET

#: Bins of a feature, and rows of a block, at most.
BINS, BLOCK = 255, 8192
#: Values that a quantile sketch tells apart; up to so many rows quantiles are exact.
ACCURACY = 10_000
#: Rows of a node that one task takes to grow all that is below it; nodes with more rows are counted where the rows lie.
GATHERED = 1 << 18
#: Bins, which are bytes, of the rows of a fit that one task takes to grow all its trees.
ALONE = 1 << 26
#: Bits of a gradient, so that sums of 2 to the 19 of them are exact as floating-point numbers.
BITS = 34
#: How far above the first gradients later ones may lie.
HEADROOM = 8
#: Rounds after which the scores of all rows are written; later rounds start from there.
STAGED = 10
#: Trees that are grown together.
TOGETHER = 64
#: Rows that a task counts at least, where there are so many, and at a time.
TASK_ROWS, STRIP = 1 << 12, 1 << 16
#: Histograms of a node that one task adds up, about, and tasks that do so at most.
ADDED, SLOTS = 64, 16
#: Tasks per core for the fits that one task grows.
LOTS = 2


@dataclass(frozen=True)
class Settings:
    """``quantile``: the quantile to predict, by pinball loss; without one it is the mean, by squared loss.

    ``subsample`` is the share of rows that a round sees; with ``bootstrap`` it sees each row as
    often as a draw with replacement would, once on average.
    """

    rounds: int = 300
    rate: float = 0.05
    leaves: int | None = 31
    depth: int | None = None
    least: int = 8
    subsample: float = 1.0
    quantile: float | None = None
    bootstrap: bool = False
    seed: int = 42

    @property
    def growth(self) -> Growth:
        return Growth(self.leaves, self.depth, self.least)


@dataclass(frozen=True)
class Fit:
    """Settings and the rows to fit: all, those of any part but one, or those of parts below one."""

    settings: Settings
    without: int | None = None
    below: int | None = None

    def uses(self, part: np.ndarray) -> np.ndarray:
        used = np.ones(len(part), bool)
        if self.without is not None:
            used &= part != self.without
        if self.below is not None:
            used &= part < self.below
        return used


def feature_cuts(df: DataFrame, size: int, features: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins - 1`` values of each of ``size`` features between its bins, at equal shares of the rows; one pass."""
    values = df.select(vector_to_array(features).alias("v"))
    shares = "array(" + ", ".join(f"{k / bins}D" for k in range(1, bins)) + ")"
    row = values.agg(*[F.expr(f"percentile_approx(v[{f}], {shares}, {ACCURACY}) AS c{f}") for f in range(size)]).first() if size else []
    return [np.unique(np.array(c or [], np.float64)) for c in row]


def blocks(df: DataFrame, layout: Layout, label: str, features: str, part: str | None) -> DataFrame:
    """Rows of ``df`` packed: ``n, y, part, row, bins, scores``; the scores, one per fit and row, are left out while they are all 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                cut = batch.slice(a, BLOCK)
                values = cut.column(0).flatten().to_numpy().reshape(len(cut), -1)
                y, own, row = (cut.column(k).to_numpy() for k in (1, 2, 3))
                content = [y.astype("<f8"), own.astype("<i4"), row.astype("<i8"), layout.bins(values), np.zeros(0)]
                yield pa.RecordBatch.from_arrays([pa.array([len(cut)], pa.int32()), *(pa.array([x.tobytes()]) for x in content)], _BLOCK_NAMES)

    values = vector_to_array(features)
    own = F.col(part).cast("int") if part else F.lit(0)
    rows = df.select(values, F.col(label).cast("double"), own, F.xxhash64(values, F.col(label)))
    return rows.mapInArrow(run, _BLOCK)


@dataclass
class Binned:
    """Rows as staged blocks, for all fits that read them."""

    layout: Layout
    frame: DataFrame


def binned(df: DataFrame, label: str, features: str, part: str | None) -> Binned:
    # A count needs no features, and one vector tells the length of all.
    with small_methods(df.sparkSession):
        n, one = df.count(), df.select(features).where(F.col(features).isNotNull()).first()
        layout = Layout(feature_cuts(df, one[0].size if one else 0, features))
        frame = stage(blocks(df.coalesce(max(1, -(-n // TASK_ROWS))), layout, label, features, part), "boosting")
    return Binned(layout, frame.persist(StorageLevel.MEMORY_AND_DISK))


_BLOCK = "n int, y binary, part binary, row binary, bins binary, scores binary"
_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]


@dataclass
class Block:
    y: np.ndarray
    part: np.ndarray
    row: np.ndarray
    bins: np.ndarray
    scores: np.ndarray


def read_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    kinds = ("<f8", "<i4", "<i8", np.uint8, "<f8")
    for batch in batches:
        for k in range(len(batch)):
            y, part, row, bins, scores = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in enumerate(kinds, 1))
            n = batch.column(0)[k].as_py()
            yield Block(y, part, row, bins.reshape(n, -1), scores.reshape(-1, n))


def merged(found: Iterable[Block]) -> Iterator[Block]:
    """Blocks of about ``STRIP`` rows."""
    held: list[Block] = []

    def together() -> Block:
        join = lambda c, axis=0: np.concatenate([getattr(b, c) for b in held], axis=axis)
        scores = join("scores", 1) if all(len(b.scores) for b in held) else np.zeros((0, sum(len(b.y) for b in held)))
        return Block(join("y"), join("part"), join("row"), join("bins"), scores)

    for block in found:
        if not len(block.y):
            continue
        held.append(block)
        if sum(len(b.y) for b in held) >= STRIP:
            yield together()
            held = []
    if held:
        yield together()


def drawn(row: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each row, another one each round, by a hash of what the row holds."""
    x = row.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


#: The chance that a row is drawn at most 0, 1, 2, ... times, once on average.
_DRAWS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass
class State:
    """What tasks need to know of a fit: its settings, base and scale, and the trees since scores were last written."""

    fit: Fit
    base: float = 0.0
    scale: float = 1.0
    trees: tuple[Tree, ...] = ()

    def scores(self, block: Block, k: int) -> np.ndarray:
        out = block.scores[k].copy() if len(block.scores) else np.zeros(len(block.y))
        for tree in self.trees:
            out += tree.predict(block.bins)
        return out

    def used(self, block: Block, turn: int) -> np.ndarray:
        """Numbers of the rows that a round sees, one that is drawn several times as often."""
        rows, s = np.flatnonzero(self.fit.uses(block.part)), self.fit.settings
        if s.bootstrap:
            return np.repeat(rows, np.searchsorted(_DRAWS, drawn(block.row[rows], s.seed, turn), "right"))
        return rows[drawn(block.row[rows], s.seed, turn) < s.subsample] if s.subsample < 1 else rows

    def gradients(self, block: Block, scores: np.ndarray) -> np.ndarray:
        """How the loss changes with the score, as whole numbers."""
        residual = scores + self.base - block.y
        q = self.fit.settings.quantile
        slope = residual if q is None else np.where(residual > 0, 1 - q, -q)
        return np.clip(np.rint(slope * self.scale), -(1 << BITS), 1 << BITS)

    def value(self, node: Node) -> float:
        """What a leaf adds to the score, by squared loss."""
        return self.fit.settings.rate * (-node.g / max(1, node.n) / self.scale)


@dataclass
class Boosted:
    """A fitted model: a base value and the trees that are added to it, each with the weight ``share``."""

    base: float
    trees: list[Tree]
    cuts: list[np.ndarray]
    features: str = "features"
    predictionCol: str = "prediction"
    share: float = 1.0

    def copy(self, names: dict | None = None) -> Boosted:
        return replace(self, predictionCol=(names or {}).get(self.predictionCol, self.predictionCol))

    def transform(self, df: DataFrame) -> DataFrame:
        layout, trees, base, share = Layout(self.cuts), self.trees, self.base, self.share

        @F.pandas_udf("double")
        def predict(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="float64")
            bins = layout.bins(np.stack(values.to_numpy()))
            return pd.Series(base + share * sum((t.predict(bins) for t in trees), np.zeros(len(bins))))

        return df.withColumn(self.predictionCol, predict(vector_to_array(self.features)))

    def leaves(self, df: DataFrame, name: str = "leaves") -> DataFrame:
        """Add the node of each tree that a row ends in."""
        layout, trees = Layout(self.cuts), self.trees

        @F.pandas_udf("array<int>")
        def find(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            bins = layout.bins(np.stack(values.to_numpy()))
            return pd.Series(list(np.stack([t.leaves(bins) for t in trees], axis=1)))

        return df.withColumn(name, find(vector_to_array(self.features)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model below ``path``, replacing what is there."""
        nodes = pd.concat([pd.DataFrame({"tree": k, "node": np.arange(len(t.feature)), **vars(t)}) for k, t in enumerate(self.trees)])
        spark.createDataFrame(nodes).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        cuts = [(f, c.tolist()) for f, c in enumerate(self.cuts)]
        spark.createDataFrame(cuts, "feature int, cuts array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cuts")
        write_meta(spark, f"{path}/ensemble", {"base": self.base, "features": self.features, "share": self.share})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        meta = read_meta(spark, f"{path}/ensemble")
        # Both tables are bounded by the settings: trees and leaves, features and bins.
        table = spark.read.parquet(f"{path}/trees").toPandas().sort_values(["tree", "node"])
        cuts = {r["feature"]: np.array(r["cuts"], np.float64) for r in spark.read.parquet(f"{path}/cuts").collect()}
        trees = [Tree(**{c: t[c].to_numpy(kind) for c, kind in _TREE.items()}) for _, t in table.groupby("tree")]
        return cls(meta["base"], trees, [cuts[f] for f in range(len(cuts))], meta["features"], share=meta["share"])

    @property
    def featureImportances(self) -> DenseVector:
        """Each feature's share of a tree's gains, as a mean over the trees that split at all."""
        total, n = np.zeros(len(self.cuts)), 0
        for t in self.trees:
            gains = np.bincount(t.feature[t.feature >= 0], t.gain[t.feature >= 0], len(self.cuts))
            if gains.sum() > 0:
                total, n = total + gains / gains.sum(), n + 1
        return DenseVector(total / max(1, n))


class Rounds:
    """The fits of one frame, grown together round by round.

    Each round asks for the best splits of nodes until all trees are complete. A node of many
    rows gets a histogram, counted where the rows lie and added up by feature bins; of two
    siblings the smaller one is counted and the other is the difference to their parent. A node
    of at most ``GATHERED`` rows goes to one task that grows all below it, and a fit of at most
    ``ALONE`` bins to one that grows all its trees, without a request per round. Either way the
    same splits come out: gradients are whole numbers, so sums do not depend on their order.

    Scores are written every few rounds, so a lost executor costs the work of one request.
    """

    def __init__(self, rows: Binned, fits: list[Fit], gathered: int | None = None):
        self.fits, self.gathered = fits, GATHERED if gathered is None else gathered
        #: Rows of a fit that is grown by one task.
        features = max(1, len(rows.layout.cuts))
        self.alone = min(max(GATHERED, ALONE // features), ((1 << 31) - 9) // features) if gathered is None else gathered
        self.layout, self.frame, self.written = rows.layout, rows.frame, False
        self.states = [State(f) for f in fits]
        self.trees: list[list[Tree]] = [[] for _ in fits]
        self.rows = [0] * len(fits)
        self.turn = 0
        self.slots = 1

    def hold(self, frame: DataFrame) -> None:
        """Write a frame, and keep it in memory for the requests to come."""
        old, self.frame = self.frame, stage(frame, "boosting").persist(StorageLevel.MEMORY_AND_DISK)
        if self.written:
            old.unpersist()
        self.written = True

    def start(self) -> None:
        """Base values and scales; fits of the same rows are summed up once."""
        fits = self.fits
        same: dict[tuple, int] = {}
        for k, f in enumerate(fits):
            same.setdefault((f.without, f.below), k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in read_blocks(batches):
                for k in same.values():
                    y = block.y[fits[k].uses(block.part)]
                    if len(y):
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (k, len(y), math.fsum(y), y.min(), y.max())], ["fit", "n", "s", "lo", "hi"])

        sums = self.frame.mapInArrow(run, "fit long, n long, s double, lo double, hi double").groupBy("fit")
        found = {r["fit"]: r for r in sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        if len(found) < len(same):
            raise ValueError("a fit has no rows")
        quantiles = self.leaf_quantiles([Tree.leaf()] * len(fits), every=True) if any(f.settings.quantile is not None for f in fits) else {}
        for k, (f, state) in enumerate(zip(fits, self.states, strict=True)):
            r, q = found[same[f.without, f.below]], f.settings.quantile
            self.rows[k] = r["n"]
            state.base = r["s"] / r["n"] if q is None else quantiles[k, 0]
            largest = max(r["hi"] - state.base, state.base - r["lo"]) * HEADROOM if q is None else 1.0
            bits = min(BITS, 62 - int(r["n"]).bit_length())
            state.scale = 2.0 ** (bits - math.frexp(largest)[1]) if largest > 0 else 1.0

    def run(self) -> list[Boosted]:
        self.start()
        alone = [k for k in range(len(self.fits)) if self.rows[k] <= self.alone]
        if alone:
            self.grow_alone(alone)
        rest = [k for k in range(len(self.fits)) if self.rows[k] > self.alone]
        self.slots = max(1, min(SLOTS, self.frame.rdd.getNumPartitions() // ADDED)) if rest else 1
        for self.turn in range(max((self.fits[k].settings.rounds for k in rest), default=0)):
            going = [k for k in rest if self.turn < self.fits[k].settings.rounds]
            grown: dict[int, Tree] = {}
            for first in range(0, len(going), TOGETHER):
                grown |= self.grow(going[first : first + TOGETHER])
            for k, tree in grown.items():
                self.trees[k].append(tree)
                if self.turn + 1 < self.fits[k].settings.rounds:
                    self.states[k].trees += (tree,)
            if (self.turn + 1) % STAGED == 0 and any(s.trees for s in self.states):
                self.write_scores()
        if self.written:
            self.frame.unpersist()
        return [Boosted(s.base, t, self.layout.cuts) for s, t in zip(self.states, self.trees, strict=True)]

    def grow_alone(self, chosen: list[int]) -> None:
        """All trees of fits of at most ``alone`` rows each. Fits of the same rows are dealt to tasks, each of which gets the rows once."""
        spark = self.frame.sparkSession
        same: dict[tuple, list[int]] = {}
        for k in chosen:
            same.setdefault((self.fits[k].without, self.fits[k].below), []).append(k)
        tasks = LOTS * spark.sparkContext.defaultParallelism
        lots = []
        for ks in same.values():
            n = min(len(ks), max(1, round(tasks * len(ks) / len(chosen))))
            lots += [ks[a::n] for a in range(n)]
        states = self.states

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in read_blocks(batches):
                for at, ks in enumerate(lots):
                    rows = states[ks[0]].fit.uses(block.part)
                    if not rows.any():
                        continue
                    content = [x[rows].tobytes() for x in (block.y, block.row, block.bins)]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at, int(rows.sum()), *content)], ["lot", "n", "y", "row", "bins"])

        sent = self.frame.mapInArrow(send, "lot long, n long, y binary, row binary, bins binary").repartitionById(len(lots), F.col("lot").cast("int"))
        grown = stage(kernel.grown(sent, self.known(lots), "fit long, turn long, " + ", ".join(f"{c} binary" for c in _TREE)), "trees")
        found: dict[int, list[tuple[int, Tree]]] = {}
        for r in grown.toLocalIterator():  # the trees of many fits are more than one result should hold
            tree = Tree(**{c: np.frombuffer(r[c], kind).copy() for c, kind in _TREE.items()})
            found.setdefault(r["fit"], []).append((r["turn"], tree))
        for k, trees in found.items():
            self.trees[k] += [tree for _, tree in sorted(trees, key=lambda t: t[0])]
        unstage(grown)

    def known(self, lots: list[list[int]]) -> bytes:
        """What the grower needs to know of bins, lots and fits."""
        layout, settings = self.layout, [f.settings for f in self.fits]
        ends = lambda xs: np.cumsum([len(x) for x in xs])
        ints = [layout.sizes, ends(layout.shared), sum(layout.shared, []), ends(lots), sum(lots, [])]
        ints += [[s.rounds for s in settings], *([-1 if x is None else x for x in xs] for xs in ([s.leaves for s in settings], [s.depth for s in settings]))]
        ints += [[s.least for s in settings], [s.bootstrap for s in settings]]
        doubles = [_DRAWS, [s.rate for s in settings], [s.subsample for s in settings], [math.nan if s.quantile is None else s.quantile for s in settings]]
        doubles += [[s.base for s in self.states], [s.scale for s in self.states], [LEAST_GAIN]]
        longs = [[s.seed for s in settings], self.rows]
        return kernel.packed(*(np.array(x, np.int32) for x in ints), *(np.array(x, np.int64) for x in longs), *(np.array(x, np.float64) for x in doubles))

    def write_scores(self) -> None:
        states = self.states

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = [np.stack([s.scores(block, k) for k, s in enumerate(states)]).tobytes() for block in read_blocks([batch])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.binary())], _BLOCK_NAMES)

        self.hold(self.frame.mapInArrow(run, _BLOCK))
        for s in self.states:
            s.trees = ()

    def grow(self, going: list[int]) -> dict[int, Tree]:
        """The next tree of each of some fits, with its leaf values."""
        roots = {k: Node(self.rows[k], 0) for k in going}
        above: dict[int, tuple[Node, Node]] = {}  # of a node its parent and its sibling
        held: dict[int, Histogram] = {}
        whole: dict[int, dict[int, Tree]] = {k: {} for k in going}  # by node, what one task has grown below it in trees without a limit of leaves
        while True:
            asked: dict[int, list[Node]] = {k: [] for k in going}
            split = {k: best_first(roots[k], self.fits[k].settings.growth, asked[k].append) for k in going}
            if not any(asked.values()):
                break
            for k in going:
                for node in split[k]:
                    a, b = node.children
                    above[id(a)], above[id(b)] = (node, b), (node, a)
            self.settle(roots, split, asked, above, held, whole)
        trees, nodes = {}, {}
        for k in going:
            trees[k], nodes[k] = Tree.of(roots[k], split[k])
        quantile = {k: f.settings.quantile for k, f in enumerate(self.fits)}
        leaf = self.leaf_quantiles([trees.get(k) if quantile[k] is not None else None for k in range(len(self.fits))]) if any(quantile[k] is not None for k in going) else {}
        for k in going:
            rate, state = self.fits[k].settings.rate, self.states[k]
            for at, node in enumerate(nodes[k]):
                if trees[k].feature[at] < 0:
                    trees[k].value[at] = state.value(node) if quantile[k] is None else rate * leaf.get((k, at), 0.0)
            if whole[k]:
                below = {at: whole[k][id(node)] for at, node in enumerate(nodes[k]) if id(node) in whole[k]}
                for tree in below.values():
                    tree.value *= -rate / state.scale
                trees[k] = trees[k].graft(below)
        return trees

    def settle(self, roots: dict, split: dict, asked: dict, above: dict, held: dict, whole: dict) -> None:
        """Find the best splits of the nodes asked for."""
        states, layout, turn, slots = self.states, self.layout, self.turn, self.slots
        trees, orders, small, large, nodes = {}, {}, {}, {}, {}
        for k, wanted in asked.items():
            if not wanted:
                continue
            trees[k], orders[k] = Tree.of(roots[k], split[k])
            number = {id(n): at for at, n in enumerate(orders[k])}
            growth = self.fits[k].settings.growth
            budget = None if growth.leaves is None else growth.leaves - 1
            for node in wanted:
                at = number[id(node)]
                nodes[k, at] = node
                if node.n <= self.gathered:
                    small[k, at] = (node.depth, growth, budget)
                else:
                    parent, sibling = above.get(id(node), (None, None))
                    counted = parent is None or id(parent) not in held or (sibling.n, number[id(sibling)]) > (node.n, at)
                    if counted:
                        large[k, at] = None
        for k, at in list(nodes):  # a sibling that is the smaller one is counted even if it is not asked for itself
            node = nodes[k, at]
            if (k, at) not in small and (k, at) not in large:
                sibling = above[id(node)][1]
                large[k, next(i for i, n in enumerate(orders[k]) if n is sibling)] = None

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], Histogram] = {}
            slot = 0
            for block in merged(read_blocks(batches)):
                slot = int(block.row[0]) % slots
                for k, tree in trees.items():
                    used = states[k].used(block, turn)
                    at = tree.leaves(block.bins[used])
                    g = states[k].gradients(block, states[k].scores(block, k))[used]
                    for leaf in np.unique(at).tolist():
                        key = (k, leaf)
                        if key not in small and key not in large:
                            continue
                        rows = np.flatnonzero(at == leaf)
                        bins, own = block.bins[used[rows]], g[rows]
                        if key in small:
                            yield _row(k, leaf, 0, len(rows), bins, own)
                        if key in large:
                            h = layout.histogram(bins, own)
                            sums[key] = sums[key] + h if key in sums else h
            for (k, leaf), h in sums.items():
                yield _row(k, leaf, 1 + slot, 0, h.counts, h.sums)

        def finish(key: tuple, table: pa.Table) -> pa.Table:
            k, leaf, slot = (x.as_py() for x in key)
            first, second = (table[c].to_pylist() for c in ("a", "b"))
            if slot:
                h = [np.sum([np.frombuffer(x, np.int64) for x in xs], axis=0) for xs in (first, second)]
                return pa.Table.from_batches([_row(k, leaf, slot, 0, *h)])
            g = np.frombuffer(b"".join(second), np.float64)
            bins = np.frombuffer(b"".join(first), np.uint8).reshape(len(g), -1)
            depth, growth, budget = small[k, leaf]
            root = Node(len(g), int(g.sum()), depth)
            if not root.stays(growth):
                grow_rows(root, bins, g, layout, growth, budget)
            return pa.Table.from_batches([_row(k, leaf, 0, len(g), to_records(root), np.array([root.g], np.int64))])

        found = self.frame.mapInArrow(count, _PART).groupBy("fit", "node", "slot").applyInArrow(finish, _PART).toArrow()
        fresh: dict[tuple[int, int], Histogram] = {}
        for r in found.to_pylist():
            key = (r["fit"], r["node"])
            if r["slot"]:
                h = Histogram(np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64))
                fresh[key] = fresh[key] + h if key in fresh else h
            else:
                node, rows = nodes[key], np.frombuffer(r["a"], _RECORD)
                node.n, node.g = r["n"], int(np.frombuffer(r["b"], np.int64)[0])
                fit = self.fits[key[0]].settings
                if fit.leaves is None and fit.quantile is None:
                    node.known, whole[key[0]][id(node)] = True, Tree.of_records(rows)
                else:
                    from_records(node, rows)
        for (k, at), h in fresh.items():
            held[id(orders[k][at])] = h
        for key, node in nodes.items():
            if key in small:
                if not node.known:  # no row came
                    node.known = True
                continue
            if id(node) not in held:
                parent, sibling = above[id(node)]
                held[id(node)] = held[id(parent)] - held[id(sibling)]
            h = held[id(node)]
            if id(node) not in above:  # a root: its rows are those drawn
                first = slice(0, len(layout.cuts[0]) + 1)
                node.n, node.g = int(h.counts[first].sum()), int(h.sums[first].sum())
            if node.stays(self.fits[key[0]].settings.growth):
                node.known = True
            else:
                node.split_by(layout, h, self.fits[key[0]].settings.least)
        for key, node in nodes.items():  # a parent's histogram has served when its children have theirs or need none
            if id(node) in above:
                parent, growth = above[id(node)][0], self.fits[key[0]].settings.growth
                if all(id(c) in held or c.known or c.stays(growth) for c in parent.children):
                    held.pop(id(parent), None)

    def leaf_quantiles(self, trees: list[Tree | None], every: bool = False) -> dict[tuple[int, int], float]:
        """Of each fit with a tree and a quantile, the residuals' quantile in each leaf."""
        states, turn = self.states, self.turn
        shares = sorted({f.settings.quantile for f in self.fits if f.settings.quantile is not None})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in read_blocks(batches):
                for k, tree in enumerate(trees):
                    state = states[k]
                    if tree is None or state.fit.settings.quantile is None:
                        continue
                    used = np.flatnonzero(state.fit.uses(block.part)) if every else state.used(block, turn)
                    residual = block.y[used] - state.base - state.scores(block, k)[used]
                    leaf = tree.leaves(block.bins[used]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int64)), pa.array(leaf), pa.array(residual)], ["fit", "leaf", "r"])

        found = self.frame.mapInArrow(run, "fit long, leaf long, r double").groupBy("fit", "leaf")
        rows = found.agg(F.percentile_approx("r", [float(q) for q in shares], ACCURACY).alias("q")).collect()
        return {(r["fit"], r["leaf"]): r["q"][shares.index(self.fits[r["fit"]].settings.quantile)] for r in rows}


_PART = "fit int, node int, slot int, n long, a binary, b binary"
_RECORD = to_records(Node(0, 0)).dtype
_TREE = {"feature": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32, "value": np.float64, "gain": np.float64}


def _row(k: int, leaf: int, slot: int, n: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [*(pa.array([x], pa.int32()) for x in (k, leaf, slot)), pa.array([n], pa.int64()), pa.array([a.tobytes()]), pa.array([b.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, ["fit", "node", "slot", "n", "a", "b"])


def fit_together(df: DataFrame, fits: list[Fit], label: str = TARGET, features: str = "features", part: str | None = None, gathered: int | None = None) -> list[Boosted]:
    """Fit several models on one frame, binned once; every round serves them all. ``part`` is the column that fits choose rows by."""
    rows = binned(df, label, features, part)
    try:
        models = Rounds(rows, fits, gathered).run()
    finally:
        rows.frame.unpersist()
        unstage(rows.frame)
    return [replace(m, features=features) for m in models]


@dataclass(frozen=True)
class Boosting:
    """A boosted learner with ``fit`` and ``transform`` as Spark's have them."""

    settings: Settings = Settings()
    label: str = TARGET
    features: str = "features"

    def fits(self, without: int | None = None, below: int | None = None) -> list[Fit]:
        return [Fit(self.settings, without, below)]

    def model(self, parts: list[Boosted]) -> Boosted:
        return parts[0]

    def fit(self, df: DataFrame) -> Boosted:
        return fit_learners(df, [(self, None, None)], self.label, self.features)[0]


@dataclass(frozen=True)
class Forest:
    """Trees of rows drawn with replacement, over all features at each split; the prediction is their mean."""

    trees: int = 300
    depth: int = 13
    least: int = 3
    seed: int = 42
    label: str = TARGET
    features: str = "features"

    def fits(self, without: int | None = None, below: int | None = None) -> list[Fit]:
        own = Settings(1, 1.0, None, self.depth, self.least, bootstrap=True)
        return [Fit(replace(own, seed=self.seed + k), without, below) for k in range(self.trees)]

    def model(self, parts: list[Boosted]) -> Boosted:
        return replace(parts[0], trees=[t for p in parts for t in p.trees], share=1 / len(parts))

    def fit(self, df: DataFrame) -> Boosted:
        return fit_learners(df, [(self, None, None)], self.label, self.features)[0]


def fit_learners(df: DataFrame, asked: list[tuple[Boosting | Forest, int | None, int | None]], label: str = TARGET, features: str = "features", part: str | None = None) -> list[Boosted]:
    """A model for each learner, without one part or below one where that is asked for; all are grown together."""
    each = [learner.fits(without, below) for learner, without, below in asked]
    # Forests take few large requests, boosting many small ones, so neither has to wait for the other.
    kinds = [[k for k, (learner, _, _) in enumerate(asked) if isinstance(learner, Forest) == forest] for forest in (True, False)]

    rows = binned(df, label, features, part)

    def fit(kind: list[int]) -> list[Boosted]:
        models = Rounds(rows, [f for k in kind for f in each[k]]).run() if kind else []
        return [replace(m, features=features) for m in models]

    fitted = {}
    try:
        with ThreadPoolExecutor(2) as pool:
            for kind, models in zip(kinds, pool.map(fit, kinds), strict=True):
                parts = iter(models)
                fitted |= {k: asked[k][0].model([next(parts) for _ in each[k]]) for k in kind}
    finally:
        rows.frame.unpersist()
        unstage(rows.frame)
    return [fitted[k] for k in range(len(asked))]


@dataclass
class Band:
    """Models of several quantiles, each giving a column ``q10``, ``q90``, ... In a row, a higher quantile is no less than a lower one."""

    models: dict[float, Boosted]

    def transform(self, df: DataFrame) -> DataFrame:
        out, upto = df, None
        for q in sorted(self.models):
            name = f"q{round(q * 100)}"
            out = self.models[q].copy({"prediction": name}).transform(out)
            if upto:
                out = out.withColumn(name, F.greatest(name, upto))
            upto = name
        return out


@dataclass(frozen=True)
class QuantileBoosting:
    """Boosted quantiles by pinball loss; after a tree is grown, its leaves are set to the quantile of their residuals."""

    qs: tuple[float, ...] = (0.1, 0.9)
    settings: Settings = Settings(rounds=200, rate=0.06, least=20)
    label: str = TARGET
    features: str = "features"

    def fit(self, df: DataFrame) -> Band:
        fits = [Fit(replace(self.settings, quantile=q)) for q in self.qs]
        return Band(dict(zip(self.qs, fit_together(df, fits, self.label, self.features), strict=True)))
