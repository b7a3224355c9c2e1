"""Regression trees over binned features, grown leaf by leaf."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from heapq import heappop, heappush

import numpy as np

#: Rows of a node up to which they are sorted instead of counted into a histogram.
FEW = 100
#: Rows of a node above which features are counted by columns that several of them share, and the cells of such a column at most.
MANY, CELLS = 2000, 1 << 12
#: Rows whose gradients are added up as floating-point numbers at a time, which is exact for so many.
EXACT = 1 << 18

#: A split must gain more than this share of the terms it is the difference of, which is their rounding error.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Growth:
    """When growing ends: leaves and depth of a tree (None: no limit), and rows of a leaf at least."""

    leaves: int | None = 31
    depth: int | None = None
    least: int = 8


class Layout:
    """Where the bins of each feature lie in one histogram of all features.

    A value falls into the bin numbered by how many cuts of its feature are below it.
    """

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = [np.asarray(c, np.float64) for c in cuts]
        sizes = np.array([len(c) + 1 for c in self.cuts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.total = int(sizes.sum())
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        self.sizes = sizes.tolist()
        #: Features that share a column, largest first, each put where it still fits.
        self.shared: list[list[int]] = []
        cells: list[int] = []
        for f in sorted(range(len(sizes)), key=lambda f: -self.sizes[f]):
            at = next((k for k, c in enumerate(cells) if c * self.sizes[f] <= CELLS), len(cells))
            if at == len(cells):
                self.shared.append([])
                cells.append(1)
            self.shared[at].append(f)
            cells[at] *= self.sizes[f]

    def bins(self, values: np.ndarray) -> np.ndarray:
        """The bin of each value of a matrix, a row per row and a column per feature."""
        out = np.empty(values.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, values[:, f], "left")
        return out

    def columns(self, bins: np.ndarray) -> Columns:
        """The matrix turned, and a number per row for each group of features that share a column."""
        turned = np.ascontiguousarray(bins.T)
        cells = np.zeros((len(self.shared), len(bins)), np.uint16)
        for cell, features in zip(cells, self.shared, strict=True):
            for f in features:
                cell *= np.uint16(self.sizes[f])
                cell += turned[f]
        return Columns(turned, cells)

    def counted(self, columns: Columns, rows: np.ndarray | slice | None, g: np.ndarray) -> Histogram:
        """``histogram`` of some rows (None: all) from shared columns, whose cells are added up by feature; ``g`` is that of the rows."""
        if len(g) > EXACT:
            cuts = [slice(a, a + EXACT) for a in range(0, len(g), EXACT)]
            return reduce(Histogram.__add__, (self.counted(columns, cut if rows is None else rows[cut], g[cut]) for cut in cuts))
        out = np.zeros((2, self.total))

        def add_up(cells: np.ndarray, features: list[int]) -> None:
            if len(features) == 1:
                first = self.starts[features[0]]
                out[:, first : first + self.sizes[features[0]]] = cells
                return
            half = len(features) // 2
            cells = cells.reshape(2, math.prod(self.sizes[f] for f in features[:half]), -1)
            add_up(cells.sum(axis=2), features[:half])
            add_up(cells.sum(axis=1), features[half:])

        for cell, features in zip(columns.cells, self.shared, strict=True):
            code = (cell if rows is None else cell[rows]).astype(np.intp)
            size = math.prod(self.sizes[f] for f in features)
            add_up(np.stack([np.bincount(code, minlength=size), np.bincount(code, g, size)]), features)
        counts, sums = out.astype(np.int64)
        return Histogram(counts, sums)

    def histogram(self, bins: np.ndarray, g: np.ndarray) -> Histogram:
        """Rows and sums of ``g`` per bin. Both are exact as long as the sums of ``EXACT`` rows stay below 2 to the 53."""
        if len(g) > MANY:
            return self.counted(self.columns(bins), None, g)
        codes = (bins + self.starts).ravel()
        counts = np.bincount(codes, minlength=self.total)
        sums = np.bincount(codes, np.repeat(g, bins.shape[1]), self.total)
        return Histogram(counts.astype(np.int64), sums.astype(np.int64))


@dataclass
class Columns:
    """Binned rows by feature: ``bins`` with a row per feature, ``cells`` with one per group of features that share a column."""

    bins: np.ndarray
    cells: np.ndarray


@dataclass
class Histogram:
    counts: np.ndarray
    sums: np.ndarray

    def __sub__(self, other: Histogram) -> Histogram:
        return Histogram(self.counts - other.counts, self.sums - other.sums)

    def __add__(self, other: Histogram) -> Histogram:
        return Histogram(self.counts + other.counts, self.sums + other.sums)


@dataclass
class Node:
    """``n`` rows whose gradients add up to ``g``; ``known`` once it is settled how the node is split best, if at all."""

    n: int
    g: int
    depth: int = 0
    known: bool = False
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    children: list[Node] = field(default_factory=list)

    @property
    def splits(self) -> bool:
        return self.feature >= 0

    def split_by(self, layout: Layout, h: Histogram, least: int) -> None:
        """Settle the split of the greatest gain, of equals the first."""
        self.known = True
        counts, sums = np.cumsum(h.counts), np.cumsum(h.sums)
        before = layout.starts - 1
        none = before < 0
        nl = counts - np.where(none, 0, counts[before])[layout.feature]
        gl = sums - np.where(none, 0, sums[before])[layout.feature]
        nr, gr = self.n - nl, (self.g - gl).astype(np.float64)
        gl = gl.astype(np.float64)
        allowed = np.flatnonzero((nl >= least) & (nr >= least))
        if not len(allowed):
            return
        nl, nr, gl, gr = nl[allowed], nr[allowed], gl[allowed], gr[allowed]
        parts = gl * gl / nl + gr * gr / nr
        gain = parts - float(self.g) * float(self.g) / self.n
        k = int(np.argmax(gain))
        if gain[k] <= LEAST_GAIN * parts[k]:
            return
        at = int(allowed[k])
        self.gain, self.feature = float(gain[k]), int(layout.feature[at])
        self.bin = at - int(layout.starts[self.feature])
        left_g = int(sums[at] - (sums[layout.starts[self.feature] - 1] if layout.starts[self.feature] else 0))
        self.children = [Node(int(nl[k]), left_g, self.depth + 1), Node(int(nr[k]), self.g - left_g, self.depth + 1)]

    def split_by_rows(self, bins: np.ndarray, g: np.ndarray, least: int) -> None:
        """The same from the rows themselves, sorted by each feature; cheaper than a histogram where rows are few."""
        self.known = True
        n = len(g)
        order = np.argsort(bins, axis=0, kind="stable")
        ranked = np.take_along_axis(bins, order, axis=0)[least - 1 : n - least + 1]
        sums = np.cumsum(g[order], axis=0)[least - 1 : n - least]
        ends = ranked[:-1] < ranked[1:]  # the last row of its bin
        if not ends.any():
            return
        nl = np.arange(least, n - least + 1, dtype=np.float64)[:, None]
        rest = self.g - sums
        parts = (sums * sums / nl + rest * rest / (n - nl)).T
        gain = np.where(ends.T, parts - float(self.g) * float(self.g) / n, -np.inf)
        feature, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[feature, at] <= LEAST_GAIN * parts[feature, at]:
            return
        self.gain, self.feature, self.bin = float(gain[feature, at]), int(feature), int(ranked[at, feature])
        left_n, left_g = least + int(at), int(sums[at, feature])
        self.children = [Node(left_n, left_g, self.depth + 1), Node(n - left_n, self.g - left_g, self.depth + 1)]

    def stays(self, growth: Growth) -> bool:
        """Whether the node is a leaf whatever its rows are."""
        return self.n < 2 * growth.least or (growth.depth is not None and self.depth >= growth.depth)


def best_first(root: Node, growth: Growth, meet: Callable[[Node], None], left: int | None = None) -> list[Node]:
    """The nodes that are split, in order: always the known one of the greatest gain, until there are enough leaves.

    ``meet`` is called for each node that comes up and is not known; it may settle it at once.
    What is still unknown then is passed over, and its descendants with it.
    """
    queue: list[tuple[float, int, Node]] = []
    turn, out = 0, []
    budget = (growth.leaves - 1 if growth.leaves else None) if left is None else left

    def enter(node: Node) -> None:
        nonlocal turn
        if node.stays(growth):
            return
        if not node.known:
            meet(node)
        if node.known and node.splits:
            heappush(queue, (-node.gain, turn, node))
            turn += 1

    enter(root)
    while queue and (budget is None or len(out) < budget):
        node = heappop(queue)[2]
        out.append(node)
        if budget is not None and len(out) == budget:
            break  # its children are leaves
        for child in node.children:
            enter(child)
    return out


def grow_rows(
    root: Node, bins: np.ndarray, g: np.ndarray, layout: Layout, growth: Growth, budget: int | None, rows: np.ndarray | None = None, columns: Columns | None = None
) -> list[Node]:
    """Settle all nodes below ``root`` that can be split with ``budget`` splits, and return those that are split.

    The node holds the given ``rows`` (None: all), one that is drawn several times as often.
    ``columns`` are those of ``bins``, for callers that grow many trees on the same rows.

    Of two children only the smaller one's histogram is counted; the other's is the difference.
    Nodes of few rows have no histogram: their rows are sorted, which finds the same splits.
    """
    rows_of: dict[int, np.ndarray] = {id(root): np.arange(len(g)) if rows is None else rows}
    if columns is None and len(rows_of[id(root)]) > MANY:
        columns = layout.columns(bins)
    held: dict[int, Histogram] = {}
    parent: dict[int, Node] = {}

    def rows_here(node: Node) -> np.ndarray:
        if id(node) not in rows_of:
            above = parent[id(node)]
            rows = rows_of.pop(id(above))
            goes_left = (bins[rows, above.feature] if columns is None else columns.bins[above.feature][rows]) <= above.bin
            for child, mine in zip(above.children, (goes_left, ~goes_left), strict=True):
                rows_of[id(child)] = rows[mine]
        return rows_of[id(node)]

    def counted(node: Node) -> Histogram:
        rows = rows_here(node)
        if columns is not None and len(rows) > MANY:
            return layout.counted(columns, rows, g[rows])
        return layout.histogram(bins[rows], g[rows])

    def histogram(node: Node) -> Histogram:
        if id(node) not in held:
            above = parent.get(id(node))
            if above is None or id(above) not in held:
                held[id(node)] = counted(node)
            else:
                h = held.pop(id(above))
                small, other = sorted(above.children, key=lambda c: c.n)
                held[id(small)] = counted(small)
                if other.n > FEW:
                    held[id(other)] = h - held[id(small)]
                if small.n <= FEW:
                    del held[id(small)]
        return held[id(node)]

    def settle(node: Node) -> None:
        if node.n > FEW:
            node.split_by(layout, histogram(node), growth.least)
        else:
            rows = rows_here(node)
            node.split_by_rows(bins[rows], g[rows], growth.least)
        if node.splits:
            parent.update((id(c), node) for c in node.children)
        else:
            held.pop(id(node), None)

    return best_first(root, growth, settle, budget)


def to_records(root: Node) -> np.ndarray:
    """The known nodes below ``root``, ``root`` first: ``rows, sum, gain, feature, bin``, the left child's ``n, g``, and ``left, right`` (-1 where a child is not known)."""
    rows, order = [], [root]
    for node in order:
        order.extend(c for c in node.children if c.known)
    number = {id(n): k for k, n in enumerate(order)}
    for node in order:
        left, right = (number.get(id(c), -1) for c in node.children) if node.splits else (-1, -1)
        first = node.children[0] if node.splits else None
        rows.append((node.n, node.g, node.gain, node.feature, node.bin, first.n if first else 0, first.g if first else 0, left, right))
    return np.array(rows, [("rows", "i8"), ("sum", "i8"), ("gain", "f8"), ("feature", "i4"), ("bin", "i4"), ("n", "i8"), ("g", "i8"), ("left", "i4"), ("right", "i4")])


def from_records(root: Node, rows: np.ndarray) -> None:
    """Settle ``root`` and what is below it from records."""
    todo = [(root, 0)]
    while todo:
        node, k = todo.pop()
        r = rows[k]
        node.known = True
        if r["feature"] < 0:
            continue
        node.gain, node.feature, node.bin = float(r["gain"]), int(r["feature"]), int(r["bin"])
        node.children = [Node(int(r["n"]), int(r["g"]), node.depth + 1), Node(node.n - int(r["n"]), node.g - int(r["g"]), node.depth + 1)]
        todo += [(c, int(r[side])) for c, side in zip(node.children, ("left", "right"), strict=True) if r[side] >= 0]


@dataclass
class Tree:
    """A finished tree as arrays; a node without a feature is a leaf and has a value."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def leaf(cls) -> Tree:
        one = lambda x: np.array([x], np.int32)
        return cls(one(-1), one(0), one(-1), one(-1), np.zeros(1), np.zeros(1))

    @classmethod
    def of(cls, root: Node, split: list[Node]) -> tuple[Tree, list[Node]]:
        """The tree of the nodes that are split, without values, and its nodes."""
        chosen = {id(n) for n in split}
        order = [root]
        for node in order:
            if id(node) in chosen:
                order.extend(node.children)
        number = {id(n): k for k, n in enumerate(order)}
        inner = [id(n) in chosen for n in order]
        link = [[number[id(c)] for c in n.children] if i else [-1, -1] for n, i in zip(order, inner, strict=True)]
        tree = cls(
            np.array([n.feature if i else -1 for n, i in zip(order, inner, strict=True)], np.int32),
            np.array([n.bin if i else 0 for n, i in zip(order, inner, strict=True)], np.int32),
            np.array([a for a, _ in link], np.int32),
            np.array([b for _, b in link], np.int32),
            np.zeros(len(order)),
            np.array([n.gain if i else 0.0 for n, i in zip(order, inner, strict=True)]),
        )
        return tree, order

    @classmethod
    def of_records(cls, rows: np.ndarray) -> Tree:
        """The tree of all splits in records, with the mean of each leaf as its value."""
        inner = rows["feature"] >= 0
        side = {"left": (rows["n"], rows["g"]), "right": (rows["rows"] - rows["n"], rows["sum"] - rows["g"])}
        total, link = [(rows["rows"], rows["sum"])], {}
        at = len(rows)
        for name, (n, g) in side.items():
            last = inner & (rows[name] < 0)  # children that stay leaves have no record
            link[name] = np.where(inner, rows[name], -1)
            link[name][last] = np.arange(at, at + last.sum())
            at += int(last.sum())
            total.append((n[last], g[last]))
        n, g = (np.concatenate([t[k] for t in total]) for k in (0, 1))
        pad = lambda x, fill: np.concatenate([x, np.full(at - len(rows), fill, x.dtype)])
        value = np.where(pad(inner, False), 0.0, g / np.maximum(n, 1))
        split = [pad(np.where(inner, rows[c], fill), fill) for c, fill in (("feature", -1), ("bin", 0))]
        return cls(*split, *(pad(link[c].astype(np.int32), -1) for c in ("left", "right")), value, pad(np.where(inner, rows["gain"], 0.0), 0.0))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at = np.zeros(len(bins), np.int32)
        moving = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(moving):
            node = at[moving]
            goes_left = bins[moving, self.feature[node]] <= self.bin[node]
            at[moving] = node = np.where(goes_left, self.left[node], self.right[node])
            moving = moving[self.feature[node] >= 0]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]

    def leaves_by_column(self, bins: np.ndarray) -> np.ndarray:
        """``leaves`` for bins with a row per feature."""
        at = np.zeros(bins.shape[1], np.int32)
        todo = [(0, np.arange(bins.shape[1]))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                at[rows] = node
                continue
            goes_left = bins[self.feature[node]][rows] <= self.bin[node]
            todo += [(self.left[node], rows[goes_left]), (self.right[node], rows[~goes_left])]
        return at

    def graft(self, below: dict[int, Tree]) -> Tree:
        """The tree with other trees in place of some of its leaves."""
        parts = {c: [getattr(self, c).copy()] for c in ("feature", "bin", "left", "right", "value", "gain")}
        end = len(self.feature)
        for leaf, tree in below.items():
            shift = end - 1  # its root takes the leaf's place, the other nodes come last
            moved = {c: np.where(getattr(tree, c) > 0, getattr(tree, c) + shift, getattr(tree, c)).astype(np.int32) for c in ("left", "right")}
            for c, part in parts.items():
                own = moved.get(c, getattr(tree, c))
                part[0][leaf] = own[0]
                part.append(own[1:])
            end += len(tree.feature) - 1
        return Tree(**{c: np.concatenate(part) for c, part in parts.items()})
