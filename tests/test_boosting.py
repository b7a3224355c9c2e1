"""Leaf-wise boosting against a plain grower that scans every split of every leaf."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from carespend.ml import boosting
from carespend.ml.boosting import Boosted, Boosting, Fit, QuantileBoosting, Settings, fit_together

N = 2000


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=N), rng.integers(0, 6, N), rng.uniform(0, 100, N), np.zeros(N), rng.integers(0, 2, N)])
    y = 300 * x[:, 0] + 80 * (x[:, 1] > 2) * x[:, 4] + x[:, 2] ** 1.5 + rng.normal(size=N) * 40
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(i, Vectors.dense(a), float(b), i % 3) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    return spark.createDataFrame(rows, ["id", "features", "y", "part"]).repartition(4).cache()


def plain_tree(bins, target, leaves, depth, least):
    """Rows of each leaf, and the splits in order, by trying all."""

    def best(rows):
        found = None
        for f in range(bins.shape[1]):
            for b in range(int(bins[rows, f].max()) if len(rows) else 0):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if len(left) < least or len(right) < least:
                    continue
                gain = target[left].sum() ** 2 / len(left) + target[right].sum() ** 2 / len(right) - target[rows].sum() ** 2 / len(rows)
                if gain > 1e-6 and (found is None or gain > found[0] * (1 + 1e-11)):
                    found = (gain, f, b, left, right)
        return found

    root = np.arange(len(bins))
    open_leaves, done, splits = [(root, 0, best(root) if depth is None or depth > 0 else None)], [], []
    while leaves is None or len(open_leaves) + len(done) < leaves:
        able = [x for x in open_leaves if x[2]]
        if not able:
            break
        top = max(able, key=lambda x: x[2][0])
        open_leaves = [x for x in open_leaves if x is not top]
        _, f, b, left, right = top[2]
        splits.append((f, b, len(left), len(right)))
        for rows in (left, right):
            open_leaves.append((rows, top[1] + 1, best(rows) if depth is None or top[1] + 1 < depth else None))
    return [x[0] for x in open_leaves] + done, splits


def plain_fit(x, y, cuts, s: Settings):
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    low = lambda v: np.sort(v)[int(np.ceil(s.quantile * len(v))) - 1]
    score = np.full(len(y), y.mean() if s.quantile is None else low(y))
    every = []
    for _ in range(s.rounds):
        slope = score - y if s.quantile is None else np.where(score > y, 1 - s.quantile, -s.quantile)
        leaves, splits = plain_tree(bins, slope, s.leaves, s.depth, s.least)
        for rows in leaves:
            score[rows] += s.rate * (-slope[rows].mean() if s.quantile is None else low((y - score)[rows]))
        every.append((splits, sorted(map(len, leaves))))
    return score, every


def shape(tree, bins):
    """Splits as feature, bin and rows on both sides, and the sizes of the leaves."""
    at = tree.leaves(bins)
    size = np.bincount(at, minlength=len(tree.feature))
    total = lambda k: size[k] if tree.feature[k] < 0 else total(tree.left[k]) + total(tree.right[k])
    splits = [(f, b, total(left), total(right)) for f, b, left, right in zip(tree.feature, tree.bin, tree.left, tree.right, strict=True) if f >= 0]
    return sorted(splits), sorted(size[tree.feature < 0].tolist())


def predictions(model, frame):
    rows = model.transform(frame).select("id", "prediction").collect()
    return np.array([p for _, p in sorted(map(tuple, rows))])


@pytest.mark.parametrize(
    "settings",
    [
        Settings(rounds=3, rate=0.3),
        Settings(rounds=2, rate=0.5, leaves=None, depth=4, least=4),
        Settings(rounds=2, rate=0.5, leaves=6, depth=2, least=300),
        Settings(rounds=2, rate=0.4, leaves=12, quantile=0.9, least=20),
        Settings(rounds=1, rate=0.4, leaves=2, least=5000),
    ],
)
def test_splits_and_leaves_equal_the_plain_grower(frame, data, settings):
    x, y = data
    model = Boosting(settings, "y").fit(frame)
    score, every = plain_fit(x, y, model.cuts, settings)
    bins = boosting.Layout(model.cuts).bins(x)
    for tree, (splits, sizes) in zip(model.trees, every, strict=True):
        got = shape(tree, bins)
        assert got == (sorted(splits), sizes)
        assert settings.leaves is None or len(got[1]) <= settings.leaves
        assert min(got[1]) >= min(settings.least, N)
    assert predictions(model, frame) == pytest.approx(score, rel=1e-7, abs=1e-6)


@pytest.mark.parametrize("gathered", [0, 150, 700])
def test_counted_and_gathered_nodes_give_the_same_trees(frame, data, gathered):
    """Histograms added up over tasks, siblings by subtraction, or rows in one task."""
    fits = [Fit(Settings(rounds=3, rate=0.3)), Fit(Settings(rounds=2, leaves=None, depth=3, subsample=0.6)), Fit(Settings(rounds=2, quantile=0.2))]
    here = fit_together(frame, fits, "y")
    there = fit_together(frame, fits, "y", gathered=gathered)
    for a, b in zip(here, there, strict=True):
        assert a.base == b.base and len(a.trees) == len(b.trees)
        bins = boosting.Layout(a.cuts).bins(data[0])
        for s, t in zip(a.trees, b.trees, strict=True):
            assert s.predict(bins).tolist() == t.predict(bins).tolist()
            assert sorted(zip(s.gain, s.feature, s.bin, strict=True)) == sorted(zip(t.gain, t.feature, t.bin, strict=True))


def test_scores_written_in_between_change_nothing(frame, monkeypatch):
    settings = Settings(rounds=5, rate=0.3, leaves=5)
    whole = predictions(Boosting(settings, "y").fit(frame), frame)
    monkeypatch.setattr(boosting, "STAGED", 2)
    assert predictions(Boosting(settings, "y").fit(frame), frame) == pytest.approx(whole, rel=1e-9)


def test_fits_use_their_rows_only(frame):
    settings = Settings(rounds=2, rate=0.5, leaves=4)
    together = fit_together(frame, [Fit(settings, without=1), Fit(settings, below=2), Fit(settings)], "y", part="part")
    for model, rows in zip(together, (frame.where("part <> 1"), frame.where("part < 2"), frame), strict=True):
        cuts = model.cuts
        alone = fit_together(rows, [Fit(settings)], "y")[0]
        if rows is frame:
            assert [t.value.tolist() for t in alone.trees] == [t.value.tolist() for t in model.trees]
        assert model.base == pytest.approx(rows.agg(F.avg("y")).first()[0])
        assert len(cuts) == len(alone.cuts)


def test_a_model_survives_saving(spark, frame, tmp_path):
    model = Boosting(Settings(rounds=2, leaves=5), "y").fit(frame)
    model.save(spark, str(tmp_path / "m"))
    again = Boosted.load(spark, str(tmp_path / "m"))
    assert predictions(again, frame).tolist() == predictions(model, frame).tolist()
    assert again.featureImportances.toArray().sum() == pytest.approx(1)


def test_quantiles_cover_what_they_say(frame, data):
    band = QuantileBoosting(settings=Settings(rounds=60, rate=0.1, least=20), label="y").fit(frame)
    out = band.transform(frame)
    assert out.columns[-2:] == ["q10", "q90"]
    got = out.agg(F.avg((F.col("y") <= F.col("q10")).cast("int")), F.avg((F.col("y") <= F.col("q90")).cast("int")), F.min(F.col("q90") - F.col("q10"))).first()
    assert got[0] == pytest.approx(0.1, abs=0.04) and got[1] == pytest.approx(0.9, abs=0.04) and got[2] >= 0


def test_one_constant_label(spark):
    df = spark.createDataFrame([(Vectors.dense([float(i)]), 7.0) for i in range(50)], ["features", "y"])
    model = Boosting(Settings(rounds=2), "y").fit(df)
    assert {r["prediction"] for r in model.transform(df).collect()} == {7.0}
    with pytest.raises(ValueError):
        Boosting(Settings(rounds=1), "y").fit(df.limit(0))


def test_a_forest_is_the_mean_of_trees_of_drawn_rows(spark, frame, data, tmp_path):
    x, y = data
    forest = boosting.Forest(trees=12, depth=6, least=3, label="y")
    model = forest.fit(frame)
    assert len(model.trees) == 12 and len({t.feature.tobytes() for t in model.trees}) > 1
    bins = boosting.Layout(model.cuts).bins(x)
    each = np.array([model.base + t.predict(bins) for t in model.trees])
    assert predictions(model, frame) == pytest.approx(each.mean(axis=0))
    assert 1 - ((y - each.mean(axis=0)) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.9
    model.save(spark, str(tmp_path / "f"))
    assert predictions(Boosted.load(spark, str(tmp_path / "f")), frame) == pytest.approx(each.mean(axis=0))
    leaves = {r["id"]: r["leaves"] for r in model.leaves(frame).select("id", "leaves").collect()}
    assert leaves[7] == [t.leaves(bins[7:8])[0] for t in model.trees]
    top = model.featureImportances.toArray()
    assert top[0] + top[2] > 0.9 and top[3] == 0


def test_rows_are_drawn_once_on_average():
    row = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    counts = np.searchsorted(boosting._DRAWS, boosting.drawn(row, 3, 0), "right")
    assert counts.mean() == pytest.approx(1, abs=0.01) and (counts == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert (boosting.drawn(row, 3, 0) < 0.85).mean() == pytest.approx(0.85, abs=0.01)
    assert np.corrcoef(boosting.drawn(row, 3, 0), boosting.drawn(row, 3, 1))[0, 1] == pytest.approx(0, abs=0.02)


def test_sorted_rows_and_histograms_split_alike():
    """The two ways to settle a node, with ties and few values."""
    from carespend.ml.trees import Layout, Node

    rng = np.random.default_rng(2)
    for turn in range(300):
        n, least = int(rng.integers(2, 60)), int(rng.integers(1, 6))
        cuts = [np.arange(k, dtype=float) for k in (1, 3, 9, 0)]
        bins = np.column_stack([rng.integers(0, len(c) + 1, n) for c in cuts]).astype(np.uint8)
        g = rng.integers(-5, 6, n).astype(float) * 2.0**30
        if n < 2 * least:
            continue
        a, b = Node(n, int(g.sum())), Node(n, int(g.sum()))
        layout = Layout(cuts)
        a.split_by(layout, layout.histogram(bins, g), least)
        b.split_by_rows(bins, g, least)
        assert (a.feature, a.bin, a.gain) == (b.feature, b.bin, b.gain), turn
        assert [(c.n, c.g) for c in a.children] == [(c.n, c.g) for c in b.children]


def test_a_tree_of_records_is_the_tree_of_its_nodes():
    from carespend.ml.trees import Growth, Layout, Node, Tree, best_first, grow_rows, to_records

    rng = np.random.default_rng(4)
    cuts = [np.arange(30.0), np.arange(3.0), np.zeros(0)]
    bins = np.column_stack([rng.integers(0, len(c) + 1, 500) for c in cuts]).astype(np.uint8)
    g = rng.integers(-1000, 1000, 500).astype(float)
    for growth in (Growth(None, 4, 3), Growth(None, None, 20), Growth(None, 0, 1), Growth(None, 9, 400)):
        root = Node(500, int(g.sum()))
        if not root.stays(growth):
            grow_rows(root, bins, g, Layout(cuts), growth, None)
        tree = Tree.of_records(to_records(root))
        other, order = Tree.of(root, best_first(root, growth, lambda n: None))
        other.value = np.array([n.g / n.n for n in order])
        assert tree.predict(bins) == pytest.approx(other.predict(bins))
        assert sorted(tree.gain[tree.gain > 0]) == sorted(other.gain[other.gain > 0])


def test_columns_that_features_share_give_the_same_histogram():
    from carespend.ml.trees import Layout

    rng = np.random.default_rng(6)
    cuts = [np.arange(float(k)) for k in (254, 1, 2, 9, 0, 60, 254, 1, 1, 2, 2, 2, 30)]
    bins = np.column_stack([rng.integers(0, len(c) + 1, 3000) for c in cuts]).astype(np.uint8)
    g = rng.integers(-(2**34), 2**34, 3000).astype(float)
    layout = Layout(cuts)
    assert len(layout.shared) < len(cuts) and sorted(f for fs in layout.shared for f in fs) == list(range(len(cuts)))
    for rows in (None, np.sort(rng.integers(0, 3000, 2500))):
        own = np.arange(3000) if rows is None else rows
        codes = (bins[own] + layout.starts).ravel()
        h = layout.counted(layout.columns(bins), rows, g[own])
        assert h.counts.tolist() == np.bincount(codes, minlength=layout.total).tolist()
        assert h.sums.tolist() == np.bincount(codes, np.repeat(g[own], len(cuts)), layout.total).tolist()


def test_a_fit_of_few_rows_needs_no_request_per_round(frame, monkeypatch):
    """Each round used to be a job of its own, so hundreds of rounds took minutes on few rows."""
    fits = [Fit(Settings(rounds=4, leaves=6)), Fit(Settings(rounds=3, quantile=0.3, leaves=6)), Fit(Settings(rounds=2, depth=3, leaves=None), without=1)]
    node_by_node = fit_together(frame, fits, "y", part="part", gathered=0)

    def no_round(*args):
        raise AssertionError("a request for a round")

    monkeypatch.setattr(boosting.Rounds, "grow", no_round)
    for a, b in zip(node_by_node, fit_together(frame, fits, "y", part="part"), strict=True):
        assert [t.value[t.feature < 0].tolist() for t in a.trees] == [t.value[t.feature < 0].tolist() for t in b.trees]


def test_subtrees_grown_apart_are_put_in_place(frame, data):
    """Trees without a limit of leaves, whose lower parts come from several tasks."""
    forest = boosting.Forest(trees=3, depth=7, least=3, label="y")
    whole, parts = (fit_together(frame, forest.fits(), "y", gathered=n) for n in (5000, 600))
    bins = boosting.Layout(whole[0].cuts).bins(data[0])
    for a, b in zip(whole, parts, strict=True):
        s, t = a.trees[0], b.trees[0]
        assert s.predict(bins).tolist() == t.predict(bins).tolist() and sorted(s.gain) == sorted(t.gain)
        assert s.leaves(bins).tolist() == s.leaves_by_column(np.ascontiguousarray(bins.T)).tolist()


def test_a_fit_of_more_rows_than_a_gathered_node_needs_no_request_per_round(frame, monkeypatch):
    """Fits of more rows than a node that goes to one task took a job or more per level of each tree."""
    fits = [Fit(Settings(rounds=4, depth=4, leaves=None, subsample=0.85)), Fit(Settings(rounds=3, leaves=6), without=1)]
    node_by_node = fit_together(frame, fits, "y", part="part", gathered=150)
    monkeypatch.setattr(boosting, "GATHERED", 150)

    def no_round(*args):
        raise AssertionError("a request for a round")

    monkeypatch.setattr(boosting.Rounds, "grow", no_round)
    for a, b in zip(node_by_node, fit_together(frame, fits, "y", part="part"), strict=True):
        assert sorted(np.concatenate([t.gain for t in a.trees])) == sorted(np.concatenate([t.gain for t in b.trees]))
        assert predictions(a, frame) == pytest.approx(predictions(b, frame))


def test_a_fit_of_many_bins_is_not_grown_by_one_task(frame, monkeypatch):
    monkeypatch.setattr(boosting, "GATHERED", 150)
    monkeypatch.setattr(boosting, "ALONE", 1000)
    monkeypatch.setattr(boosting.Rounds, "grow_alone", lambda *args: pytest.fail("grown by one task"))
    assert len(fit_together(frame, [Fit(Settings(rounds=2, leaves=6))], "y")[0].trees) == 2


def test_sums_of_many_large_gradients_are_exact():
    """Their floating-point sum goes beyond 2 to the 53."""
    from carespend.ml.trees import EXACT, Layout

    n = 4 * EXACT + 3
    bins = np.zeros((n, 1), np.uint8)
    g = np.full(n, 2.0**34 - 1)
    h = Layout([np.zeros(0)]).histogram(bins, g)
    assert h.counts.tolist() == [n] and h.sums.tolist() == [n * (2**34 - 1)]


def test_the_compiled_grower_gives_the_trees_that_are_grown_node_by_node(spark):
    """Rows enough for shared columns and several packed sums; drawn rows, limits of leaves and quantiles."""
    from carespend.ml import kernel

    rng = np.random.default_rng(8)
    n = 40_000
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 7, n), rng.integers(0, 200, n) / 4, np.ones(n)])
    y = 50 * x[:, 0] + 30 * x[:, 1] * (x[:, 2] > 3) + x[:, 3] + rng.normal(size=n) * 9
    rows = [(Vectors.dense(a), b) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    df = spark.createDataFrame(rows, ["features", "y"]).repartition(5).cache()
    fits = [
        Fit(Settings(rounds=2, rate=0.3, leaves=9)),
        Fit(Settings(rounds=2, rate=0.3, leaves=None, depth=4, least=4, subsample=0.7)),
        Fit(Settings(rounds=1, rate=1.0, leaves=None, depth=9, least=3, bootstrap=True)),
        Fit(Settings(rounds=2, rate=0.2, leaves=8, quantile=0.5, least=20)),
    ]
    bins = None
    for a, b in zip(fit_together(df, fits, "y"), fit_together(df, fits, "y", gathered=3000), strict=True):
        bins = boosting.Layout(a.cuts).bins(x) if bins is None else bins
        for s, t in zip(a.trees, b.trees, strict=True):
            assert sorted(zip(s.feature, s.bin, s.gain, strict=True)) == sorted(zip(t.feature, t.bin, t.gain, strict=True))
            # Quantiles of many rows are sketched where a leaf's rows lie in several tasks.
            assert s.predict(bins) == pytest.approx(t.predict(bins), rel=1e-3, abs=1e-3)
    assert spark.sparkContext.applicationId in kernel._classes


def test_the_limit_of_methods_is_put_back(spark):
    from carespend.session import JIT_LIMIT, small_methods

    key = "spark.sql.codegen.hugeMethodLimit"
    old = spark.conf.get(key)
    with small_methods(spark), small_methods(spark):
        assert spark.conf.get(key) == str(JIT_LIMIT)
    assert spark.conf.get(key) == old


def test_a_fit_leaves_no_files(spark, frame):
    """Binned rows and grown trees used to stay on disk until the application ended."""
    from pathlib import Path

    from carespend.session import shared_root

    root = Path(shared_root(spark).removeprefix("file:"))
    before = set(root.iterdir()) if root.exists() else set()
    model = Boosting(Settings(rounds=2, leaves=4), "y").fit(frame)
    assert {p.name.split("-")[0] for p in set(root.iterdir()) - before} == set()
    assert model.transform(frame).count() == N
