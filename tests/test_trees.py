"""Boosted trees and forests against a numpy version that looks at every split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators import trees
from ionweave.operators.model import Scorer, metrics


def by_hand(bins, target, margin, growth, number, depth, cuts):
    """One tree, node by node, every split tried in turn."""
    weight = growth.weights(np.arange(len(bins)), number)
    g, h = weight * ((margin if growth.boosted else 0) - target), weight
    tree, open_, level = trees.Tree(), [(0, np.flatnonzero(weight > 0))], 0
    share = lambda a, b: a * a / (b + growth.lambda_)
    value = lambda own: -growth.rate * g[own].sum() / (h[own].sum() + growth.lambda_)
    tree.value[0] = value(open_[0][1])
    while open_ and (depth is None or level < depth):
        after = []
        for node, own in open_:
            best = (0.0,)
            allowed = growth.allowed(bins.shape[1], number, node)
            for f in np.flatnonzero(allowed) if h[own].sum() >= growth.least_split else []:
                b = bins[own, f]
                none = b == trees.BINS
                for cut in np.unique(b):
                    for missing_left in (True, False) if none.any() else (True,):
                        left = np.where(none, missing_left, b <= cut)
                        l, r = own[left], own[~left]
                        if min(h[l].sum(), h[r].sum()) < max(growth.least_leaf, 1e-9):
                            continue
                        gain = round(0.5 * (share(g[l].sum(), h[l].sum()) + share(g[r].sum(), h[r].sum()) - share(g[own].sum(), h[own].sum())) - growth.gamma, 7)
                        if gain > 0 and (-gain, f, cut, not missing_left) < best[:4]:
                            best = (-gain, f, cut, not missing_left, l, r)
            if len(best) > 1:
                children = tree.split(node, int(best[1]), int(best[2]), not best[3], (value(best[4]), value(best[5])))
                after += zip(children, best[4:])
        open_, level = sorted(after, key=lambda x: x[0]), level + 1
    return tree


def table(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    x[rng.random((n, 5)) < 0.1] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0, 3.0, -1.0) + np.nan_to_num(x[:, 1]) ** 2 + np.isnan(x[:, 2]) * 2 + rng.normal(size=n) * 0.1
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(*[None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)], None if np.isnan(t) else float(t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"f{k} double" for k in range(x.shape[1])) + ", target double").repartition(parts)


def state_of(spark, x, y, tmp_path):
    """Binned rows, their bins and targets by number."""
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = frame(spark, x, y)
    made = trees.Ensemble(names, trees.quantile_cuts(rows, names), 0.5, [])
    state = trees.binned_rows(rows, made, "target", str(tmp_path / "s"))
    got = sorted(state.collect(), key=lambda r: r.row)
    numbers = np.array([r.row for r in got])
    return state, np.array([list(r.bins) for r in got], np.uint8), np.array([r.target for r in got]), numbers


@pytest.mark.parametrize("growth,depth", [
    (trees.Growth(depth=4, rate=0.1, lambda_=1.0, share=0.9, features=3), 4),
    (trees.Growth(depth=3, rate=1.0, lambda_=0.5, gamma=2.0, share=1.0), 3),
    (trees.Growth(least_split=40, least_leaf=15, share=None, features=2, by_node=True, boosted=False), None),
])
def test_trees_against_numpy(spark, tmp_path, growth, depth):
    state, bins, target, numbers = state_of(spark, *table(), tmp_path)
    own = trees.Growth(**growth.__dict__)
    own.weights = lambda rows, tree: growth.weights(numbers, tree)  # by place instead of by number
    got = trees.grow(state, [], [2, 3], growth, bins.shape[1])
    for number, tree in zip((2, 3), got):
        want = by_hand(bins, target, np.full(len(target), 0.5), own, number, depth, None)
        assert (tree.feature, tree.bin, tree.missing_left, tree.left) == (want.feature, want.bin, want.missing_left, want.left)
        assert np.allclose(tree.value, want.value) and len(tree.feature) > 3


def test_nodes_in_several_passes(spark, tmp_path, monkeypatch):
    state, *_ = state_of(spark, *table(), tmp_path)
    growth = trees.Growth(least_leaf=20, share=None, features=2, by_node=True, boosted=False)
    one = trees.grow(state, [], [0, 1, 2], growth, 5)
    monkeypatch.setattr(trees, "CELLS", 20 * 5 * (trees.BINS + 1))
    two = trees.grow(state, [], [0, 1, 2], growth, 5)
    assert [t.feature for t in one] == [t.feature for t in two] and all(np.allclose(a.value, b.value) for a, b in zip(one, two))


def test_depth_has_no_limit(spark):
    """Each split parts one row from the rest: a chain of 35."""
    n = 36
    x, y = np.arange(n, dtype=float)[:, None], 4.0 ** np.arange(n)
    rows = frame(spark, x, y, 2)
    names = ["f0"]
    got = trees.forest(rows, names, "target", trees=1, growth=trees.Growth(share=1.0, boosted=False))
    assert got.trees[0].depth() > 30
    predicted = {r.f0: r.p for r in got.predict(rows, "p").collect()}
    assert all(predicted[k] == pytest.approx(y[k]) for k in range(n - 10, n))


def test_boosting_learns_and_carries_margins(spark, monkeypatch):
    x, y = table(1500, 4)
    rows, names = frame(spark, x, y), [f"f{k}" for k in range(5)]
    monkeypatch.setattr(trees, "WRITE_EVERY", 2)
    growth = trees.Growth(depth=3, rate=0.3, lambda_=1.0, share=0.9, features=3)
    many = trees.boost(rows, names, "target", 5, growth)
    monkeypatch.setattr(trees, "WRITE_EVERY", 100)
    same = trees.boost(rows, names, "target", 5, growth)
    assert [t.feature for t in many.trees] == [t.feature for t in same.trees]
    assert metrics(many.predict(rows, "p"), "target", "p").first().r2 > 0.6


def test_scorers_of_odd_tables(spark, tmp_path):
    x, y = table(300, 7)
    y[::10] = np.nan
    rows, names = frame(spark, x, y), [f"f{k}" for k in range(5)]
    for kind in ("boosted", "forest"):
        scorer = Scorer.train(rows, names, "target", kind, count=2)
        scorer.save(str(tmp_path / kind))
        again = Scorer.load(str(tmp_path / kind)).predict(rows)
        assert again.count() == 300 and again.columns == [*rows.columns, "score"]
        assert sorted(r.score for r in again.collect()) == sorted(r.score for r in scorer.predict(rows).collect())
        none = Scorer.train(rows.limit(0), names, "target", kind, count=2)
        assert {r.score for r in none.predict(rows).collect()} == {0.0}
    constant = rows.withColumn("target", F.lit(2.0))
    assert {r.score for r in Scorer.train(constant, names, "target", "boosted", count=2).predict(rows).collect()} == {-2.0}


def test_equal_rows_are_looked_at_once(spark, tmp_path):
    """A whole sample's trees are those of the single rows, and a bootstrap's draws have the mean and spread of their sums."""
    x, y = table(120, 3)
    x, y = np.repeat(x, 9, axis=0), np.repeat(y.round(1), 9)
    state, bins, *_ = state_of(spark, x, y, tmp_path)
    once = trees.alike(state, str(tmp_path / "once"))
    assert once.count() <= 120 and once.agg(F.sum("times")).first()[0] == 1080
    growth = trees.Growth(least_split=90, least_leaf=45, boosted=False)
    many, few = trees.grow(state, [], [1], growth, 5)[0], trees.grow(once, [], [1], growth, 5)[0]
    assert (many.feature, many.bin, many.left) == (few.feature, few.bin, few.left) and np.allclose(many.value, few.value) and len(many.feature) > 3
    for n in (1, 2, 48, 1_000_000):
        w = trees.Growth(share=None).weights(np.arange(100_000), 3, np.full(100_000, n))
        assert abs(w.mean() / n - 1) < 0.02 and abs(w.var() / n - 1) < 0.03
    assert (trees.Growth(share=None).weights(np.arange(999), 3, np.ones(999, int)) == trees.Growth(share=None).weights(np.arange(999), 3)).all()


def test_draws():
    u = trees.uniform(np.arange(200_000), 5, 7)
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.01
    w = trees.Growth(share=None).weights(np.arange(200_000), 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert trees.drawn(20, 4, 1, 2).sum() == 4 and (trees.drawn(20, 4, 1, 2) != trees.drawn(20, 4, 1, 3)).any()
