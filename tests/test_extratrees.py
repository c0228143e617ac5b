"""Extremely randomized trees against a builder that holds all rows."""

import numpy as np
import pandas as pd
import pytest

from ramplake.operators import extratrees as et


def grown_by_hand(x, t, trees, depth, leaf, seed):
    """The same rule on one array, node by node."""
    d, m = x.shape[1], t.shape[1]
    nodes = [(k, np.arange(len(x))) for k in range(trees)]  # (tree, rows)
    made, level = [], 0
    while nodes:
        following = []
        base = len(made)
        splits = []
        for k, (tree, rows) in enumerate(nodes):
            best = (-1, 0.0, None)
            total = (t[rows].sum(0) ** 2).sum() / len(rows)
            if level < depth and len(rows) >= 2 * leaf:
                low, high = np.fmin.reduce(x[rows], axis=0), np.fmax.reduce(x[rows], axis=0)
                cuts = low + et.uniform(seed, np.array([base + k]), d)[0] * (high - low)
                top = 1e-12 * max(1.0, len(rows))
                for f in range(d):
                    left = ~(x[rows, f] > cuts[f])
                    if low[f] < high[f] and min(left.sum(), (~left).sum()) >= leaf:
                        gain = sum((t[rows[s]].sum(0) ** 2).sum() / s.sum() for s in (left, ~left)) - total
                        if gain > top + 1e-9:
                            top, best = gain, (f, cuts[f], left)
            splits.append((tree, rows, best))
        for tree, rows, (feature, cut, left) in splits:
            made.append((tree, feature, cut, len(rows), t[rows].sum(0)))
            if feature >= 0:
                following += [(tree, rows[left]), (tree, rows[~left])]
        nodes, level = following, level + 1
    return made


def data(seed, n=400, d=4, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(3)
    x[:, 1] = rng.integers(0, 3, n)  # many ties
    x[:, 2] = 7.0  # no cut at all
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int) + (x[:, 1] > 1)
    return x, y, np.eye(classes)[y]


@pytest.mark.parametrize("room", [et.SUMS, 120])
def test_trees_equal_the_builder_with_all_rows(spark, monkeypatch, room):
    monkeypatch.setattr(et, "SUMS", room)  # the small one takes a few nodes at a time
    monkeypatch.setattr(et, "PAIRS", 300)
    x, y, t = data(3)
    frame = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "t": t.tolist()})).repartition(5)
    model = et.grow(frame, "t", trees=3, depth=5, leaf=6, seed=9)
    want = grown_by_hand(x, t, 3, 5, 6, 9)
    assert model.feature.tolist() == [w[1] for w in want] and model.tree.tolist() == [w[0] for w in want]
    np.testing.assert_allclose(model.cut, [w[2] for w in want])
    np.testing.assert_allclose(model.count, [w[3] for w in want])
    np.testing.assert_allclose(model.sums, [w[4] for w in want])
    assert len(want) > 40
    again = et.grow(frame.repartition(2), "t", trees=3, depth=5, leaf=6, seed=9)
    assert again.feature.tolist() == model.feature.tolist() and np.array_equal(again.cut, model.cut)


def test_paths_as_targets_and_predictions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    paths = np.stack([x[:, 0] * k / 4 for k in range(5)], 1)
    frame = spark.createDataFrame(pd.DataFrame({"i": range(600), "x": x.tolist(), "t": paths.tolist()})).repartition(3)
    model = et.grow(frame.filter("i < 500"), "t", trees=30, depth=8, leaf=5)
    got = frame.filter("i >= 500").select("i", et.predicted(model).alias("p"), et.leaves(model).alias("l")).orderBy("i").toPandas()
    p = np.array(got["p"].tolist())
    assert np.corrcoef(p[:, 4], paths[500:, 4])[0, 1] > 0.95 and np.abs(p[:, 0]).max() < 1e-12
    for row, leaf in zip(p, got["l"]):
        np.testing.assert_allclose(row, (model.sums[leaf] / model.count[leaf][:, None]).mean(0))


def test_missing_values_and_small_tables(spark):
    rows = [([1.0, None], [1.0, 0.0]), ([2.0, 5.0], [0.0, 1.0]), (None, [1.0, 0.0]), ([3.0, 1.0], None), ([4.0, 2.0], [None, 1.0])]
    frame = spark.createDataFrame(rows, "x array<double>, t array<double>")
    model = et.grow(frame, "t", trees=2, depth=3, leaf=1)
    assert model.count[:2].tolist() == [2, 2] and model.sums[0].tolist() == [1, 1]
    with pytest.raises(ValueError):
        et.grow(frame.filter("false"), "t")
