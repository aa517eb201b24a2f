"""Boosted trees against a plain version that goes row by row."""

import math

import numpy as np
import pytest

from stopflow.operators import boosting

SETTINGS = boosting.Settings(classes=3, rounds=4, depth=3, bins=16)
FEATURES = ["a", "b", "c"]


def examples(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), np.round(rng.exponential(size=n), 1)])
    y = ((x[:, 0] > 0.3).astype(int) + (x[:, 1] * x[:, 2] > 2)).astype(int)
    flip = rng.random(n) < 0.1
    y[flip] = rng.integers(0, 3, flip.sum())
    return x, y


def frame(spark, x, y, parts):
    rows = [(int(k), *map(float, v)) for k, v in zip(y, x, strict=True)]
    return spark.createDataFrame(rows, "y int, a double, b double, c double").repartition(parts)


def plain_trees(x, y, cuts, s):
    """(feature, cut, children or value) trees by class and round, by plain loops over rows."""
    bins = [[sum(c <= v for c in cut) for v, cut in zip(row, cuts, strict=True)] for row in x.tolist()]
    margin = [[0.0] * s.classes for _ in bins]
    out = []
    for _ in range(s.rounds):
        g, h = [], []
        for row, k in zip(margin, y, strict=True):
            top = max(row)
            e = [math.exp(v - top) for v in row]
            p = [v / sum(e) for v in e]
            g.append([round((v - (c == k)) * 2**24) for c, v in enumerate(p)])
            h.append([round(max(2 * v * (1 - v), 1e-16) * 2**24) for v in p])
        trees = []
        for c in range(s.classes):

            def leaf(own):
                a, b = (sum(v[i][c] for i in own) / 2**24 for v in (g, h))
                return -s.rate * a / (b + s.penalty)

            def build(own, depth):
                best = (1e-6, None)
                if depth < s.depth:
                    for f in range(len(cuts)):
                        for cut in range(s.bins):
                            sides = [[i for i in own if bins[i][f] <= cut], [i for i in own if bins[i][f] > cut]]
                            sums = [[sum(v[i][c] for i in side) / 2**24 for v in (g, h)] for side in (*sides, own)]
                            if min(sums[0][1], sums[1][1]) < s.least:
                                continue
                            score = [a * a / (b + s.penalty) for a, b in sums]
                            gain = score[0] + score[1] - score[2]
                            if gain > best[0]:
                                best = (gain, (f, cut, sides))
                if best[1] is None:
                    return leaf(own)
                f, cut, sides = best[1]
                return (f, cut, *[build(side, depth + 1) for side in sides])

            trees.append(build(range(len(bins)), 0))
        out.append(trees)
        for i, row in enumerate(bins):
            for c, tree in enumerate(trees):
                while isinstance(tree, tuple):
                    tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
                margin[i][c] += tree
    return out, margin


def nested(r, c, at=0):
    f = r.feature[c, at]
    if f < 0:
        return r.value[c, at]
    return (f, r.cut[c, at], nested(r, c, 2 * at + 1), nested(r, c, 2 * at + 2))


def flat(tree):
    return [v for part in tree for v in flat(part)] if isinstance(tree, tuple) else [float(tree)]


def shape(tree):
    return (int(tree[0]), int(tree[1]), shape(tree[2]), shape(tree[3])) if isinstance(tree, tuple) else None


def test_trees_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    x, y = examples(500)
    model = boosting.fit(frame(spark, x, y, 5), FEATURES, SETTINGS)
    want, margin = plain_trees(x, y, model.cuts, SETTINGS)
    for r, trees in zip(model.rounds, want, strict=True):
        for c, tree in enumerate(trees):
            assert shape(nested(r, c)) == shape(tree)
            assert np.allclose(flat(nested(r, c)), flat(tree), rtol=1e-12)
    assert np.allclose(model.margins(x), margin, rtol=1e-9)
    assert any(shape(t) for trees in want for t in trees)


def test_trees_do_not_depend_on_partitions(spark):
    x, y = examples(400, 1)
    one, many = (boosting.fit(frame(spark, x, y, n), FEATURES, SETTINGS) for n in (1, 9))
    for a, b in zip(one.rounds, many.rounds, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_predictions_beat_the_majority(spark):
    x, y = examples(1_000, 2)
    s = boosting.Settings(classes=3, rounds=8, depth=4, bins=64)
    model = boosting.fit(frame(spark, x[:700], y[:700], 4), FEATURES, s)
    test = frame(spark, x[700:], y[700:], 4)
    got = model.transform(test)
    assert got.columns == [*test.columns, "prediction"]
    right = np.mean([r.y == r.prediction for r in got.collect()])
    assert right > np.bincount(y[700:]).max() / 300 + 0.15


def test_awkward_examples(spark):
    s = boosting.Settings(classes=3, rounds=2, depth=2, bins=8)
    same = frame(spark, np.ones((20, 3)), np.ones(20, dtype=int), 3)
    model = boosting.fit(same, FEATURES, s)
    assert {r.prediction for r in model.transform(same).collect()} == {1.0}
    none = same.limit(0)
    assert boosting.fit(none, FEATURES, s).transform(none).count() == 0
    assert {r.prediction for r in boosting.fit(none, FEATURES, s).transform(same).collect()} == {0.0}
    with pytest.raises(ValueError):
        boosting.fit(same, FEATURES, boosting.Settings(bins=300))
