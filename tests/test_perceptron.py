"""The perceptron's gradients, steps and stages against plain versions."""

import math

import numpy as np
import pytest

from stopflow.operators import perceptron

FEATURES = ["a", "b"]
SMALL = perceptron.Settings(classes=3, hidden=5, epochs=6, batch=10_000)


def examples(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, (x[:, 0] > 0).astype(int) + ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(int)


def frame(spark, x, y):
    rows = [(int(k), *map(float, v)) for k, v in zip(y, x, strict=True)]
    return spark.createDataFrame(rows, "y int, a double, b double")


def plain_loss(flat, x, y, s):
    w1, b1, w2, b2 = perceptron.parts(flat, x.shape[1], s)
    total = 0.0
    for row, k in zip(x, y, strict=True):
        hidden = [max(0.0, sum(v * w for v, w in zip(row, w1[:, j], strict=True)) + b1[j]) for j in range(s.hidden)]
        z = [sum(h * w for h, w in zip(hidden, w2[:, c], strict=True)) + b2[c] for c in range(s.classes)]
        total += math.log(sum(math.exp(v) for v in z)) - z[k]
    return total


def test_gradients_equal_differences_of_a_plain_loss():
    x, y = examples(12)
    flat = perceptron.initial(2, SMALL).weights
    got = perceptron.gradients(flat, x, y, SMALL)
    assert got[-1] == 12 and math.isclose(got[-2], plain_loss(flat, x, y, SMALL))
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (plain_loss(up, x, y, SMALL) - plain_loss(down, x, y, SMALL)) / 2e-6
        assert abs(got[k] - slope) < 1e-5
    halves = [perceptron.gradients(flat, x[p], y[p], SMALL) for p in (slice(0, 5), slice(5, 12))]
    assert np.allclose(halves[0] + halves[1], got) and not perceptron.gradients(flat, x[:0], y[:0], SMALL).any()


def plain_training(x, y, s):
    """Whole-batch Adam, in plain terms."""
    flat = perceptron.initial(x.shape[1], s).weights
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, s.epochs + 1):
        g = perceptron.gradients(flat, x, y, s)[:-2] / len(x)
        decay = np.concatenate([np.full(math.prod(k), float(len(k) == 2)) for k in perceptron.shapes(x.shape[1], s)])
        g = g + s.penalty * decay * flat / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v) / math.sqrt(1 - 0.999**t) + 1e-8 / math.sqrt(1 - 0.999**t))
    return flat


@pytest.mark.parametrize("tasks", [1, 3])
def test_stages_equal_plain_training(spark, tasks, monkeypatch):
    monkeypatch.setattr(perceptron, "BLOCK_EPOCHS", 4)
    x, y = examples(150, 1)
    model = perceptron.fit(frame(spark, x, y), FEATURES, SMALL, tasks=tasks)
    assert model.state.epoch == 6 and len(model.state.losses) == 6
    assert np.allclose(model.state.weights, plain_training(x, y, SMALL), atol=1e-9)


def test_mini_batches_learn_and_stop(spark):
    x, y = examples(600, 2)
    s = perceptron.Settings(classes=3, hidden=20, epochs=60, batch=20, rate=0.01, patience=3, tolerance=0.01)
    model = perceptron.fit(frame(spark, x[:400], y[:400]), FEATURES, s, tasks=1)
    test = frame(spark, x[400:], y[400:])
    got = model.transform(test)
    assert got.columns == [*test.columns, "prediction"]
    assert np.mean([r.y == r.prediction for r in got.collect()]) > 0.9
    assert model.state.losses[-1] < model.state.losses[0] and model.state.epoch < 60


def test_mini_batches_of_several_tasks(spark):
    x, y = examples(90, 3)
    s = perceptron.Settings(classes=3, hidden=4, epochs=2, batch=30)
    one, two = (perceptron.fit(frame(spark, x, y), FEATURES, s, tasks=2).state for _ in range(2))
    assert one.steps == 6 and (one.weights == two.weights).all()


def test_no_examples(spark):
    none = frame(spark, *examples(0))
    model = perceptron.fit(none, FEATURES, SMALL)
    assert model.state.epoch == 0 and model.transform(none).count() == 0
