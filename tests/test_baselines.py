"""The baseline learners on snapshot rows whose class follows from their features."""

import numpy as np
import pytest

from stopflow.operators import baselines, boosting, perceptron
from stopflow.operators.snapshots import FEATURES


def snapshots(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES)))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.2)
    rows = [(i, int(k), *(float(v) if v > -2.5 else None for v in r)) for i, (k, r) in enumerate(zip(y, x, strict=True))]
    columns = ", ".join(f"{c} double" for c in FEATURES)
    return spark.createDataFrame(rows, f"id int, y int, {columns}"), np.bincount(y).max() / n


@pytest.mark.parametrize("learner", ["forest", "boosted", "perceptron"])
def test_scores_beat_the_majority_class(spark, learner):
    rows, _ = snapshots(spark, 500, 0)
    test, majority = snapshots(spark, 200, 1)
    if learner == "forest":
        model = baselines.train(baselines.random_forest(trees=20), rows)
        assert model.stages[-1].getOrDefault("maxDepth") == 30
        assert max(t.depth for t in model.stages[-1].trees) > 5
    elif learner == "boosted":
        model = baselines.train_boosted_trees(rows, boosting.Settings(rounds=5, depth=3))
    else:
        model = baselines.train_perceptron(rows, perceptron.Settings(epochs=80, rate=0.01))
    scored = baselines.batch_score(model, test, "id")
    assert scored.columns == ["id", "ytrue", "ypred"]
    got = scored.collect()
    assert len(got) == 200 and np.mean([r.ytrue == r.ypred for r in got]) > majority + 0.3
