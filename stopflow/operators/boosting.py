"""Multiclass boosted trees on histograms of gradients.

Features are cut at quantiles once. A round grows one tree per class on the softmax loss; a level of
all its trees is one job: every task sums gradients and second derivatives by (class, node,
feature, bin), Spark adds the sums, and the driver picks the splits out of a table whose size
depends on the parameters alone. Sums are exact integers, so that trees do not depend on how rows
are partitioned. Margins are brought up to date in a stored table every few rounds; in between
tasks apply the rounds since.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.session import stored

# Tasks get this module with the job; executors need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Gradients are sums of whole steps of this size.
STEP = 2.0**-24
# Gains up to this are none.
LEAST_GAIN = 1e-6
STORE_EVERY = 10
# Rows that a task of its own is worth.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Settings:
    """``penalty`` is added to the second derivatives of a leaf; a child needs ``least`` of them."""

    classes: int = 4
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    penalty: float = 1.0
    least: float = 1.0
    bins: int = 256


@dataclass
class Round:
    """The trees of a round, one row per class; the children of node i are 2 i + 1 and 2 i + 2.

    A node with a feature sends bins up to ``cut`` to the left; one without is a leaf.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, s: Settings) -> Round:
        shape = (s.classes, 2 ** (s.depth + 1) - 1)
        return cls(np.full(shape, -1), np.zeros(shape, dtype=np.int64), np.zeros(shape))

    def nodes(self, bins: np.ndarray, c: int, levels: int) -> np.ndarray:
        """Where the rows stand in the tree of a class after so many levels."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[c, at]
            right = bins[rows, np.maximum(f, 0)] > self.cut[c, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def scores(self, bins: np.ndarray, s: Settings) -> np.ndarray:
        return np.column_stack(
            [self.value[c, self.nodes(bins, c, s.depth)] for c in range(s.classes)]
        )


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value: how many cuts lie at or below it."""
    return np.column_stack(
        [np.searchsorted(c, values[:, f], side="right") for f, c in enumerate(cuts)]
    ).astype(np.uint8)


def derivatives(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss by margin, in whole steps."""
    e = np.exp(margin - margin.max(axis=1)[:, None])
    p = e / e.sum(axis=1)[:, None]
    first = p - (y[:, None] == np.arange(margin.shape[1]))
    second = np.maximum(2 * p * (1 - p), 1e-16)
    return np.rint(first / STEP), np.rint(second / STEP)


def best_splits(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, sums left and right) of the best split per class and node.

    ``g`` and ``h`` are sums by class, node, feature and bin, in whole steps. Of equal gains the first
    feature and bin count.
    """
    left_g, left_h = g.cumsum(axis=3) * STEP, h.cumsum(axis=3) * STEP
    all_g, all_h = left_g[..., -1:], left_h[..., -1:]
    right_g, right_h = all_g - left_g, all_h - left_h

    def score(a, b):
        return a * a / (b + s.penalty)

    gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
    gain = np.where((left_h >= s.least) & (right_h >= s.least), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    where = flat.argmax(axis=2)
    feature, cut = where // gain.shape[3], where % gain.shape[3]
    at = (*np.ogrid[: g.shape[0], : g.shape[1]], feature, cut)
    sums = [v[at] for v in (left_g, left_h, right_g, right_h)]
    return (np.take_along_axis(flat, where[..., None], 2)[..., 0], feature, cut, *sums)


def grow(tree: Round, level: int, g: np.ndarray, h: np.ndarray, s: Settings) -> bool:
    """Split the nodes of a level by their sums; whether any was split."""
    first = 2**level - 1
    gain, feature, cut, left_g, left_h, right_g, right_h = best_splits(g, h, s)
    if level == 0:
        total_g, total_h = g[:, 0, 0].sum(axis=1) * STEP, h[:, 0, 0].sum(axis=1) * STEP
        tree.value[:, 0] = -s.rate * total_g / (total_h + s.penalty)
    split = gain > LEAST_GAIN
    for c, node in zip(*np.nonzero(split), strict=True):
        at = first + node
        tree.feature[c, at], tree.cut[c, at] = feature[c, node], cut[c, node]
        for child, a, b in ((1, left_g, left_h), (2, right_g, right_h)):
            tree.value[c, 2 * at + child] = -s.rate * a[c, node] / (b[c, node] + s.penalty)
    return bool(split.any())


@dataclass
class Model:
    features: list[str]
    cuts: list[np.ndarray]
    settings: Settings
    rounds: list[Round] = field(default_factory=list)

    def margins(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        out = np.zeros((len(values), self.settings.classes))
        for r in self.rounds:
            out += r.scores(bins, self.settings)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction``, the class of the greatest margin and the smallest of equals."""
        model = self

        def classes(*columns: pd.Series) -> pd.Series:
            values = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            return pd.Series(model.margins(values).argmax(axis=1).astype(np.float64))

        predict = F.pandas_udf(classes, "double")
        return rows.withColumn("prediction", predict(*[F.col(c) for c in self.features]))


def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins - 1`` distinct cuts of every feature, at its quantiles."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, shares, 100 * bins).alias(c) for c in features]).first()
    return [np.unique(np.array(found[c] or [], dtype=np.float64)) for c in features]


_STATE = "y int, bins binary, margin array<double>"


def _rows(batch: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = batch.column("y").to_numpy()
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8)
    margin = batch.column("margin").flatten().to_numpy().reshape(-1, classes)
    return y, bins.reshape(len(y), -1), margin


def _state(y: np.ndarray, bins: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(y) + 1, dtype=np.int32) * margin.shape[1]
    values = [
        pa.array(y, pa.int32()),
        pa.array([b.tobytes() for b in bins], pa.binary()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(margin.reshape(-1))),
    ]
    return pa.RecordBatch.from_arrays(values, names=["y", "bins", "margin"])


def _start(rows: DataFrame, model: Model, tasks: int) -> DataFrame:
    cuts, classes = model.cuts, model.settings.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy().astype(np.int32)
            values = np.column_stack([batch.column(f).to_numpy() for f in model.features])
            yield _state(y, binned(values, cuts), np.zeros((len(y), classes)))

    # Few rows are few files: every level starts a task for each.
    dealt = rows.select("y", *model.features).coalesce(tasks)
    return stored(dealt.mapInArrow(run, _STATE), "margins")


def _advanced(state: DataFrame, rounds: list[Round], s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, bins, margin = _rows(batch, s.classes)
            yield _state(y, bins, margin + sum(r.scores(bins, s) for r in rounds))

    return stored(state.mapInArrow(run, _STATE), "margins")


def _sums(
    state: DataFrame, since: list[Round], tree: Round, level: int, features: int, s: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Sums by class, node of the level, feature and bin over all rows."""
    width, shape = 2**level, (s.classes, 2**level, features, s.bins)
    schema = pa.schema([("cell", pa.int64()), ("g", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, *shape))
        for batch in batches:
            y, bins, margin = _rows(batch, s.classes)
            margin = margin + sum(r.scores(bins, s) for r in since)
            g, h = derivatives(margin, y)
            for c in range(s.classes):
                node = tree.nodes(bins, c, level) - (width - 1)
                here = np.flatnonzero(node >= 0)
                for f in range(features):
                    at = node[here] * s.bins + bins[here, f]
                    for k, v in enumerate((g, h)):
                        sums = np.bincount(at, v[here, c], width * s.bins)
                        total[k, c, :, f] += sums.reshape(width, s.bins)
        cell = np.flatnonzero((total != 0).any(axis=0).reshape(-1))
        flat = total.reshape(2, -1)[:, cell].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cell, *flat)], schema=schema)

    parts = state.mapInArrow(run, "cell long, g long, h long")
    found = parts.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, int(np.prod(shape))))
    for k, c in enumerate("gh"):
        out[k, found["cell"].to_numpy()] = found[c].to_numpy()
    return tuple(out.reshape(2, *shape))


def fit(rows: DataFrame, features: Sequence[str], settings: Settings | None = None) -> Model:
    """Train on rows with a class ``y`` from 0 and numeric features without gaps.

    Rows with another ``y`` count against every class.
    """
    s = settings or Settings()
    if s.bins > 256:
        raise ValueError("at most 256 bins")
    model = Model(list(features), quantile_cuts(rows, features, s.bins), s)
    state = _start(rows, model, -(-rows.count() // TASK_ROWS) or 1)
    since: list[Round] = []
    for _ in range(s.rounds):
        tree = Round.empty(s)
        for level in range(s.depth):
            g, h = _sums(state, since, tree, level, len(features), s)
            if not grow(tree, level, g, h, s):
                break
        model.rounds.append(tree)
        since.append(tree)
        if len(since) == STORE_EVERY:
            state, since = _advanced(state, since, s), []
    return model
