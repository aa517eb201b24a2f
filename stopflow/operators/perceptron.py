"""A rectified perceptron trained by Adam on mini-batches, in data-parallel barrier stages.

Every task holds its share of the rows. A step sums the gradients of each task's part of the mini-batch;
the tasks exchange their sums and all take the same step. A stage runs a block of epochs and hands the
weights back, so a lost executor repeats one block at most.
"""

from __future__ import annotations

import base64
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.session import stored

# Tasks get this module with the job; executors need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Epochs of one stage, and the rows that a further task is worth.
BLOCK_EPOCHS, TASK_ROWS = 100, 20_000
DECAY_FIRST, DECAY_SECOND, TINY = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Settings:
    """Training ends after ``epochs``, or when for ``patience`` epochs in a row the loss has not fallen
    by ``tolerance`` below the best."""

    classes: int = 4
    hidden: int = 100
    epochs: int = 1_000
    batch: int = 200
    rate: float = 1e-3
    penalty: float = 1e-4
    tolerance: float = 1e-4
    patience: int = 10
    seed: int = 1


@dataclass
class State:
    """Weights as one array, Adam's moments, and how training went."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    epoch: int = 0
    losses: list[float] = field(default_factory=list)
    stale: int = 0
    best: float = math.inf

    def done(self, s: Settings) -> bool:
        return self.epoch >= s.epochs or self.stale > s.patience


def shapes(inputs: int, s: Settings) -> list[tuple[int, ...]]:
    return [(inputs, s.hidden), (s.hidden,), (s.hidden, s.classes), (s.classes,)]


def parts(flat: np.ndarray, inputs: int, s: Settings) -> list[np.ndarray]:
    """Views of the hidden and output weights and biases."""
    out, at = [], 0
    for shape in shapes(inputs, s):
        size = math.prod(shape)
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def initial(inputs: int, s: Settings) -> State:
    rng = np.random.default_rng(s.seed)
    flat = np.empty(sum(map(math.prod, shapes(inputs, s))))
    w1, b1, w2, b2 = parts(flat, inputs, s)
    for w, b in ((w1, b1), (w2, b2)):
        reach = math.sqrt(6 / sum(w.shape))
        w[:] = rng.uniform(-reach, reach, w.shape)
        b[:] = rng.uniform(-reach, reach, b.shape)
    return State(flat, np.zeros_like(flat), np.zeros_like(flat))


def outputs(flat: np.ndarray, x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hidden activations and class probabilities."""
    w1, b1, w2, b2 = parts(flat, x.shape[1], s)
    hidden = np.maximum(x @ w1 + b1, 0)
    z = hidden @ w2 + b2
    e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
    return hidden, e / e.sum(axis=1, keepdims=True)


def gradients(flat: np.ndarray, x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Summed gradients of the log loss over the rows; behind them the summed loss and the rows."""
    out = np.zeros(len(flat) + 2)
    if not len(x):
        return out
    hidden, p = outputs(flat, x, s)
    rows = np.arange(len(y))
    out[-2:] = -np.log(np.maximum(p[rows, y], 1e-300)).sum(), len(y)
    p[rows, y] -= 1
    g1, c1, g2, c2 = parts(out[:-2], x.shape[1], s)
    back = (p @ parts(flat, x.shape[1], s)[2].T) * (hidden > 0)
    g1[:], c1[:] = x.T @ back, back.sum(axis=0)
    g2[:], c2[:] = hidden.T @ p, p.sum(axis=0)
    return out


def step(state: State, total: np.ndarray, inputs: int, s: Settings) -> float:
    """One step of Adam from gradients summed over a mini-batch; returns its summed loss."""
    n = max(total[-1], 1.0)
    g = total[:-2] / n
    loss = total[-2]
    for w, gw in zip(parts(state.weights, inputs, s), parts(g, inputs, s), strict=True):
        if w.ndim == 2:
            gw += s.penalty * w / n
            loss += 0.5 * s.penalty * (w * w).sum()
    state.steps += 1
    t = state.steps
    state.first = DECAY_FIRST * state.first + (1 - DECAY_FIRST) * g
    state.second = DECAY_SECOND * state.second + (1 - DECAY_SECOND) * g * g
    rate = s.rate * math.sqrt(1 - DECAY_SECOND**t) / (1 - DECAY_FIRST**t)
    state.weights = state.weights - rate * state.first / (np.sqrt(state.second) + TINY)
    return loss


def train(
    state: State,
    x: np.ndarray,
    y: np.ndarray,
    rows: int,
    task: int,
    summed: Callable[[np.ndarray], np.ndarray],
    s: Settings,
) -> State:
    """A block of epochs over this task's rows; ``summed`` adds an array up over all tasks."""
    batches = max(-(-rows // s.batch), 1)
    for _ in range(BLOCK_EPOCHS):
        if state.done(s):
            break
        order = np.random.default_rng((s.seed, state.epoch, task)).permutation(len(x))
        cuts = np.linspace(0, len(x), batches + 1).astype(np.int64)
        loss = 0.0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[a:b]
            total = summed(gradients(state.weights, x[own], y[own], s))
            loss += step(state, total, x.shape[1], s)
        loss /= max(rows, 1)
        state.losses.append(loss)
        state.stale = state.stale + 1 if loss > state.best - s.tolerance else 0
        state.best = min(state.best, loss)
        state.epoch += 1
    return state


def _gathered(context: BarrierTaskContext, tasks: int) -> Callable[[np.ndarray], np.ndarray]:
    def summed(own: np.ndarray) -> np.ndarray:
        if tasks == 1:
            return own
        every = context.allGather(base64.b64encode(own.tobytes()).decode())
        # Added in the order of tasks, so that all hold the same weights.
        return np.sum([np.frombuffer(base64.b64decode(v)) for v in every], axis=0)

    return summed


@dataclass
class Model:
    features: list[str]
    settings: Settings
    state: State

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction``, the likeliest class."""
        flat, s = self.state.weights, self.settings

        def classes(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            return pd.Series(outputs(flat, x, s)[1].argmax(axis=1).astype(np.float64))

        predict = F.pandas_udf(classes, "double")
        return rows.withColumn("prediction", predict(*[F.col(c) for c in self.features]))


def fit(
    rows: DataFrame, features: Sequence[str], settings: Settings | None = None, tasks: int | None = None
) -> Model:
    """Train on rows with a class ``y`` from 0 and numeric features without gaps.

    All ``tasks`` have to run at once; by default there are as many as the rows are worth and the
    session runs side by side.
    """
    s = settings or Settings()
    spark = rows.sparkSession
    kept = stored(rows.select(F.col("y").cast("int").alias("y"), *features), "examples")
    n = kept.count()
    slots = spark.sparkContext.defaultParallelism
    tasks = tasks or max(1, min(slots, -(-n // TASK_ROWS)))
    dealt = kept.repartition(tasks, F.xxhash64(*kept.columns))
    state = initial(len(features), s)

    while n and not state.done(s):

        def run(batches: Iterator[pa.RecordBatch], state: State = state) -> Iterator[pa.RecordBatch]:
            table = [np.column_stack([b.column(c).to_numpy() for c in ("y", *features)]) for b in batches]
            values = np.concatenate(table) if table else np.empty((0, 1 + len(features)))
            # Rows arrive in any order.
            values = values[np.lexsort(values.T[::-1])]
            context = BarrierTaskContext.get()
            task = context.partitionId()
            y = values[:, 0].astype(np.int64)
            out = train(replace(state), values[:, 1:], y, n, task, _gathered(context, tasks), s)
            if task == 0:
                arrays = np.concatenate([out.weights, out.first, out.second, out.losses])
                ends = [out.steps, out.epoch, out.stale, out.best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([arrays.tobytes()]), pa.array([np.array(ends, float).tobytes()])],
                    names=["arrays", "ends"],
                )

        found = dealt.mapInArrow(run, "arrays binary, ends binary", barrier=True).collect()[0]
        size = len(state.weights)
        arrays = np.frombuffer(found["arrays"])
        ends = np.frombuffer(found["ends"])
        w, first, second = (arrays[k * size : (k + 1) * size].copy() for k in range(3))
        steps, epoch, stale = map(int, ends[:3])
        state = State(w, first, second, steps, epoch, arrays[3 * size :].tolist(), stale, ends[3])
    return Model(list(features), s, state)
