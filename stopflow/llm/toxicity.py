"""A convolutional text classifier for toxicity, trained and applied by Spark tasks in numpy.

Each word is the sum of hashed embeddings of itself and of its first bytes. Filters of several
widths run over all words of a text, each keeps its largest response, and a logistic layer on
these gives the score. Neither labels nor language, source or id are inputs.

``fit`` learns from a bounded sample on the driver. ``fit_all`` learns from every labelled row:
tasks descend over their rows from common weights, and their steps are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stopflow.llm.text import END, PLAIN, chunks, spans, text_bytes, token_table
from stopflow.session import passing, stored

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 6)
# Bounds of the fit: labelled rows of either class, and bytes of all their texts.
FIT_TOXIC, FIT_CLEAN, FIT_BYTES = 1_500, 3_000, 32 << 20
EPOCHS, STEPS, BATCH, RATE = 8, 1_000, 64, 0.01  # passes, or as many steps if fewer rows
# Share of words hidden in each step, against learning single documents by heart.
WORD_DROP = 0.3
# Share of the fitted rows held back to set the thresholds, and the precision asked of them.
CHECK_SHARE, PRECISION = 0.2, 0.98
THRESHOLD = 0.7
# Passes over all rows by their rates, rows that a further task of a pass is worth, and text bytes
# that it holds at once. A task reads more than FULL_TASK_ROWS only if the files are dealt so.
PASS_RATES, TASK_ROWS, PASS_BYTES = (0.01, 0.01, 0.005, 0.002), 4_000, 2 << 20
FULL_TASK_ROWS = 64_000
# Changes of weights are summed in whole steps of 1 / DELTA_STEPS, so that their order does not
# matter; thresholds of all rows lie on a grid of 1 / SCORE_STEPS.
DELTA_STEPS, SCORE_STEPS = 1 << 24, 1 << 12


def _word_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of each word and its prefixes; 0 stands for padding."""
    out = np.empty((len(words), 1 + len(PREFIXES)), dtype=np.int32)
    for i, w in enumerate(words):
        out[i, 0] = xxhash.xxh3_64_intdigest(w, 1) % (BUCKETS - 1) + 1
        for j, n in enumerate(PREFIXES):
            out[i, j + 1] = xxhash.xxh3_64_intdigest(w[:n], n) % (BUCKETS - 1) + 1
        if w == END:
            out[i] = 0
    return out


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def _new_model(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    embed[0] = 0
    shape = (DIM, FILTERS)
    filters = {w: rng.normal(0, 0.2, (w, *shape)).astype(np.float32) for w in WIDTHS}
    total = FILTERS * len(WIDTHS)
    return Model(embed, filters, np.full(total, 0.1, np.float32), rng.normal(0, 0.2, total))


def _padded(codes: np.ndarray, starts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Token codes with ``max(WIDTHS)`` paddings after each text, END first, and the text starts."""
    room = max(WIDTHS) - 1
    spread = np.insert(codes, np.repeat(starts[1:], room), pad)
    return spread, starts[:-1] + room * np.arange(len(starts) - 1)


def _products(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """``x @ f``, summed in one order whatever rows stand beside a row."""
    out = x[:, :1] * f[0]
    for k in range(1, len(f)):
        out += x[:, k : k + 1] * f[k]
    return out


def predict(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores of texts, over every word of each."""
    if not texts:
        return np.empty(0)
    codes, words, starts = token_table(texts, PLAIN)
    vectors = model.embed[_word_buckets(words)].sum(axis=1)
    codes, starts = _padded(codes, starts, words.index(END))
    ends = np.append(starts[1:], len(codes))
    pooled = np.empty((len(texts), len(model.bias)), dtype=np.float32)
    for k, (w, f) in enumerate(model.filters.items()):
        span = slice(k * FILTERS, (k + 1) * FILTERS)
        n = len(codes) - w + 1
        # Each word is multiplied with each filter row once; a window adds up its words.
        response = _products(vectors, f[0])[codes[:n]]
        for j in range(1, w):
            response += _products(vectors, f[j])[codes[j : j + n]]
        # Windows that start on the last paddings would reach into the next text.
        borders = np.stack([starts, ends - w + 1], axis=1).reshape(-1)[:-1]
        pooled[:, span] = np.maximum.reduceat(response, borders, axis=0)[::2] + model.bias[span]
    z = _products(np.maximum(pooled, 0), model.out[:, None])[:, 0] + model.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 5) -> Model:
    """Fit the network by Adam steps; the gradient of a maximum goes to its word window."""
    model = _new_model(seed)
    if texts:
        passes = max(EPOCHS, -(-STEPS * BATCH // len(texts)))
        _Descent(model, RATE, seed).over(texts, toxic, passes)
    return model


class _Descent:
    """Adam on a model in place. ``seen`` counts the gradients that each embedding has had."""

    def __init__(self, model: Model, rate: float, seed: int | list[int]):
        self.model, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.params = {"embed": model.embed, "bias": model.bias, "out": model.out}
        self.params |= {f"w{w}": f for w, f in model.filters.items()}
        self.first = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.params.items()}
        self.step, self.bias_first, self.bias_second = 0, 0.0, 0.0
        self.seen, self.rows = np.zeros(BUCKETS, dtype=np.int64), 0

    def over(self, texts: list[bytes], toxic: np.ndarray, passes: int = 1) -> None:
        model, rng = self.model, self.rng
        codes, words, starts = token_table(texts, PLAIN)
        buckets = _word_buckets(words)
        codes, starts = _padded(codes, starts, words.index(END))
        ends = np.append(starts[1:], len(codes))
        self.rows += passes * len(texts)
        for _ in range(passes):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                take = spans(starts[batch], ends[batch] - starts[batch])
                own = buckets[codes[take]]
                own[rng.random(len(own)) < WORD_DROP] = 0
                x = model.embed[own].sum(axis=1)
                heads = np.concatenate([[0], np.cumsum(ends[batch] - starts[batch])])
                grads = {k: np.zeros_like(v) for k, v in self.params.items() if k != "embed"}
                picked = np.empty((len(batch), len(model.bias)), dtype=np.int64)
                pooled = np.empty((len(batch), len(model.bias)), dtype=np.float32)
                for k, (w, f) in enumerate(model.filters.items()):
                    span = slice(k * FILTERS, (k + 1) * FILTERS)
                    n = len(x) - w + 1
                    response = x[:n] @ f[0]
                    for j in range(1, w):
                        response += x[j : j + n] @ f[j]
                    for i in range(len(batch)):
                        # Windows that start on the last paddings would reach into the next text.
                        seen = response[heads[i] : heads[i + 1] - w + 1]
                        best = seen.argmax(axis=0)
                        picked[i, span] = heads[i] + best
                        pooled[i, span] = seen[best, np.arange(FILTERS)] + model.bias[span]
                hidden = np.maximum(pooled, 0)
                z = np.clip(hidden @ model.out + model.out_bias, -30, 30)
                delta = (1 / (1 + np.exp(-z)) - toxic[batch]) / len(batch)
                grads["out"] = hidden.T @ delta + 1e-5 * model.out
                back = (delta[:, None] * model.out * (pooled > 0)).astype(np.float32)
                grads["bias"] = back.sum(axis=0)
                rows, values = [], []
                for k, (w, f) in enumerate(model.filters.items()):
                    span = slice(k * FILTERS, (k + 1) * FILTERS)
                    for j in range(w):
                        at_words = picked[:, span] + j
                        b = own[at_words]
                        grads[f"w{w}"][j] = np.einsum("df,dfe->ef", back[:, span], x[at_words])
                        g = back[:, span, None] * f[j].T[None]
                        rows.append(b.reshape(-1))
                        values.append(np.repeat(g.reshape(-1, DIM), b.shape[2], axis=0))
                self.step += 1
                touched, inverse, times = np.unique(
                    np.concatenate(rows), return_inverse=True, return_counts=True
                )
                self.seen[touched] += times
                summed = np.zeros((len(touched), DIM), dtype=np.float32)
                np.add.at(summed, inverse, np.concatenate(values))
                rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
                for name, value in self.params.items():
                    at_rows = touched if name == "embed" else slice(None)
                    g = summed if name == "embed" else grads[name]
                    m = 0.9 * self.first[name][at_rows] + 0.1 * g
                    s = 0.999 * self.second[name][at_rows] + 0.001 * g * g
                    self.first[name][at_rows], self.second[name][at_rows] = m, s
                    value[at_rows] -= rate * m / (np.sqrt(s) + 1e-8)
                model.embed[0] = 0
                g = delta.sum()
                self.bias_first = 0.9 * self.bias_first + 0.1 * g
                self.bias_second = 0.999 * self.bias_second + 0.001 * g * g
                model.out_bias -= rate * self.bias_first / (np.sqrt(self.bias_second) + 1e-8)


def calibrated_thresholds(
    scores: np.ndarray, toxic: np.ndarray, langs: list[str | None]
) -> dict[str, float]:
    """Per language, the lowest threshold with the precision asked for, within [0.5, 0.9]."""
    found = {}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        s, y = scores[own], toxic[own]
        order = np.argsort(-s, kind="stable")
        precision = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        at = s[order[good[-1]]] if len(good) else THRESHOLD
        found[lang] = float(np.clip(at, 0.5, 0.9))
    return found


def _sample(docs: DataFrame, labels: DataFrame) -> list:
    """Bounded labelled rows in the order of a hash, the rarer class among the others."""
    known = _known(labels)
    parts = [
        known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        for value, bound in ((1, FIT_TOXIC), (0, FIT_CLEAN))
    ]
    # At most FIT_TOXIC + FIT_CLEAN ids: the texts of all others stay where they are.
    ids = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select("doc_id", "text", "lang").where("text IS NOT NULL")
    # A hash apart from the one that chose: by that one, the rarer class alone would come last.
    chosen = texts.join(ids, "doc_id").select(
        F.xxhash64(F.lit("fit"), "doc_id").alias("h"),
        F.xxhash64("doc_id").alias("by_id"),
        text_bytes().alias("text"),
        "lang",
        "toxic",
    )
    sample, size = [], 0
    for row in chosen.orderBy("h", "text").toLocalIterator():
        size += len(row.text)
        if sample and size > FIT_BYTES:
            break
        sample.append(row)
    n_toxic = sum(r.toxic for r in sample)
    if n_toxic < FIT_TOXIC and len(sample) - n_toxic < FIT_CLEAN:
        # All labels are here, so the first hash has chosen nothing.
        sample.sort(key=lambda r: (r.by_id, r.text))
    return sample


def _known(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """Train on the texts of ``docs`` (doc_id, text, lang) that ``labels`` (doc_id, toxic) marks.

    A bounded sample is used: of either class the first labels by a hash of the id, up to
    ``FIT_TOXIC`` and ``FIT_CLEAN``; of these, in the order of another hash, as many as
    ``FIT_BYTES`` hold, whatever the length of each. The last of that order, of both classes, set
    the thresholds. Labels other than 0 and 1 and documents without a text are left out. With no
    rows the model gives a constant score.
    """
    sample = _sample(docs, labels)
    texts = [bytes(r.text) for r in sample]
    toxic = np.array([r.toxic for r in sample], dtype=np.float64)
    held = int(len(sample) * (1 - CHECK_SHARE))
    model = train(texts[:held], toxic[:held], seed)
    model.thresholds = calibrated_thresholds(
        predict(model, texts[held:]), toxic[held:], [r.lang for r in sample[held:]]
    )
    return model


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, toxic of every labelled text, each task's rows in the order of a hash.

    A Bloom filter of the labelled ids keeps the texts of most others out of the exchange.
    """
    spark = docs.sparkSession
    known = stored(_known(labels), "toxic-labels")
    texts = docs.select("doc_id", "text", "lang").where("text IS NOT NULL")
    rows = texts.join(known.where("toxic IN (0, 1)"), "doc_id")
    rows = rows.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text", "toxic")
    n = max(known.count(), 1)
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    given = {
        "applicationSideScanSizeThreshold": "0",
        "creationSideThreshold": "1g",
        "expectedNumItems": str(n),
        "numBits": str(max(10 * n, 1 << 13)),
    }
    before = {k: spark.conf.get(prefix + k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(prefix + k, v)
        return stored(rows, "labelled")
    finally:
        for k, v in before.items():
            spark.conf.set(prefix + k, v)


def _weights(model: Model) -> np.ndarray:
    """All weights in rows of ``DIM``: the embeddings, then the dense layers."""
    parts = [*model.filters.values(), model.bias, model.out, np.array([model.out_bias])]
    dense = np.concatenate([p.reshape(-1) for p in parts])
    dense = np.pad(dense, (0, -len(dense) % DIM)).reshape(-1, DIM)
    return np.concatenate([model.embed, dense])


def _with_weights(rows: np.ndarray) -> Model:
    model = _new_model(0)
    model.embed[:] = rows[:BUCKETS]
    dense, at = rows[BUCKETS:].reshape(-1), 0
    for part in (*model.filters.values(), model.bias, model.out):
        part[...] = dense[at : at + part.size].reshape(part.shape)
        at += part.size
    model.out_bias = float(dense[at])
    return model


def _descended(rows: DataFrame, model: Model, rate: float, seed: list[int]) -> Model:
    """The model after one pass over all rows (text, toxic).

    Every task descends over its own rows from the same weights. A weight's change is the mean of
    the tasks', an embedding's by the gradients it had in each, so a word known to one task only
    moves as there. Of every task at most one row per embedding is exchanged.
    """
    sums = [f"s{k}" for k in range(DIM)]
    begin = _weights(model)

    def run(batches):
        descent = _Descent(_with_weights(begin), rate, seed)
        for rest, texts in chunks(batches, limit=PASS_BYTES):
            descent.over(texts, np.array(rest["toxic"], dtype=np.float64))
        if not descent.rows:
            return
        change = np.rint((_weights(descent.model) - begin) * DELTA_STEPS).astype(np.int64)
        times = np.append(descent.seen, np.full(len(begin) - BUCKETS, descent.rows))
        at = np.flatnonzero(times)
        moved = change[at] * times[at, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(times[at]), *[pa.array(c) for c in moved.T.copy()]],
            names=["at", "times", *sums],
        )

    schema = ", ".join(f"{c} long" for c in ("at", "times", *sums))
    tasks = rows.select(text_bytes().alias("text"), "toxic").mapInArrow(run, schema)
    total = tasks.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("times", *sums)]).toArrow()
    change = np.stack([total.column(c).to_numpy() for c in sums], axis=1) / DELTA_STEPS
    after = begin.copy()
    after[total.column("at").to_numpy()] += change / total.column("times").to_numpy()[:, None]
    return _with_weights(after)


def _pass_tasks(rows: int, cores: int) -> int:
    """Tasks of a pass: one per ``TASK_ROWS`` as far as cores are there, and more for many rows.

    Each sends its change of nearly all weights whatever its rows, so tasks beyond the cores only
    add to the exchange.
    """
    return max(min(rows // TASK_ROWS, cores), rows // FULL_TASK_ROWS, 1)


def grid_thresholds(scored: DataFrame) -> dict[str, float]:
    """``calibrated_thresholds`` of rows (score, toxic, lang), from their counts on a grid."""
    step = F.floor(F.col("score") * SCORE_STEPS).alias("step")
    counts = scored.where("lang IS NOT NULL").groupBy("lang", step)
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    above = [F.sum(c).over(down) for c in ("toxic", "n")]
    good = F.when(above[0] / above[1] >= PRECISION, F.col("step") / SCORE_STEPS)
    rows = counts.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    found = rows.select("lang", good.alias("good")).groupBy("lang").agg(F.min("good").alias("at"))
    return {
        r.lang: float(np.clip(THRESHOLD if r.at is None else r.at, 0.5, 0.9))
        for r in found.orderBy("lang").collect()
    }


def fit_all(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """Train as ``fit`` does, but on every labelled text and with thresholds from every row held back.

    A share of the ids by their hash is held back. A fit on some of the other rows gives the weights
    to start from; then each of ``PASS_RATES`` is one pass over all of them by Spark tasks. To the
    driver come one row per embedding and pass, and one per language.
    """
    # The model is on the driver: the labelled texts need not stay in the shared folder.
    with passing(docs.sparkSession):
        rows = _labelled(docs, labels)
        held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(1000)) < 1000 * CHECK_SHARE
        learnt = rows.where(~held)
        sample = _sample(learnt, learnt)
        texts = [bytes(r.text) for r in sample]
        model = train(texts, np.array([r.toxic for r in sample], dtype=np.float64), seed)
        cores = docs.sparkSession.sparkContext.defaultParallelism
        dealt = learnt.coalesce(_pass_tasks(learnt.count(), cores))
        for k, rate in enumerate(PASS_RATES):
            model = _descended(dealt, model, rate, [seed, k])
        checked = with_scores(rows.where(held).select("text", "lang", "toxic"), model)
        model.thresholds = grid_thresholds(checked)
    return model


def threshold(model: Model, lang: str = "lang"):
    """The threshold of a row's language; ``THRESHOLD`` for languages without labelled rows."""
    found = F.lit(THRESHOLD)
    for name, value in model.thresholds.items():
        found = F.when(F.col(lang) == name, value).otherwise(found)
    return found


def with_scores(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of its whole text; a column of its name is replaced.

    A missing text scores as an empty one; every other column may hold NULLs and passes through.
    """
    docs = docs.drop(into)
    width = len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches):
        for batch in batches:
            # Within a batch only the texts are copied, a chunk at a time.
            texts = batch.column(width)
            scores = []
            for _, part in chunks([pa.RecordBatch.from_arrays([texts], ["text"])]):
                scores.append(predict(model, part))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score, pa.float64())],
                names=[*batch.schema.names[:-1], into],
            )

    return docs.select("*", text_bytes().alias("_bytes")).mapInArrow(run, schema)
