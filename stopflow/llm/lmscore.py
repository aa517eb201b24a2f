"""Language-model scores from a bigram trie in Elias-Fano levels, sharded by word.

The model is a bigram with a Dirichlet prior on the word distribution,

    p(w | v) = (c(v w) + MU * p(w)) / (c(v) + MU),   p(w) = (c(w) + 1) / (N + V + 1),

a proper distribution whose logarithm splits into a part known where w is and a part known where
v is. So everything about a word stands in one shard: its count, its contexts and their counts.
Tokens travel once, as blocks per shard, and partial sums travel back; neither the model nor the
corpus has to fit one executor. A shard's trie is a file of monotone sequences that a task maps
into memory: words, pointers to their contexts, and contexts relative to the word before.

Words are known by 64-bit hashes, contexts by 56 bits of them.
"""

from __future__ import annotations

import mmap
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopflow.llm.packing import from_file, packed, to_file, unpacked
from stopflow.llm.succinct import EliasFano
from stopflow.llm.text import (
    END,
    chunks,
    spans,
    text_bytes,
    token_table,
    trim,
    word_hashes,
)
from stopflow.session import stored

MU = 4.0
# Text bytes that a task turns into blocks at once.
BLOCK_BYTES = 24 << 20
# One document in so many is looked at for words too frequent for one shard.
SAMPLE = 64
START = b"\xfe"
_END_HASH = word_hashes([END])[0]
_EIGHT = np.uint64(8)


def frequent_words(docs: DataFrame, shards: int) -> list[int]:
    """Hashes of words with more than a quarter of a shard's even share, at most 4 * shards.

    Found in a sample; the list only steers how tokens are dealt, never the result.
    """

    def run(batches):
        for _, texts in chunks(batches):
            codes, words, _ = token_table(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(word_hashes(words).view(np.int64)),
                    pa.array(np.bincount(codes, minlength=len(words))),
                ],
                names=["h", "n"],
            )

    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = few.select(text_bytes().alias("text")).mapInArrow(run, "h long, n long")
    counts = stored(counts.groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * 4 * shards > total).select("h").collect()
    return sorted(r["h"] % (1 << 64) for r in found)


def blocks(docs: DataFrame, shards: int, frequent: list[int], postings: bool) -> DataFrame:
    """Bigrams of all texts by shard: one row per shard and about ``BLOCK_BYTES`` of text.

    A frequent word's bigrams are dealt to all shards by context, any other word has one shard.
    With ``postings`` a row also lists the documents of every bigram, and one row of a chunk
    the chunk's doc_ids and token counts.
    """
    salted = np.array(frequent, dtype=np.uint64)

    def run(batches):
        part = TaskContext.get().partitionId()
        for seq, (rest, texts) in enumerate(chunks(batches, limit=BLOCK_BYTES)):
            yield from _chunk_rows((part << 24) + seq, rest, texts)

    def _chunk_rows(chunk, rest, texts):
        codes, words, starts = token_table(texts)
        h = word_hashes([*words, START])
        many = len(h)
        before = np.empty(len(codes), dtype=np.int32)
        before[1:] = codes[:-1]
        before[starts[:-1]] = many - 1
        order = np.argsort(codes.astype(np.int64) * many + before, kind="stable")
        word, context = codes[order], before[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (context[1:] != context[:-1])
        heads = np.flatnonzero(new)
        runs = np.diff(np.append(heads, len(order)))
        word, context = word[heads], context[heads]
        spread = np.where(np.isin(h, salted)[word], h[context], np.uint64(0)) % np.uint64(shards)
        shard = ((h[word] % np.uint64(shards) + spread) % np.uint64(shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[by_shard], np.arange(shards + 1))
        doc_of = np.repeat(np.arange(len(texts)), np.diff(starts))[order] if postings else None
        for s in range(shards):
            own = by_shard[edges[s] : edges[s + 1]]
            names = postings and s == chunk % shards
            if not len(own) and not names:
                continue
            w = word[own]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            table, index = np.unique(h[context[own]] >> _EIGHT, return_inverse=True)
            docs_of = doc_of[spans(heads[own], runs[own])] if postings else np.empty(0)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": s,
                        "chunk": chunk,
                        "words": packed(h[w[first]]),
                        "fan": packed(np.diff(np.append(first, len(w)))),
                        "contexts": packed(table),
                        "context": packed(index),
                        "runs": packed(runs[own]),
                        "docs": packed(docs_of),
                        "doc_ids": rest["doc_id"] if names else None,
                        "sizes": packed(np.diff(starts)) if names else None,
                        "n_docs": len(texts),
                    }
                ],
                schema=_BLOCK,
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(
        run,
        "shard int, chunk long, words binary, fan binary, contexts binary, context binary, "
        "runs binary, docs binary, doc_ids array<long>, sizes binary, n_docs int",
    )


_BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int64()),
        *[(n, pa.binary()) for n in ("words", "fan", "contexts", "context", "runs", "docs")],
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.binary()),
        ("n_docs", pa.int32()),
    ]
)


def _merged(table: pa.Table, frequent: list[int]) -> pa.Table:
    """One shard's counts from its blocks."""
    trim()
    rows = table.to_pylist()
    words = np.unique(np.concatenate([unpacked(r["words"]) for r in rows]))
    contexts = np.unique(np.concatenate([unpacked(r["contexts"]) for r in rows]))
    keys, counts = [], []
    for r in rows:
        w = np.searchsorted(words, unpacked(r["words"]))
        c = np.searchsorted(contexts, unpacked(r["contexts"]))[unpacked(r["context"])]
        keys.append(np.repeat(w, unpacked(r["fan"])) * len(contexts) + c)
        counts.append(unpacked(r["runs"]).astype(np.int64))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    pairs = np.add.reduceat(counts[order], heads)
    keys = keys[heads]
    w, c = keys // len(contexts), keys % len(contexts)
    count = np.bincount(w, weights=pairs, minlength=len(words)).astype(np.int64)
    salted = np.isin(words, np.array(frequent, dtype=np.uint64))
    return pa.table(
        {
            "shard": pa.array([rows[0]["shard"]], pa.int32()),
            "n_tokens": pa.array([int(count.sum())], pa.int64()),
            "n_words": pa.array([int((~salted).sum())], pa.int64()),
            "frequent": pa.array(
                [
                    [
                        {"h": int(x), "n": int(n)}
                        for x, n in zip(words[salted].view(np.int64), count[salted], strict=True)
                    ]
                ],
                pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])),
            ),
            "words": [packed(words)],
            "count": [packed(count)],
            "fan": [packed(np.bincount(w, minlength=len(words)))],
            "contexts": [packed(contexts)],
            "context": [packed(c)],
            "pairs": [packed(pairs)],
        }
    )


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit steps between the smallest and the largest value, and these two."""
    if not len(x):
        return np.empty(0, np.uint16), np.zeros(2)
    low, high = float(x.min()), float(x.max())
    step = (high - low) / 65535 or 1.0
    return np.rint((x - low) / step).astype(np.uint16), np.array([low, step])


class Trie:
    """The levels of one shard, over arrays that may lie in a mapped file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.words, self.pointers, self.contexts, self.successors = (
            EliasFano.from_arrays([arrays[f"{n}{i}"] for i in range(4)])
            for n in ("words", "pointers", "contexts", "successors")
        )
        self.arrays = arrays

    @staticmethod
    def file(words, count, fan, contexts, context, pairs, total: float) -> bytes:
        """``total`` is N + V + 1. Contexts of a word stand above the last of the word before."""
        pointers = np.concatenate([[0], np.cumsum(fan)])
        last = context[np.maximum(pointers[1:] - 1, 0)] + 1 if len(fan) else np.empty(0, np.int64)
        base = np.cumsum(last) - last
        steps = np.repeat(base, fan) + context + 1
        prior = MU * (count + 1.0) / total
        levels = {
            "unseen": np.log10(prior),
            "next": -np.log10(count + MU),
            "pair": np.log10(pairs + np.repeat(prior, fan)),
        }
        arrays = {"count": count}
        for name, x in levels.items():
            arrays[name], arrays[f"{name}_scale"] = quantised(x)
        for name, x in (
            ("words", words), ("pointers", pointers), ("contexts", contexts), ("successors", steps),
        ):
            arrays |= {f"{name}{i}": a for i, a in enumerate(EliasFano.of(x).arrays())}
        return to_file(arrays)

    def value(self, level: str, at: np.ndarray) -> np.ndarray:
        low, step = self.arrays[f"{level}_scale"]
        return low + step * self.arrays[level][at]

    def pairs(self, word: np.ndarray, fan: np.ndarray, context: np.ndarray):
        """For runs of ``fan`` contexts under each known word: place in the pair level, and
        whether it is there. A context's successor is sought relative to its word's range."""
        begin = self.pointers.get(word).astype(np.int64)
        end = np.repeat(self.pointers.get(word + 1).astype(np.int64), fan)
        base = np.zeros(len(word), dtype=np.uint64)
        base[begin > 0] = self.successors.get(begin[begin > 0] - 1)
        target = np.repeat(base, fan) + context.astype(np.uint64) + np.uint64(1)
        at = self.successors.find(target)
        there = at < end
        there[there] = self.successors.get(at[there]) == target[there]
        return at, there


def mapped(raw: bytes) -> Trie:
    """The trie over a memory map of its file; the name goes at once, the map stays valid."""
    with tempfile.NamedTemporaryFile() as file:
        file.write(raw)
        file.flush()
        return Trie(from_file(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)))


@dataclass
class Model:
    """``tries``: shard and file of each shard. N tokens, V words, ends of training texts."""

    tries: DataFrame
    shards: int
    frequent: list[int]
    tokens: int
    vocabulary: int
    texts: int


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """Count the bigrams of ``docs`` (doc_id, text) and build the tries."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    frequent = frequent_words(docs, shards)
    counts = stored(
        blocks(docs, shards, frequent, postings=False)
        .groupBy("shard")
        .applyInArrow(
            lambda table: _merged(table, frequent),
            "shard int, n_tokens long, n_words long, frequent array<struct<h: long, n: long>>, "
            "words binary, count binary, fan binary, contexts binary, context binary, "
            "pairs binary",
        ),
        "lm-counts",
    )
    n, v = counts.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    split = counts.select(F.explode("frequent").alias("f")).groupBy("f.h").agg(F.sum("f.n"))
    totals = {h % (1 << 64): c for h, c in split.collect()}
    n, v = n or 0, (v or 0) + len(totals)
    texts = docs.count()
    names = np.array(sorted(totals), dtype=np.uint64)
    sums = np.array([totals[int(x)] for x in names], dtype=np.int64)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = unpacked(r["words"])
                count = unpacked(r["count"]).astype(np.int64)
                salted = np.isin(words, names)
                count[salted] = sums[np.searchsorted(names, words[salted])]
                file = Trie.file(
                    words,
                    count,
                    unpacked(r["fan"]).astype(np.int64),
                    unpacked(r["contexts"]),
                    unpacked(r["context"]).astype(np.int64),
                    unpacked(r["pairs"]).astype(np.int64),
                    float(n + v + 1),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]], pa.int32()), pa.array([file], pa.binary())],
                    names=["shard", "file"],
                )

    tries = stored(counts.mapInArrow(run, "shard int, file binary"), "lm-tries")
    return Model(tries, shards, frequent, n, v, texts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row's whole text.

    Lower-cased (A-Z) words and one end per text are the tokens. A missing text is an empty one,
    which has the end alone; repeated rows are scored alike, a missing doc_id stays missing and
    other columns are ignored. Untrained, the model gives every token the same probability.
    ``docs`` should be a table or stored frame, read again alike if a task is repeated.
    """
    total = float(model.tokens + model.vocabulary + 1)
    first = -np.log10(model.texts + MU)

    def run(tries: pa.Table, rows: pa.Table) -> pa.Table:
        trie = mapped(tries["file"][0].as_py()) if tries.num_rows else None
        # One block at a time: a shard's blocks together are many times one block.
        blocks_of = (rows.slice(i, 1).to_pylist()[0] for i in range(rows.num_rows))
        out = pa.Table.from_pylist([_partial(r, trie, total) for r in blocks_of], schema=_PARTIAL)
        trim()
        return out

    tokens = blocks(docs, model.shards, model.frequent, postings=True)
    partial = (
        model.tries.groupBy("shard")
        .cogroup(tokens.groupBy("shard"))
        .applyInArrow(
            run,
            "chunk long, score binary, base binary, known binary, doc_ids array<long>, "
            "sizes binary",
        )
    )

    def together(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        named = next(r for r in rows if r["sizes"] is not None)
        sums = [
            np.sum([np.frombuffer(r[n], np.float64) for r in rows], axis=0)
            for n in ("score", "base")
        ]
        known = np.sum([unpacked(r["known"]) for r in rows], axis=0, dtype=np.int64)
        return pa.table(
            {
                "doc_id": pa.array(named["doc_ids"], pa.int64()),
                "n_tokens": pa.array(unpacked(named["sizes"]).astype(np.int64)),
                "n_known": pa.array(known),
                "base_score": pa.array(sums[1]),
                "score": pa.array(sums[0] + first),
            }
        )

    return partial.groupBy("chunk").applyInArrow(
        together, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


_PARTIAL = pa.schema(
    [
        ("chunk", pa.int64()),
        *[(n, pa.binary()) for n in ("score", "base", "known")],
        ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.binary()),
    ]
)


def _partial(r: dict, trie: Trie | None, total: float) -> dict:
    """What a shard's words add to the sums of a chunk's documents."""
    words, fan = unpacked(r["words"]), unpacked(r["fan"]).astype(np.int64)
    contexts, context = unpacked(r["contexts"]), unpacked(r["context"]).astype(np.int64)
    runs, docs = unpacked(r["runs"]).astype(np.int64), unpacked(r["docs"])
    count = np.zeros(len(words), dtype=np.int64)
    value = np.full(len(words), np.log10(MU / total))
    follows = np.full(len(words), -np.log10(MU))
    if trie is not None:
        at, known = trie.words.has(words)
        count[known] = trie.arrays["count"][at[known]]
        value[known] = trie.value("unseen", at[known])
        follows[known] = trie.value("next", at[known])
    follows[words == _END_HASH] = 0
    pair = np.repeat(value, fan)
    if trie is not None and known.any():
        c, c_known = trie.contexts.has(contexts)
        w_known = np.repeat(known, fan)
        # Contexts that the shard lacks sort behind all others and are found under no word.
        ids = np.where(c_known, c, trie.contexts.n)[context[w_known]]
        place, there = trie.pairs(at[known], fan[known], ids)
        seen = np.flatnonzero(w_known)[there]
        pair[seen] = trie.value("pair", place[there])
    pair += np.repeat(follows, fan)
    base = np.repeat(np.log10((count + 1.0) / total), fan)
    size = r["n_docs"]
    sums = [np.bincount(docs, np.repeat(x, runs), minlength=size) for x in (pair, base)]
    known_tokens = np.repeat(np.repeat(count > 0, fan), runs)
    return {
        "chunk": r["chunk"],
        "score": sums[0].tobytes(),
        "base": sums[1].tobytes(),
        "known": packed(np.bincount(docs, known_tokens, minlength=size)),
        "doc_ids": r["doc_ids"],
        "sizes": r["sizes"],
    }


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))
