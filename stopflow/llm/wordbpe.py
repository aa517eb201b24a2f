"""BPE encoding and decoding over a table of distinct words.

Texts are split at white space into blocks: a block holds its documents' words as numbers and
its distinct words, dealt to shards by hash. A shard encodes each distinct word of all blocks
once. The ids go back to the blocks and take the place of the word numbers; decoding joins every
id with its piece.
"""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.packing import packed, unpacked, unzstd, zstd
from stopflow.llm.text import END, chunks, spans, text_bytes, token_table, trim
from stopflow.session import scratch_path

# Text bytes of a block, and of the documents that leave a task together.
BLOCK_BYTES, OUT_BYTES = 10 << 20, 4 << 20


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.cache
def pieces(path: str) -> list[bytes]:
    """The piece of every id; ids without one are never produced."""
    known = tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(known.values()) + 1)
    for piece, i in known.items():
        out[i] = piece.encode()
    return out


def blocks(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents as word numbers, with the distinct words of the block by shard."""

    def run(batches):
        for rest, texts in chunks(batches, limit=block_bytes):
            codes, words, starts = token_table(texts, None)
            texts.clear()
            codes = np.delete(codes, starts[1:] - 1)
            lengths = np.diff(starts) - 1
            # The end marks go; numbers above theirs move down by one.
            end = words.index(END)
            words.pop(end)
            codes = codes - (codes > end)
            # Frequent words get small numbers; words about as frequent stand in their own
            # order. Both compress well.
            counts = np.bincount(codes, minlength=len(words))
            group = -np.log2(np.maximum(counts, 1)).astype(np.int64)
            order = np.array(sorted(range(len(words)), key=lambda i: (group[i], words[i])))
            order = order.astype(np.int64)
            rank = np.empty(len(words), dtype=np.int64)
            rank[order] = np.arange(len(words))
            words = [words[i] for i in order]
            shard = np.fromiter(
                (xxhash.xxh3_64_intdigest(w) % shards for w in words), np.int64, len(words)
            )
            dealt: list[list[bytes]] = [[] for _ in range(shards)]
            for w, s in zip(words, shard.tolist(), strict=True):
                dealt[s].append(w)
            del words, counts, group, order
            sent = []
            for x in dealt:
                sent.append(zstd(b" ".join(x)) if x else None)
                x.clear()
            trim()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_64_intdigest(os.urandom(16)) >> 1], pa.int64()),
                    pa.array([rest["doc_id"]], pa.list_(pa.int64())),
                    pa.array([packed(lengths)]),
                    pa.array([packed(rank[codes])]),
                    pa.array([packed(shard)]),
                    pa.array([sent], pa.list_(pa.binary())),
                ],
                names=["block", "doc_ids", "lengths", "codes", "shard_of", "words"],
            )

    schema = (
        "block long, doc_ids array<long>, lengths binary, codes binary, shard_of binary, "
        "words array<binary>"
    )
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, schema)


def encoded_words(made: DataFrame, path: str) -> DataFrame:
    """block, shard, counts and ids of the block's words, from one encoding of each word."""

    def run(table: pa.Table) -> pa.Table:
        encode = tokenizer(path)
        lists = [unzstd(b).split(b" ") for b in table["words"].to_pylist()]
        number: dict[bytes, int] = {}
        places = [
            np.fromiter((number.setdefault(w, len(number)) for w in x), np.int64, len(x))
            for x in lists
        ]
        ids, sizes = [], np.empty(len(number), dtype=np.int64)
        distinct = list(number)
        for at in range(0, len(distinct), 10_000):
            part = [w.decode() for w in distinct[at : at + 10_000]]
            for i, e in enumerate(encode.encode_batch_fast(part, add_special_tokens=False), at):
                ids.append(np.array(e.ids, dtype=np.uint32))
                sizes[i] = len(ids[-1])
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        counts, values = [], []
        for x in places:
            counts.append(packed(sizes[x]))
            values.append(packed(flat[spans(begin[x], sizes[x])]))
        return pa.table(
            {
                "block": table["block"],
                "shard": table["shard"].cast(pa.int32()),
                "counts": pa.array(counts, pa.binary()),
                "ids": pa.array(values, pa.binary()),
            }
        )

    dealt = made.select("block", F.posexplode("words").alias("shard", "words"))
    dealt = dealt.where("words IS NOT NULL")
    return dealt.groupBy("shard").applyInArrow(
        run, "block long, shard int, counts binary, ids binary"
    )


def _bucketed(made: DataFrame, buckets: int) -> DataFrame:
    """The blocks, written to the shared folder in buckets of ``block``: a join needs no exchange."""
    spark = made.sparkSession
    name = f"stopflow_blocks_{uuid.uuid4().hex}"
    writer = made.write.bucketBy(buckets, "block").option("path", scratch_path(spark, "blocks"))
    writer.saveAsTable(name)
    rows = spark.table(name)
    # The frame holds the files; only the name in the catalog goes.
    spark.sql(f"DROP TABLE {name}")
    return rows


def encode_decode(
    docs: DataFrame, path: str, shards: int | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the decoded text of each row.

    Equal to encoding the whole text with the tokenizer file at ``path`` without special tokens
    added, and decoding the ids with special tokens kept: this tokenizer drops white space, so
    words between ASCII white space are encoded apart. A missing or empty text has no ids;
    repeated rows and missing ids are rows like any other, other columns are ignored.
    Smaller blocks take less memory of a task and repeat more words.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = _bucketed(blocks(docs, shards, block_bytes), shards)
    words = encoded_words(made, path).groupBy("block").agg(
        F.collect_list(F.struct("shard", "counts", "ids")).alias("found")
    )

    def run(batches):
        piece = pieces(path)
        for batch in batches:
            for row in batch.to_pylist():
                shard = unpacked(row["shard_of"])
                sizes = np.zeros(len(shard), dtype=np.int64)
                order = np.argsort(shard, kind="stable")
                found = sorted(row["found"] or [], key=lambda x: x["shard"])
                if found:
                    sizes[order] = np.concatenate([unpacked(x["counts"]) for x in found])
                    flat = np.concatenate([unpacked(x["ids"]) for x in found])
                else:
                    flat = np.empty(0, np.uint32)
                begin = np.zeros(len(shard), dtype=np.int64)
                ordered = sizes[order]
                begin[order] = np.cumsum(ordered) - ordered
                text_of = [
                    b" ".join([piece[i] for i in flat[b : b + n].tolist()])
                    for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)
                ]
                yield from _documents(row, sizes, begin, flat, text_of)
                del row, shard, sizes, order, found, flat, begin, text_of
                trim()

    joined = made.drop("words").join(words, "block", "left")
    return joined.mapInArrow(run, "doc_id long, ids binary, decoded string")


def _documents(row, sizes, begin, flat, text_of):
    """The block's documents, in batches of bounded size."""
    codes = unpacked(row["codes"]).astype(np.int64)
    ends = np.cumsum(unpacked(row["lengths"]).astype(np.int64))
    doc_ids, ids, decoded, size, start = [], [], [], 0, 0
    for doc_id, end in zip(row["doc_ids"], ends.tolist(), strict=True):
        own = codes[start:end]
        start = end
        n = sizes[own]
        doc_ids.append(doc_id)
        ids.append(flat[spans(begin[own], n)].astype("<u4").tobytes())
        decoded.append(b" ".join([text_of[c] for c in own[n > 0].tolist()]))
        size += len(decoded[-1]) + len(ids[-1])
        if size >= OUT_BYTES:
            yield _batch(doc_ids, ids, decoded)
            doc_ids, ids, decoded, size = [], [], [], 0
    if doc_ids:
        yield _batch(doc_ids, ids, decoded)


def _batch(doc_ids, ids, decoded):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc_ids, pa.int64()),
            pa.array(ids, pa.binary()),
            pa.array(decoded, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "ids", "decoded"],
    )
