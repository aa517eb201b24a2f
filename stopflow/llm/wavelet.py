"""Token ids in wavelet matrix files: one compressed file per run of documents.

A file holds one bit plane per bit of the ids, each plane ordered by the bits above it, with a
directory of counts. It gives the token at any place, the count of a token up to a place and the
place of its k-th occurrence without being unpacked, and all tokens when read in full.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopflow.llm.packing import from_file, to_file
from stopflow.llm.succinct import Bits, pack_bits
from stopflow.llm.text import chunks, spans, text_bytes
from stopflow.llm.wordbpe import tokenizer
from stopflow.session import stored

# Text bytes encoded together, and tokens of a file; a longer document has a file of its own.
TEXT_BYTES, FILE_TOKENS = 8 << 20, 1 << 22
# Pieces whose ids a worker process remembers from task to task.
KNOWN_PIECES = 800_000
# New pieces that are encoded as one text.
JOINED_PIECES = 256
END_ID = 0
NO_ID = -(1 << 63)


class WaveletMatrix:
    def __init__(self, size: int, planes: list[Bits], zeros: list[int]):
        self.size, self.planes, self.zeros = size, planes, zeros

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
        a = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(width - 1, -1, -1):
            bit = (a >> b & 1).astype(bool)
            planes.append(Bits(pack_bits(bit), len(a)))
            low = a[~bit]
            zeros.append(len(low))
            a = np.concatenate([low, a[bit]])
        return cls(len(ids), planes, zeros)

    def all(self) -> np.ndarray:
        """Every token, plane by plane from the lowest."""
        width = len(self.planes)
        a = np.zeros(self.size, dtype=np.uint16 if width <= 16 else np.uint32)
        for b, (plane, zeros) in enumerate(
            zip(reversed(self.planes), reversed(self.zeros), strict=True)
        ):
            raw = plane.words.view(np.uint8)
            bit = np.unpackbits(raw, count=self.size, bitorder="little").view(bool)
            above = np.empty_like(a)
            above[~bit] = a[:zeros]
            above[bit] = a[zeros:] | a.dtype.type(1 << b)
            a = above
        return a

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at positions."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(at)
            ones = plane.rank1(at)
            out = out << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if token >> len(self.planes):
            return 0, 0
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            a, b = (int(x) for x in plane.rank1(np.array([lo, hi])))
            one = token >> (len(self.planes) - 1 - k) & 1
            lo, hi = (zeros + a, zeros + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before a position (by default everywhere)."""
        lo, hi = self._range(token, self.size if end is None else end)
        return hi - lo

    def locate(self, token: int) -> np.ndarray:
        """All positions of a token, ascending."""
        lo, hi = self._range(token, self.size)
        at = np.arange(lo, hi, dtype=np.int64)
        for k in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - k) & 1
            at = self.planes[k].select(at - self.zeros[k] if one else at, bool(one))
        return at


def file_of(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.of(ids)
    named = np.array([NO_ID if d is None else d for d in doc_ids], dtype=np.int64)
    arrays = {
        "doc_ids": named,
        "ends": np.cumsum(lengths).astype(np.int64),
        "zeros": np.array([matrix.size, *matrix.zeros], dtype=np.int64),
    }
    for k, plane in enumerate(matrix.planes):
        arrays |= {f"plane{k}": plane.words, f"ranks{k}": plane.directory}
    return to_file(arrays)


def open_file(raw) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids (``NO_ID`` where missing), ends of the documents, and the matrix."""
    a = from_file(raw)
    size, *zeros = a["zeros"].tolist()
    planes = [Bits(a[f"plane{k}"], size, a[f"ranks{k}"]) for k in range(len(zeros))]
    return a["doc_ids"], a["ends"], WaveletMatrix(size, planes, zeros)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where texts can be cut without changing their encoding.

    The tokenizer's pattern never joins a word to the white space after it. So a cut before ASCII
    white space is safe unless white space, of any kind, ends right before it.
    """
    space = _SPACE[raw]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    one, two = raw[at - 1], raw[np.maximum(at - 2, 0)]
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide |= (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    wide |= ((two == 0x81) & (one == 0x9F)) | ((two == 0x9A) & (one == 0x80))
    wide |= (one >= 0x1C) & (one <= 0x1F)
    cut = np.zeros(len(raw), dtype=bool)
    cut[at[~wide]] = True
    cut[starts] = True
    return np.flatnonzero(cut)


class _Known:
    """Ids of pieces encoded before in this worker process, up to ``KNOWN_PIECES`` of them."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ends = array("q", [0])
        self.ids = array("I")


_KNOWN: dict[str, _Known] = {}


@functools.cache
def _token_bytes(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level tokenizer stands for."""
    encode = tokenizer(path)
    sizes = {i: len(token) for token, i in encode.get_vocab().items()}
    sizes |= {i: len(t.content.encode()) for i, t in encode.get_added_tokens_decoder().items()}
    out = np.zeros(max(sizes, default=0) + 1, dtype=np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def _fresh_ids(pieces: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in order and their number per piece.

    Pieces are joined where they may be cut again and told apart by the bytes of their tokens; where
    these do not meet the borders, each is encoded by itself.
    """
    encode = tokenizer(path)
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.append(0, ends[:-1])
    raw = b"".join(pieces)
    cuts = _cuts(np.frombuffer(raw, dtype=np.uint8), starts[:1])
    joined = cuts[np.minimum(np.searchsorted(cuts, starts), len(cuts) - 1)] == starts
    joined[::JOINED_PIECES] = False
    heads = starts[~joined].tolist()
    texts = [raw[x:y].decode() for x, y in zip(heads, [*heads[1:], len(raw)], strict=True)]
    found = [e.ids for e in encode.encode_batch_fast(texts, add_special_tokens=False)]
    ids = np.array([i for x in found for i in x], dtype=np.uint32)
    at = np.append(0, np.cumsum(_token_bytes(path)[ids]))
    upto = np.searchsorted(at, ends)
    if at[-1] == ends[-1] and (at[upto] == ends).all():
        return ids, np.diff(upto, prepend=0)
    parts = [p.decode() for p in pieces]
    found = [e.ids for e in encode.encode_batch_fast(parts, add_special_tokens=False)]
    ids = np.array([i for x in found for i in x], dtype=np.uint32)
    return ids, np.array([len(x) for x in found], dtype=np.int64)


def _piece_ids(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and size of each piece's ids in a flat array."""
    known = _KNOWN.setdefault(path, _Known())
    at = np.array([known.number.get(w, -1) for w in words], dtype=np.int64)
    new = np.flatnonzero(at < 0)
    fresh = [words[k] for k in new.tolist()]
    parts = [_fresh_ids(fresh[i : i + 10_000], path) for i in range(0, len(fresh), 10_000)]
    new_ids = np.concatenate([np.empty(0, np.uint32), *[p[0] for p in parts]])
    new_sizes = np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]])
    old_ends = np.array(known.ends, dtype=np.int64)
    old_ids = np.array(known.ids, dtype=np.uint32)
    sizes = np.empty(len(words), dtype=np.int64)
    begin = np.empty(len(words), dtype=np.int64)
    seen = at >= 0
    begin[seen] = old_ends[at[seen]]
    sizes[seen] = old_ends[at[seen] + 1] - begin[seen]
    sizes[new] = new_sizes
    new_ends = len(old_ids) + np.cumsum(new_sizes)
    begin[new] = new_ends - new_sizes
    flat = np.concatenate([old_ids, new_ids])
    kept = fresh[: max(KNOWN_PIECES - len(known.number), 0)]
    known.number.update(zip(kept, range(len(known.number), len(known.number) + len(kept))))
    known.ends.frombytes(new_ends[: len(kept)].astype(np.int64).tobytes())
    known.ids.frombytes(new_ids[: int(new_sizes[: len(kept)].sum())].tobytes())
    return begin, sizes, flat


def encoded(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, each text closed by ``END_ID``, and the ids per text.

    Equal to encoding each whole text; every distinct piece of them is encoded once.
    """
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(raw):
        return np.full(len(texts), END_ID, np.uint32), np.ones(len(texts), dtype=np.int64)
    cuts = _cuts(raw, np.unique(starts[starts < ends]))
    offsets = np.append(cuts, len(raw))
    kind, width = (pa.binary(), np.int32) if len(raw) < 2**31 else (pa.large_binary(), np.int64)
    buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(raw)]
    table = pa.Array.from_buffers(kind, len(cuts), buffers).dictionary_encode()
    codes = table.indices.to_numpy().astype(np.int64)
    begin, sizes, flat = _piece_ids(table.dictionary.to_pylist(), path)
    ids = flat[spans(begin[codes], sizes[codes])]
    upto = np.concatenate([[0], np.cumsum(sizes[codes])])
    doc_end = upto[np.searchsorted(cuts, ends, "left")]
    lengths = np.diff(doc_end, prepend=0) + 1
    return np.insert(ids, doc_end, END_ID), lengths


def write_files(docs: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """part, block, n_tokens, file: the documents' ids in ascending doc_id order.

    Every document's ids end with ``END_ID``. Parts are ranges of doc_id; a part's documents are
    sorted and written to files of about ``FILE_TOKENS`` tokens. Rows without doc_id come first,
    rows that share one stand side by side in the order of their texts. A missing text is an
    empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, total = [], [], [], 0

        def closed():
            file = file_of(doc_ids, np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([total], pa.int64()),
                    pa.array([file], pa.binary()),
                ],
                names=["part", "block", "n_tokens", "file"],
            )

        for rest, texts in chunks(batches, limit=TEXT_BYTES):
            own, sizes = encoded(texts, path)
            if total and total + len(own) > FILE_TOKENS:
                yield closed()
                doc_ids, lengths, ids, total, block = [], [], [], 0, block + 1
            doc_ids += rest["doc_id"]
            lengths.append(sizes)
            ids.append(own)
            total += len(own)
        if total:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "part int, block int, n_tokens long, file binary")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit).

    The running sum goes over one small row per file.
    """
    order = Window.orderBy("part", "block")
    starts = files.select("part", "block", "n_tokens").withColumn(
        "ahead", F.sum("n_tokens").over(order) - F.col("n_tokens")
    )
    starts = stored(starts.drop("n_tokens"), "file-starts")

    def run(batches):
        for batch in batches:
            for file, ahead in zip(batch.column("file"), batch.column("ahead"), strict=True):
                doc_ids, ends, matrix = open_file(file.as_buffer())
                ids = matrix.all().astype("<u4")
                begin = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ends), 256):
                    b, e = begin[at : at + 256], ends[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(
                                [None if d == NO_ID else d for d in doc_ids[at : at + 256].tolist()],
                                pa.int64(),
                            ),
                            pa.array(b + ahead.as_py(), pa.int64()),
                            pa.array(
                                [ids[x:y].tobytes() for x, y in zip(b, e, strict=True)], pa.binary()
                            ),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    placed = files.select("part", "block", "file").join(starts, ["part", "block"])
    return placed.select("file", "ahead").mapInArrow(run, "doc_id long, start long, ids binary")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """doc_id and place in the document of every occurrence of a token, from the bit planes."""

    def run(batches):
        for batch in batches:
            for file in batch.column("file"):
                doc_ids, ends, matrix = open_file(file.as_buffer())
                at = matrix.locate(token)
                doc = np.searchsorted(ends, at, "right")
                begin = np.concatenate([[0], ends[:-1]])
                named = doc_ids[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(named, pa.int64(), mask=named == NO_ID),
                        pa.array(at - begin[doc], pa.int64()),
                    ],
                    names=["doc_id", "place"],
                )

    return files.select("file").mapInArrow(run, "doc_id long, place long")
