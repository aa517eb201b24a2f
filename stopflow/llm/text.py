"""Word tables of many texts at once, as arrays, for use inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Closes each text in the token stream; the byte never occurs in UTF-8.
END = b"\xff"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Every ASCII character but letters and digits becomes a space: words are then runs of
# letters, digits and non-ASCII characters.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
# Bytes of text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 8 << 20

# Freed memory goes back to the system: a Python worker lives through many tasks beside the JVM.
pa.set_memory_pool(pa.system_memory_pool())
_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Hand pages that numpy has freed back to the system, where the C library can."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; a missing text is an empty one."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Group the rows of Arrow batches to about ``limit`` bytes of text: (other columns, texts)."""
    rest: dict[str, list] = {}
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        others = [n for n in batch.schema.names if n != column]
        values = {n: batch.column(n).to_pylist() for n in others}
        for i, text in enumerate(batch.column(column)):
            raw = text.as_py()
            for n in others:
                rest.setdefault(n, []).append(values[n][i])
            texts.append(raw)
            size += len(raw)
            if size >= limit:
                yield rest, texts
                rest, texts, size = {}, [], 0
                trim()
    if texts:
        yield rest, texts
        del rest, texts
        trim()


def token_table(
    texts: list[bytes], table: bytes | None = LOWER
) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts, each text closed by ``END``.

    ``table`` maps the bytes first: ``LOWER``, ``PLAIN``, or None to leave them.
    Returns the token codes of all texts in order, the distinct tokens by code, and the position
    of every text's first token (one more entry than texts).
    """
    joined = (b" " + END + b" ").join(texts) + b" " + END
    if table is not None:
        joined = joined.translate(table)
    raw = np.frombuffer(joined, dtype=np.uint8)
    inside = ~_SPACE[raw]
    letters = raw[inside]
    # Word borders; of arrays as long as the text no more are kept than needed.
    wide = len(letters) >= 2**31
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    del joined, raw, inside
    offsets = np.zeros(len(edges) // 2 + 1, dtype=np.int64 if wide else np.int32)
    np.cumsum(edges[1::2] - edges[0::2], out=offsets[1:])
    del edges
    values = pa.Array.from_buffers(
        pa.large_binary() if wide else pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets), pa.py_buffer(letters)],
    ).dictionary_encode()
    del offsets, letters
    codes = values.indices.to_numpy()
    words = values.dictionary.to_pylist()
    ends = np.flatnonzero(codes == words.index(END)) if texts else np.empty(0, np.int64)
    return codes, words, np.concatenate([[0], ends + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: begin[0] .. begin[0] + sizes[0] - 1, then the next run."""
    out = np.ones(int(sizes.sum()), dtype=np.int64)
    if not len(out):
        return out
    begin, sizes = begin[sizes > 0], sizes[sizes > 0]
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out[0] = begin[0]
    out[heads[1:]] = begin[1:] - (begin[:-1] + sizes[:-1] - 1)
    return np.cumsum(out)
