"""Compressed integer arrays, and several named arrays in one run of bytes."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa


def zstd(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzstd(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Compressed unsigned integers: bytes of equal weight stand together."""
    values = np.ascontiguousarray(values)
    wide = values.dtype == np.uint64
    values = values.astype("<u8" if wide else "<u4")
    planes = values.view(np.uint8).reshape(-1, 8 if wide else 4).T
    raw = np.ascontiguousarray(planes).tobytes()
    return bytes([planes.shape[0]]) + len(values).to_bytes(8, "little") + zstd(raw)


def unpacked(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    kind = "<u8" if width == 8 else "<u4"
    if n == 0:
        return np.empty(0, dtype=kind)
    planes = np.frombuffer(unzstd(blob[9:]), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def to_file(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays one after another, each from a multiple of 8 bytes, behind a header of places."""
    at, body, places = 0, [], {}
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        places[name] = (at, len(a), a.dtype.str)
        body += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    header = json.dumps(places).encode()
    header += b" " * (-len(header) % 8)
    return len(header).to_bytes(8, "little") + header + b"".join(body)


def from_file(raw) -> dict[str, np.ndarray]:
    """The arrays of ``to_file``, as views of a buffer or a memory map."""
    view = memoryview(raw)
    size = int.from_bytes(view[:8], "little")
    places = json.loads(bytes(view[8 : 8 + size]))
    return {
        name: np.frombuffer(view, dtype=kind, count=n, offset=8 + size + at)
        for name, (at, n, kind) in places.items()
    }
