"""Sharding by histogram sort: even bytes per shard, found by counting, with one exchange.

Rows are ordered by (hash of the text, doc_id), so equal texts lie together. The search for the
39 keys that cut 40 even shards counts exact bytes between probe keys in every partition, keeps
for each cut the range that holds it, and probes again inside, until a cut is within tolerance
or falls between two neighbouring keys. Only then are the rows exchanged, once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopflow.session import stored

SHARDS = 40
# Allowed distance of a cut from its even place, as a share of a shard's bytes.
TOLERANCE = 0.005
# Probe keys per open range and round.
PROBES = 32
# Rows of a range that one task numbers.
RANGE_ROWS = 20_000

_LOW = -(1 << 63)
_MASK = (1 << 64) - 1
TOP = (1 << 128) - 1


def _split(key: int) -> tuple[int, int]:
    return (key >> 64) + _LOW, (key & _MASK) + _LOW


def _joined(h: int, d: int) -> int:
    return ((h - _LOW) << 64) | (d - _LOW)


def bins_below(h: np.ndarray, d: np.ndarray, probes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of probe keys smaller than each key (h, d); probes are sorted."""
    ph, pd_ = probes
    left, right = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    out = left.copy()
    tied = np.flatnonzero(left < right)
    for at in np.unique(left[tied]):
        own = tied[left[tied] == at]
        out[own] += np.searchsorted(pd_[at : right[own[0]]], d[own], "left")
    return out


def _arrays(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_split(k) for k in keys]
    return (
        np.array([p[0] for p in parts], dtype=np.int64),
        np.array([p[1] for p in parts], dtype=np.int64),
    )


@dataclass
class Range:
    """Keys above one probe up to the next: bytes, rows, and the smallest and largest key."""

    bytes: int
    rows: int
    first: int
    last: int


def histogram(keys: DataFrame, probes: list[int]) -> dict[int, Range]:
    """Exact contents of the ranges between sorted probe keys; one small row per range."""
    edges = _arrays(probes)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h, d = batch.column("h").to_numpy(), batch.column("d").to_numpy()
            size = batch.column("size").to_numpy()
            where = bins_below(h, d, edges)
            order = np.lexsort((d, h, where))
            heads = np.flatnonzero(np.diff(where[order], prepend=-1))
            tails = np.append(heads[1:], len(order)) - 1
            first, last = order[heads], order[tails]
            columns = [
                where[first],
                np.add.reduceat(size[order], heads),
                tails - heads + 1,
                h[first],
                d[first],
                h[last],
                d[last],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["bin", "bytes", "rows", "h0", "d0", "h1", "d1"],
            )

    schema = "bin long, bytes long, rows long, h0 long, d0 long, h1 long, d1 long"
    found = (
        keys.mapInArrow(run, schema)
        .groupBy("bin")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.sum("rows").alias("rows"),
            F.min(F.struct("h0", "d0")).alias("first"),
            F.max(F.struct("h1", "d1")).alias("last"),
        )
        .collect()
    )
    return {r["bin"]: Range(r["bytes"], r["rows"], _joined(*r["first"]), _joined(*r["last"])) for r in found}


def _between(low: int, high: int, n: int) -> list[int]:
    """Up to n keys from low to below high, evenly spread."""
    width = high - low
    return sorted({low + width * i // n for i in range(n)}) if width > 0 else []


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[int]:
    """The keys that close the shards but the last; rows up to and with the key are before it."""
    whole = histogram(keys, []).get(0)
    if whole is None:
        return [TOP] * (shards - 1)
    slack = tolerance * whole.bytes / shards
    wanted = [whole.bytes * (i + 1) / shards for i in range(shards - 1)]
    # Per cut: bytes up to ``low``, and the range above it that holds the wanted place.
    open_cuts = {i: (whole.first - 1, 0, whole) for i in range(shards - 1)}
    cuts: dict[int, int] = {}
    while open_cuts:
        ranges = {(low, r.first, r.last) for low, _, r in open_cuts.values()}
        each = max(PROBES, 1024 // len(ranges))
        probes = sorted(
            {low for low, _, _ in ranges}
            | {k for _, first, last in ranges for k in _between(first, last, each)}
            | {last for _, _, last in ranges}
        )
        found = histogram(keys, probes)
        before, at = [], 0
        for b in range(len(probes) + 1):
            before.append(at)
            at += found[b].bytes if b in found else 0
        for i in list(open_cuts):
            want = wanted[i]
            # The range whose bytes span the wanted place.
            b = max(b for b in found if before[b] <= want)
            r = found[b]
            below, above = before[b], before[b] + r.bytes
            low = probes[b - 1] if b > 0 else r.first - 1
            near = below if want - below <= above - want else above
            if abs(near - want) <= slack or r.first == r.last:
                cuts[i] = low if near == below else r.last
                del open_cuts[i]
            else:
                open_cuts[i] = (low, below, r)
    return [cuts[i] for i in range(shards - 1)]


def fine_edges(keys: DataFrame, cuts: list[int], limit: int) -> tuple[list[int], dict[int, Range]]:
    """More edges between the cuts, until no range of several keys has more rows than the limit."""
    edges = sorted(set(cuts))
    found = histogram(keys, edges)
    while True:
        more = set()
        for r in found.values():
            if r.rows > limit and r.first < r.last:
                more.update(_between(r.first, r.last, 2 * (r.rows // limit + 1)))
        if not more - set(edges):
            return edges, found
        edges = sorted(set(edges) | more)
        found = histogram(keys, edges)


def sharded(
    docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with size, shard and slot.

    Size is the bytes of the text and 16. Shards follow the order of (text hash, doc_id); slots
    number a shard's rows in that order from 0. Equal texts share a shard unless a cut must fall
    inside their group to keep sizes even. A missing text has size 16; a missing doc_id sorts
    first; rows equal in text and doc_id stay together. Columns named size, shard or slot are
    replaced, all others pass through.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    tagged = docs.withColumn("size", size).withColumns(
        {
            "_h": F.xxhash64("text"),
            "_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)),
        }
    )
    keys = stored(tagged.select(F.col("_h").alias("h"), F.col("_d").alias("d"), "size"), "shard-keys")
    cuts = splitters(keys, shards, tolerance)
    edges, found = fine_edges(keys, cuts, RANGE_ROWS)
    table = _arrays(edges)

    # Per range: its shard, and the rows of the shard in the ranges before it.
    shard_of = [sum(c < _end(edges, b) for c in cuts) for b in range(len(edges) + 1)]
    shard_at = np.array(shard_of, dtype=np.int32)
    rows = np.array([found[b].rows if b in found else 0 for b in range(len(edges) + 1)])
    before = np.cumsum(rows) - rows
    first = np.searchsorted(shard_at, np.arange(shards), "left")
    starts = np.append(before, rows.sum())[first]
    ahead = before - starts[shard_at]

    @F.pandas_udf("long")
    def range_of(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(bins_below(h.to_numpy(), d.to_numpy(), table))

    @F.pandas_udf("shard int, ahead long")
    def place_of(b: pd.Series) -> pd.DataFrame:
        i = b.to_numpy()
        return pd.DataFrame({"shard": shard_at[i], "ahead": ahead[i]})

    order = Window.partitionBy("_range").orderBy("_h", "_d")
    numbered = tagged.withColumn("_range", range_of("_h", "_d")).withColumn(
        "_at", F.row_number().over(order)
    )
    placed = numbered.withColumn("_place", place_of("_range"))
    return placed.select(
        *[c for c in docs.columns if c not in ("size", "shard", "slot")],
        "size",
        F.col("_place.shard").alias("shard"),
        (F.col("_place.ahead") + F.col("_at") - 1).cast("long").alias("slot"),
    )


def _end(edges: list[int], b: int) -> int:
    """The last key that can lie in range b."""
    return edges[b] if b < len(edges) else TOP + 1
