"""Records out of large single JSON documents, read by several tasks.

A document such as a GeoJSON feature collection or an array of readings need not have line breaks
where it could be split. Spark's text source reads it in byte ranges all the same when told that
lines end at ``}``. What a range cannot know is whether it begins inside a string and how deep. A first
pass notes for each range how it changes both; their running totals give every range its start. A
second pass cuts the records out. One that crosses a border is put together from its pieces.

All reading is Spark's, so any store that Spark reads will do.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopflow.session import stored

# Tasks get this module with the job; executors need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of a range that are looked at together.
CHUNK_BYTES = 8 << 20
BATCH_ROWS = 1_000
QUOTE, ESCAPE = ord('"'), ord("\\")
RANGE = ["file", "block"]
WHOLE, TAIL, MIDDLE, HEAD, END = range(5)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of the files between closing braces, in order within each byte range."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def _steps(raw: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(places of brackets, whether each stands outside strings, whether a string is open behind)."""
    quotes = np.flatnonzero(raw == QUOTE)
    behind = quotes[quotes > 0]
    for q in behind[raw[behind - 1] == ESCAPE].tolist():
        k = q - 1
        while k >= 0 and raw[k] == ESCAPE:
            k -= 1
        if (q - 1 - k) % 2:
            quotes = quotes[quotes != q]
    kind = np.zeros(256, dtype=bool)
    kind[[ord(c) for c in "{}[]"]] = True
    at = np.flatnonzero(kind[raw])
    outside = (np.searchsorted(quotes, at) + in_string) % 2 == 0
    return at, outside, bool((len(quotes) + in_string) % 2)


def _signs(chars: np.ndarray) -> np.ndarray:
    return np.where((chars == ord("{")) | (chars == ord("[")), 1, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """(columns of the range, bytes) of consecutive fragments of a range."""
    first, some, size = None, [], 0
    for batch in batches:
        others = [n for n in batch.schema.names if n != "value"]
        rows = batch.select(others).to_pylist()
        for row, value in zip(rows, batch.column("value"), strict=True):
            if first is not None and (row["file"], row["block"]) != (first["file"], first["block"]):
                yield first, b"}".join(some) + b"}"
                first, some, size = None, [], 0
            first = first or row
            some.append(value.as_py())
            size += len(some[-1])
            if size >= CHUNK_BYTES:
                yield first, b"}".join(some) + b"}"
                first, some, size = None, [], 0
    if first is not None:
        yield first, b"}".join(some) + b"}"


_PROFILE = "file long, block long, outside long, inside long, flips boolean, root string"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each range changes the depth, begun outside or inside a string, and the string state."""
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.string()]
    schema = pa.schema(list(zip([c.split()[0] for c in _PROFILE.split(", ")], kinds, strict=True)))

    def row(key, depth, open_, root):
        values = (*key, depth[0], depth[1], open_, root)
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema)

    now, depth, open_, root = None, [0, 0], False, ""
    for own, text in _chunks(batches):
        key = own["file"], own["block"]
        if key != now:
            if now is not None:
                yield row(now, depth, open_, root)
            now, depth, open_ = key, [0, 0], False
            root = text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")
        raw = np.frombuffer(text, np.uint8)
        at, outside, open_after = _steps(raw, open_)
        sign = _signs(raw[at])
        depth[0] += int(sign[outside].sum())
        depth[1] += int(sign[~outside].sum())
        open_ = open_after
    if now is not None:
        yield row(now, depth, open_, root)


_START = "file long, block long, in_string boolean, depth long, level int"


def _starts(key: str | None):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        level = 2 if key is not None else 0 if rows[0]["root"] == "{" else 1
        out, open_, depth = [], False, 0
        for r in rows:
            out.append(
                {"file": r["file"], "block": r["block"], "in_string": open_, "depth": depth, "level": level}
            )
            depth += r["inside"] if open_ else r["outside"]
            open_ ^= r["flips"]
        schema = pa.schema(
            [("file", pa.int64()), ("block", pa.int64()), ("in_string", pa.bool_()), ("depth", pa.int64()), ("level", pa.int32())]
        )
        return pa.Table.from_pylist(out, schema)

    return run


@dataclass
class _Range:
    """What is known of a byte range at the place that has been read to."""

    in_string: bool
    depth: int
    level: int
    # Whether the records now passed are wanted; None while that depends on an earlier range.
    wanted: bool | None
    # Whether an element is unfinished, its bytes, whether it began here, and whether it is wanted.
    # One that did not begin here may turn out to be no object.
    inside: bool = False
    rest: list[bytes] = field(default_factory=list)
    began: bool = False
    rest_wanted: bool | None = None

    def __post_init__(self):
        self.inside = self.depth > self.level

    def cut(self, text: bytes, key: bytes | None) -> Iterator[tuple[int, bool | None, bytes]]:
        raw = np.frombuffer(text, np.uint8)
        at, outside, open_ = _steps(raw, self.in_string)
        at = at[outside]
        char = raw[at]
        after = self.depth + np.cumsum(_signs(char))
        before = after - _signs(char)
        begins = at[(char == ord("{")) & (before == self.level)]
        ends = at[(char == ord("}")) & (after == self.level)] + 1
        # Members of the root object: their records are wanted under the one key.
        doors, flags = np.empty(0, np.int64), []
        if key is not None:
            doors = at[(before == 1) & (after == 2)]
            flags = [_is_member(text, int(d), key) for d in doors]
        known = [self.wanted, *flags]
        which = np.searchsorted(doors, begins)
        if self.inside:
            back = np.flatnonzero(after == self.level)
            self.rest.append(text[: at[back[0]] + 1] if len(back) else text)
            if len(back):
                if char[back[0]] == ord("}"):
                    yield (WHOLE if self.began else HEAD), self.rest_wanted, b"".join(self.rest)
                    ends = ends[1:]
                self.inside, self.rest = False, []
        for a, b, w in zip(begins.tolist(), ends.tolist(), which.tolist(), strict=False):
            yield WHOLE, known[w], text[a:b]
        if len(begins) > len(ends):
            self.inside, self.began, self.rest = True, True, [text[int(begins[-1]) :]]
            self.rest_wanted = known[int(which[-1])]
        self.in_string, self.wanted = open_, known[-1]
        self.depth = int(after[-1]) if len(after) else self.depth


def _is_member(text: bytes, at: int, key: bytes) -> bool:
    """Whether the bracket opens the array of a member of this name."""
    if text[at : at + 1] != b"[":
        return False
    name = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', text[max(0, at - len(key) - 200) : at])
    return bool(name) and name[1] == key


_CUT = "file long, block long, ord long, part int, wanted boolean, value binary"


def _cuts(key: str | None):
    name = None if key is None else key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.bool_(), pa.binary()]
        schema = pa.schema(list(zip([c.split()[0] for c in _CUT.split(", ")], kinds, strict=True)))

        def rows():
            now, state, n = None, None, 0

            def end():
                if state.inside:
                    part = TAIL if state.began else MIDDLE
                    yield (*now, n, part, state.rest_wanted, b"".join(state.rest))
                yield (*now, n + 1, END, state.wanted, b"")

            for own, text in _chunks(batches):
                if (own["file"], own["block"]) != now:
                    if now is not None:
                        yield from end()
                    now, n = (own["file"], own["block"]), 0
                    wanted = True if name is None else None
                    state = _Range(own["in_string"], own["depth"], own["level"], wanted)
                for part, wanted, value in state.cut(text, name):
                    yield (*now, n, part, wanted, value)
                    n += 1
            if now is not None:
                yield from end()

        some, size = [], 0
        for row in rows():
            some.append(row)
            size += len(row[-1])
            if len(some) >= BATCH_ROWS or size >= CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], schema=schema)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], schema=schema)

    return run


def read_records(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The objects (``value``, as text) of the arrays that JSON documents hold, one row each.

    Every file is one document: an array, or with ``key`` an object whose member of that name is
    the array. Without ``key`` a file may also be a single object, which is then the one record.
    Elements that are no objects are passed over, and so is a record that its file breaks off.
    """
    if key is not None and ("}" in key or '"' in key or "\\" in key):
        raise ValueError("a key cannot hold a brace, a quote or a backslash")
    fragments = _fragments(spark, path)
    starts = fragments.mapInArrow(_profiles, _PROFILE).groupBy("file").applyInArrow(_starts(key), _START)
    # One narrow row per byte range of the input, which Spark's own list of ranges also has.
    placed = fragments.join(F.broadcast(starts), RANGE)
    cut = stored(placed.mapInArrow(_cuts(key), _CUT), "records")

    in_file = Window.partitionBy("file").orderBy("block", "ord")
    ranges = cut.where(F.col("part") == END).select(
        *RANGE, F.last("wanted", True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("_inherited")
    )
    pieces = cut.where(F.col("part").between(TAIL, HEAD))
    # A record is a tail, the whole ranges behind it, and a head; what an array left is no record.
    begun = F.sum((F.col("part") == TAIL).cast("int")).over(in_file)
    ended = F.sum((F.col("part") == HEAD).cast("int")).over(
        in_file.rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = (
        pieces.withColumn("_record", begun + F.coalesce(ended, F.lit(0)))
        .groupBy("file", "_record")
        .agg(
            F.min_by("block", "block").alias("block"),
            F.min_by("wanted", F.struct("block", "ord")).alias("wanted"),
            (F.bool_or(F.col("part") == TAIL) & F.bool_or(F.col("part") == HEAD)).alias("_ended"),
            F.array_sort(F.collect_list(F.struct("block", "ord", "value"))).alias("_pieces"),
        )
        .where("_ended")
        .select(
            *RANGE,
            "wanted",
            F.aggregate(
                "_pieces", F.lit(b""), lambda all_, p: F.concat(all_, p["value"])
            ).alias("value"),
        )
    )
    every = cut.where(F.col("part") == WHOLE).select(*RANGE, "wanted", "value").unionByName(joined)
    own = every.join(F.broadcast(ranges), RANGE) if key is not None else every
    wanted = F.coalesce("wanted", "_inherited", F.lit(False)) if key is not None else F.lit(True)
    return own.where(wanted).select(F.col("value").cast("string").alias("value"))
