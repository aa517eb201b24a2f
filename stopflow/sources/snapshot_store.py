"""Snapshot tables in versions, with one manifest per version as the commit point.

A version writes nodes and edges to folders of its own, one directory per date. Then a manifest that
names the version of every date is moved to its number: readers see all of a version or nothing, and
of two writers at once one fails. What a failed write leaves is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("nodes", "edges")
DATE = "transit_date"
OVERWRITE, DATES = "overwrite", "dates"


@dataclass(frozen=True)
class Manifest:
    """Per table, its columns and the version folder that holds each date directory."""

    number: int
    schemas: dict[str, str]
    dates: dict[str, dict[str, str]]


class _Files:
    """The store's file system, through Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> JavaObject:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        if not self.fs.exists(at):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(at)]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """The file with this text, all at once; fails if it is there already."""
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._at(name)
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer has committed {name}; write again")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The last committed one, or None where nothing is."""
    files = _Files(spark, path)
    numbers = [int(n.removesuffix(".json")) for n in files.names("_manifests") if n.endswith(".json") and n[0] != "."]
    if not numbers:
        return None
    return Manifest(**json.loads(files.read(f"_manifests/{max(numbers)}.json")))


def write_snapshots(
    nodes: DataFrame, edges: DataFrame, path: str, mode: str = OVERWRITE
) -> Manifest:
    """Commit both tables together: all of the store, or with ``mode="dates"`` only the dates that
    either of them has; other dates stay as they are and are not read.
    """
    if mode not in (OVERWRITE, DATES):
        raise ValueError(f"no mode {mode!r}")
    spark = nodes.sparkSession
    files, old = _Files(spark, path), manifest(spark, path)
    number = old.number + 1 if old else 1
    version = f"v{number}-{uuid.uuid4().hex[:8]}"
    new = {}
    for name, table in zip(TABLES, (nodes, edges), strict=True):
        at = f"{name}/{version}"
        table.hint("rebalance", DATE).write.partitionBy(DATE).parquet(f"{files.path}/{at}")
        new[name] = {d: version for d in files.names(at) if d.startswith(f"{DATE}=")}
    replaced = {d for dates in new.values() for d in dates}
    dates = {
        name: ({d: v for d, v in old.dates[name].items() if d not in replaced} if old and mode == DATES else {})
        | new[name]
        for name in TABLES
    }
    schemas = {n: t.schema.json() for n, t in zip(TABLES, (nodes, edges), strict=True)}
    made = Manifest(number, schemas, dates)
    files.commit(f"_manifests/{number}.json", json.dumps(vars(made)))
    return made


def _table(spark: SparkSession, path: str, held: Manifest, name: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(held.schemas[name]))
    root = f"{path.rstrip('/')}/{name}"
    paths = [f"{root}/{v}/{d}" for d, v in sorted(held.dates[name].items())]
    if not paths:
        return spark.createDataFrame([], schema)
    # The column of the date comes from its directory, below that of its version.
    frames = {}
    for p, v in zip(paths, (v for _, v in sorted(held.dates[name].items())), strict=True):
        frames.setdefault(v, []).append(p)
    tables = [
        spark.read.schema(schema).option("basePath", f"{root}/{v}").parquet(*own)
        for v, own in sorted(frames.items())
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select(*schema.names)


def read_snapshots(
    spark: SparkSession, path: str, number: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the last version, or of the one with a number."""
    held = manifest(spark, path)
    if held and number is not None:
        held = Manifest(**json.loads(_Files(spark, path).read(f"_manifests/{number}.json")))
    if held is None:
        raise FileNotFoundError(f"no committed snapshots in {path}")
    return tuple(_table(spark, path, held, name) for name in TABLES)


def prune_snapshots(spark: SparkSession, path: str) -> Sequence[str]:
    """Delete all versions that the last manifest does not name; returns their folders.

    For times without writers and without readers of older versions.
    """
    files, held = _Files(spark, path), manifest(spark, path)
    gone = []
    for name in TABLES:
        used = set(held.dates[name].values()) if held else set()
        gone += [f"{name}/{v}" for v in files.names(name) if v not in used]
    for number in files.names("_manifests"):
        if held and number != f"{held.number}.json" and number.endswith(".json"):
            gone.append(f"_manifests/{number}")
    for name in gone:
        files.delete(name)
    return gone
