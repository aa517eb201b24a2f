"""Session settings the operators read, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings that suit these jobs on a cluster; pass them to ``SparkSession.builder``.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# A group up to this many rows is one task's work and is never split.
HOT_GROUP_ROWS = ("stopflow.hotGroupRows", 1_000_000)
# A lookup side up to this many (narrow) rows may be broadcast.
BROADCAST_ROWS = ("stopflow.broadcastRows", 100_000)


def setting(spark: SparkSession, option: tuple[str, int]) -> int:
    key, default = option
    return int(spark.conf.get(key, str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints.

    ``spark.checkpoint.dir`` must name it on a cluster. Only a local master, whose tasks all run
    on this machine, may do without: it gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stopflow-"))
    return sc.getCheckpointDir()


_SCRATCH: dict[str, list[str]] = {}
# The tables of each ``passing`` block that is open, the outermost first.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> int:
    """Delete the stage tables this application wrote so far; returns how many.

    For callers that have read their results: frames that still refer to a stage cannot be
    evaluated afterwards.
    """
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the stage tables written inside, but those stored with ``outlive``.

    For results that are on the driver or stored: other frames made inside cannot be evaluated
    afterwards.
    """
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(token)
        known = _SCRATCH.get(spark.sparkContext.applicationId, [])
        for path in paths:
            if path in known:
                known.remove(path)
        _delete(spark, paths)


def scratch_path(spark: SparkSession, name: str, outlive: bool = False) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/stopflow/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    blocks = _PASSING.get()[: -1 if outlive else None]
    if blocks:
        blocks[-1].append(path)
    return path


def stored(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage where several later steps need the same rows: they then scan only the
    columns they use, and a lost executor costs a file read instead of the whole plan. With
    ``outlive`` the table stays when the innermost ``passing`` block ends.
    """
    path = scratch_path(df.sparkSession, name, outlive)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
