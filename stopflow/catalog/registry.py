"""Collects queries: a Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.catalog.roles import Tables, with_roles

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, roles: str = "", sql: str | None = None):
    """Register a function of ``Tables`` under a name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in RUN:
            raise ValueError(f"query {name!r} registered twice")
        RUN[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_roles(roles, sql)
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six decimals, as sums depend on the order of their terms."""
    doubles = {c for c, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, places).alias(c) if c in doubles else c for c in df.columns])


def r(*cols: str) -> str:
    """SQL for rounded columns; ``t.c`` keeps the name ``c``."""
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)
