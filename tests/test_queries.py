"""Every registered query against its SQL in DuckDB, and repartition invariance of a plan."""

import decimal
import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from stopflow.catalog.roles import Tables  # noqa: E402
from stopflow.operators.trips import TRIP  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(row[i]) for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, str(SF_DIR))
    assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


def test_edge_targets_do_not_depend_on_partitioning(spark):
    t = Tables(spark, str(SF_DIR))

    def targets(parts):
        t.prepared = t.prepared.repartition(parts)
        t.__dict__.pop("ready", None)
        rows = t.ready.select(*TRIP, "stop_sequence", "source", "target").collect()
        return sorted(map(str, rows))

    assert targets(1) == targets(16)
