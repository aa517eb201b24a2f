"""The permutation index against brute force over every awkward row."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopflow.llm import permindex
from stopflow.llm.queries import RUN
from stopflow.llm.shipping import ship

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("vec", "shard", "part", "score", "rank", "query_id")}
    )


def vectors(n, seed=0, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, width))
    # A third of the rows are near copies of one vector; norms differ.
    x[: n // 3] = x[0] + 0.01 * rng.normal(size=(n // 3, width))
    return (x * rng.uniform(0.5, 2, (n, 1))).tolist()


def brute(rows, k, every):
    by_id = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        by_id[i] = min(by_id.get(i, v), v)
    width = max(map(len, by_id.values()))
    ids = sorted(by_id)
    x = np.array([by_id[i] + [0.0] * (width - len(by_id[i])) for i in ids])
    out = {}
    for q, i in enumerate(ids):
        if i % every == 0:
            score = (x * x[q]).sum(axis=1)
            order = sorted((-s, j) for s, j in zip(score.tolist(), ids, strict=True) if j != i)
            out[i] = [(j, -s) for s, j in order[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rows = list(enumerate(vectors(3_000)))
    df = frame(spark, rows)
    found = permindex.nearest(df, F.col("vec_id") % 20 == 0, 20)
    got, want = by_query(found), brute(rows, 20, 20)
    assert got.keys() == want.keys()
    held = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(held) >= 0.9
    assert np.isclose(permindex.recall(df, found, F.col("vec_id") % 20 == 0, 20), np.mean(held))
    x = np.array([v for _, v in rows])
    for q, pairs in got.items():
        assert len(pairs) == 20 and pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))
        assert all(s == (x[i] * x[q]).sum() for i, s in pairs)


def test_few_and_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (20, [2.0, 1.0, 0.0]), (40, [1.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.0]),
        (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [inf, 1.0]),
        (None, [1.0, 1.0]), (60, [1e200, 1.0]), (9, [1e-200, 1e-200]), (1, [1.0, 2.0]), (10, [1e180, -1e180]),
        (80, [0.5, 0.5]), (80, [0.25, 9.0]), (80, [0.5, 0.5]), (100, None),
    ]
    found = permindex.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert by_query(found) == brute(rows, 20, 20)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(3, [1.0]), (5, [2.0])], [(0, None), (20, [0.0])]])
def test_tables_without_neighbours(spark, rows):
    assert permindex.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_equal_vectors_fill_the_ranks_by_id(spark):
    rows = [(i, [3.0, 4.0]) for i in range(500)]
    got = by_query(permindex.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0, 5))
    assert got[0] == [(i, 25.0) for i in (1, 2, 3, 4, 5)]
    assert got[100] == [(i, 25.0) for i in range(5)]


def test_files_give_the_footrule_distance():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(5, 8))
    pivots = permindex.lifted(x[:40], permindex.norms(x).max())
    listed = permindex.orders(permindex.lifted(x, permindex.norms(x).max()), pivots, 12)
    asked = permindex.orders(permindex.asking(q), pivots, 6)
    files, gain = permindex.post(listed, 40), permindex.gains(6, 12)
    for order in asked:
        got = permindex.footrule(files, 200, order, gain)
        far = sum(abs(j - 12) for j in range(6))
        for i in range(200):
            place = {p: k for k, p in enumerate(listed[i].tolist())}
            assert got[i] == far - sum(abs(j - place.get(p, 12)) for j, p in enumerate(order.tolist()))


def test_query_on_whole_table(spark, tmp_path):
    rows = list(enumerate(vectors(700, seed=5)))
    frame(spark, rows).write.parquet(str(Path(tmp_path) / "embeddings.parquet"))
    got, want = by_query(RUN["op13_permutation_search"](spark, str(tmp_path))), brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    held = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(held) >= 0.9
