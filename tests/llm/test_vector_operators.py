"""Vector operators against plain versions, and the succinct structures below them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopflow import session
from stopflow.llm import annlinks, mtree
from stopflow.llm.components import components
from stopflow.llm.packing import from_file, packed, to_file, unpacked
from stopflow.llm.succinct import Bits, EliasFano, pack_bits
from stopflow.llm.wavelet import WaveletMatrix

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def vectors(spark, corpus):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.3, (400, 8)).astype(np.float32)
    x[100:160] = x[100]  # one vector very often
    x[200:230] = x[200] + rng.normal(0, 0.01, (30, 8))  # near copies
    rows = [(k, v.tolist(), k % 3 if k < 100 else 1, "clash") for k, v in enumerate(x)]
    rows += [
        (1000, None, 1, "x"),
        (1001, [None] * 8, 1, "x"),
        (1002, [float("nan")] * 8, 1, "x"),
        (1003, [float("inf")] * 8, 1, "x"),
        (1004, [0.0] * 8, 1, "x"),
        (1050, x[100].tolist(), None, "x"),
        (None, x[100].tolist(), 1, "x"),
        (7, x[7].tolist(), 1, "x"),
        (7, x[7].tolist(), 1, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def usable(vectors):
    ids, x, labels = [], [], []
    for r in vectors.select("vec_id", "embedding", "label").distinct().collect():
        ok = r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)
        if ok and r.vec_id is not None:
            ids.append(r.vec_id)
            x.append(r.embedding)
            labels.append(r.label)
    return np.array(ids), np.array(x, dtype=np.float64), labels


def test_top_k(vectors, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 60)
    got = mtree.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    ids, x, _ = usable(vectors)
    ints = np.floor(256 * x)
    first = np.unique(ids, return_index=True)[1]
    ids, ints = ids[first], ints[first]
    expected = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = (ints @ ints[q]).astype(int)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != ids[q]][:5]
        expected += [(ids[q], n, ids[k], score[k]) for n, k in enumerate(order, 1)]
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in got]
    assert sorted(found) == sorted(tuple(map(int, e)) for e in expected)
    assert mtree.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 100, (20, 6))
    x = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 1, (2000, 6)))
    top = float((x * x).sum(axis=1).max())
    search = mtree.Search(mtree.build(np.arange(2000), x, top), 5)
    best, names, computed = search.run(np.arange(50), x[:50], np.full(50, -np.inf))
    score = x[:50] @ x.T
    score[np.arange(50), np.arange(50)] = -np.inf
    assert (best == -np.sort(-score, axis=1)[:, :5]).all()
    assert computed.mean() < 1000


def brute_links(vectors, threshold=annlinks.THRESHOLD):
    ids, x, labels = usable(vectors)
    near = np.zeros((len(ids), len(ids)), dtype=bool)
    norm = np.sqrt((x * x).sum(axis=1))
    for a in range(len(ids)):
        if labels[a] is not None and norm[a] > 0:
            same = np.array([lab == labels[a] for lab in labels]) & (norm > 0)
            near[a, same] = x[same] @ x[a] / (norm[same] * norm[a]) >= threshold
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        low = np.array([min(label[a], *label[near[a]]) if near[a].any() else label[a] for a in range(len(ids))])
        if (low == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids.tolist(), near.sum(axis=1), label, strict=True)}
        label = low


def test_links(vectors, monkeypatch):
    monkeypatch.setattr(annlinks, "CELL_ROWS", 120)
    monkeypatch.setattr(annlinks, "SHARD_ROWS", 100)
    # A vector whose id stands under two labels would be two vectors; leave that out here.
    plain = vectors.where("vec_id IS NULL OR vec_id != 7")
    got = annlinks.linked(plain).collect()
    assert len(got) == plain.count()
    expected = brute_links(plain)
    true = sum(n for n, _ in expected.values())
    found = 0
    for r in got:
        n, component = expected.get(r.vec_id, (0, r.vec_id))
        assert r.n_links <= n
        found += r.n_links
        assert (r.component_id, r.kept) == (component, r.vec_id == component or r.vec_id is None)
    assert found >= 0.9 * true
    assert annlinks.audit(plain, annlinks.linked(plain)) [0] >= 0
    assert annlinks.linked(plain.limit(0)).count() == 0


def test_linked_vectors_share_their_home_cells():
    rng = np.random.default_rng(8)
    x = annlinks.unit(rng.normal(0, 1, (1, 8)) + rng.normal(0, 0.05, (2000, 8)))
    row, cell, home = annlinks.memberships(x, x[:60], annlinks.THRESHOLD)
    member = np.zeros((len(x), 60), dtype=bool)
    member[row, cell] = True
    of = np.full(len(x), -1)
    of[row[home]] = cell[home]
    assert home.sum() == len(x)
    a, b = np.nonzero(x @ x.T >= annlinks.THRESHOLD)
    assert member[b, of[a]].all()


def test_links_of_a_near_copy_group_above_the_cell_size(spark, corpus, monkeypatch):
    monkeypatch.setattr(annlinks, "CELL_ROWS", 60)
    monkeypatch.setattr(annlinks, "SHARD_ROWS", 300)
    rng = np.random.default_rng(9)
    copies = rng.normal(0, 0.3, 16) + rng.normal(0, 0.01, (1200, 16))
    x = np.vstack([copies, rng.normal(0, 0.3, (600, 16))])
    rows = [(k, v.tolist(), 1, "x") for k, v in enumerate(x)]
    many = spark.createDataFrame(rows, SCHEMA)
    found, there = annlinks.audit(many, annlinks.linked(many))
    assert there > 60 * 1000
    assert 0.9 * there <= found <= there


def test_cells_are_taken_where_they_save_work(spark, corpus, monkeypatch):
    """Scattered vectors, near every border, cost no more than in one cell; far clusters keep theirs."""
    monkeypatch.setattr(annlinks, "CELL_ROWS", 100)
    monkeypatch.setattr(annlinks, "SHARD_ROWS", 250)
    written = {}

    def kept(df, name, outlive=False):
        written[name] = session.stored(df, name, outlive)
        return written[name]

    monkeypatch.setattr(annlinks, "stored", kept)
    rng = np.random.default_rng(11)
    scattered = rng.normal(0, 1, (500, 16))
    rows = [(k, v.tolist(), 1, "x") for k, v in enumerate(np.vstack([scattered, scattered[:20] * 1.01]))]
    got = annlinks.linked(spark.createDataFrame(rows, SCHEMA))
    cells = written["members"].groupBy("cell").agg(F.count("*").alias("held"), F.sum(F.col("home").cast("int")).alias("ask"))
    met = sum(r.held + r.ask * -(-r.held // 250) for r in cells.collect())
    assert met <= 520 + 520 * 3  # all in one cell of three shards
    assert {r.vec_id for r in got.collect() if r.n_links} == {*range(20), *range(500, 520)}

    far = np.repeat(np.eye(8), 250, axis=0) + rng.normal(0, 0.02, (2000, 8))
    x = annlinks.unit(far[rng.permutation(2000)])
    cells = annlinks.spread(x[:40], x[40:], annlinks.THRESHOLD, len(x))
    assert len(np.unique(cells.argmax(axis=1))) == 8


def test_components(spark, corpus):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(400, 460)]
    edges = spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    low = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: c for x, c in low.items() if x in linked}


@pytest.mark.parametrize("n,top", [(0, 1), (1, 2**64 - 1), (9, 3), (3000, 10**5), (3000, 2**64 - 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = EliasFano.from_arrays(EliasFano.of(v).arrays())
    assert (e.get(np.arange(n)) == v).all()
    asked = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    assert (e.find(asked) == np.searchsorted(v, asked, "left")).all()


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_rank_and_select(share):
    bits = np.random.default_rng(1).random(5001) < share
    b = Bits(pack_bits(bits), len(bits))
    assert (b.rank1(np.arange(5002)) == np.concatenate([[0], np.cumsum(bits)])).all()
    assert (b.select(np.arange(bits.sum()), True) == np.flatnonzero(bits)).all()
    assert (b.select(np.arange((~bits).sum()), False) == np.flatnonzero(~bits)).all()


@pytest.mark.parametrize("high", [1, 2, 300, 70_000])
def test_wavelet_matrix(high):
    v = np.random.default_rng(high).integers(0, high, 4000)
    w = WaveletMatrix.of(v)
    assert (w.all() == v).all() and (w.access(np.arange(4000)) == v).all()
    for token in [*v[:5].tolist(), high + 5]:
        assert (w.locate(token) == np.flatnonzero(v == token)).all()
        assert w.count(token, 1234) == (v[:1234] == token).sum()


def test_packing():
    for kind in (np.uint32, np.uint64, np.int64):
        v = np.random.default_rng(1).integers(0, 2**31, 1000).astype(kind)
        assert (unpacked(packed(v)) == v).all()
    arrays = {"a": np.arange(5), "b": np.empty(0), "c": np.ones(3, np.uint16)}
    assert all((from_file(to_file(arrays))[k] == x).all() for k, x in arrays.items())
