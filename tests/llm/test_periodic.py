"""Periodic runs against a plain search, and the query against all its columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopflow.llm import periodic
from stopflow.llm.queries import RUN, with_planted_periods
from stopflow.llm.text import token_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=24, exponent=3):
    """Every maximal stretch that repeats at a lag, each at its smallest lag only."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= 2 * q:
                inside = any(a <= i and i + length <= b for a, b in seen)
                if not inside and length >= max(least, exponent * q):
                    out.append((i, length, q))
                seen.add((i, i + length))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = [hashlib.sha256(v.encode()).hexdigest() for v in (lines, collapsed(words, found))]
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, *sha)


def words_with_runs(rng, n):
    out = []
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0:
            out += [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
        elif kind == 1:
            root = [rng.choice("ab") for _ in range(rng.randrange(1, 40))]
            out += (root * 9)[: rng.randrange(1, 9 * len(root))]
        elif kind == 2:
            root = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))]
            # A root with a repetition of its own.
            root = root + root[: rng.randrange(len(root) + 1)]
            out += (root * 5)[: rng.randrange(1, 5 * len(root))]
        else:
            out += [f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 20))]
    return out[:n]


@pytest.mark.parametrize("least, exponent", [(24, 3), (5, 3), (12, 4), (40, 3)])
def test_runs_of_several_texts_at_once(least, exponent):
    rng = random.Random(least)
    lists = [words_with_runs(rng, rng.randrange(0, 400)) for _ in range(60)]
    lists += [[], ["x"] * 23, ["x"] * 24, ["x", "y"] * 300, lists[5], lists[5]]
    codes, _, starts = token_table([" ".join(v).encode() for v in lists], None)
    got = periodic.runs(codes, starts, least, exponent)
    want = [(i, *r) for i, v in enumerate(lists) for r in plain_runs(v, least, exponent)]
    assert [tuple(r) for r in got.tolist()] == want
    assert len(want) > 20


def test_bands_cover_every_lag():
    for least, exponent in ((24, 3), (2, 3), (7, 5), (100, 3)):
        lags = []
        for k, first, last in periodic.bands(least, exponent, 5_000):
            assert last <= k
            lags += range(first, last + 1)
            assert all(k <= max(least, exponent * q) - q for q in range(first, last + 1))
        assert lags == list(range(1, len(lags) + 1)) and exponent * len(lags) >= 4_998


def test_long_repetitive_text_takes_few_extensions(monkeypatch):
    steps = Counter()
    reach = periodic._reach

    def counted(codes, at, lag, way):
        steps["n"] += 1
        return reach(codes, at, lag, way)

    monkeypatch.setattr(periodic, "_reach", counted)
    text = b"a line that comes again and again in one text " * 40_000
    codes, _, starts = token_table([text], None)
    got = periodic.runs(codes, starts)
    assert got.tolist() == [[0, 0, 400_000, 10]] and steps["n"] < 10


def test_awkward_rows(corpus, nothing):
    got = sorted(map(repr, map(tuple, periodic.detected(corpus).collect())))
    want = []
    for r in corpus.select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        found = plain_runs(words) if len(words) < 10_000 else []
        want.append(repr((r.doc_id, len(words), [*found], collapsed(words, found))))
    named = [v.replace("Row(", "(").replace("start=", "").replace("length=", "").replace("period=", "") for v in got]
    assert named == sorted(want)
    assert periodic.detected(nothing).count() == 0
    with pytest.raises(ValueError):
        periodic.detected(corpus, exponent=2)


def test_query_on_whole_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(words_with_runs(rng, rng.randrange(0, 300)))) for i in range(150)]
    rows += [(None, "x " * 50), (160, None), (161, ""), (162, " \n\t"), (7, "dup " * 30), (7, "dup " * 30)]
    rows += [(163, "Ça va " * 40), (164, "one word " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    docs.write.parquet(str(Path(tmp_path) / "documents.parquet"))
    got = RUN["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ]
    want = [expected(*r) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(w[1] for w in want) > 50


def test_planting_touches_a_tenth(spark):
    docs = spark.createDataFrame([(i, "a b  c") for i in range(200)], "doc_id long, text string")
    got = {r.doc_id for r in with_planted_periods(docs).where("text != 'a b  c'").collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0}


def test_repeats_marks_all_but_the_first_period():
    got = periodic.repeats(np.array([[2, 9, 3], [8, 6, 2]]), 16)
    assert np.flatnonzero(got).tolist() == [5, 6, 7, 8, 9, 10, 11, 12, 13]
