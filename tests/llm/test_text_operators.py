"""Operators on texts against plain versions, over rows with every awkward value."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopflow import session
from stopflow.llm import (
    components,
    histsort,
    licenses,
    lmscore,
    mixing,
    sketches,
    toxicity,
    wavelet,
    wordbpe,
)
from stopflow.llm.queries import tokenizer_path, toxicity_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_license_places(corpus, nothing):
    got = licenses.scan(corpus).collect()
    expected = []
    for i, text in rows_of(corpus):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        hits = [
            (label, k)
            for k in range(len(words))
            for phrase, label in licenses.BASE
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        expected.append((i, len(words), sorted(hits)))
    found = [
        (r.doc_id, r.n_words, sorted((d.label, d.first_word) for d in r.detections if d.base))
        for r in got
    ]
    same(found, expected)
    assert licenses.scan(nothing).count() == 0


def test_license_containment():
    given = licenses.rules()
    plain = b" ".join(licenses.words_of(b"Licensed under the Apache License, Version 2.0 only"))
    raw = list(licenses.raw_detections(plain, given))
    kept = licenses.resolved(raw, given)
    for i, a, b in raw:
        inside = [
            k for k in kept if k != (i, a, b) and k[1] <= a and b <= k[2]
            and given[k[0]].priority <= given[i].priority
        ]
        assert ((i, a, b) in kept) == (given[i].base or not inside)
    assert len(given) > 300 and {given[i].label for i, _, _ in kept} == {"apache-2"}


def test_lm_scores(corpus, nothing):
    model = lmscore.train(corpus.where("doc_id IS NULL OR doc_id < 12"), shards=5)
    got = lmscore.score(corpus, model).collect()
    docs = rows_of(corpus)
    token = {k: [*WORD.findall(lower(t)), "\0"] for k, (_, t) in enumerate(docs)}
    c, pairs, texts = Counter(), Counter(), 0
    for k, (i, _) in enumerate(docs):
        if i is None or i < 12:
            c.update(token[k])
            pairs.update(zip(["\1", *token[k]], token[k], strict=False))
            texts += 1
    n, v, mu = sum(c.values()), len(c), lmscore.MU
    assert (model.tokens, model.vocabulary, model.texts) == (n, v, texts)
    expected = []
    for k, (i, _) in enumerate(docs):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token[k])
        score = sum(
            math.log10((pairs[p, w] + mu * (c[w] + 1) / (n + v + 1)) / ((c[p] if p != "\1" else texts) + mu))
            for p, w in zip(["\1", *token[k]], token[k], strict=False)
        )
        expected.append((i, len(token[k]), sum(c[w] > 0 for w in token[k]), base, score))
    key = lambda r: (repr(r[0]), r[1], r[3])
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert g[:3] == e[:3]
        assert g[3:] == pytest.approx(e[3:], rel=2e-4)
    assert lmscore.score(nothing, model).count() == 0
    untrained = lmscore.train(nothing, shards=3)
    assert {r.n_known for r in lmscore.score(corpus, untrained).collect()} == {0}


def test_lm_is_a_distribution(spark):
    """Over all words, the end and one unknown word the probabilities after a word sum to one."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a")], "doc_id long, text string")
    model = lmscore.train(docs, shards=2)
    asked = spark.createDataFrame(
        [(k, f"a {w}") for k, w in enumerate(["a", "b", "c", "never"])] + [(9, "a")],
        "doc_id long, text string",
    )
    score = {r.doc_id: r.score for r in lmscore.score(asked, model).collect()}
    end_after = {}
    total, n, v, mu = 0.0, 8, 4, lmscore.MU
    c = {"a": 3, "b": 2, "c": 1, "never": 0}
    ends = {"a": 1, "b": 0, "c": 1, "never": 0}
    first = (0 + 1 + mu * 4 / (n + v + 1)) / (2 + mu)
    for k, w in enumerate(c):
        end_after[w] = (ends[w] + mu * 3 / (n + v + 1)) / (c[w] + mu)
        total += 10 ** score[k] / first / end_after[w]
    total += 10 ** score[9] / first
    assert total == pytest.approx(1, rel=1e-3)


def test_token_files(corpus, nothing):
    path = tokenizer_path("byte_bpe_50k.json")
    encode = wavelet.tokenizer(path)
    files = wavelet.write_files(corpus, path, parts=3)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in wavelet.read_ids(files).collect()]
    docs = sorted(rows_of(corpus), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at, expected = 0, []
    for i, text in docs:
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, wavelet.END_ID]
        expected.append((i, at, np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    same(got, expected)
    token = encode.encode(" the", add_special_tokens=False).ids[0]
    places = wavelet.occurrences(files, token).collect()
    same(
        [(r.doc_id, r.place) for r in places],
        [
            (i, p)
            for i, _, b in expected
            for p in np.flatnonzero(np.frombuffer(b, "<u4") == token).tolist()
        ],
    )
    assert wavelet.read_ids(wavelet.write_files(nothing, path, parts=2)).count() == 0


def test_new_pieces_are_encoded_together(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    plain = wavelet.tokenizer(path)
    texts = ["", "one two  three\n four", " x\u00a0 y\u2003 z", "\t\t", "caf\u00e9 \u6f22\u5b57 \U0001f600", "it's 10 <|x|> "]
    texts += [" ".join(f"w{k}x{j}" for j in range(40)) + " \n" * (k % 3) for k in range(60)]
    sent = []

    class Counted:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, parts, **kwargs):
            sent.extend(parts)
            return plain.encode_batch_fast(parts, **kwargs)

    monkeypatch.setattr(wavelet, "tokenizer", lambda _: Counted())
    monkeypatch.setattr(wavelet, "_KNOWN", {})
    expected = [[*plain.encode(t, add_special_tokens=False).ids, wavelet.END_ID] for t in texts]
    for _ in range(2):
        ids, lengths = wavelet.encoded([t.encode() for t in texts], path)
        assert ids.tolist() == [i for x in expected for i in x]
        assert lengths.tolist() == [len(x) for x in expected]
    assert len(sent) < 200
    # Where tokens do not meet the borders of pieces, each piece is encoded by itself.
    monkeypatch.setattr(wavelet, "_token_bytes", lambda _: np.ones(1 << 17, dtype=np.int64))
    monkeypatch.setattr(wavelet, "_KNOWN", {})
    ids, _ = wavelet.encoded([t.encode() for t in texts], path)
    assert ids.tolist() == [i for x in expected for i in x]


def test_toxicity_learns_and_scores_every_row(spark, corpus, nothing):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(900):
        words = [f"w{x}" for x in rng.integers(0, 200, 60)]
        if k % 3 == 0:
            for at in rng.integers(0, 60, 3):
                words[int(at)] = f"vile{'abc'[int(at) % 3]}x"
        rows.append((k, " ".join(words), ["en", "de"][k % 2], int(k % 3 == 0)))
    schema = "doc_id long, text string, lang string, toxic int"
    labelled = spark.createDataFrame(rows, schema)
    model = toxicity.fit(labelled, labelled.where("doc_id < 600"))
    new = labelled.where("doc_id >= 600")
    scored = toxicity.with_scores(new, model).collect()
    right = sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in scored)
    assert right >= 0.9 * len(scored)
    assert set(model.thresholds) == {"en", "de"}
    all_rows = toxicity.with_scores(corpus, model)
    assert all_rows.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in all_rows.collect())
    empty_model = toxicity.fit(labelled, labelled.where("false"))
    assert len({r.score for r in toxicity.with_scores(corpus, empty_model).collect()}) >= 1
    assert toxicity.with_scores(nothing, model).count() == 0


def test_toxicity_sees_the_end_of_a_long_text(spark):
    texts = [b"bad end" if k % 2 else b"good end" for k in range(80)]
    model = toxicity.train(texts, np.arange(80) % 2)
    tail = b"word " * 50_000
    low, high = toxicity.predict(model, [tail + b"good", tail + b"bad"])
    assert low < 0.5 < high


def test_toxicity_of_a_text_is_its_own():
    rng = np.random.default_rng(6)
    texts = [b"calm day", b"vile words stand first", b"", b"x", b"vile", b"so it ends"]
    texts += [b" ".join(b"w%d" % x for x in rng.integers(0, 90, n)) for n in range(1, 60)]
    model = toxicity._new_model(2)
    model.embed[1:] = rng.normal(0, 1, model.embed[1:].shape)
    alone = [toxicity.predict(model, [t])[0] for t in texts]
    assert toxicity.predict(model, texts).tolist() == alone
    assert toxicity.predict(model, texts[::-1]).tolist() == alone[::-1]
    assert toxicity.predict(model, texts[:2]).tolist() == alone[:2]


@pytest.mark.parametrize(
    "sentence,label",
    [
        ("This is GPLv2 code.", "gpl-2"),
        ("Use it by the GPLv3+.", "gpl-3"),
        ("Our library, LGPLv2.1, is small.", "lgpl-2"),
        ("It is LGPL 3 from now on.", "lgpl-3"),
        ("Served as AGPLv3.", "agpl-3"),
        ("Old parts: MPL 1.1.", "mpl-1"),
        ("New parts: MPL 2.0.", "mpl-2"),
        ("Plugins: EPL 1.0", "epl-1"),
        ("Plugins (EPL 2.0)", "epl-2"),
        ("CDDLv1.0 files", "cddl-1"),
        ("EUPL v1.2 text", "eupl"),
        ("a GPL program", "gpl"),
        ("an LGPL library", "lgpl"),
        ("an AGPL server", "agpl"),
        ("It has a BSD license.", "bsd"),
        ("with an Apache licence", "apache"),
        ("the Mozilla Public License", "mpl"),
        ("the Eclipse Public Licence", "epl"),
        ("a Creative Commons licence", "cc"),
        ("Released under the Boost Software Licence", "boost"),
        ("See the zlib licence", "zlib"),
        ("Licence: ISC", "isc"),
    ],
)
def test_short_names_and_british_spelling(sentence, label):
    plain = b" ".join(licenses.words_of(sentence.encode()))
    given = licenses.rules()
    found = licenses.resolved(list(licenses.raw_detections(plain, given)), given)
    assert [given[i].label for i, _, _ in found] == [label]


@pytest.fixture
def fitted_rows(monkeypatch):
    """What a fit learns from and what sets its thresholds."""
    seen = {}

    def train(texts, toxic, seed):
        seen["learnt"] = (texts, toxic)
        return toxicity._new_model(seed)

    def calibrated(scores, toxic, langs):
        seen["held"] = toxic
        return {}

    monkeypatch.setattr(toxicity, "train", train)
    monkeypatch.setattr(toxicity, "calibrated_thresholds", calibrated)
    return seen


def test_toxicity_fits_long_texts(spark, fitted_rows, monkeypatch):
    rows = [(k, ("x" * 500 + " ") * (60 if k % 2 else 1), "en", k // 2 % 2) for k in range(40)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    toxicity.fit(labelled, labelled)
    learnt = fitted_rows["learnt"][0]
    assert len(learnt) == 32 and any(len(t) > 20_000 for t in learnt)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 200_000)
    toxicity.fit(labelled, labelled)
    learnt = fitted_rows["learnt"][0]
    assert any(len(t) > 20_000 for t in learnt) and sum(map(len, learnt)) <= 200_000


def test_toxicity_thresholds_see_both_classes(spark, fitted_rows, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 100)
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 100)
    rows = [(k, f"text {k}", "en", int(k % 10 == 0)) for k in range(1000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    toxicity.fit(labelled, labelled)
    assert len(fitted_rows["held"]) == 40
    assert 0.2 < fitted_rows["held"].mean() < 0.8


def test_toxicity_model_learns_from_every_labelled_row(spark, tmp_path, monkeypatch):
    """With room for a few rows only in the first fit: rare words come from all the others."""
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 4)
    monkeypatch.setattr(toxicity, "FIT_CLEAN", 8)
    monkeypatch.setattr(toxicity, "STEPS", 100)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(6000):
        words = [f"w{x}" for x in rng.integers(0, 100, 12)]
        if k % 3 == 0:
            words[int(rng.integers(0, 12))] = f"{k // 3 % 40}vile"
        rows.append((k, " ".join(words), ["en", None][k % 2], int(k % 3 == 0)))
    schema = "doc_id long, text string, lang string, toxic int"
    docs = spark.createDataFrame(rows, schema)
    docs.drop("toxic").write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    learnt, passes = toxicity._descended, []

    def counted(given, *rest):
        passes.append(given.count())
        return learnt(given, *rest)

    monkeypatch.setattr(toxicity, "_descended", counted)
    model = toxicity_model(spark, str(tmp_path), F.expr("doc_id < 5400"))
    assert passes and all(0.75 * 5400 <= n <= 0.85 * 5400 for n in passes)
    assert set(model.thresholds) == {"en"}
    new = docs.where("doc_id >= 5400").drop("lang")
    scored = toxicity.with_scores(new, model).collect()
    toxic = [r.score for r in scored if r.toxic]
    clean = [r.score for r in scored if not r.toxic]
    pairs = np.mean([np.mean(np.array(clean) < s) for s in toxic])
    assert pairs > 0.95


def test_toxicity_passes_take_no_more_tasks_than_cores(spark, monkeypatch):
    """Every task of a pass sends its change of nearly all weights."""
    monkeypatch.setattr(toxicity, "TASK_ROWS", 10)
    monkeypatch.setattr(toxicity, "STEPS", 10)
    rows = [(k, f"text {k} of {k % 7}", "en", int(k % 5 == 0)) for k in range(600)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    learnt, dealt, seen = toxicity._descended, [], []

    def counted(given, *rest):
        dealt.append(given.rdd.getNumPartitions())
        seen.append(given.count())
        return learnt(given, *rest)

    monkeypatch.setattr(toxicity, "_descended", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        toxicity.fit_all(labelled, labelled)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    cores = spark.sparkContext.defaultParallelism
    assert len(dealt) == len(toxicity.PASS_RATES) and 1 < max(dealt) <= cores
    assert len(set(seen)) == 1 and 400 < seen[0] < 560
    tasks = [toxicity._pass_tasks(n, 100) for n in (0, 39, 5_000, 64_000 * 300)]
    assert tasks == [1, 3, 100, 300]


def test_toxicity_thresholds_by_counts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for lang, noise in (("en", 0.02), ("de", 0.2), ("fr", 0.0)):
        for s in np.floor(rng.random(3000) * toxicity.SCORE_STEPS) / toxicity.SCORE_STEPS:
            rows.append((lang, float(s), int(rng.random() > noise if s > 0.6 else rng.random() < s / 2)))
    rows += [(None, 0.9, 1), ("it", 0.99, 0), ("pt", 0.95, 1), ("nl", 0.3, 1)]
    expected = {}
    for lang in {r[0] for r in rows} - {None}:
        own = [r[1:] for r in rows if r[0] == lang]
        good = [
            t for t, _ in own
            if np.mean([y for s, y in own if s >= t]) >= toxicity.PRECISION
        ]
        expected[lang] = float(np.clip(min(good, default=toxicity.THRESHOLD), 0.5, 0.9))
    scored = spark.createDataFrame(rows, "lang string, score double, toxic int")
    assert toxicity.grid_thresholds(scored) == expected


def test_shards(spark, corpus, nothing):
    hot = spark.createDataFrame([(k, "same text again") for k in range(100, 700)], "doc_id long, text string")
    docs = corpus.select("doc_id", "text").union(hot)
    got = histsort.sharded(docs.withColumn("shard", docs.doc_id), shards=4, tolerance=0.01).collect()
    same([(r.doc_id, r.text) for r in got], rows_of(docs))
    assert all(r["size"] == len((r.text or "").encode()) + 16 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = histsort.sharded(hot, shards=4, tolerance=0.01).groupBy("shard").count().collect()
    assert {r["count"] for r in even} <= {149, 150, 151}
    assert histsort.sharded(nothing).count() == 0


def test_shard_order_is_the_key_order(spark):
    docs = spark.createDataFrame([(k, f"t{k % 50}") for k in range(500)], "doc_id long, text string")
    got = histsort.sharded(docs, shards=3).selectExpr("shard", "slot", "xxhash64(text) h", "doc_id").collect()
    keys = [(r.h, r.doc_id) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert keys == sorted(keys)


def test_bins_below():
    rng = np.random.default_rng(3)
    h, d = rng.integers(0, 5, 300), rng.integers(0, 50, 300)
    probes = sorted({(int(a), int(b)) for a, b in zip(h[:40], d[:40], strict=True)})
    edges = tuple(np.array(x) for x in zip(*probes, strict=True))
    expected = [sum(p < (a, b) for p in probes) for a, b in zip(h.tolist(), d.tolist(), strict=True)]
    assert histsort.bins_below(h, d, edges).tolist() == expected


def test_mix(corpus, nothing):
    mix = mixing.plan(corpus)
    rows = mixing.with_cuts(mix.counted, mix).withColumn("taken", mixing.taken_words()).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    # Refill until no target is above twice its source.
    weight = dict(zip(["a", "b", None], (3, 1, 2), strict=True))
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in weight if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
    for s in weight:
        assert target[s] == pytest.approx((full | share)[s])
        # Only rows that repeat an id share a cut, rounded down by row.
        assert target[s] - 3 <= taken[s] <= target[s]
    assert mixing.plan(nothing).cuts.count() == 0
    assert mixing.mixed(nothing).columns == nothing.columns


def test_mixed_rows_keep_their_columns(corpus):
    got = mixing.mixed(corpus)
    assert got.columns == corpus.columns
    assert set(rows_of(got)) <= set(rows_of(corpus))
    assert max(Counter(rows_of(got)).values()) <= 4  # a row that stands twice, in two epochs


def test_word_bpe(corpus, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    encode = wordbpe.tokenizer(path)
    got = wordbpe.encode_decode(corpus, path, shards=3).collect()
    expected = []
    for i, text in rows_of(corpus):
        ids = encode.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        expected.append((i, packed, encode.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, bytes(r.ids), r.decoded) for r in got], expected)
    assert wordbpe.encode_decode(nothing, path, shards=2).count() == 0


def shingles(text, n):
    words = WORD.findall(lower(text))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_groups(docs, n, percent):
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is None or docs[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            near = both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
            if near or docs[a][0] == docs[b][0]:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(docs)):
        groups.setdefault(find(k), []).append(docs[k][0])
    low = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return [
        (i, len(sets[k]), low[find(k)], i is None or low[find(k)] == i)
        for k, (i, _) in enumerate(docs)
    ]


def test_near_duplicates(corpus, nothing):
    for n in (4, 5):
        got = sketches.near_duplicates(corpus, words=n).collect()
        same([tuple(r) for r in got], brute_groups(rows_of(corpus), n, 80))
    assert sketches.near_duplicates(nothing).count() == 0


def test_near_duplicate_chains(spark, monkeypatch):
    """A drifting text links neighbours only; short sketches leave much to the second round."""
    monkeypatch.setattr(sketches, "LONG_SKETCH", 256)
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for k in range(40):
        rows.append((1000 - k, " ".join(words)))
        for at in rng.integers(0, 120, 2):
            words[int(at)] = f"n{k}x{at}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sketches.near_duplicates(docs, words=4).collect()
    same([tuple(r) for r in got], brute_groups(rows, 4, 80))


@pytest.mark.parametrize("most", [100_000, 0])
def test_rows_of_one_id_join_their_groups(spark, monkeypatch, most):
    """Ids on several texts tie classes; copies under one id and empty texts tie none."""
    monkeypatch.setattr(sketches, "BROADCAST_ROWS", ("stopflow.unset", most))
    base = [" ".join(f"{w}{i}" for i in range(30)) for w in "pqrs"]
    rows = [(9, base[0]), (9, base[1]), (3, base[1]), (5, base[0]), (4, base[2]), (4, base[2])]
    rows += [(9, ""), (2, base[3]), (2, None), (1, base[3] + " s30")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sketches.near_duplicates(docs, words=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(9, 3), (3, 3), (5, 3), (4, 4), (2, 1), (1, 1)}


def test_near_duplicates_take_few_rounds_and_leave_texts_in_place(spark, monkeypatch):
    """Groups tied to one text are stars after a round, and no text is shuffled for few pairs."""
    written = []

    def stored(df, name, outlive=False):
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return session.stored(df, name, outlive)

    monkeypatch.setattr(sketches, "stored", stored)
    monkeypatch.setattr(components, "stored", stored)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))] + [(k, " ".join([*base, f"x{k}"])) for k in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sketches.near_duplicates(docs, words=4).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.component_id for r in got} == {0}
    assert [n for n, _ in written].count("stars") == 2
    plans = [plan for n, plan in written if n == "sets"]
    assert len(plans) == 2
    assert all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in plans)


def test_ids_hash_as_in_the_query(spark):
    """crc32 of the id as text, as zlib counts it, fixes the folds."""
    rows = spark.range(50).selectExpr("id AS doc_id").withColumn("h", lmscore.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
