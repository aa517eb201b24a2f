"""Conversation repair against an exhaustive search, a plain version and SQL."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from stopflow.llm import dialogue
from stopflow.llm.queries import RUN, SQL
from stopflow.llm.shipping import ship

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, lines) over all edits; rows are (role, text, fault)."""
    best = {(0, ""): (0, "", ())}
    done = None
    for i in range(len(rows) + 1):
        # Up to three inserted messages stand before each row and at the end.
        for _ in range(3):
            for cost, audit, lines in list(best.values()):
                for role in ("user", "assistant"):
                    put(best, (cost + 5, audit + "I", (*lines, (role, ""))))
        if i == len(rows):
            break
        role, text, fault = rows[i]
        after = {}
        for cost, audit, lines in best.values():
            put(after, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                put(after, (cost + more, audit + "K", (*lines, (role, text))))
                for other in ("user", "assistant"):
                    put(after, (cost + 1 + more, audit + "R", (*lines, (other, text))))
        best = after
    for cost, audit, lines in best.values():
        if PATTERN.fullmatch("".join(r[:1] for r, _ in lines)):
            done = min(done, (cost, audit, lines)) if done else (cost, audit, lines)
    return done[0], done[1], [f"{r}:{t}" for r, t in done[2]]


def put(best, found):
    """Keep the cheapest and least of the edits that leave the same role initials behind them."""
    initials = "".join(r[:1] or " " for r, _ in found[2])
    viable = re.fullmatch(r"s?(ua)*u?", initials)
    if viable:
        key = (initials[:1] == "s", initials[-1:], bool(initials))
        if key not in best or found[:2] < best[key][:2]:
            best[key] = found


def faults(rows):
    """(role, text, fault) of messages in order."""
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = (
            "blank" if not body else "duplicate" if (role, text) in seen else "truncated"
            if body[-1] not in ".!?" else ""
        )
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def plain(rows):
    """The query's rows for (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        own += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        judged = faults([r[1:] for r in own])
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        count = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit, lines = cheapest(judged)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *count, illegal, cost, audit, sha))
    return out


def symbols(judged):
    return bytes(
        0 if f in ("blank", "duplicate") else 1 + ("sua".find(r[:1]) % 4) + (4 if f == "truncated" else 0)
        for r, _, f in judged
    )


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "user", "assistant"]
    texts = ["Yes.", "No!", "cut", "  ", "", "What?", "a. \n", "more"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}.") for _ in range(n)]


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(400):
        judged = faults(random_rows(rng, rng.randrange(0, 9)))
        runs = dialogue.collapsed(symbols(judged), [1] * len(judged))
        v = dialogue.FINAL
        for symbol, length in reversed(runs):
            v = dialogue.run_ahead(symbol, length, v)
        audit, _ = dialogue.unrolled(runs, dialogue.START, dialogue.FINAL, True)
        roles, texts = [r for r, _, _ in judged], [t for _, t, _ in judged]
        lines = list(dialogue.messages(audit, dialogue.START, roles, texts, [1] * len(roles)))
        assert (v[dialogue.START], audit, lines) == cheapest(judged)


def test_runs_advance_as_their_messages_do():
    rng = random.Random(2)
    for _ in range(60):
        codes = bytes(rng.randrange(9) for _ in range(3) for _ in range(1))
        runs = [(c, rng.randrange(1, 40)) for c in codes]
        v = dialogue.FINAL
        for symbol, length in reversed(runs):
            for _ in range(length):
                v = dialogue._ahead(dialogue.power(symbol, 0), v)
        assert v == dialogue._ahead(dialogue.matrix_of(runs), dialogue.FINAL)


def test_stretches_join_to_the_whole():
    rng = random.Random(3)
    for _ in range(100):
        judged = faults(random_rows(rng, 30))
        cuts = sorted(rng.sample(range(1, 30), 3))
        parts = [judged[a:b] for a, b in itertools.pairwise([0, *cuts, 30])]
        runs = [dialogue.collapsed(symbols(p), [1] * len(p)) for p in parts]
        behind, v = [], dialogue.FINAL
        for r in reversed(runs):
            behind.insert(0, v)
            v = dialogue._ahead(dialogue.matrix_of(r), v)
        state, audit = dialogue.START, ""
        for i, r in enumerate(runs):
            letters, state = dialogue.unrolled(r, state, behind[i], i == len(runs) - 1)
            audit += letters
        assert (v[dialogue.START], audit) == cheapest(judged)[:2]


def test_copies_of_a_message_have_to_go():
    assert dialogue.collapsed(bytes([2, 2, 0, 3]), [1, 4, 2, 1]) == [(2, 2), (0, 5), (3, 1)]


def fixture(rng):
    rows = []
    for conv in range(120):
        rows += [(conv, t, *r) for t, r in enumerate(random_rows(rng, rng.randrange(1, 8)))]
    # One conversation holds a third of all rows, with repeated, shared and missing turns.
    rows += [(500, rng.randrange(60) * 3, *r) for r in random_rows(rng, 250)]
    rows += [(501, None, "user", "no turn"), (501, 4, None, None), (501, 7, "", "empty role."), (501, None, "user", "no turn")]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, 1, "assistant", "Ho.")]
    rows += [(502, 0, "system", "Only this."), (503, 5, "user", "long. " * 30_000), (503, 6, "assistant", "ok.")]
    rows += [(i, 0, "assistant", "one.") for i in range(600, 660)]
    rows += [(i, 3, "user", "Gone.") for i in range(700, 2_000) if zlib.crc32(f"{i}:3".encode()) % 20 == 0]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 24])
def test_query_on_whole_table(spark, tmp_path, parts):
    rows = fixture(random.Random(4))
    path = str(Path(tmp_path) / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("key", F.lit("clash")).write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = RUN["op12_conversation_repair"](spark, str(tmp_path))
        got = sorted(map(repr, map(tuple, df.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(repr, plain(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    result = con.execute(SQL["op12_conversation_repair"])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in df.columns]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
    # Some conversations have no message left.
    assert any(r[7] == "" for r in plain(rows))


def test_stretches_keep_texts(spark):
    ship(spark)
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still here."), (1, 2, "assistant", "Yes."), (2, 0, "user", "x")]
    found = dialogue.repaired(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.audit, r.repaired, r.cost) for r in found.collect()}
    assert got == {1: ("DKK", "user:Still here.\nassistant:Yes.", 2), 2: ("D", "", 2)}
    assert dialogue.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    assert dialogue.summary(spark.createDataFrame([], SCHEMA)).count() == 0
