"""Cheapest repair of conversations by run-length dynamic programming.

A message is one symbol: its role initial, and whether it is truncated or has to go. A symbol
moves the repair between four states (nothing yet, after the system message, after a user, after
an assistant) at a cost, so it is a min-plus matrix. Equal consecutive symbols are collapsed; a run
advances through cached binary powers of its matrix. The choices are unrolled forwards from the costs to
go, always the smallest letter that stays cheapest.

Messages are dealt by ranges of (conversation, turn), so a long conversation lies in several
tasks. What crosses the border of a stretch is its matrix: costs to go pass over all stretches of a
conversation, then states, and every stretch is unrolled where it lies.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.session import stored

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
# State after an inserted message, and after one with a new role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_AT = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
# Symbols: 0 has to go; 1 to 4 are the initials s, u, a and any other, 5 to 8 the same truncated.
INITIALS = "sua"
TRUNC = 4
# Distinct messages and bytes of text in a stretch.
STRETCH_ROWS, STRETCH_BYTES = 4_096, 8 << 20
BLANKS = " \t\n\u000b\f\r"

Matrix = tuple[tuple[int, ...], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        tuple(min(min(x + y[q] for x, y in zip(row, b, strict=True)), NEVER) for q in range(4))
        for row in a
    )


def _ahead(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


IDENTITY: Matrix = tuple(tuple(0 if p == q else NEVER for q in range(4)) for p in range(4))
_ONCE: Matrix = tuple(
    tuple(0 if p == q else INSERT if q == NEXT[p] else NEVER for q in range(4)) for p in range(4)
)
INSERTS: Matrix = _times(_times(_ONCE, _ONCE), _ONCE)
# Costs to go behind the last message: nothing at all, or a whole exchange.
FINAL = _ahead(INSERTS, (0, NEVER, NEVER, 0))


def kept_in(symbol: int, state: int) -> int | None:
    """State after the message is kept as it is, if that is allowed."""
    kind = (symbol - 1) % TRUNC if symbol else 3
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


@functools.cache
def power(symbol: int, exponent: int) -> Matrix:
    """The matrix of 2 ** exponent equal symbols; inserted messages stand before each."""
    if exponent:
        half = power(symbol, exponent - 1)
        return _times(half, half)
    more = TRUNCATED if symbol > TRUNC else 0
    moves = [[NEVER] * 4 for _ in range(4)]
    for p in range(4):
        moves[p][p] = DELETE
        if symbol:
            moves[p][NEXT[p]] = min(moves[p][NEXT[p]], REROLE + more)
            kept = kept_in(symbol, p)
            if kept is not None:
                moves[p][kept] = min(moves[p][kept], more)
    return _times(INSERTS, tuple(map(tuple, moves)))


@functools.lru_cache(maxsize=65_536)
def _run_ahead(symbol: int, length: int, v: tuple[int, ...]) -> tuple[int, ...]:
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            v = _ahead(power(symbol, bit), v)
    return v


def run_ahead(symbol: int, length: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a run of equal symbols, from those behind it."""
    low = min(v)
    return tuple(low + x for x in _run_ahead(symbol, length, tuple(x - low for x in v)))


def collapsed(symbols: bytes, copies: list[int]) -> list[tuple[int, int]]:
    """(symbol, length) runs of messages; further copies of a message have to go."""
    out: list[tuple[int, int]] = []
    for symbol, n in zip(symbols, copies, strict=True):
        for s, k in ((symbol, 1), (0, n - 1)):
            if k and out and out[-1][0] == s:
                out[-1] = (s, out[-1][1] + k)
            elif k:
                out.append((s, k))
    return out


def matrix_of(runs: list[tuple[int, int]]) -> Matrix:
    out = IDENTITY
    for symbol, length in runs:
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                out = _times(out, power(symbol, bit))
    return out


@functools.lru_cache(maxsize=65_536)
def _letters(symbol: int, state: int, v: tuple[int, ...]) -> tuple[str, int]:
    here = _ahead(power(symbol, 0), v)
    more = TRUNCATED if symbol > TRUNC else 0
    out = ""
    while True:
        to_go = here[state]
        if to_go == DELETE + v[state]:
            return out + "D", state
        if to_go == INSERT + here[NEXT[state]]:
            out, state = out + "I", NEXT[state]
            continue
        kept = kept_in(symbol, state)
        if kept is not None and to_go == more + v[kept]:
            return out + "K", kept
        return out + "R", NEXT[state]


def unrolled(
    runs: list[tuple[int, int]], state: int, v: tuple[int, ...], last: bool
) -> tuple[str, int]:
    """Letters of the cheapest edits from a state on, the least of them in ASCII, and the state reached.

    ``v`` are the costs to go behind the runs.
    """
    behind = [v]
    for symbol, length in reversed(runs):
        behind.append(run_ahead(symbol, length, behind[-1]))
    behind.reverse()
    out: list[str] = []
    for (symbol, length), v in zip(runs, behind[1:], strict=True):
        if not symbol:
            # Deleting is cheapest and least in any state.
            out.append("D" * length)
            continue
        low = min(v)
        steps = [tuple(x - low for x in v)]
        for _ in range(length - 1):
            w = _run_ahead(symbol, 1, steps[-1])
            low = min(w)
            steps.append(tuple(x - low for x in w))
        while steps:
            letters, state = _letters(symbol, state, steps.pop())
            out.append(letters)
    while last and FINAL[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def messages(
    letters: str, state: int, roles: list[str], texts: list[str], copies: list[int]
) -> Iterator[str]:
    """``role:text`` of every message that the edits leave, from a state on."""
    at, left = 0, copies[0] if copies else 0
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield f"{ROLE_AT[state]}:"
            continue
        if letter == "R":
            state = NEXT[state]
            yield f"{ROLE_AT[state]}:{texts[at]}"
        elif letter == "K":
            initial = roles[at][:1]
            state = SYSTEM if initial == "s" else USER if initial == "u" else ASSISTANT
            yield f"{roles[at]}:{texts[at]}"
        left -= 1
        if not left:
            at += 1
            left = copies[at] if at < len(copies) else 0


COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PIECE = (
    "conv_id long, part int, seq int, open boolean, blank long, duplicate long, truncated long, "
    "illegal long, first_turn long, last_turn long, min_turn long, turns long, first_initial string, "
    "last_initial string, cost long, audit string, repaired string, messages long"
)
_STRETCH = f"{_PIECE}, symbols binary, copies array<long>, roles array<string>, texts array<string>"
_LEGAL = ("su", "ua", "au")


def _initial(role: str) -> str:
    return role[:1] or " "


class _Stretch:
    """Consecutive messages of one conversation."""

    def __init__(self, conv_id: int | None, part: int, seq: int):
        self.conv_id, self.part, self.seq = conv_id, part, seq
        self.symbols, self.bytes = bytearray(), 0
        self.copies: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.turns: list[int | None] = []
        self.counts = dict.fromkeys(COUNTS, 0)

    def add(self, turn, role: str, text: str, last: str, n: int, again: bool) -> None:
        initial, counts = _initial(role), self.counts
        cut = last not in (".", "!", "?")
        if not last:
            counts["blank"] += n
        else:
            counts["duplicate"] += n - (not again)
            counts["truncated"] += cut and not again
        if not last or again:
            self.symbols.append(0)
        else:
            kind = INITIALS.find(initial)
            self.symbols.append(1 + (kind if kind >= 0 else 3) + (TRUNC if cut else 0))
        # Copies of one message stand side by side.
        counts["illegal"] += n - 1
        if self.roles and _initial(self.roles[-1]) + initial not in _LEGAL:
            counts["illegal"] += 1
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(n)
        self.bytes += len(text)

    def full(self) -> bool:
        return len(self.roles) >= STRETCH_ROWS or self.bytes >= STRETCH_BYTES

    def row(self, open_: bool) -> dict:
        known = [t for t in self.turns if t is not None]
        out = {
            "conv_id": self.conv_id, "part": self.part, "seq": self.seq, "open": open_, **self.counts,
            "first_turn": self.turns[0], "last_turn": self.turns[-1],
            "min_turn": known[0] if known else None, "turns": len(set(known)),
            "first_initial": _initial(self.roles[0]), "last_initial": _initial(self.roles[-1]),
        }
        if open_:
            return out | {
                "symbols": bytes(self.symbols), "copies": self.copies, "roles": self.roles, "texts": self.texts,
            }
        runs = collapsed(bytes(self.symbols), self.copies)
        v = FINAL
        for symbol, length in reversed(runs):
            v = run_ahead(symbol, length, v)
        audit, _ = unrolled(runs, START, FINAL, True)
        left = list(messages(audit, START, self.roles, self.texts, self.copies))
        return out | {
            "cost": v[START], "audit": audit, "repaired": "\n".join(left), "messages": len(left)
        }


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in schema.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Rows of dictionaries in Arrow batches; an absent column is missing."""
    some: list[dict] = []
    size = 0
    for row in rows:
        some.append(row)
        size += sum(len(row.get(c) or "") for c in ("repaired", "audit"))
        size += sum(map(len, row.get("texts") or ()))
        if len(some) >= limit or size >= STRETCH_BYTES:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the conversations of a task's range.

    A conversation that lies whole between two others of its task is repaired at once.
    """
    part = TaskContext.get().partitionId()

    def stretches():
        now, seq, first, cut = None, 0, True, False
        for r in _rows(batches):
            conv_id = r["conv_id"] if r["known"] else None
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.row(open_=first or cut)
                    first, seq = False, seq + 1
                now, cut = _Stretch(conv_id, part, seq), False
            elif now.full():
                yield now.row(open_=True)
                seq += 1
                now, cut = _Stretch(conv_id, part, seq), True
            turn = r["turn"] if r["timed"] else None
            now.add(turn, r["role"], r["text"], r["last"], r["n"], r["again"])
        if now is not None:
            yield now.row(open_=True)

    yield from _batched(stretches(), _arrow(_STRETCH))


def _ordered(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))


def _to_go(table: pa.Table) -> pa.Table:
    """Costs to go behind every stretch of a conversation, and its whole cost."""
    rows, v = _ordered(table), FINAL
    out = []
    for r in reversed(rows):
        out.append({"part": r["part"], "seq": r["seq"], "behind": list(v), "last": r is rows[-1]})
        m = r["matrix"]
        v = _ahead(tuple(tuple(m[4 * p : 4 * p + 4]) for p in range(4)), v)
    return pa.Table.from_pylist([r | {"cost": v[START]} for r in out], _BEHIND)


def _entries(table: pa.Table) -> pa.Table:
    """The state in which the repair enters every stretch."""
    out, state = [], START
    for r in _ordered(table):
        out.append({"part": r["part"], "seq": r["seq"], "state": state})
        state = r["exits"][state]
    return pa.Table.from_pylist(out, _STATE)


_BEHIND = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_()), ("cost", pa.int64())]
)
_STATE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32())])
_KEY = ["part", "seq"]


def _matrices(batches):
    schema = _arrow("conv_id long, part int, seq int, matrix array<long>")
    rows = (
        {k: r[k] for k in ("conv_id", *_KEY)}
        | {"matrix": [x for line in matrix_of(collapsed(r["symbols"], r["copies"])) for x in line]}
        for r in _rows(batches)
    )
    yield from _batched(rows, schema)


def _exits(batches):
    """The state in which each stretch would be left from each state."""
    schema = _arrow("conv_id long, part int, seq int, exits array<int>")

    def rows():
        for r in _rows(batches):
            runs = collapsed(r["symbols"], r["copies"])
            ends = [unrolled(runs, p, tuple(r["behind"]), False)[1] for p in range(4)]
            yield {k: r[k] for k in ("conv_id", *_KEY)} | {"exits": ends}

    yield from _batched(rows(), schema)


def _repair(batches):
    names = _arrow(_PIECE).names

    def rows():
        for r in _rows(batches):
            runs = collapsed(r["symbols"], r["copies"])
            audit, _ = unrolled(runs, r["state"], tuple(r["behind"]), r["last"])
            left = list(messages(audit, r["state"], r["roles"], r["texts"], r["copies"]))
            done = {"audit": audit, "repaired": "\n".join(left), "messages": len(left)}
            yield {k: r.get(k) for k in names} | {"cost": r["whole"]} | done

    yield from _batched(rows(), _arrow(_PIECE))


def faulty(rows: DataFrame) -> DataFrame:
    """Distinct messages of a conversation and turn with their number, last character, and
    whether an earlier turn of the conversation has the same role and text.

    Neither step gathers a conversation: copies are counted before they move, and the first
    turns return to the messages by the keys that these are dealt by already.
    """
    given = rows.select(
        F.col("conv_id").isNotNull().alias("known"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
        F.col("turn").isNotNull().alias("timed"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.md5(F.col("text").cast("binary")))
    whose, when = ["known", "conv_id"], ["timed", "turn"]
    keys = [*whose, *when, "role", "digest"]
    distinct = given.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("text").alias("text")
    )
    firsts = (
        given.groupBy(*whose, "role", "digest")
        .agg(F.min(F.struct(*when)).alias("_first"))
        .select(*whose, "role", "digest", "_first.*", F.lit(False).alias("again"))
    )
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    return distinct.join(firsts, keys, "left").select(
        *keys, "n", "text", last.alias("last"), F.coalesce("again", F.lit(True)).alias("again")
    )


def _pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that lie in one task, and the stretches of all others."""
    order = ["known", "conv_id", "timed", "turn", "role", "digest"]
    dealt = faulty(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    cut = stored(dealt.mapInArrow(_cut, _STRETCH), "stretches")
    open_ = cut.where("open")
    narrow = open_.select("conv_id", *_KEY, "symbols", "copies")
    matrices = narrow.mapInArrow(_matrices, "conv_id long, part int, seq int, matrix array<long>")
    behind = stored(
        matrices.groupBy("conv_id").applyInArrow(
            _to_go, "part int, seq int, behind array<long>, last boolean, cost long"
        ),
        "costs",
    ).withColumnRenamed("cost", "whole")
    exits = narrow.join(behind, _KEY).mapInArrow(
        _exits, "conv_id long, part int, seq int, exits array<int>"
    )
    states = exits.groupBy("conv_id").applyInArrow(_entries, "part int, seq int, state int")
    done = open_.join(behind, _KEY).join(states, _KEY).mapInArrow(_repair, _PIECE)
    return cut.where("NOT open").select(*done.columns), done


def repaired(rows: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation, in one or more stretches (part, seq).

    ``rows`` are messages (conv_id, turn, role, text); within a conversation they stand by turn,
    missing turns first, then by role and a digest of the text. A missing role or text is one space;
    rows without conv_id are one conversation; an empty role counts as one that starts with a
    space. Of repeated rows all but the first are duplicates. Other columns are ignored, and an
    empty table gives no stretch.

    A stretch has its counts of blank, duplicate and truncated messages and of illegal neighbours
    within it, its turns and border messages, the letters of its edits in ``audit``
    (Keep, Rerole, Delete, Insert) and the messages they leave as lines ``role:text``;
    ``cost`` is that of the whole conversation.
    """
    whole, stretches = _pieces(rows)
    return whole.unionByName(stretches)


_SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _fold(batches):
    """Whole conversations from stretches in their order; only letters and a digest are held."""

    def rows():
        now, audit, digest, prior = None, [], hashlib.sha256(), None
        begun = False

        def whole():
            low, high = now["min_turn"], now["last_turn"]
            gaps = high - low + 1 - now["turns"] if low is not None else 0
            return {k: now[k] for k in ("conv_id", "cost", *COUNTS)} | {
                "gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()
            }

        for r in _rows(batches):
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield whole()
                now, audit, digest, begun = r, [], hashlib.sha256(), False
            else:
                for c in COUNTS:
                    now[c] += r[c]
                now["illegal"] += prior["last_initial"] + r["first_initial"] not in _LEGAL
                same = r["first_turn"] is not None and r["first_turn"] == prior["last_turn"]
                now["turns"] += r["turns"] - same
                if now["min_turn"] is None:
                    now["min_turn"] = r["min_turn"]
                now["last_turn"] = r["last_turn"]
            prior = dict(r)
            audit.append(r["audit"])
            if r["messages"]:
                digest.update((b"\n" if begun else b"") + r["repaired"].encode())
                begun = True
        if now is not None:
            yield whole()

    yield from _batched(rows(), _arrow(_SUMMARY))


def summary(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (see ``repaired``): the gaps between its turns, its
    counts, cost and letters, and the SHA-256 of what is left of it.

    Conversations in one piece need no exchange; the stretches of the others stream by in order.
    """
    whole, stretches = _pieces(rows)
    gaps = F.coalesce(F.col("last_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0))
    several = stretches.repartition("conv_id").sortWithinPartitions("conv_id", *_KEY)
    return whole.select(
        "conv_id",
        gaps.alias("gaps"),
        *COUNTS,
        "cost",
        "audit",
        F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"),
    ).unionByName(several.mapInArrow(_fold, _SUMMARY))
