"""Periodic runs of words by seeds and extended diagonals.

A run of smallest period q repeats its words at lag q over an overlap of at least
``max(least, exponent * q) - q`` words. Lags are taken in bands, and the k-grams of a band are as
long as the overlap its lags guarantee: each run then holds a k-gram twice, q words apart. As a
k-gram is also no shorter than any lag of its band, no copy of it lies between the two: the
neighbouring occurrences within a document are all the pairs there are to look at. A pair is
extended along its diagonal to both sides; a table of the furthest word covered per lag suppresses
pairs that an earlier extension holds already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.llm.text import chunks, mixed, text_bytes, token_table

LEAST, EXPONENT = 24, 3
# Bytes of text whose words are indexed together; a longer text is indexed alone.
CHUNK_BYTES = 4 << 20
# Words compared in the first step of an extension; each further step doubles.
STEP = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)

RUN = "struct<start: long, length: long, period: long>"


def bands(least: int, exponent: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(k, first lag, last lag) of every band that a text of n words needs, in order of lags.

    Every lag up to k guarantees an overlap of k in the first band, and every lag above k one of
    2 k in each next, as exponents are 3 or more.
    """
    low = min(max(least, exponent * q) - q for q in range(1, least // exponent + 2))
    k = 1 << (low.bit_length() - 1)
    first = 1
    while exponent * first <= n:
        yield k, first, k
        first, k = k + 1, 2 * k


def _reach(codes: np.ndarray, at: int, lag: int, way: int) -> int:
    """How many words from ``at`` on, to the right (1) or left (-1), equal those ``lag`` later."""
    room = len(codes) - lag - at if way > 0 else at + 1
    done, step = 0, STEP
    while done < room:
        size = min(step, room - done)
        lo = at + done if way > 0 else at - done - size + 1
        differ = codes[lo : lo + size] != codes[lo + lag : lo + lag + size]
        if differ.any():
            return done + int(differ.argmax() if way > 0 else differ[::-1].argmax())
        done, step = done + size, 2 * step
    return done


def _diagonals(
    codes: np.ndarray, seeds: np.ndarray, lags: np.ndarray, k: int
) -> Iterator[tuple[int, int, int]]:
    """(start, length, lag) of the maximal repeats at a lag that hold a seed pair."""
    order = np.lexsort((seeds, lags))
    seeds, lags = seeds[order], lags[order]
    # A seed right behind another of its lag lies on the same diagonal.
    fresh = np.ones(len(seeds), dtype=bool)
    fresh[1:] = (np.diff(lags) != 0) | (np.diff(seeds) != 1)
    covered: dict[int, int] = {}
    for at, lag in zip(seeds[fresh].tolist(), lags[fresh].tolist(), strict=True):
        if at < covered.get(lag, -1):
            continue
        right = at + _reach(codes, at, lag, 1)
        if right - at < k:
            # Different words of equal hash.
            continue
        left = at - _reach(codes, at - 1, lag, -1) if at else at
        covered[lag] = right
        yield left, right + lag - left, lag


def runs(
    codes: np.ndarray, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT
) -> np.ndarray:
    """Rows (text, start in the text, length, period) of all maximal runs, by text and start.

    ``codes`` are the words of all texts, each text closed by one code that no word has, and
    ``starts`` the places of their first words with the end behind them.
    """
    n = len(codes)
    sizes = np.diff(starts) - 1
    longest = int(sizes.max()) if len(sizes) else 0
    out: list[tuple[int, int, int]] = []
    if longest >= least:
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        grams, width = mixed(codes.astype(np.uint64) + _ODD), 1
        active = None
        for k, first, last in bands(least, exponent, longest):
            if active is None:
                while width < k:
                    grams = mixed(grams[:-width] * _ODD + grams[width:])
                    width *= 2
                active = np.arange(len(grams))
            else:
                # Both halves of a repeated k-gram are repeated themselves.
                alive = np.zeros(len(grams), dtype=bool)
                alive[active] = True
                active = active[active < len(grams) - width]
                active = active[alive[active + width]]
                grams[active] = mixed(grams[active] * _ODD + grams[active + width])
                width = k
            at = active[np.argsort(grams[active], kind="stable")]
            again = (np.diff(grams[at]) == 0) & (np.diff(owner[at]) == 0)
            seeds, lags = at[:-1][again], np.diff(at)[again]
            kept = (lags >= first) & (lags <= last)
            for left, length, lag in _diagonals(codes, seeds[kept], lags[kept], k):
                if length >= max(least, exponent * lag):
                    out.append((left, length, lag))
            repeated = np.zeros(len(at), dtype=bool)
            repeated[:-1] |= again
            repeated[1:] |= again
            active = np.sort(at[repeated])
            if len(active) < 2:
                break
    found = np.array(out, dtype=np.int64).reshape(-1, 3)
    text = np.searchsorted(starts, found[:, 0], side="right") - 1
    found = np.column_stack([text, found[:, 0] - starts[text], found[:, 1:]])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def repeats(found: np.ndarray, n: int) -> np.ndarray:
    """Words of one text that repeat an earlier period of a run (start, length, period)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return np.cumsum(step)[:n] > 0


def detected(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of each row.

    A run is a stretch of words ``[^\\x20\\x09-\\x0D]+`` with smallest period q, at least ``least``
    words and ``exponent`` (3 or more) periods long, that no neighbouring word extends. The collapsed
    text joins by one space the words that no run holds after its first period. Words differ by
    case. A missing or empty text has no words, no runs and an empty collapsed text; rows are
    taken apart, so repeated rows give equal rows, a missing doc_id stays missing, an empty table
    gives none, and other columns are ignored.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")

    def run(batches):
        for rest, texts in chunks(batches, limit=CHUNK_BYTES):
            codes, _, starts = token_table(texts, None)
            found = runs(codes, starts, least, exponent)
            bounds = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            collapsed = []
            for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
                # The bytes at which ``split`` cuts are the ones no word holds.
                kept = text.split()
                if a < b:
                    kept = compress(kept, ~repeats(found[a:b, 1:], len(kept)))
                collapsed.append(b" ".join(kept))
            values = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(found[:, c])) for c in (1, 2, 3)],
                names=["start", "length", "period"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rest["doc_id"], pa.int64()),
                    pa.array(np.diff(starts) - 1),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
