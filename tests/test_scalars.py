from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stopflow import functions as f
from stopflow.functions.scalars import BOOLEAN_CODES, DIRECTION_CODES, KNOWN_CAPACITIES


def evaluate(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_load_bin_any_capacity(spark):
    cases = [
        (40.0, [(0, 0), (13, 0), (14, 1), (26, 1), (27, 2), (40, 2), (41, 3), (-1, 3)]),
        (50.0, [(16, 0), (17, 1)]),
        (55.0, [(18, 0), (19, 1)]),
    ]
    rows = [(float(x), cap, want) for cap, pairs in cases for x, want in pairs]
    rows.append((None, 40.0, 3))
    got = evaluate(spark, rows, "x double, cap double, want int", f.load_bin("x", "cap"))
    assert got == [want for _, _, want in rows]


def test_load_bin_known_capacities_only(spark):
    rows = [(5.0, 30.0), (5.0, 15.0), (6.0, 15.0), (5.0, None)]
    got = evaluate(
        spark, rows, "x double, cap double", f.load_bin("x", "cap", KNOWN_CAPACITIES)
    )
    assert got == [3, 0, 1, 3]


def test_five_minute_slot(spark):
    rows = [(0, 2), (0, 3), (23, 58), (7, 30)]
    got = evaluate(spark, rows, "h int, m int", f.window_n_min("h", "m"))
    assert got == [0, 1, 288, 90]


def test_haversine(spark):
    rows = [(36.0, -86.0, 36.01, -86.0), (36.0, -86.0, None, -86.0)]
    km = f.haversine_km("a", "b", "c", "d")
    got = evaluate(spark, rows, "a double, b double, c double, d double", km)
    assert got[0] == pytest.approx(1.111949, abs=1e-6)
    assert got[1] is None


@pytest.mark.parametrize(
    "per, fold, pairs",
    [
        (2, 12, [(23, 11), (24, 0), (48, 24)]),
        (2, None, [(23, 11), (24, 12), (48, 0)]),
        (4, None, [(47, 11), (48, 0)]),
    ],
)
def test_fold_window(spark, per, fold, pairs):
    got = evaluate(spark, pairs, "w int, want int", f.fold_window("w", per, fold))
    assert got == [want for _, want in pairs]


def test_daypart(spark):
    pairs = [(7, 5), (8, 1), (12, 1), (13, 2), (18, 2), (19, 3), (28, 3), (29, 4), (36, 4)]
    pairs += [(37, 5), (None, 5)]
    got = evaluate(spark, pairs, "w int, want int", f.daypart("w"))
    assert got == [want for _, want in pairs]


def test_is_weekend(spark):
    rows = [(d,) for d in (1, 2, 6, 7, None)]
    assert evaluate(spark, rows, "d int", f.is_weekend("d")) == [True, False, False, True, True]


def test_delay_truncates_toward_zero(spark):
    at = datetime(2024, 1, 1, 12, 0, 0)
    rows = [
        (datetime(2024, 1, 1, 12, 1, 59), at),
        (datetime(2024, 1, 1, 11, 58, 30), at),
        (None, at),
    ]
    schema = "arrival timestamp_ntz, scheduled timestamp_ntz"
    assert evaluate(spark, rows, schema, f.delay_minutes("arrival", "scheduled")) == [1, -1, None]


def test_epoch_shift(spark):
    got = evaluate(spark, [(1704067200,)], "t long", f.epoch_shift("t"))
    assert got == [datetime(2023, 12, 31, 19, 0, 0)]


def test_period_label(spark):
    days = [date(2020, 9, 12), date(2020, 9, 13), date(2021, 4, 10), date(2021, 4, 11)]
    days += [date(2023, 4, 1), date(2023, 4, 2), None]
    got = evaluate(spark, [(d,) for d in days], "d date", f.period_label("d"))
    assert got == [
        None,
        "September 2020",
        "September 2020",
        "April 2021",
        "October 2022",
        None,
        None,
    ]


def test_county_and_ratio(spark):
    names = [("Census Tract 1, Davidson County, Tennessee",), ("no commas",), (None,)]
    assert evaluate(spark, names, "n string", f.county_of("n")) == ["Davidson", None, None]
    pairs = [(1.0, 4.0), (1.0, 0.0), (None, 4.0), (3.0, None)]
    got = evaluate(spark, pairs, "a double, b double", f.safe_ratio("a", "b"))
    assert got == [0.25, 0.0, 0.0, 0.0]


def test_map_values(spark):
    rows = [("TO DOWNTOWN",), ("FROM DOWNTOWN",), ("CROSSTOWN",), (None,)]
    got = evaluate(spark, rows, "d string", f.map_values("d", DIRECTION_CODES))
    assert got == [1, 0, None, None]
    flags = [(True,), (False,), (None,)]
    assert evaluate(spark, flags, "b boolean", f.map_values("b", BOOLEAN_CODES)) == [1, 0, None]


def test_argmax_first_on_ties(spark):
    rows = [([0.1, 0.7, 0.2],), ([0.5, 0.5, 0.0],)]
    assert evaluate(spark, rows, "s array<double>", f.argmax_class("s")) == [1, 0]


def test_calendar_parts(spark):
    rows = [(datetime(2023, 2, 28, 23, 59, 1),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    got = df.select(*[c.alias(n) for n, c in f.calendar_parts("t").items()]).first()
    assert tuple(got) == (2023, 2, 28, 23, 59)
    assert df.select(F.dayofweek("t")).first()[0] == 3
