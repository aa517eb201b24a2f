"""Scalar rules of the occupancy data model as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sign-up periods and their inclusive date ranges.
SIGNUP_PERIODS = (
    ("September 2020", "2020-09-13", "2021-04-10"),
    ("April 2021", "2021-04-11", "2021-10-02"),
    ("October 2021", "2021-10-03", "2022-04-02"),
    ("April 2022", "2022-04-03", "2022-10-01"),
    ("October 2022", "2022-10-02", "2023-04-01"),
)

# Direction codes, Boolean codes, known vehicle capacities.
DIRECTION_CODES = {"TO DOWNTOWN": 1, "FROM DOWNTOWN": 0}
BOOLEAN_CODES = {True: 1, False: 0}
KNOWN_CAPACITIES = (15, 40, 45, 55)

# Share of capacity at the upper edge of load bins 0 and 1; bin 2 ends at
# capacity and 3 takes everything else.
BIN_SHARES = (0.33, 0.66)
OVER_CAPACITY = 3

# Half-hour index ranges (inclusive) of day parts 1 to 4; the rest is 5.
DAYPARTS = ((1, 8, 12), (2, 13, 18), (3, 19, 28), (4, 29, 36))
OTHER_DAYPART = 5

EARTH_RADIUS_KM = 6371.0
UTC_MINUS_5_SECONDS = -18000


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first_match(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """``CASE WHEN`` over (condition, value) pairs, first hit wins."""
    return F.coalesce(*[F.when(cond, value) for cond, value in rules], otherwise)


def period_label(
    date: Column | str, ranges: Sequence[tuple[str, str, str]] = SIGNUP_PERIODS
) -> Column:
    """Name of the period whose inclusive range holds the date, else NULL."""
    day = _as_col(date).cast("date")
    return F.coalesce(
        *[
            F.when(day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(name))
            for name, lo, hi in ranges
        ],
        F.lit(None).cast("string"),
    )


def delay_minutes(arrival: Column | str, scheduled: Column | str) -> Column:
    """Whole minutes from scheduled to arrival, truncated toward zero; NULL stays NULL."""
    return F.timestamp_diff("MINUTE", _as_col(scheduled), _as_col(arrival)).cast("int")


def calendar_parts(ts: Column | str) -> dict[str, Column]:
    """Year, month, day, hour and minute columns, ready for ``withColumns``."""
    t = _as_col(ts)
    return {
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "hour": F.hour(t),
        "minute": F.minute(t),
    }


def window_n_min(hour: Column | str, minute: Column | str, n: int = 5) -> Column:
    """Nearest n-minute slot of the day, half to even; the last slot is not wrapped."""
    slots_per_hour = 60 / n
    return F.bround(_as_col(minute) / n + _as_col(hour) * slots_per_hour).cast("int")


def fold_window(window: Column | str, per: int = 2, fold: int | None = None) -> Column:
    """Half-hour index → coarser window of ``per`` half hours; window ``fold`` becomes 0.

    The default folds midnight (24:00) only. ``per=2, fold=12`` reproduces the variant that
    also merges noon into midnight.
    """
    fold = 48 // per if fold is None else fold
    coarse = F.floor(_as_col(window) / per).cast("int")
    return F.when(coarse == fold, F.lit(0)).otherwise(coarse)


def daypart(window: Column | str) -> Column:
    """Day part 1..5 of a half-hour index (may be fractional; NULL gives 5)."""
    w = _as_col(window)
    # Ranges are contiguous, so each one starts right above the end of the one before.
    rules = []
    below = None
    for part, first, last in DAYPARTS:
        lower = w >= first if below is None else w > below
        rules.append((lower & (w <= last), F.lit(part)))
        below = last
    return _first_match(rules, F.lit(OTHER_DAYPART))


def is_weekend(dayofweek: Column | str) -> Column:
    """True outside Monday..Friday (1 = Sunday); an unknown day counts as weekend."""
    return ~F.coalesce(_as_col(dayofweek).between(2, 6), F.lit(False))


def load_bin(
    load: Column | str, capacity: Column | str, allowed: Sequence[int] | None = None
) -> Column:
    """Occupancy bin 0..3 of a load against 33 %, 66 % and 100 % of capacity.

    Edges are rounded half to even. Negative, missing or over-capacity loads, and capacities
    outside ``allowed`` (when given), fall into bin 3.
    """
    x, cap = _as_col(load), _as_col(capacity)
    valid = x >= 0
    if allowed is not None:
        valid = valid & cap.isin(*allowed)
    edges = [F.bround(F.lit(share) * cap) for share in BIN_SHARES] + [cap]
    return _first_match(
        [(valid & (x <= edge), F.lit(i)) for i, edge in enumerate(edges)],
        F.lit(OVER_CAPACITY),
    )


def haversine_km(
    lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str
) -> Column:
    """Great-circle distance in kilometres; NULL when any coordinate is NULL."""
    phi1, phi2 = F.radians(_as_col(lat1)), F.radians(_as_col(lat2))
    half_dphi = F.radians(_as_col(lat2) - _as_col(lat1)) / 2
    half_dlam = F.radians(_as_col(lon2) - _as_col(lon1)) / 2
    h = F.pow(F.sin(half_dphi), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_dlam), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def county_of(name: Column | str) -> Column:
    """First word of the second comma-separated part of a tract name."""
    second = F.trim(F.try_element_at(F.split(_as_col(name), ","), F.lit(2)))
    return F.try_element_at(F.split(second, " "), F.lit(1))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, 0 when either side is missing or the denominator is 0."""
    return F.coalesce(F.try_divide(_as_col(numerator), _as_col(denominator)), F.lit(0.0))


def map_values(c: Column | str, mapping: Mapping) -> Column:
    """Replace values by a fixed dictionary; unmapped and missing values become NULL."""
    source = _as_col(c)
    pairs = [F.when(source == F.lit(k), F.lit(v)) for k, v in mapping.items()]
    return reduce(lambda a, b: F.coalesce(a, b), pairs)


def epoch_shift(seconds: Column | str, offset: int = UTC_MINUS_5_SECONDS) -> Column:
    """Epoch seconds moved by a fixed offset, as a time-zone-free timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", _as_col(seconds) + F.lit(offset), epoch)


def argmax_class(scores: Column | str) -> Column:
    """Zero-based index of the highest score, the first one on ties."""
    s = _as_col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")
