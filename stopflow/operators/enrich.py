"""Equi-join enrichment of stop visits: raw counts, road traffic, hourly weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.functions import calendar_parts, delay_minutes, epoch_shift, window_n_min
from stopflow.operators.cleaning import dedupe_first
from stopflow.operators.skew import adaptive_join, fan_out_join, keyed_join

RAW_KEYS = (
    "route_id",
    "transit_date",
    "route_direction_name",
    "trip_id",
    "block_abbr",
    "pattern_num",
    "stop_sequence",
)
RAW_VALUES = ("map_latitude", "map_longitude", "sched_hdwy", "actual_hdwy")
TRAFFIC_VALUES = ("average_speed", "reference_speed", "congestion", "extreme_congestion")
HOUR = ("year", "month", "day", "hour")
WEATHER_VALUES = ("precipitation_intensity", "temperature", "humidity")
SLOT = "time_window_5_mins"


def with_delay(raw: DataFrame) -> DataFrame:
    """Raw counts cut down to join keys, position, headways and delay in minutes."""
    return raw.select(
        *RAW_KEYS, *RAW_VALUES, delay_minutes("arrival_time", "scheduled_time").alias("delay")
    )


def enrich(visits: DataFrame, raw: DataFrame, keys: Sequence[str] = RAW_KEYS) -> DataFrame:
    """Left join raw counts on the seven keys, missing keys matching each other.

    Duplicate raw rows multiply the visit, as every match is kept.
    """
    return fan_out_join(visits, with_delay(raw), keys, null_safe=True)


def traffic_slots(readings: DataFrame, county: str = "davidson") -> DataFrame:
    """Readings of one county, the first per segment, day and 5-minute slot."""
    local = readings.where(F.col("county") == county).withColumns(
        calendar_parts("measurement_tstamp")
    )
    slots = local.withColumn(SLOT, window_n_min("hour", "minute"))
    keys = ["xd_id", "year", "month", "day", SLOT]
    first = dedupe_first(
        slots, keys, ["measurement_tstamp", *[c for c in TRAFFIC_VALUES if c in slots.columns]]
    )
    return first.select(*keys, *TRAFFIC_VALUES)


def with_slot(visits: DataFrame) -> DataFrame:
    """Add the 5-minute slot of departure."""
    return visits.withColumn(SLOT, window_n_min("hour", F.minute("departure_time")))


def join_traffic(visits: DataFrame, slots: DataFrame) -> DataFrame:
    """Left join traffic slots on day, slot and the visit's road segment."""
    keys = ["year", "month", "day", SLOT, "XDSegID"]
    keyed = slots.withColumn("XDSegID", F.col("xd_id"))
    return keyed_join(visits, keyed, keys, "left")


def weather_hourly_mean(weather: DataFrame, offset: int | None = None) -> DataFrame:
    """Mean weather per local calendar hour from epoch-second readings."""
    at = epoch_shift("time") if offset is None else epoch_shift("time", offset)
    parts = calendar_parts(at)
    timed = weather.select(*WEATHER_VALUES, *[parts[c].alias(c) for c in HOUR])
    return timed.groupBy(*HOUR).agg(*[F.avg(c).alias(c) for c in WEATHER_VALUES])


def join_weather(visits: DataFrame, hourly: DataFrame) -> DataFrame:
    """Left join hourly weather, one row per calendar hour."""
    return adaptive_join(visits, hourly, HOUR)
