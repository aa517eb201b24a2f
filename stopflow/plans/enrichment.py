"""Visit enrichment: raw counts, displacement, tracts, road traffic, load bins, weather.

One plan over all routes and months. Like the hand-over files between cleaning steps, tables are
stored on the way: visits after the raw join, after the traffic fills, and complete ones. Several
steps read each of them (heavy trips, distinct coordinates, the rows themselves), every time only
the columns they need. Heavy trips are looked for once; the block column serves all trip operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopflow.functions import daypart, is_weekend, load_bin, period_label
from stopflow.functions.scalars import DIRECTION_CODES, KNOWN_CAPACITIES
from stopflow.operators.cleaning import dedupe_rows, drop_nulls
from stopflow.operators.enrich import (
    enrich,
    join_traffic,
    join_weather,
    traffic_slots,
    weather_hourly_mean,
    with_slot,
)
from stopflow.operators.skew import BLOCK, tag_blocks
from stopflow.operators.spatial import nearest_line, within
from stopflow.operators.trips import (
    TRIP,
    TRIP_ORDER,
    displacement,
    fill_traffic,
    keep_loaded_trips,
    with_key,
)
from stopflow.session import stored

TRACT_VALUES = [
    "pct_public_transit_for_work",
    "median_income_last12months",
    "white_pct",
    "black_pct",
    "hispanic_pct",
    "public_transit_pct",
]


def label_and_filter(visits: DataFrame) -> DataFrame:
    """Sign-up period, and only the two downtown directions."""
    labelled = visits.withColumn("apc_signup_name", period_label("transit_date"))
    return labelled.where(F.col("route_direction_name").isin(*DIRECTION_CODES))


def enriched_visits(
    visits: DataFrame,
    raw: DataFrame,
    tracts: DataFrame,
    segments: DataFrame,
    traffic: DataFrame,
    radius: float = 0.001,
) -> DataFrame:
    """Visits with delay, displacement, tract values and gap-filled traffic."""
    rows = stored(dedupe_rows(enrich(label_and_filter(visits), raw)), "counted")
    # Copies made by the raw join differ in delay and position only; they order the ties.
    order = [*TRIP_ORDER, "delay", "sched_hdwy", "actual_hdwy"]
    rows = tag_blocks(with_key(rows, TRIP), TRIP, order)
    rows = displacement(rows, order=order, tagged=True)
    rows = within(with_slot(rows), tracts, TRACT_VALUES)
    rows = join_traffic(nearest_line(rows, segments, radius), traffic_slots(traffic))
    filled = fill_traffic(rows, keys=(*TRIP, "year", "month"), order=order, tagged=True)
    return stored(filled.drop(BLOCK), "enriched")


def prepared_visits(enriched: DataFrame, weather: DataFrame) -> DataFrame:
    """Day part, weekend, load bin and weather; empty trips and incomplete rows dropped."""
    named = enriched.withColumnsRenamed({"y_reg100": "load", "icon": "weather_category"})
    binned = named.withColumns(
        {
            "new_time_window": daypart("time_window"),
            "is_weekend": is_weekend("dayofweek"),
            "load_bin_transit": load_bin("load", "vehicle_capacity", KNOWN_CAPACITIES),
        }
    )
    loaded = keep_loaded_trips(binned)
    complete = drop_nulls(join_weather(loaded, weather_hourly_mean(weather)))
    return stored(complete, "prepared")
