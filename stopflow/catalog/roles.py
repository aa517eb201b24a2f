"""The bench tables in the roles of the transit model.

``Tables`` derives every role with Spark; ``ROLE_SQL`` says the same in SQL. A trip is a user's
week of events, ordered by time; a stop is the event's ``k`` property. Measures that get averaged
have long decimals, so that no mean sits right between two values of its rounded form.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.functions import load_bin
from stopflow.operators.snapshots import dynamic_nodes, snapshot_edges
from stopflow.operators.trips import TRIP, edge_target
from stopflow.session import stored

TRIP_SQL = ", ".join(TRIP)
ORDER_SQL = "stop_sequence, departure_time"
SNAP_SQL = "transit_date, direction, slot"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
CAPACITY = "element_at(array(15D, 40D, 45D, 55D), cast({key} % 4 as int) + 1)"
LON = "(-86.899D + ((stop_id * 37) % 100) / 500)"
LAT = "(36.001D + stop_id / 500)"


class Tables:
    """Role tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _events(self) -> DataFrame:
        """Events with the visit columns next to their own."""
        week = "date_sub(date(ts), weekday(ts))"
        direction = "array('FROM DOWNTOWN', 'TO DOWNTOWN', 'CROSSTOWN')"
        return self.table("events").selectExpr(
            "ts",
            "user_id",
            "event_id",
            "value",
            "event_id as visit_id",
            "cast(user_id % 10 as int) as route_id",
            f"{week} as transit_date",
            "cast(user_id as int) as trip_id",
            "cast(user_id % 7 as int) as block_abbr",
            "cast(user_id % 5 as int) as pattern_num",
            f"element_at({direction}, cast(user_id % 3 as int) + 1) as route_direction_name",
            f"cast(floor(timestampdiff(SECOND, cast({week} as timestamp_ntz), ts) / 600) as int)"
            " as stop_sequence",
            "cast(get_json_object(props, '$.k') as int) as stop_id",
            "ts as departure_time",
            "year(ts) as year",
            "month(ts) as month",
            "day(ts) as day",
            "hour(ts) as hour",
            "dayofweek(ts) as dayofweek",
            "hour(ts) * 2 + cast(floor(minute(ts) / 30) as int) as time_window",
            "day(ts) = 15 as is_holiday",
            f"if(user_id % 17 <> 0, {CAPACITY.format(key='user_id')}, null) as vehicle_capacity",
            "value / 8 as y_reg100",
            "event_type as icon",
        )

    @cached_property
    def visits(self) -> DataFrame:
        return self._events.drop("ts", "user_id", "event_id", "value")

    @cached_property
    def located(self) -> DataFrame:
        """Visits with the coordinates of their stop and a road segment."""
        return self.visits.selectExpr(
            "*", f"{LAT} as map_latitude", f"{LON} as map_longitude", "stop_id % 16 as XDSegID"
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Raw counts of every event, with headways and some missing positions."""
        early = "cast(round((value - 100) * 1000) as bigint)"
        headway = "(10 + event_id % 20) + (value - 50) / 10"
        return self._events.selectExpr(
            "route_id",
            "transit_date",
            "route_direction_name",
            "trip_id",
            "block_abbr",
            "pattern_num",
            "stop_sequence",
            "ts as arrival_time",
            f"timestampadd(MILLISECOND, -{early}, ts) as scheduled_time",
            f"if(event_id % 101 <> 0, {LAT}, null) as map_latitude",
            f"if(event_id % 101 <> 0, {LON}, null) as map_longitude",
            "cast(10 + event_id % 20 as double) as sched_hdwy",
            f"if(event_id % 11 <> 0, {headway}, null) as actual_hdwy",
        )

    @cached_property
    def traffic(self) -> DataFrame:
        """Traffic readings: every event, by stop group."""
        return self.table("events").selectExpr(
            "cast(get_json_object(props, '$.k') as int) % 16 as xd_id",
            "value as average_speed",
            "value + 10 as reference_speed",
            "value / 500 as congestion",
            "(event_id % 100) / 100 as extreme_congestion",
            "if(user_id % 10 = 9, 'rutherford', 'davidson') as county",
            "ts as measurement_tstamp",
            "year(ts) as year",
            "month(ts) as month",
        )

    @cached_property
    def shipments(self) -> DataFrame:
        """Traffic readings over several years, from line items."""
        return self.table("lineitem").selectExpr(
            "cast(l_partkey % 1000 as int) as xd_id",
            "l_quantity as average_speed",
            "l_quantity + 10 as reference_speed",
            "l_discount as congestion",
            "l_tax as extreme_congestion",
            "if(l_suppkey % 10 = 9, 'rutherford', 'davidson') as county",
            "cast(l_shipdate as timestamp_ntz) as measurement_tstamp",
            "year(l_shipdate) as year",
            "month(l_shipdate) as month",
        )

    @cached_property
    def weather(self) -> DataFrame:
        return self.table("events").selectExpr(
            f"timestampdiff(SECOND, {EPOCH}, ts) as time",
            "value * 0.0010309278D as precipitation_intensity",
            "cast(30 + event_id % 61 as double) as temperature",
            "(user_id % 97) / 97 as humidity",
        )

    @cached_property
    def tracts(self) -> DataFrame:
        """One 0.04-degree square per nation, six to a row."""
        named = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        x, y = "-86.9D + (k % 6) * 0.04D", "36.0D + floor(k / 6) * 0.04D"
        return self._squares(
            named.selectExpr("n_nationkey as k", "r_name as county"), x, y, "0.04D"
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """One small square per customer."""
        customers = self.table("customer").selectExpr("c_custkey as k", "c_mktsegment as county")
        x, y = "-86.9D + ((k * 61) % 199) / 1000", "36.0D + ((k * 83) % 199) / 1000"
        return self._squares(customers, x, y, "0.002D")

    def _squares(self, keyed: DataFrame, x: str, y: str, side: str) -> DataFrame:
        boxed = keyed.selectExpr(
            "lpad(cast(k as string), 8, '0') as GEOID",
            "concat('Census Tract ', k, ', ', county, ' County, US') as NAME",
            "if(k % 7 <> 0, cast(k % 40 as double), null) as no_public_transport_for_work",
            "cast((k % 9) * 25 as double) as total_surveyed_public_transportation_for_work",
            "if(k % 5 <> 0, 30000D + k * 100, null) as median_income_last12months",
            "cast(k % 90 as double) as white_pct",
            "cast(k % 80 as double) as black_pct",
            "cast(k % 70 as double) as hispanic_pct",
            "cast(k % 60 as double) as public_transit_pct",
            f"{x} as xmin",
            f"{y} as ymin",
            f"{x} + {side} as xmax",
            f"{y} + {side} as ymax",
        )
        corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")]
        ring = ", ".join(
            f"named_struct('lon', {lon}, 'lat', {lat})" for lon, lat in [*corners, corners[0]]
        )
        return boxed.selectExpr("*", f"array(array({ring})) as rings")

    @cached_property
    def segments(self) -> DataFrame:
        """One straight road segment per supplier."""
        ends = self.table("supplier").selectExpr(
            "cast(s_suppkey as int) as XDSegID",
            "36.0D + ((s_suppkey * 83) % 199) / 1000 as StartLat",
            "-86.9D + ((s_suppkey * 61) % 199) / 1000 as StartLong",
            "36.0D + ((s_suppkey * 83) % 199 + s_suppkey % 5) / 1000 as EndLat",
            "-86.9D + ((s_suppkey * 61) % 199 + 4) / 1000 as EndLong",
        )
        return self._as_paths(ends)

    def _as_paths(self, ends: DataFrame) -> DataFrame:
        """Straight lines from start and end columns, with their bounding box."""
        points = (
            "named_struct('lon', StartLong, 'lat', StartLat), "
            "named_struct('lon', EndLong, 'lat', EndLat)"
        )
        return ends.selectExpr(
            "*",
            f"array(array({points})) as paths",
            "least(StartLong, EndLong) as xmin",
            "least(StartLat, EndLat) as ymin",
            "greatest(StartLong, EndLong) as xmax",
            "greatest(StartLat, EndLat) as ymax",
        )

    @cached_property
    def roads(self) -> DataFrame:
        """A short stretch of road by every stop; sixteen roads in all, some out of reach."""
        lat = f"{LAT} + if(stop_id % 5 = 0, 0.003D, 0.0003D)"
        lines = self.visits.select("stop_id").distinct().selectExpr(
            "stop_id % 16 as XDSegID",
            f"{lat} as StartLat",
            f"{LON} - 0.0004D as StartLong",
            f"{lat} as EndLat",
            f"{LON} + 0.0004D as EndLong",
        )
        return self._as_paths(lines)

    @cached_property
    def prepared(self) -> DataFrame:
        """Visits with features of their own, ready for targets and snapshots."""
        kept = [c for c in self.visits.columns if c not in ("y_reg100", "icon")]
        known = self.visits.where("route_direction_name in ('TO DOWNTOWN', 'FROM DOWNTOWN')")
        return known.selectExpr(
            *kept,
            "y_reg100 as load",
            "icon as weather_category",
            "if(route_direction_name = 'TO DOWNTOWN', 1, 0) as direction",
            "cast(floor(time_window / 4) as int) as slot",
            "y_reg100 * 0.0103092783D as precipitation_intensity",
            "cast(30 + visit_id % 61 as double) as temperature",
            "(trip_id % 97) / 97 as humidity",
            "if(visit_id % 11 <> 0, cast(visit_id % 23 - 8 as double), null) as delay",
            "20 + stop_id * 0.30707070707071D as average_speed",
            "(visit_id % 7) / 8 as extreme_congestion",
            "y_reg100 / 47 as displacement",
            "30000D + stop_id * 100 as median_income_last12months",
            "stop_id / 100 as white_pct",
            "stop_id / 200 as black_pct",
            "stop_id / 300 as hispanic_pct",
            "stop_id / 400 as public_transit_pct",
            "stop_id / 500 as pct_public_transit_for_work",
            "dayofweek - 1 as dayofweek_cat",
            "month - 1 as month_cat",
            "year - 2024 as year_cat",
            f"if(visit_id % 13 <> 0, {LAT}, null) as map_latitude",
            f"if(visit_id % 17 <> 0, {LON}, null) as map_longitude",
            "cast(floor(time_window / 4) as int) as slot_cat",
        )

    @cached_property
    def ready(self) -> DataFrame:
        return stored(edge_target(self.prepared, "slot"), "ready")

    @cached_property
    def outbound(self) -> DataFrame:
        return self.ready.where("direction = 0")

    @cached_property
    def edges(self) -> DataFrame:
        return snapshot_edges(self.outbound)

    @cached_property
    def nodes(self) -> DataFrame:
        return dynamic_nodes(self.outbound)

    @cached_property
    def preds(self) -> DataFrame:
        """Load bin of a quantity as truth, line number as prediction."""
        rows = self.table("lineitem").selectExpr(
            "l_quantity",
            f"{CAPACITY.format(key='l_suppkey')} as capacity",
            "l_linenumber % 4 as ypred",
        )
        return rows.select(load_bin("l_quantity", "capacity").alias("ytrue"), "ypred")

    @cached_property
    def scored(self) -> DataFrame:
        """Four class scores per line item."""
        return self.table("lineitem").selectExpr(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_shipdate",
            "cast(l_suppkey % 4 as int) as y",
            "array(l_tax * 10, l_discount * 10, l_quantity / 50, l_linenumber / 7) as scores",
        )

    @cached_property
    def history(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_custkey as run",
            "o_orderkey as epoch",
            "cast(floor(o_totalprice / 50000) as double) as validation_loss",
        )


# ---------------------------------------------------------------------------------------
# The same roles in SQL: name → (roles it needs, body of the common table expression).

_VISIT_KEYS = (
    "route_id, transit_date, route_direction_name, trip_id, block_abbr, pattern_num, stop_sequence"
)

_SQUARES = """
    SELECT lpad(CAST({k} AS VARCHAR), 8, '0') AS GEOID,
           'Census Tract ' || CAST({k} AS VARCHAR) || ', ' || {county} || ' County, US' AS NAME,
           CASE WHEN {k} % 7 <> 0 THEN CAST({k} % 40 AS DOUBLE) END
             AS no_public_transport_for_work,
           CAST(({k} % 9) * 25 AS DOUBLE) AS total_surveyed_public_transportation_for_work,
           CASE WHEN {k} % 5 <> 0 THEN 30000.0::DOUBLE + {k} * 100 END
             AS median_income_last12months,
           CAST({k} % 90 AS DOUBLE) AS white_pct, CAST({k} % 80 AS DOUBLE) AS black_pct,
           CAST({k} % 70 AS DOUBLE) AS hispanic_pct,
           CAST({k} % 60 AS DOUBLE) AS public_transit_pct,
           {x} AS xmin, {y} AS ymin, {x} + {side} AS xmax, {y} + {side} AS ymax
    FROM {source}
"""

ROLE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "visits": (
        (),
        """
    SELECT event_id AS visit_id, CAST(user_id % 10 AS INTEGER) AS route_id,
           CAST(date_trunc('week', ts) AS DATE) AS transit_date,
           CAST(user_id AS INTEGER) AS trip_id, CAST(user_id % 7 AS INTEGER) AS block_abbr,
           CAST(user_id % 5 AS INTEGER) AS pattern_num,
           CASE user_id % 3 WHEN 0 THEN 'FROM DOWNTOWN' WHEN 1 THEN 'TO DOWNTOWN'
                ELSE 'CROSSTOWN' END AS route_direction_name,
           CAST(date_diff('second', date_trunc('week', ts), ts) // 600 AS INTEGER)
             AS stop_sequence,
           CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS stop_id,
           ts AS departure_time, CAST(year(ts) AS INTEGER) AS year,
           CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
           CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS dayofweek,
           CAST(hour(ts) * 2 + minute(ts) // 30 AS INTEGER) AS time_window,
           day(ts) = 15 AS is_holiday,
           CASE WHEN user_id % 17 <> 0 THEN CASE user_id % 4 WHEN 0 THEN 15.0::DOUBLE
                WHEN 1 THEN 40.0 WHEN 2 THEN 45.0 ELSE 55.0 END END AS vehicle_capacity,
           value / 8 AS y_reg100, event_type AS icon
    FROM events
""",
    ),
    "located": (
        ("visits",),
        """
    SELECT *, 36.001::DOUBLE + stop_id / 500 AS map_latitude,
           -86.899::DOUBLE + ((stop_id * 37) % 100) / 500 AS map_longitude,
           stop_id % 16 AS XDSegID
    FROM visits
""",
    ),
    "raw": (
        ("visits",),
        f"""
    SELECT {_VISIT_KEYS}, ts AS arrival_time,
           ts - to_milliseconds(CAST(round((value - 100) * 1000) AS BIGINT)) AS scheduled_time,
           CASE WHEN event_id % 101 <> 0 THEN 36.001::DOUBLE + stop_id / 500 END
             AS map_latitude,
           CASE WHEN event_id % 101 <> 0
                THEN -86.899::DOUBLE + ((stop_id * 37) % 100) / 500 END AS map_longitude,
           CAST(10 + event_id % 20 AS DOUBLE) AS sched_hdwy,
           CASE WHEN event_id % 11 <> 0 THEN (10 + event_id % 20) + (value - 50) / 10 END
             AS actual_hdwy
    FROM visits JOIN events ON event_id = visit_id
""",
    ),
    "traffic": (
        (),
        """
    SELECT CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 16 AS xd_id,
           value AS average_speed, value + 10 AS reference_speed, value / 500 AS congestion,
           (event_id % 100) / 100 AS extreme_congestion,
           CASE WHEN user_id % 10 = 9 THEN 'rutherford' ELSE 'davidson' END AS county,
           ts AS measurement_tstamp, CAST(year(ts) AS INTEGER) AS year,
           CAST(month(ts) AS INTEGER) AS month
    FROM events
""",
    ),
    "shipments": (
        (),
        """
    SELECT CAST(l_partkey % 1000 AS INTEGER) AS xd_id, l_quantity AS average_speed,
           l_quantity + 10 AS reference_speed, l_discount AS congestion,
           l_tax AS extreme_congestion,
           CASE WHEN l_suppkey % 10 = 9 THEN 'rutherford' ELSE 'davidson' END AS county,
           l_shipdate AS measurement_tstamp, CAST(year(l_shipdate) AS INTEGER) AS year,
           CAST(month(l_shipdate) AS INTEGER) AS month
    FROM lineitem
""",
    ),
    "slots": (
        ("traffic",),
        """
    SELECT xd_id, year, month, day, time_window_5_mins, average_speed, reference_speed,
           congestion, extreme_congestion
    FROM (
      SELECT *, row_number() OVER (
               PARTITION BY xd_id, year, month, day, time_window_5_mins
               ORDER BY measurement_tstamp) AS nth
      FROM (
        SELECT *, CAST(day(measurement_tstamp) AS INTEGER) AS day,
               CAST(round_even(minute(measurement_tstamp) / 5
                    + hour(measurement_tstamp) * 12, 0) AS INTEGER) AS time_window_5_mins
        FROM traffic WHERE county = 'davidson'))
    WHERE nth = 1
""",
    ),
    "weather": (
        (),
        """
    SELECT CAST(epoch_us(ts) // 1000000 AS BIGINT) AS time,
           value * 0.0010309278::DOUBLE AS precipitation_intensity,
           CAST(30 + event_id % 61 AS DOUBLE) AS temperature, (user_id % 97) / 97 AS humidity
    FROM events
""",
    ),
    "hourly": (
        ("weather",),
        """
    SELECT CAST(year(local_time) AS INTEGER) AS year, CAST(month(local_time) AS INTEGER) AS month,
           CAST(day(local_time) AS INTEGER) AS day, CAST(hour(local_time) AS INTEGER) AS hour,
           avg(precipitation_intensity) AS precipitation_intensity,
           avg(temperature) AS temperature, avg(humidity) AS humidity
    FROM (SELECT *, TIMESTAMP '1970-01-01' + to_seconds(time - 18000) AS local_time FROM weather)
    GROUP BY 1, 2, 3, 4
""",
    ),
    "tracts": (
        (),
        _SQUARES.format(
            k="n_nationkey",
            county="r_name",
            x="(-86.9::DOUBLE + (n_nationkey % 6) * 0.04::DOUBLE)",
            y="(36.0::DOUBLE + (n_nationkey // 6) * 0.04::DOUBLE)",
            side="0.04::DOUBLE",
            source="nation JOIN region ON n_regionkey = r_regionkey",
        ),
    ),
    "blocks": (
        (),
        _SQUARES.format(
            k="c_custkey",
            county="c_mktsegment",
            x="(-86.9::DOUBLE + ((c_custkey * 61) % 199) / 1000)",
            y="(36.0::DOUBLE + ((c_custkey * 83) % 199) / 1000)",
            side="0.002::DOUBLE",
            source="customer",
        ),
    ),
    "profile": (
        ("tracts",),
        """
    SELECT GEOID, split_part(trim(split_part(NAME, ',', 2)), ' ', 1) AS county_name,
           coalesce(no_public_transport_for_work
             / nullif(total_surveyed_public_transportation_for_work, 0), 0)
             AS pct_public_transit_for_work,
           coalesce(median_income_last12months, 0) AS median_income_last12months,
           white_pct, black_pct, hispanic_pct, public_transit_pct, xmin, ymin, xmax, ymax
    FROM tracts
""",
    ),
    "segments": (
        (),
        """
    SELECT CAST(s_suppkey AS INTEGER) AS XDSegID,
           36.0::DOUBLE + ((s_suppkey * 83) % 199) / 1000 AS StartLat,
           -86.9::DOUBLE + ((s_suppkey * 61) % 199) / 1000 AS StartLong,
           36.0::DOUBLE + ((s_suppkey * 83) % 199 + s_suppkey % 5) / 1000 AS EndLat,
           -86.9::DOUBLE + ((s_suppkey * 61) % 199 + 4) / 1000 AS EndLong
    FROM supplier
""",
    ),
    "roads": (
        ("visits",),
        """
    SELECT stop_id % 16 AS XDSegID, lat AS StartLat, lon - 0.0004::DOUBLE AS StartLong,
           lat AS EndLat, lon + 0.0004::DOUBLE AS EndLong
    FROM (SELECT stop_id, -86.899::DOUBLE + ((stop_id * 37) % 100) / 500 AS lon,
                 36.001::DOUBLE + stop_id / 500
                   + CASE WHEN stop_id % 5 = 0 THEN 0.003::DOUBLE ELSE 0.0003 END AS lat
          FROM (SELECT DISTINCT stop_id FROM visits))
""",
    ),
    "prepared": (
        ("visits",),
        """
    SELECT * EXCLUDE (y_reg100, icon), y_reg100 AS load, icon AS weather_category,
           CASE route_direction_name WHEN 'TO DOWNTOWN' THEN 1 WHEN 'FROM DOWNTOWN' THEN 0 END
             AS direction,
           time_window // 4 AS slot, y_reg100 * 0.0103092783::DOUBLE AS precipitation_intensity,
           CAST(30 + visit_id % 61 AS DOUBLE) AS temperature,
           (trip_id % 97) / 97 AS humidity,
           CASE WHEN visit_id % 11 <> 0 THEN CAST(visit_id % 23 - 8 AS DOUBLE) END AS delay,
           20 + stop_id * 0.30707070707071::DOUBLE AS average_speed, (visit_id % 7) / 8 AS extreme_congestion,
           y_reg100 / 47 AS displacement,
           30000.0::DOUBLE + stop_id * 100 AS median_income_last12months,
           stop_id / 100 AS white_pct, stop_id / 200 AS black_pct, stop_id / 300 AS hispanic_pct,
           stop_id / 400 AS public_transit_pct, stop_id / 500 AS pct_public_transit_for_work,
           dayofweek - 1 AS dayofweek_cat, month - 1 AS month_cat, year - 2024 AS year_cat,
           CASE WHEN visit_id % 13 <> 0 THEN 36.001::DOUBLE + stop_id / 500 END
             AS map_latitude,
           CASE WHEN visit_id % 17 <> 0
                THEN -86.899::DOUBLE + ((stop_id * 37) % 100) / 500 END AS map_longitude,
           time_window // 4 AS slot_cat
    FROM visits WHERE route_direction_name IN ('TO DOWNTOWN', 'FROM DOWNTOWN')
""",
    ),
    "ready": (
        ("prepared",),
        f"""
    SELECT * EXCLUDE (following, more), CASE WHEN more IS NOT NULL THEN following END AS target
    FROM (
      SELECT *, stop_id AS source,
             lead(stop_id) OVER (PARTITION BY {TRIP_SQL} ORDER BY {ORDER_SQL}) AS following,
             lead(1) OVER (PARTITION BY {TRIP_SQL}, slot ORDER BY {ORDER_SQL}) AS more
      FROM prepared)
""",
    ),
    "outbound": (("ready",), "SELECT * FROM ready WHERE direction = 0"),
    "edges": (
        ("outbound",),
        f"""
    SELECT {SNAP_SQL}, source, target, arg_max(displacement, departure_time) AS displacement,
           arg_max(median_income_last12months, departure_time) AS median_income_last12months,
           arg_max(white_pct, departure_time) AS white_pct,
           arg_max(black_pct, departure_time) AS black_pct,
           arg_max(hispanic_pct, departure_time) AS hispanic_pct,
           arg_max(public_transit_pct, departure_time) AS public_transit_pct,
           arg_max(pct_public_transit_for_work, departure_time) AS pct_public_transit_for_work
    FROM outbound WHERE target IS NOT NULL GROUP BY {SNAP_SQL}, source, target
""",
    ),
    "own_nodes": (
        ("outbound",),
        f"""
    SELECT {SNAP_SQL}, stop_id, avg(precipitation_intensity) AS precipitation_intensity,
           avg(temperature) AS temperature, avg(humidity) AS humidity, avg(delay) AS delay,
           avg(average_speed) AS average_speed, avg(extreme_congestion) AS extreme_congestion,
           min(dayofweek_cat) AS dayofweek_cat, min(month_cat) AS month_cat,
           min(year_cat) AS year_cat, min(slot_cat) AS slot_cat, max(load) AS top_load,
           max(vehicle_capacity) AS top_capacity
    FROM outbound GROUP BY {SNAP_SQL}, stop_id
""",
    ),
    "nodes": (
        ("own_nodes",),
        """
    SELECT e.transit_date, e.direction, e.slot, e.stop_id, {features},
           CASE WHEN o.stop_id IS NULL THEN 0 ELSE {label} END AS y
    FROM (SELECT transit_date, direction, slot, source AS stop_id FROM outbound
          UNION SELECT transit_date, direction, slot, target FROM outbound
          WHERE target IS NOT NULL) e
    LEFT JOIN own_nodes o ON o.transit_date = e.transit_date AND o.direction = e.direction
         AND o.slot = e.slot AND o.stop_id = e.stop_id
""",
    ),
    "preds": (
        (),
        """
    SELECT {bin} AS ytrue, l_linenumber % 4 AS ypred
    FROM (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 15.0::DOUBLE WHEN 1 THEN 40.0
                         WHEN 2 THEN 45.0 ELSE 55.0 END AS cap FROM lineitem)
""",
    ),
    "scored": (
        (),
        """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
           CAST(l_suppkey % 4 AS INTEGER) AS y,
           [l_tax * 10, l_discount * 10, l_quantity / 50, l_linenumber / 7] AS scores
    FROM lineitem
""",
    ),
    "history": (
        (),
        """
    SELECT o_custkey AS run, o_orderkey AS epoch,
           CAST(floor(o_totalprice / 50000) AS DOUBLE) AS validation_loss
    FROM orders
""",
    ),
}


def bin_sql(load: str, cap: str) -> str:
    """Occupancy bin of a load, any capacity."""
    return (
        f"CASE WHEN {load} >= 0 AND {load} <= round_even(0.33::DOUBLE * {cap}, 0) THEN 0"
        f" WHEN {load} >= 0 AND {load} <= round_even(0.66::DOUBLE * {cap}, 0) THEN 1"
        f" WHEN {load} >= 0 AND {load} <= {cap} THEN 2 ELSE 3 END"
    )


FEATURE_NAMES = (
    "precipitation_intensity",
    "temperature",
    "humidity",
    "delay",
    "average_speed",
    "extreme_congestion",
    "dayofweek_cat",
    "month_cat",
    "year_cat",
    "slot_cat",
)


def imputed_sql(value: str) -> str:
    """Features of ``o`` with a constant where the stop has no visit of its own."""
    return ", ".join(
        f"CASE WHEN o.stop_id IS NULL THEN {value} ELSE o.{c} END AS {c}" for c in FEATURE_NAMES
    )


_FILLED = {
    "nodes": {
        "features": imputed_sql("0"),
        "label": bin_sql("o.top_load", "o.top_capacity"),
    },
    "preds": {"bin": bin_sql("l_quantity", "cap")},
}


def with_roles(names: str, body: str) -> str:
    """SQL with the named roles, and what they need, as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in ROLE_SQL[name][0]:
            visit(need)
        ordered.append(name)

    for name in names.split():
        visit(name)
    parts = []
    for name in ordered:
        text = ROLE_SQL[name][1].strip()
        parts.append(f"{name} AS ({text.format(**_FILLED[name]) if name in _FILLED else text})")
    return f"WITH {', '.join(parts)} {body.strip()}" if parts else body.strip()
