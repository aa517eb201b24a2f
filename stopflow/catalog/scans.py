"""Readers and writers: each query stores a role table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopflow.catalog.aggregates import prf_sql
from stopflow.catalog.registry import query, r, rounded
from stopflow.catalog.roles import SNAP_SQL, Tables
from stopflow.operators.metrics import report
from stopflow.operators.snapshots import EDGE
from stopflow.session import scratch_path
from stopflow.sources import readers, snapshot_store, writers

VISIT_COLUMNS = (
    "route_id, transit_date, trip_id, block_abbr, pattern_num, route_direction_name, "
    "stop_sequence, stop_id, departure_time, year, month, day, hour, dayofweek, time_window, "
    "is_holiday, vehicle_capacity, y_reg100, icon"
)
TRAFFIC_COLUMNS = (
    "xd_id, average_speed, reference_speed, congestion, extreme_congestion, county, "
    "measurement_tstamp, year, month"
)


def _visits(t: Tables):
    return t.visits.drop("visit_id")


@query("src_parquet", "visits", f"SELECT {VISIT_COLUMNS} FROM visits")
def src_parquet(t: Tables):
    path = scratch_path(t.spark, "visits")
    _visits(t).write.parquet(path)
    return readers.read_visits(t.spark, path)


@query(
    "src_parquet_by_route",
    "visits",
    f"SELECT {VISIT_COLUMNS} FROM visits WHERE route_id IN (3, 5, 8)",
)
def src_parquet_by_route(t: Tables):
    path = scratch_path(t.spark, "routes")
    writers.write_by_route(_visits(t), path)
    return readers.read_routes(t.spark, path, [3, 5, 8])


@query(
    "src_parquet_pruned",
    "shipments",
    f"SELECT {TRAFFIC_COLUMNS} FROM shipments WHERE year = 1998 AND month = 3",
)
def src_parquet_pruned(t: Tables):
    path = scratch_path(t.spark, "traffic")
    writers.write_traffic(t.shipments, path)
    return readers.read_traffic(t.spark, path, 1998, 3)


# Documents that the queries write and read back.
DOCUMENTS = 4


def _text(value):
    return F.to_json(value).alias("value")


def _coordinates(points):
    return F.transform(points, lambda p: F.array(p["lon"], p["lat"]))


POLYGON_SQL = """
    SELECT GEOID, NAME, no_public_transport_for_work,
           total_surveyed_public_transportation_for_work, median_income_last12months,
           white_pct, black_pct, hispanic_pct, public_transit_pct,
           round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax,
           round(ymax, 6) AS ymax, 1 AS n_rings, 5 AS n_points
    FROM blocks
"""


@query("src_geojson_polygons", "blocks", POLYGON_SQL)
def src_geojson_polygons(t: Tables):
    path = scratch_path(t.spark, "polygons")
    names = [c for c in t.blocks.columns if c not in ("rings", "xmin", "ymin", "xmax", "ymax")]
    geometry = F.struct(
        F.lit("Polygon").alias("type"),
        F.transform("rings", _coordinates).alias("coordinates"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*names).alias("properties"),
        geometry.alias("geometry"),
    )
    writers.write_collections(t.blocks.select(_text(feature)), path, DOCUMENTS)
    layer = readers.read_polygons(t.spark, path)
    return rounded(
        layer.withColumns(
            {"n_rings": F.size("rings"), "n_points": F.size(F.get(F.col("rings"), 0))}
        ).drop("rings")
    )


LINE_SQL = f"""
    SELECT XDSegID, {r("StartLat", "StartLong", "EndLat", "EndLong")},
           round(least(StartLong, EndLong), 6) AS xmin, round(least(StartLat, EndLat), 6) AS ymin,
           round(greatest(StartLong, EndLong), 6) AS xmax,
           round(greatest(StartLat, EndLat), 6) AS ymax, 2 AS n_points
    FROM segments
"""


@query("src_geojson_lines", "segments", LINE_SQL)
def src_geojson_lines(t: Tables):
    path = scratch_path(t.spark, "lines")
    properties = F.struct(
        F.col("XDSegID").cast("string").alias("XDSegID"),
        "StartLat",
        "StartLong",
        "EndLat",
        "EndLong",
    )
    geometry = F.struct(
        F.lit("LineString").alias("type"),
        _coordinates(F.get(F.col("paths"), 0)).alias("coordinates"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        properties.alias("properties"),
        geometry.alias("geometry"),
    )
    writers.write_collections(t.segments.select(_text(feature)), path, DOCUMENTS)
    layer = readers.read_lines(t.spark, path)
    return rounded(
        layer.withColumn("n_points", F.size(F.get(F.col("paths"), 0))).drop("paths")
    )


@query(
    "src_json",
    "weather",
    f"SELECT time, {r('precipitation_intensity', 'temperature', 'humidity')} FROM weather",
)
def src_json(t: Tables):
    path = scratch_path(t.spark, "weather")
    writers.write_documents(t.weather.select(_text(F.struct("*"))), path, DOCUMENTS)
    return rounded(readers.read_weather(t.spark, path, multi_line=True))


@query(
    "src_csv",
    "",
    """
    SELECT CAST(o_orderkey AS INTEGER) AS epoch, o_totalprice / 1000 AS train_acc,
           CAST(NULL AS DOUBLE) AS validation_acc, o_totalprice AS train_loss,
           o_totalprice AS validation_loss, CAST(NULL AS DOUBLE) AS test_acc_with_4th_bin
    FROM orders
    """,
)
def src_csv(t: Tables):
    path = scratch_path(t.spark, "history")
    price = F.col("o_totalprice")
    rows = t.table("orders").select(
        F.col("o_custkey").alias("_c0"),
        F.col("o_orderkey").alias("epoch"),
        (price / 1000).alias("train_acc"),
        F.lit("NaN").alias("validation_acc"),
        price.alias("train_loss"),
        price.alias("validation_loss"),
        F.lit(None).cast("double").alias("test_acc_with_4th_bin"),
    )
    writers.write_csv(rows, path)
    return readers.read_history(t.spark, path)


@query("sink_parquet_by_route", "visits", f"SELECT {VISIT_COLUMNS} FROM visits")
def sink_parquet_by_route(t: Tables):
    path = scratch_path(t.spark, "by-route")
    writers.write_by_route(_visits(t), path)
    return readers.read_routes(t.spark, path)


@query(
    "sink_snapshots",
    "nodes edges",
    f"""
    SELECT {SNAP_SQL}, CAST(count(*) AS BIGINT) AS n_nodes, CAST(sum(y) AS BIGINT) AS sum_y,
           any_value(n_edges) AS n_edges, round(any_value(km), 6) AS km
    FROM nodes JOIN (
      SELECT {SNAP_SQL}, CAST(count(*) AS BIGINT) AS n_edges, sum(displacement) AS km
      FROM edges GROUP BY {SNAP_SQL}) USING ({SNAP_SQL})
    GROUP BY {SNAP_SQL}
    """,
)
def sink_snapshots(t: Tables):
    path = scratch_path(t.spark, "snapshots")
    snapshot_store.write_snapshots(t.nodes, t.edges, path)
    nodes, edges = snapshot_store.read_snapshots(t.spark, path)
    keys = list(EDGE[:3])
    per_nodes = nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("y").alias("sum_y")
    )
    per_edges = edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("displacement").alias("km")
    )
    return rounded(per_nodes.join(per_edges, keys))


@query("sink_csv", "preds", "SELECT ytrue, ypred FROM preds")
def sink_csv(t: Tables):
    path = scratch_path(t.spark, "predictions")
    writers.write_csv(t.preds, path)
    return readers.read_predictions(t.spark, path, index_col=False)


@query(
    "sink_metrics",
    "preds",
    f"""
    SELECT accuracy, precision, recall, f1, ordinal_accuracy
    FROM ({prf_sql("preds")}) CROSS JOIN (
      SELECT round(avg(CASE WHEN ytrue = ypred THEN 1 ELSE 0 END), 6) AS accuracy,
             round(avg(1 - abs(ytrue - ypred) / 4), 6) AS ordinal_accuracy FROM preds)
    """,
)
def sink_metrics(t: Tables):
    path = scratch_path(t.spark, "metrics")
    writers.write_metrics(report(t.preds), path)
    names = ("accuracy", "precision", "recall", "f1", "ordinal_accuracy")
    stored = t.spark.read.schema(", ".join(f"{n} DOUBLE" for n in names)).json(path)
    return rounded(stored)
