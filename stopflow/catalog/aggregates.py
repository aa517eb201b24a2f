"""Aggregations, counts, fits and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stopflow.catalog.registry import query, r, rounded
from stopflow.catalog.roles import FEATURE_NAMES, SNAP_SQL, Tables, bin_sql
from stopflow.functions import argmax_class, daypart, epoch_shift, load_bin
from stopflow.functions.scalars import KNOWN_CAPACITIES
from stopflow.operators import metrics, stats
from stopflow.operators.cleaning import dedupe_first, dedupe_rows, null_audit
from stopflow.operators.enrich import WEATHER_VALUES, enrich, weather_hourly_mean
from stopflow.operators.scaling import (
    SCALED_COLUMNS,
    apply_minmax,
    fit_minmax,
    label_encode,
    read_bounds,
    save_bounds,
)
from stopflow.operators.snapshots import (
    SNAPSHOT,
    node_features,
    node_labels,
    snapshot_class_mean,
    snapshot_size_check,
)
from stopflow.operators.splits import hash_split
from stopflow.session import scratch_path


@query("distinct_values", "visits", "SELECT DISTINCT route_id, stop_id FROM visits")
def _(t: Tables):
    return stats.distinct_values(t.visits, "route_id", "stop_id")


@query(
    "dedupe_rows",
    "",
    "SELECT DISTINCT l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem",
)
def _(t: Tables):
    cols = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    return dedupe_rows(t.table("lineitem").select(*cols))


@query(
    "dedupe_keep_first",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                   ORDER BY l_partkey, l_shipdate, l_quantity) AS nth FROM lineitem)
       WHERE nth = 1""",
)
def _(t: Tables):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity"]
    rows = t.table("lineitem").select(*cols)
    return dedupe_first(
        rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_shipdate", "l_quantity"]
    )


@query(
    "weather_hourly_mean",
    "hourly",
    f"SELECT year, month, day, hour, {r(*WEATHER_VALUES)} FROM hourly",
)
def _(t: Tables):
    return rounded(weather_hourly_mean(t.weather))


@query(
    "time_bounds",
    "weather",
    """SELECT min(local_time) AS first_time, max(local_time) AS last_time FROM (
         SELECT TIMESTAMP '1970-01-01' + to_seconds(time - 18000) AS local_time FROM weather)""",
)
def _(t: Tables):
    return stats.time_bounds(t.weather.select(epoch_shift("time").alias("datetime")))


_HEADWAY = "if(visit_id % 11 <> 0, 10D + visit_id % 20 + (visit_id % 7) / 8, null)"
_HEADWAY_SQL = (
    "CASE WHEN visit_id % 11 <> 0 THEN 10.0::DOUBLE + visit_id % 20 + (visit_id % 7) / 8 END"
)
_GAPS = ("delay", "actual_hdwy")
_SCALED_SQL = ", ".join(
    f"round(({f'coalesce({c}, 0)' if c in _GAPS else c} - {c}_lo) / ({c}_hi - {c}_lo), 6) AS {c}"
    for c in SCALED_COLUMNS
)
_BOUNDS_SQL = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in SCALED_COLUMNS)


def _with_headway(t: Tables):
    rows = t.prepared.withColumn("actual_hdwy", F.expr(_HEADWAY))
    return rows.select("visit_id", "direction", *SCALED_COLUMNS)


def _filled(rows):
    return rows.drop("direction").fillna(dict.fromkeys(_GAPS, 0))


@query(
    "minmax_scale",
    "prepared",
    f"""SELECT visit_id, {_SCALED_SQL}
       FROM (SELECT *, {_HEADWAY_SQL} AS actual_hdwy FROM prepared)
       CROSS JOIN (SELECT {_BOUNDS_SQL} FROM
                   (SELECT *, {_HEADWAY_SQL} AS actual_hdwy FROM prepared))""",
)
def _(t: Tables):
    return rounded(apply_minmax(_filled(_with_headway(t)), fit_minmax(_with_headway(t))))


@query(
    "minmax_saved",
    "prepared",
    f"""SELECT visit_id, {_SCALED_SQL}
       FROM (SELECT *, {_HEADWAY_SQL} AS actual_hdwy FROM prepared)
       CROSS JOIN (SELECT {_BOUNDS_SQL} FROM
                   (SELECT *, {_HEADWAY_SQL} AS actual_hdwy FROM prepared WHERE direction = 0))""",
)
def _(t: Tables):
    """Bounds fitted on the outbound direction, saved, read again and applied to all visits."""
    path = scratch_path(t.spark, "bounds")
    save_bounds(fit_minmax(_with_headway(t).where("direction = 0")), path)
    return rounded(apply_minmax(_filled(_with_headway(t)), read_bounds(t.spark, path)))


@query(
    "label_encode",
    "visits",
    """SELECT visit_id, CAST(dense_rank() OVER (ORDER BY dayofweek) - 1 AS INTEGER)
                AS dayofweek_cat,
              CAST(dense_rank() OVER (ORDER BY month) - 1 AS INTEGER) AS month_cat,
              CAST(dense_rank() OVER (ORDER BY year) - 1 AS INTEGER) AS year_cat,
              CAST(dense_rank() OVER (ORDER BY stop_sequence) - 1 AS INTEGER)
                AS stop_sequence_cat
       FROM visits""",
)
def _(t: Tables):
    cols = ["dayofweek", "month", "year", "stop_sequence"]
    coded = label_encode(t.visits.select("visit_id", *cols), cols)
    return coded.drop(*cols)


_DAYPART_SQL = """
    (SELECT *, CASE WHEN time_window BETWEEN 8 AND 12 THEN 1
            WHEN time_window BETWEEN 13 AND 18 THEN 2 WHEN time_window BETWEEN 19 AND 28 THEN 3
            WHEN time_window BETWEEN 29 AND 36 THEN 4 ELSE 5 END AS new_time_window FROM visits)
"""
_RECURRING_SQL = (
    "new_time_window, block_abbr, route_id, route_direction_name, stop_id, dayofweek"
)


@query(
    "flag_small_groups",
    "visits",
    f"""SELECT visit_id, count(*) OVER (PARTITION BY {_RECURRING_SQL}) < 4
               AS remove_trip_condn FROM {_DAYPART_SQL}""",
)
def _(t: Tables):
    visits = t.visits.withColumn("new_time_window", daypart("time_window"))
    return stats.flag_small_groups(visits).select("visit_id", "remove_trip_condn")


@query(
    "any_small_group",
    "visits",
    f"""SELECT count(*) > 0 AS any_small FROM (
          SELECT 1 AS one FROM {_DAYPART_SQL} GROUP BY {_RECURRING_SQL} HAVING count(*) < 4)""",
)
def _(t: Tables):
    return stats.any_small_group(
        t.visits.withColumn("new_time_window", daypart("time_window"))
    )


@query(
    "value_counts",
    "visits",
    f"""SELECT load_bin_transit, count(*) AS n FROM (
          SELECT CASE WHEN vehicle_capacity IN (15, 40, 45, 55)
                 THEN {bin_sql("y_reg100", "vehicle_capacity")} ELSE 3 END AS load_bin_transit
          FROM visits) GROUP BY load_bin_transit""",
)
def _(t: Tables):
    bins = load_bin("y_reg100", "vehicle_capacity", KNOWN_CAPACITIES)
    return stats.value_counts(
        t.visits.select(bins.alias("load_bin_transit")), "load_bin_transit"
    )


HISTOGRAM_SQL = """
    SELECT k.y, coalesce(n, 0) AS n
    FROM (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS y) k
    LEFT JOIN (SELECT y, count(*) AS n FROM nodes GROUP BY y) c ON c.y = k.y
"""


@query("class_histogram", "nodes", HISTOGRAM_SQL)
def _(t: Tables):
    return stats.class_histogram(t.nodes)


def split_sql(keys: str, test: int = 2000, validation: int = 1200, seed: int = 42) -> str:
    """SQL for ``hash_split``: two numbers from the MD5 of key and seed."""
    text = f"md5(concat_ws('|', {keys}, '{seed}'))"
    number = "CAST('0x' || substr({t}, {at}, 7) AS BIGINT) % 10000"
    first, second = number.format(t=text, at=1), number.format(t=text, at=8)
    return (
        f"CASE WHEN {first} < {test} THEN 'test' WHEN {second} < {validation} "
        "THEN 'validation' ELSE 'train' END"
    )


SNAP_KEYS_SQL = "CAST(transit_date AS VARCHAR), CAST(direction AS VARCHAR), CAST(slot AS VARCHAR)"


@query(
    "class_percentages",
    "nodes",
    f"""SELECT split, y, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY split), 6) AS pct
        FROM (SELECT {split_sql(SNAP_KEYS_SQL)} AS split, y, count(*) AS n FROM nodes
              GROUP BY 1, 2)""",
)
def _(t: Tables):
    return rounded(stats.class_percentages(hash_split(t.nodes, SNAPSHOT)))


@query(
    "class_weights",
    "nodes",
    """SELECT y, n, round(sum(n) OVER () / n, 6) AS weight
       FROM (SELECT y, count(*) AS n FROM nodes GROUP BY y)""",
)
def _(t: Tables):
    return rounded(stats.class_weights(t.nodes))


@query(
    "null_audit",
    "visits raw",
    """SELECT v.route_id, count(*) FILTER (map_latitude IS NULL) AS null_latitude,
              count(*) FILTER (map_longitude IS NULL) AS null_longitude,
              count(*) FILTER (scheduled_time IS NULL) AS null_delay
       FROM visits v LEFT JOIN raw r ON v.route_id = r.route_id
        AND v.transit_date = r.transit_date AND v.trip_id = r.trip_id
        AND v.route_direction_name = r.route_direction_name AND v.block_abbr = r.block_abbr
        AND v.pattern_num = r.pattern_num AND v.stop_sequence = r.stop_sequence
       GROUP BY v.route_id
       HAVING count(*) FILTER (map_latitude IS NULL OR map_longitude IS NULL) > 0""",
)
def _(t: Tables):
    return null_audit(enrich(t.visits, t.raw))


@query(
    "node_features",
    "own_nodes",
    f"""SELECT {SNAP_SQL}, stop_id, {r(*FEATURE_NAMES[:6])}, {", ".join(FEATURE_NAMES[6:])}
        FROM own_nodes""",
)
def _(t: Tables):
    return rounded(node_features(t.outbound))


@query(
    "node_labels",
    "own_nodes",
    f"""SELECT {SNAP_SQL}, stop_id, {bin_sql("top_load", "top_capacity")} AS y
        FROM own_nodes""",
)
def _(t: Tables):
    return node_labels(t.outbound)


@query(
    "stop_positions",
    "prepared",
    """SELECT stop_id,
              round(arg_min(map_longitude, departure_time)
                    FILTER (map_longitude IS NOT NULL), 6) AS map_longitude,
              round(arg_min(map_latitude, departure_time)
                    FILTER (map_latitude IS NOT NULL), 6) AS map_latitude
       FROM prepared WHERE direction = 0 GROUP BY stop_id""",
)
def _(t: Tables):
    order = ["departure_time", "visit_id"]
    return rounded(stats.stop_positions(t.prepared, order, F.col("direction") == 0))


@query(
    "distinct_per_day",
    "visits",
    """SELECT transit_date, count(DISTINCT time_window) AS n_windows
       FROM visits GROUP BY transit_date""",
)
def _(t: Tables):
    return stats.distinct_per_day(t.visits, "time_window", "n_windows")


_MEANS_SQL = ", ".join(f"avg({c}) AS {c}" for c in FEATURE_NAMES)


@query(
    "snapshot_class_mean",
    "nodes",
    f"""SELECT {SNAP_SQL}, y, {r(*FEATURE_NAMES)}
        FROM (SELECT DISTINCT {SNAP_SQL}, y FROM nodes)
        JOIN (SELECT {SNAP_SQL}, {_MEANS_SQL} FROM nodes GROUP BY {SNAP_SQL})
        USING ({SNAP_SQL})""",
)
def _(t: Tables):
    return rounded(snapshot_class_mean(t.nodes))


@query(
    "snapshot_class_mean_per_class",
    "nodes",
    f"""SELECT {SNAP_SQL}, y, {r(*FEATURE_NAMES)}
        FROM (SELECT {SNAP_SQL}, y, {_MEANS_SQL} FROM nodes GROUP BY {SNAP_SQL}, y)""",
)
def _(t: Tables):
    return rounded(snapshot_class_mean(t.nodes, "per_class"))


GRID_SQL = """
    (SELECT a.y AS ytrue, b.y AS ypred
     FROM (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS y) a
     CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS y) b)
"""
CONFUSION_SQL = f"""
    SELECT g.ytrue, g.ypred, coalesce(n, 0) AS n FROM {GRID_SQL} g LEFT JOIN (
      SELECT ytrue, ypred, count(*) AS n FROM preds GROUP BY ytrue, ypred) c
    ON c.ytrue = g.ytrue AND c.ypred = g.ypred
"""


@query("confusion_matrix", "preds", CONFUSION_SQL)
def _(t: Tables):
    return metrics.confusion(t.preds)


@query(
    "confusion_row_pct",
    "preds",
    f"""SELECT ytrue, ypred, n,
               round(n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY ytrue), 0), 6) AS pct
        FROM ({CONFUSION_SQL})""",
)
def _(t: Tables):
    return rounded(metrics.confusion_row_pct(t.preds))


@query(
    "accuracy",
    "preds",
    "SELECT round(avg(CASE WHEN ytrue = ypred THEN 1 ELSE 0 END), 6) AS accuracy FROM preds",
)
def _(t: Tables):
    return rounded(metrics.accuracy(t.preds))


def prf_sql(source: str) -> str:
    """Support-weighted precision, recall and F1."""
    return f"""
    SELECT round(sum(support * coalesce(hit / nullif(predicted, 0), 0)) / sum(support), 6)
             AS precision,
           round(sum(support * coalesce(hit / nullif(support, 0), 0)) / sum(support), 6)
             AS recall,
           round(sum(support * coalesce(2 * hit / nullif(support + predicted, 0), 0))
                 / sum(support), 6) AS f1
    FROM (
      SELECT k.y, count(*) FILTER (p.ytrue = k.y) AS support,
             count(*) FILTER (p.ypred = k.y) AS predicted,
             count(*) FILTER (p.ytrue = k.y AND p.ypred = k.y) AS hit
      FROM {source} p CROSS JOIN (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS y) k
      GROUP BY k.y)
    """


@query("precision_recall_f1_weighted", "preds", prf_sql("preds"))
def _(t: Tables):
    return rounded(metrics.prf_weighted(t.preds))


@query(
    "ordinal_accuracy",
    "preds",
    "SELECT round(avg(1 - abs(ytrue - ypred) / 4), 6) AS ordinal_accuracy FROM preds",
)
def _(t: Tables):
    return rounded(metrics.ordinal_accuracy(t.preds, 4))


@query(
    "metrics_excluding_class",
    "preds",
    f"""SELECT accuracy, precision, recall, f1, ordinal_accuracy
        FROM ({prf_sql("(SELECT * FROM preds WHERE ytrue <> 3)")})
        CROSS JOIN (SELECT round(avg(CASE WHEN ytrue = ypred THEN 1 ELSE 0 END), 6) AS accuracy,
                           round(avg(1 - abs(ytrue - ypred) / 5), 6) AS ordinal_accuracy
                    FROM preds WHERE ytrue <> 3)""",
)
def _(t: Tables):
    return rounded(metrics.report(metrics.excluding_class(t.preds, 3), k=5))


@query(
    "focal_loss_mean",
    "scored",
    """SELECT round(avg(loss), 6) AS focal_loss FROM (
         SELECT l_orderkey, avg(w.weight * pow(1 - exp(lp), 2) * -lp) AS loss
         FROM (SELECT *, scores[y + 1] - ln(exp(scores[1]) + exp(scores[2]) + exp(scores[3])
                      + exp(scores[4])) AS lp FROM scored) s
         JOIN (SELECT y, sum(n) OVER () / n AS weight
               FROM (SELECT y, count(*) AS n FROM scored GROUP BY y)) w ON w.y = s.y
         GROUP BY l_orderkey)""",
)
def _(t: Tables):
    total = F.ln(F.aggregate(F.transform("scores", F.exp), F.lit(0.0), lambda a, x: a + x))
    log_probs = F.transform("scores", lambda s: s - total)
    scored = t.scored.withColumn("log_probs", log_probs)
    weights = stats.class_weights(t.scored)
    return rounded(metrics.focal_loss(scored, weights, ["l_orderkey"]))


@query(
    "snapshot_size_check",
    "nodes",
    f"""SELECT {SNAP_SQL}, count(*) AS n_nodes FROM nodes GROUP BY {SNAP_SQL}
        HAVING count(*) <> 60""",
)
def _(t: Tables):
    return snapshot_size_check(t.nodes, 60)


@query(
    "scored_accuracy",
    "scored",
    """SELECT round(avg(CASE WHEN list_position(scores, list_max(scores)) - 1 = y
                             THEN 1 ELSE 0 END), 6) AS accuracy FROM scored""",
)
def _(t: Tables):
    preds = t.scored.select(F.col("y").alias("ytrue"), argmax_class("scores").alias("ypred"))
    return rounded(metrics.accuracy(preds))
