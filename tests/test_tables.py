"""Cleaning, scaling, encoding, counts, splits, metrics and readers."""

import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stopflow.operators import metrics, splits, stats
from stopflow.operators.cleaning import (
    dedupe_first,
    drop_nulls,
    fill_constant,
    nan_to_null,
    null_audit,
)
from stopflow.operators.enrich import (
    enrich,
    join_traffic,
    join_weather,
    traffic_slots,
    weather_hourly_mean,
)
from stopflow.operators.periods import with_period
from stopflow.operators.scaling import apply_minmax, fit_minmax, label_encode, minmax
from stopflow.operators.splits import (
    best_epoch,
    exact_split,
    hash_split,
    ordered_split,
    stratified_fold,
)
from stopflow.sources import readers, writers


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_minmax(spark):
    df = spark.createDataFrame(
        [(0, 2.0, 3.0), (1, 4.0, 3.0), (2, 6.0, 3.0), (3, None, None)], "i int, a double, b double"
    )
    out = minmax(df, ["a", "b"])
    assert column(out, "a", "i") == [0.0, 0.5, 1.0, None]
    assert column(out, "b", "i") == [0.0, 0.0, 0.0, None]


def test_minmax_fit_before_fill_may_leave_range(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 4.0), (2, None)], "i int, a double")
    bounds = fit_minmax(df, ["a"])
    out = apply_minmax(fill_constant(df, {"a": 0}), bounds, ["a"])
    assert column(out, "a", "i") == [0.0, 1.0, -1.0]


def test_label_encode_numeric_order(spark, small_limits):
    df = spark.createDataFrame(
        [(0, 10, "b"), (1, 2, "a"), (2, 10, "b"), (3, 7, None)], "i int, a int, s string"
    )
    out = label_encode(df, ["a", "s"])
    assert column(out, "a_cat", "i") == [2, 0, 2, 1]
    assert column(out, "s_cat", "i") == [1, 0, 1, None]


def test_dedupe_first_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 5, float("nan")), (1, 3, 2.0), (2, 1, None)], "k int, o int, v double"
    )
    first = dedupe_first(df, ["k"], ["o"])
    assert column(first, "o", "k") == [3, 1]
    assert column(nan_to_null(df), "v", "k", "o") == [2.0, None, None]
    assert drop_nulls(nan_to_null(df), ["v"]).count() == 1


def test_dedupe_limits_copies_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    plan = dedupe_first(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_null_audit_only_lists_routes_with_gaps(spark):
    rows = [(1, 1.0, None, 3), (1, None, 1.0, None), (2, 1.0, 1.0, None)]
    df = spark.createDataFrame(
        rows, "route_id int, map_latitude double, map_longitude double, delay int"
    )
    assert [tuple(r) for r in null_audit(df).collect()] == [(1, 1, 1, 1)]


def test_raw_join_matches_missing_keys_and_fans_out(spark):
    keys = "route_id int, transit_date date, route_direction_name string, trip_id int, "
    keys += "block_abbr int, pattern_num int, stop_sequence int"
    visits = spark.createDataFrame(
        [(1, None, "TO", 1, 1, 1, 1), (1, None, "TO", 1, 1, 1, 2), (2, None, "TO", 1, 1, 1, 9)],
        keys,
    )
    at = datetime(2024, 1, 1, 8)
    raw = spark.createDataFrame(
        [
            (1, None, "TO", 1, 1, 1, 1, at, at, 1.0, 1.0, 1.0, 1.0),
            (1, None, "TO", 1, 1, 1, 1, at, None, 2.0, 1.0, 1.0, 1.0),
            (1, None, "TO", 1, 1, 1, 2, at, at, 3.0, 1.0, 1.0, 1.0),
        ],
        keys + ", arrival_time timestamp_ntz, scheduled_time timestamp_ntz, map_latitude double,"
        " map_longitude double, sched_hdwy double, actual_hdwy double",
    )
    out = enrich(visits, raw)
    rows = sorted(
        (r["stop_sequence"], r["map_latitude"], r["delay"])
        for r in out.collect()
        if r["map_latitude"]
    )
    assert rows == [(1, 1.0, 0), (1, 2.0, None), (2, 3.0, 0)]
    assert out.count() == 4


def test_traffic_and_weather(spark):
    readings = spark.createDataFrame(
        [
            (5, 30.0, 40.0, 0.1, 0.2, "davidson", datetime(2024, 1, 1, 8, 2), 2024, 1),
            (5, 10.0, 40.0, 0.1, 0.2, "davidson", datetime(2024, 1, 1, 8, 1), 2024, 1),
            (5, 99.0, 40.0, 0.1, 0.2, "other", datetime(2024, 1, 1, 8, 0), 2024, 1),
        ],
        "xd_id int, average_speed double, reference_speed double, congestion double, "
        "extreme_congestion double, county string, measurement_tstamp timestamp_ntz, year int, "
        "month int",
    )
    slots = traffic_slots(readings)
    visits = spark.createDataFrame(
        [(1, 2024, 1, 1, 8, 96, 5), (2, 2024, 1, 1, 9, 96, None)],
        "id int, year int, month int, day int, hour int, time_window_5_mins int, XDSegID int",
    )
    joined = join_traffic(visits, slots)
    assert column(joined, "average_speed", "id") == [10.0, None]
    weather = spark.createDataFrame(
        [(1704114000 + s, p, 50.0, 0.5) for s, p in [(0, 0.1), (60, 0.3), (7200, 0.9)]],
        "time long, precipitation_intensity double, temperature double, humidity double",
    )
    hourly = weather_hourly_mean(weather)
    both = join_weather(visits, hourly)
    assert column(both, "precipitation_intensity", "id") == [pytest.approx(0.2), None]


def test_small_groups(spark):
    rows = [(1, k) for k in [1] * 4 + [2] * 3 + [None]]
    df = spark.createDataFrame(rows, "x int, k int")
    flagged = stats.flag_small_groups(df, ["k"], 4)
    assert sorted((r["k"], r["remove_trip_condn"]) for r in flagged.collect()) == (
        [(1, False)] * 4 + [(2, True)] * 3
    )
    assert stats.any_small_group(df, ["k"], 4).first()[0]
    assert not stats.any_small_group(df.where("k = 1"), ["k"], 4).first()[0]


def test_class_weights_and_histogram(spark):
    nodes = spark.createDataFrame([(0,), (0,), (1,), (2,)], "y int")
    assert column(stats.class_weights(nodes), "weight", "y") == [2.0, 4.0, 4.0]
    assert column(stats.class_histogram(nodes), "n", "y") == [2, 1, 1, 0, 0]


PREDS = [(0, 0), (1, 2), (2, 2), (3, 0)]


def test_metrics(spark):
    preds = spark.createDataFrame(PREDS, "ytrue int, ypred int")
    assert metrics.accuracy(preds).first()[0] == 0.5
    scores = metrics.prf_weighted(preds).first()
    assert [round(x, 6) for x in scores] == [0.25, 0.5, 0.333333]
    assert metrics.ordinal_accuracy(preds, 4).first()[0] == 0.75
    whole = metrics.report(preds, 4).first()
    assert whole["accuracy"] == 0.5 and whole["ordinal_accuracy"] == 0.75
    assert round(whole["f1"], 6) == 0.333333
    matrix = metrics.confusion(preds)
    assert matrix.count() == 16 and matrix.agg(F.sum("n")).first()[0] == 4
    pct = metrics.confusion_row_pct(preds.where("ytrue < 3"))
    assert {r["pct"] for r in pct.where("ytrue = 3").collect()} == {None}
    assert metrics.excluding_class(preds, 3).count() == 3


def test_recall_equals_accuracy(spark):
    rows = [(i % 4, (i * 7 + i // 3) % 4) for i in range(97)]
    preds = spark.createDataFrame(rows, "ytrue int, ypred int")
    whole = metrics.report(preds, 4).first()
    assert whole["recall"] == pytest.approx(whole["accuracy"])


def test_focal_loss(spark):
    scored = spark.createDataFrame(
        [(1, 1, [-5.0, -0.6931471805599453])], "s int, y int, log_probs array<double>"
    )
    weights = spark.createDataFrame([(1, 2.0)], "y int, weight double")
    got = metrics.focal_loss(scored, weights, ["s"]).first()[0]
    assert got == pytest.approx(0.346574, abs=1e-6)


@pytest.mark.parametrize("limits", ["default", "small"])
def test_ordered_split(request, spark, limits):
    if limits == "small":
        request.getfixturevalue("small_limits")
    df = spark.range(100).withColumnRenamed("id", "i").repartition(6)
    got = {}
    for r in ordered_split(df, ["i"]).collect():
        got.setdefault(r["split"], []).append(r["i"])
    assert sorted(got["train"]) == list(range(70))
    assert sorted(got["validation"]) == list(range(71, 80))
    assert sorted(got["test"]) == list(range(81, 100))


@pytest.mark.parametrize("limits", ["default", "small"])
def test_stratified_fold(request, spark, limits):
    if limits == "small":
        request.getfixturevalue("small_limits")
    df = spark.createDataFrame([(i, 0 if i < 7 else 1) for i in range(11)], "i int, y int")
    test = stratified_fold(df, "y", ["i"]).where("is_test").collect()
    assert sorted(r["i"] for r in test) == [0, 1, 7]
    many = spark.createDataFrame([(i, i % 3) for i in range(200)], "i int, y int").repartition(5)
    got = sorted(r["i"] for r in stratified_fold(many, "y", ["i"]).where("is_test").collect())
    assert got == [i for i in range(200) if i // 3 < (14 if i % 3 == 0 else 13)]


def test_hash_split_is_stable_and_whole(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    a = {(r["k"], r["split"]) for r in hash_split(df.repartition(1), ["k"]).collect()}
    b = {(r["k"], r["split"]) for r in hash_split(df.repartition(16), ["k"]).collect()}
    assert a == b and len(a) == 1000
    share = sum(1 for _, s in a if s == "test") / 1000
    assert 0.15 < share < 0.25


def test_best_epoch_last_on_ties(spark):
    rows = [(1, i, loss) for i, loss in enumerate([3.0, 2.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "run int, epoch int, validation_loss double")
    assert best_epoch(df).first()["epoch"] == 2
    assert [r["epoch"] for r in best_epoch(df, per=["run"]).collect()] == [2]


def test_stop_positions_skip_missing(spark):
    rows = [(1, 1, None, 5.0), (1, 2, 7.0, 6.0), (2, 1, None, None)]
    df = spark.createDataFrame(
        rows, "stop_id int, o int, map_longitude double, map_latitude double"
    )
    got = stats.stop_positions(df, ["o"]).orderBy("stop_id").collect()
    assert [tuple(r) for r in got] == [(1, 7.0, 5.0), (2, None, None)]


def test_csv_with_unnamed_index(spark, tmp_path):
    path = tmp_path / "preds.csv"
    path.write_text(",ytrue,ypred\n0,1,2\n1,0,0\n")
    got = readers.read_predictions(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 2)]
    out = str(tmp_path / "out")
    writers.write_csv(got, out)
    back = readers.read_predictions(spark, out, index_col=False)
    assert sorted(map(tuple, back.collect())) == [(0, 0), (1, 2)]


def test_weather_array_file(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text('[\n {"time": 1, "temperature": 2.5, "humidity": 0.5},\n {"time": 2}\n]')
    got = readers.read_weather(spark, str(path), multi_line=True).orderBy("time").collect()
    assert [tuple(r) for r in got] == [(1, None, 2.5, 0.5), (2, None, None, None)]


def test_routes_are_pruned(spark, tmp_path):
    path = str(tmp_path / "routes")
    df = spark.range(100).select((F.col("id") % 5).cast("int").alias("route_id"), "id")
    writers.write_by_route(df, path)
    got = readers.read_routes(spark, path, [2, 3], schema="id LONG, route_id INT")
    assert got.count() == 40
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(route_id" in plan or "route_id" in plan.split(
        "PartitionFilters"
    )[1][:80]


@pytest.mark.parametrize("n", [0, 1, 10, 101, 10_007])
def test_exact_split(spark, monkeypatch, n):
    # Small ranges, so that the larger tables take several passes.
    monkeypatch.setattr(splits, "COUNT_RANGES", 16)
    monkeypatch.setattr(splits, "FEW_HASHES", 40)
    df = spark.range(n).select(
        F.when(F.col("id") != 3, F.col("id")).alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")
    )
    got = [
        {(r["k"], r["copy"]): r["split"] for r in exact_split(df.repartition(p), ["k"]).collect()}
        for p in (1, 16)
    ]
    assert got[0] == got[1] and len(got[0]) == 2 * n
    assert all(v == got[0][k, 3 - c] for (k, c), v in got[0].items())
    tests = math.ceil(n * 0.2)
    validations = math.ceil((n - tests) * 0.12)
    counts = Counter(got[0].values())
    want = {"test": 2 * tests, "validation": 2 * validations, "train": 2 * (n - tests - validations)}
    assert counts == {k: v for k, v in want.items() if v}
    if n == 10_007:
        other = {r["k"]: r["split"] for r in exact_split(df, ["k"], seed=7).collect()}
        assert other != {k: v for (k, _), v in got[0].items()}


def test_with_period_equals_brute_force(spark):
    rng = random.Random(2)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(1500))
    periods = [("zero", None, day()), ("back", date(2021, 5, 2), date(2021, 5, 1)), ("one", date(2021, 3, 31), date(2021, 3, 31))]
    for i in range(300):
        start = day()
        periods.append((f"p{i}", start, start + timedelta(days=rng.choice([0, 3, 40, 700]))))
    periods += [("b", date(2025, 1, 1), date(2025, 1, 9)), ("a", date(2025, 1, 1), date(2025, 1, 9))]
    days = [day() for _ in range(200)] + [None, date(2025, 1, 9), date(1999, 1, 1), date(2021, 3, 31)]
    rows = spark.createDataFrame(list(enumerate(days * 2)), "id int, day date").withColumn("period", F.lit("old"))
    table = spark.createDataFrame(periods, "period string, start_date date, end_date date")
    joined = with_period(rows, table, "day")
    got = {r.id: r.period for r in joined.collect()}
    for i, d in enumerate(days * 2):
        held = [p for p in periods if d and p[1] and p[1] <= d <= p[2]]
        best = min(held, key=lambda p: (-p[1].toordinal(), p[2], p[0]), default=(None,))
        assert got[i] == best[0]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert joined.columns == ["id", "day", "period"]
