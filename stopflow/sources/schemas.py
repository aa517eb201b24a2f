"""Declared schemas of the stored tables, as DDL."""

VISITS = """
    route_id INT, transit_date DATE, trip_id INT, block_abbr INT, pattern_num INT,
    route_direction_name STRING, stop_sequence INT, stop_id INT,
    departure_time TIMESTAMP_NTZ, year INT, month INT, day INT, hour INT, dayofweek INT,
    time_window INT, is_holiday BOOLEAN, vehicle_capacity DOUBLE, y_reg100 DOUBLE, icon STRING
"""

RAW_COUNTS = """
    route_id INT, transit_date DATE, route_direction_name STRING, trip_id INT,
    block_abbr INT, pattern_num INT, stop_sequence INT,
    arrival_time TIMESTAMP_NTZ, scheduled_time TIMESTAMP_NTZ,
    map_latitude DOUBLE, map_longitude DOUBLE, sched_hdwy DOUBLE, actual_hdwy DOUBLE
"""

TRAFFIC = """
    xd_id INT, average_speed DOUBLE, reference_speed DOUBLE, congestion DOUBLE,
    extreme_congestion DOUBLE, county STRING, measurement_tstamp TIMESTAMP_NTZ,
    year INT, month INT
"""

WEATHER = """
    time BIGINT, precipitation_intensity DOUBLE, temperature DOUBLE, humidity DOUBLE
"""

TRACT_ATTRIBUTES = """
    GEOID STRING, NAME STRING, no_public_transport_for_work DOUBLE,
    total_surveyed_public_transportation_for_work DOUBLE, median_income_last12months DOUBLE,
    white_pct DOUBLE, black_pct DOUBLE, hispanic_pct DOUBLE, public_transit_pct DOUBLE
"""

SEGMENT_ATTRIBUTES = """
    XDSegID STRING, StartLat DOUBLE, StartLong DOUBLE, EndLat DOUBLE, EndLong DOUBLE
"""

PREDICTIONS = "ytrue INT, ypred INT"

HISTORY = """
    epoch INT, train_acc DOUBLE, validation_acc DOUBLE, train_loss DOUBLE,
    validation_loss DOUBLE, test_acc_with_4th_bin DOUBLE
"""
