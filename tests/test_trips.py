import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import cleaning, trips

FIX = "id long, idterm long, timedate timestamp_ntz, longitude double, latitude double, speed long, grade long, panel int, vehtype int, progressive long"


def fixes(spark, rows):
    """(seconds, panel, progressive[, speed[, lon]]) of vehicle 1 as fixes."""
    start = dt.datetime(2019, 2, 1)
    full = []
    for k, r in enumerate(rows):
        s, panel, odo, speed, lon = (*r, *(50, 15.0 + 0.001 * k)[len(r) - 3 :]) if len(r) < 5 else r
        full.append((k, 1, start + dt.timedelta(seconds=s), lon, 37.5, speed, 1, panel, 1, odo))
    return spark.createDataFrame(full, FIX)


def test_gap_splits_at_exactly_the_gap(spark):
    df = fixes(spark, [(0, 1, 0), (599, 1, 10), (1199, 1, 20), (1200, 1, 30)])
    assert [r.trip_no for r in trips.split_trips_gap(df, 600).orderBy("id").collect()] == [0, 0, 1, 1]


def test_engine_split_needs_engine_off(spark):
    df = fixes(spark, [(0, 1, 0), (200, 1, 10), (400, 0, 20), (600, 1, 30)])
    assert [r.trip_no for r in trips.split_trips_engine(df, 180).orderBy("id").collect()] == [0, 0, 1, 2]


def test_panel_machine(spark):
    df = fixes(spark, [(0, 0, 0), (10, 1, 10), (20, 2, 20), (30, 2, 30), (40, 1, 40), (5000, 1, 50), (5010, 1, 20000)])
    assert [r.trip_no for r in trips.split_trips_panel(df).orderBy("id").collect()] == [1, 1, 1, 2, 3, 4, 5]


def test_ids_and_route(spark):
    df = fixes(spark, [(0, 1, 0), (60, 1, 500), (120, 0, 900), (1000, 1, 900), (1100, 0, 2000)])
    clean = trips.anomaly_codes(trips.assign_trip_ids(trips.split_trips_gap(df, 600)))
    rows = clean.orderBy("id").collect()
    assert [r.TRIP_ID for r in rows] == ["1_0"] * 3 + ["1_1"] * 2 and [r.segment for r in rows] == [0, 1, 2, 0, 1]
    assert [r.anomaly[0] for r in rows] == ["S", "I", "E", "S", "E"] and all(len(r.anomaly) == 7 for r in rows)
    (route,) = trips.route_summary(clean).collect()
    assert (route.idtrace_o, route.idtrace_d, route.tripdistance_m, route.triptime_s, route.breaktime_s, len(route.path)) == (0, 2, 900, 120, 880, 3)


def test_odometer_resets_join_trips(spark):
    df = fixes(spark, [(0, 1, 0), (1000, 1, 500), (2000, 1, 10), (3000, 1, 20)])
    out = trips.concat_trips_odometer(trips.assign_trip_ids(trips.split_trips_gap(df, 600))).orderBy("id").collect()
    assert [r.TRIP_ID for r in out] == ["1_conc_0", "1_conc_0", "1_2", "1_3"]


def test_fill_gaps_and_row_ids(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 4.0), (1, 3, None), (1, 4, 8.0), (1, 5, None)], "k int, t int, x double")
    assert [r.x for r in cleaning.fill_gaps(df, ["k"], ["t"], ["x"]).orderBy("t").collect()] == [4.0, 4.0, 4.0, 8.0, 8.0]
    assert [r.x for r in cleaning.fill_gaps(df, ["k"], ["t"], ["x"], "mean").orderBy("t").collect()] == [4.0, 4.0, 6.0, 8.0, 8.0]
    ids = cleaning.add_row_id(spark.range(1000).repartition(7), ["id"]).collect()
    assert all(r.row_id == r.id + 1 for r in ids)


def test_clip(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 0.0, 9.0), (4, 10.0, 9.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (3, 4), (1, 4)], "u long, v long")
    out = {(r.u, r.v): r.inside for r in cleaning.clip_rect(edges, nodes, 2.0, 7.0, -1.0, 5.0).collect()}
    assert out[1, 2] == 0.5 and (3, 4) not in out and out[1, 4] == pytest.approx(5 / 9 - 0.2, abs=1e-6)


def test_empty_inputs(spark):
    empty = fixes(spark, []).where(F.lit(False))
    assert trips.route_summary(trips.anomaly_codes(trips.assign_trip_ids(trips.split_trips_gap(empty)))).collect() == []


def test_trip_flags_and_table(spark):
    df = fixes(spark, [(0, 1, 0), (60, 1, 500), (120, 0, 900), (2000, 1, 900), (2060, 0, 2000), (9000, 1, 2000), (9060, 1, 3000), (9100, 1, 4000)])
    flagged = trips.trip_flags(df)
    assert [r.flag for r in flagged.orderBy("id").collect()] == [10, 0, 20, 10, 20, 10, 0, 20]
    out = trips.trip_table(flagged).orderBy("start").collect()
    assert [(r.trip_id, r.km) for r in out] == [("1_1", 0.9), ("1_2", 1.1), ("1_3", 2.0)]
    assert out[0].stop_h == out[1].stop_before_h and out[2].stop_h is None


def test_trip_flags_sum_whole_metres(spark):
    """A trip of 9 and 1 metres is exactly as long as the least, not shorter."""
    df = fixes(spark, [(0, 1, 0), (60, 1, 9), (120, 1, 10), (180, 0, 10)])
    assert [r.flag for r in trips.trip_flags(df).orderBy("id").collect()] == [10, 0, 0, 20]
    shorter = fixes(spark, [(0, 1, 0), (60, 1, 8), (120, 1, 9), (180, 0, 9)])
    assert [r.flag for r in trips.trip_flags(shorter).orderBy("id").collect()] == [5, 0, 0, 5]
