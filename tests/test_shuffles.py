"""What follows by trip stays in the partitions of one shuffle."""

import datetime as dt

from roadpulse.operators import demand, matching, places


def network(spark):
    nodes = spark.createDataFrame([(k, 15.0 + 0.01 * k, 37.5) for k in range(3)], "node long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 880), (1, 0, 880), (1, 2, 880), (2, 1, 880)], "u long, v long, length long")
    return nodes, edges


def fixes(spark):
    start = dt.datetime(2019, 2, 1)
    rows = [("a", k, start + dt.timedelta(seconds=60 * k), 15.001 + 0.005 * k, 37.50001, 440 * k) for k in range(4)]
    return spark.createDataFrame(rows, "TRIP_ID string, id long, timedate timestamp_ntz, longitude double, latitude double, progressive long")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_candidates_and_their_spread_take_one_shuffle(spark):
    nodes, edges = network(spark)
    found = matching.candidates(fixes(spark), edges, nodes, radius_m=30.0)
    assert exchanges(matching.sigma_z(matching.drop_ambiguous(found))) == 1
    assert sorted((r.id, r.u, r.v) for r in found.collect()) == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 0), (2, 1, 2), (2, 2, 1), (3, 1, 2), (3, 2, 1)]


def test_steps_take_no_shuffle_after_their_candidates(spark):
    nodes, edges = network(spark)
    out = matching.steps(matching.candidates(fixes(spark), edges, nodes, radius_m=30.0), edges, 20.0)
    assert exchanges(out) == 0
    # of four pairs a step, those that no route within the odometer joins are left out
    assert sorted((r.id, r.u, r.v, r.from_u, r.from_v) for r in out.collect()) == [(1, 0, 1, 0, 1), (2, 1, 2, 0, 1), (3, 1, 2, 1, 2)]


def test_candidates_of_equal_fixes_count_once(spark):
    nodes, edges = network(spark)
    twice = fixes(spark).unionByName(fixes(spark))
    assert matching.candidates(twice, edges, nodes, radius_m=30.0).count() == 8


def test_quarters_of_paths_take_no_shuffle_after_the_paths(spark):
    start = dt.datetime(2019, 2, 1)
    trav = spark.createDataFrame([(0, 1, start), (0, 1, start), (1, 2, start), (1, 2, start + dt.timedelta(minutes=20))], "u long, v long, timedate timestamp_ntz")
    paths = spark.createDataFrame([(0, 2, 0, 1), (0, 2, 1, 2)], "origin long, destination long, u long, v long")
    out = demand.travel_demand_15min(paths, trav)
    assert exchanges(out) == 1
    assert [tuple(r) for r in out.collect()] == [(0, 2, 5.0)]  # quarters of 1.5 and 1 records an edge


def test_boxes_bring_their_weights(spark):
    points = spark.createDataFrame([(1, 7, 15.0, 37.5, 3), (2, 7, 15.001, 37.501, 4), (3, 7, 16.0, 37.5, 5)], "id long, idterm long, lon double, lat double, weight long")
    out = places._boxed(points, 0.0065, 0.0045)
    assert sorted((r.a, r.b, r.weight) for r in out.collect()) == [(1, 1, 3), (1, 2, 4), (2, 1, 3), (2, 2, 4), (3, 3, 5)]


def test_trips_without_gaps_take_no_shuffle_after_their_legs(spark):
    """A gap, a null and an edge driven twice; trips without the first two are ready when their legs are written."""
    nodes, edges = network(spark)
    start = dt.datetime(2019, 2, 1)
    rows = [("a", 0, 0, 1, 5), ("a", 1, 1, 2, 6), ("a", 2, 2, 1, 7), ("a", 3, 1, 2, 8), ("b", 0, 0, 1, 5), ("b", 1, 2, 1, 6), ("c", 0, 0, 1, 7), ("c", 1, 1, 2, None)]
    matched = spark.createDataFrame([(t, k, u, v, start, s) for t, k, u, v, s in rows], "TRIP_ID string, sequenza int, u long, v long, timedate timestamp_ntz, mean_speed long")
    whole, mended = matching._route(matched, edges, "length", 2, ["mean_speed"])
    assert exchanges(whole) == 0
    assert sorted(tuple(r) for r in whole.collect()) == [("a", 0, 1, 1, 5), ("a", 1, 2, 2, 6), ("a", 2, 1, 3, 7)]
    assert sorted(tuple(r) for r in mended.collect() if r.TRIP_ID == "b") == [("b", 0, 1, 1, 5), ("b", 1, 2, 2, None), ("b", 2, 1, 3, 6)]
    assert sorted((r.u, r.v, r.order) for r in mended.collect() if r.TRIP_ID == "c") == [(0, 1, 1), (1, 2, 2)]


def test_stretches_take_one_shuffle(spark):
    start = dt.datetime(2019, 2, 1)
    matched = spark.createDataFrame([("a", k, start + dt.timedelta(seconds=60 * k), u, u + 1) for k, u in ((0, 0), (1, 0), (2, 1))], "TRIP_ID string, id long, timedate timestamp_ntz, u long, v long")
    own = spark.createDataFrame([("a", k, 600 * k, 40) for k in range(4)], "TRIP_ID string, id long, progressive long, speed long")
    out = matching.stretches(matched, own)
    assert exchanges(out) == 1
    want = [("a", 0, 0, 1, 0, 36), ("a", 1, 1, 2, 2, 40)]
    for found in (out, matching.stretches(matched, own.drop("TRIP_ID"))):
        assert sorted((r.TRIP_ID, r.sequenza, r.u, r.v, r.idtrace, r.mean_speed) for r in found.collect()) == want
