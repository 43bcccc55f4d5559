import pytest
from pyspark.sql import functions as F

from roadpulse.operators import demand, network


def graph(spark, pairs):
    return spark.createDataFrame([(u, v, 0, float(w)) for u, v, w in pairs], "u long, v long, key int, length double")


def both(pairs):
    return [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]


def test_paths_take_the_shorter_way(spark):
    edges = graph(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 5), (3, 4, 1)])
    origin = spark.createDataFrame([(1,)], "origin long")
    best = network.shortest_paths(edges, origin)
    assert {r.node: r.dist for r in best.collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    od = spark.createDataFrame([(1, 4)], "origin long, destination long")
    assert [(r.u, r.v) for r in network.path_edges(best, od).orderBy(F.desc("back")).collect()] == [(1, 2), (2, 3), (3, 4)]


def test_closed_forms(spark):
    path5 = graph(spark, both([(k, k + 1, 1) for k in range(1, 5)]))
    out = {r.node: r.betweenness for r in network.betweenness_nodes(path5, normalized=False).collect()}
    assert out == {1: 0, 2: 6, 3: 8, 4: 6, 5: 0}
    star5 = graph(spark, both([(1, k, 1) for k in range(2, 6)]))
    assert {r.node: r.betweenness for r in network.betweenness_nodes(star5).collect()} == {1: 1.0, 2: 0, 3: 0, 4: 0, 5: 0}
    close = {r.node: r.closeness for r in network.closeness(star5).collect()}
    assert close[1] == 1.0 and close[2] == pytest.approx(4 / 7)


def test_equal_paths_share(spark):
    diamond = graph(spark, [(1, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 1)])
    out = {r.node: r.betweenness for r in network.betweenness_nodes(diamond, normalized=False).collect()}
    assert out[2] == out[3] == 0.5
    edges = {(r.u, r.v): r.betweenness for r in network.betweenness_edges(diamond, normalized=False).collect()}
    assert edges[1, 2] == 1.5 and edges[2, 4] == 1.5


def test_delay_formula(spark):
    row = spark.range(1).select(demand.delay(F.lit(10.0), F.lit(1.0), 5.0).alias("a"), demand.delay(F.lit(10.0), F.lit(6.0), 5.0).alias("b")).first()
    assert (row.a, row.b) == (45.0, 125.0)


def test_closure_impact(spark):
    edges = graph(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 3)]).withColumn("cost", F.col("length") * 3600)
    cells = spark.createDataFrame([(7, 1, 2), (8, 1, 3)], "cell long, u long, v long")
    od = spark.createDataFrame([(1, 3)], "origin long, destination long")
    need = spark.createDataFrame([(1, 3, 10.0)], "origin long, destination long, demand double")
    (r,) = demand.closure_impact(cells, od, edges, need).collect()
    assert (r.cell, r.dt, r.delay) == (7, 1.0, 45.0)


def test_edge_cost_reads_lists(spark):
    edges = spark.createDataFrame([(1, 2, 1000.0, ["motorway", "x"], ["100", "80"]), (2, 3, 1000.0, ["path"], ["50"]), (3, 4, 1000.0, ["trunk"], None)], "u long, v long, length double, highway array<string>, maxspeed array<string>")
    out = [r.cost for r in network.edge_cost(edges).orderBy("u").collect()]
    assert out == pytest.approx([40.0, 120.0, 3600 / 70])


def test_nearest_and_hexes(spark):
    nodes = spark.createDataFrame([(1, 14.90, 37.45), (2, 14.91, 37.45), (3, 14.90, 37.46)], "node long, x double, y double")
    points = spark.createDataFrame([(9, 14.9045, 37.45)], "id long, x double, y double")
    assert network.nearest_node(points, nodes).first().node == 1
    far = spark.createDataFrame([(1, 0.0395, 0.0395), (2, -0.0205, 0.0)], "node long, x double, y double")
    assert network.nearest_node(spark.createDataFrame([(9, 0.0, 0.0)], "id long, x double, y double"), far).first().node == 2
    cells = network.cell_edges(network.hex_grid(nodes), spark.createDataFrame([(1, 2), (1, 3)], "u long, v long"), nodes)
    assert cells.select("u", "v").distinct().count() == 2


def test_matched_route_closes_gaps(spark):
    from roadpulse.operators import matching

    edges = graph(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (2, 4, 5)])
    matched = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 3, 4), ("b", 0, 1, 2)], "TRIP_ID string, sequenza int, u long, v long")
    out = matching.matched_route(matched, edges).orderBy("TRIP_ID", "order").collect()
    assert [(r.TRIP_ID, r.u, r.v) for r in out] == [("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("b", 1, 2)]


def test_nearest_against_brute_force(spark):
    import math
    import random

    r = random.Random(8)
    nodes = [(k, 14.9 + r.random() * 0.3, 37.4 + r.random() * 0.2) for k in range(40)]
    points = [(k, 14.5 + r.random() * 1.2, 37.1 + r.random() * 0.9) for k in range(150)] + [(200, 100.0, -60.0), (201, None, 1.0)]
    edges = [(a, (a * 7 + 3) % 40) for a in range(40)]
    at = {k: (x, y) for k, x, y in nodes}

    def sphere(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))

    def plane(p, a, b):
        k = math.cos(math.radians(p[1]))
        ax, ay, bx, by = (p[0] - a[0]) * k, p[1] - a[1], (b[0] - a[0]) * k, b[1] - a[1]
        t = max(0, min(1, (ax * bx + ay * by) / (bx * bx + by * by) if bx or by else 0))
        return math.hypot(ax - t * bx, ay - t * by) * 111195

    n, p = spark.createDataFrame(nodes, "node long, x double, y double"), spark.createDataFrame(points, "id long, x double, y double")
    out = {x.id: x for x in network.nearest_node(p, n).collect()}
    assert set(out) == {k for k, x, _ in points if x is not None}
    for k, x, y in points[:-1]:
        assert out[k].m == pytest.approx(min(sphere((x, y), b) for b in at.values()), abs=0.01)
    out = {x.id: x for x in network.nearest_edge(p, spark.createDataFrame(edges, "u long, v long"), n).collect()}
    for k, x, y in points[:-1]:
        assert out[k].m == pytest.approx(min(plane((x, y), at[a], at[b]) for a, b in edges), abs=0.01)
        assert out[k].node in (out[k].u, out[k].v) and sphere((x, y), at[out[k].node]) <= min(sphere((x, y), at[out[k].u]), sphere((x, y), at[out[k].v])) + 0.01
    empty = n.where("false")
    assert network.nearest_node(p, empty).collect() == [] and network.nearest_edge(p, spark.createDataFrame([], "u long, v long"), n).collect() == []


def test_long_paths_and_totals(spark):
    edges = graph(spark, [(k, k + 1, 2) for k in range(30)]).withColumn("cost", F.col("length") * 1.8)
    od = spark.createDataFrame([(0, 30), (0, 6), (3, 3), (30, 0)], "origin long, destination long")
    best = network.shortest_paths(edges, od.select("origin"))
    paths = network.path_edges(best, od)
    rows = sorted((r.origin, r.destination, -r.back, r.u, r.v) for r in paths.collect())
    assert rows == sorted([(0, 30, k - 29, k, k + 1) for k in range(30)] + [(0, 6, k - 5, k, k + 1) for k in range(6)])
    t = {r.destination: r for r in network.path_totals(paths, edges).collect()}
    assert (t[30].n_edges, t[30].km, t[30].hours) == (30, pytest.approx(0.06), pytest.approx(0.03)) and t[6].kmh == pytest.approx(2.0)
    near = network.shortest_paths(edges, spark.createDataFrame([(0, 7.0), (10, 3.0)], "origin long, reach double"))
    assert sorted((r.origin, r.node) for r in near.collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (10, 10), (10, 11)]


def test_endpoints_count(spark):
    path3 = graph(spark, both([(1, 2, 1), (2, 3, 1)]))
    assert {r.node: r.betweenness for r in network.betweenness_nodes(path3, normalized=False, endpoints=True).collect()} == {1: 4, 2: 6, 3: 4}


def test_edges_beside_a_hexagon_are_not_in_it(spark):
    hexes = spark.createDataFrame([(1, 0.0, 0.0, 0.02)], "cell long, x double, y double, w double")
    nodes = spark.createDataFrame([(1, 0.0095, 0.0105), (2, 0.0098, 0.02), (3, -0.02, 0.0), (4, 0.02, 0.0), (5, 0.001, 0.001), (6, 0.002, 0.001)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "u long, v long")  # the first meets the bounding box alone
    assert {(r.u, r.v) for r in network.cell_edges(hexes, edges, nodes).collect()} == {(3, 4), (5, 6)}


def test_last_leg_that_goes_back_is_dropped(spark):
    from roadpulse.operators import matching

    edges = graph(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 5, 1), (5, 2, 1), (4, 2, 1)])
    matched = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 4, 5), ("a", 2, 3, 4)], "TRIP_ID string, sequenza int, u long, v long")
    out = matching.matched_route(matched, edges).orderBy("order").collect()
    assert [(r.u, r.v) for r in out] == [(1, 2), (2, 3), (3, 4), (4, 5)]


def test_ties_take_the_smallest_predecessor_of_any_round(spark):
    """Of two least paths to 9 the one of five edges ends in the smaller predecessor, and a later round finds it."""
    edges = spark.createDataFrame([(1, 8, 4.0), (8, 9, 4.0), (1, 4, 1.0), (4, 5, 1.0), (5, 6, 1.0), (6, 2, 1.0), (2, 9, 4.0), (9, 7, 0.0), (7, 9, 0.0)], "u long, v long, length double")
    found = network.shortest_paths(edges, spark.createDataFrame([(1,)], "origin long"))
    assert {r.node: (r.dist, r.pred) for r in found.collect()} == {1: (0, None), 8: (4, 1), 4: (1, 1), 5: (2, 4), 6: (3, 5), 2: (4, 6), 9: (8, 2), 7: (8, 9)}
    ends = spark.createDataFrame([(1, 7)], "origin long, destination long")
    assert [(r.u, r.v) for r in network.path_edges(found, ends).orderBy("back").collect()] == [(9, 7), (2, 9), (6, 2), (5, 6), (4, 5), (1, 4)]
