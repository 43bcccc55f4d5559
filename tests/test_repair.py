"""Repair of trees against Dijkstra's algorithm on each closed network."""

import random

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import hubs, network, repair
from tests.test_hubs import grid, least


@pytest.mark.parametrize("penalty", [0.5, 7.0, 1e5])
def test_repair_equals_new_trees(spark, penalty):
    r = random.Random(6)
    edges = grid(9, 3) + [(100, 101, 1.0)]
    closed = {c: [edges[r.randrange(len(edges))][:2] for _ in range(r.choice([1, 3, 12]))] for c in range(12)}
    origins = [0, 40, 77]
    table = spark.createDataFrame(edges, "u long, v long, length double")
    base = network.shortest_paths(table, spark.createDataFrame([(o,) for o in origins], "origin long")).cache()
    asked = [(c, o, t) for c in closed for o in origins for t in range(81) if r.random() < 0.4] + [(0, 0, 101), (3, 0, 0)]
    found = repair.repaired_costs(
        base, table, spark.createDataFrame([(c, u, v) for c, es in closed.items() for u, v in es], "cell int, u long, v long"),
        spark.createDataFrame(asked, "cell int, origin long, destination long"), "length", penalty,
    )
    got = {(x.cell, x.origin, x.destination): x.dist for x in found.collect()}
    tree = {(x.origin, x.node): x.pred for x in base.collect()}

    def crosses(c, o, t):
        while t != o:
            if (tree[o, t], t) in closed[c]:
                return True
            t = tree[o, t]
        return False

    want = {}
    for c, es in closed.items():
        dearer = [(u, v, w + (penalty if (u, v) in es else 0)) for u, v, w in edges]
        for o in origins:
            new = least(dearer, o)
            want.update({(c, o, t): new[t] for a, b, t in asked if (a, b) == (c, o) and (o, t) in tree and crosses(c, o, t)})
    assert len(want) > 50 and got == pytest.approx(want)


def test_rows_are_those_below(spark):
    base = spark.createDataFrame([(1, k, k - 1 if k > 1 else None) for k in range(1, 30)], "origin long, node long, pred long")
    cut = spark.createDataFrame([("a", 1, 19, 20), ("a", 1, 24, 25), ("b", 1, 20, 19), ("b", 1, 3, 20)], "cell string, origin long, u long, v long")
    got = {(r.cell, r.node): r.n for r in repair.cut_nodes(base, cut).collect()}
    assert got == {("a", k): 1 + (k >= 25) for k in range(20, 30)}  # what isn't on the tree, or against it, cuts nothing
    assert repair.cut_nodes(base, cut.where("false")).count() == 0
    assert repair.repaired_costs(base.withColumn("dist", F.col("node") * 1.0), spark.createDataFrame([], "u long, v long, cost double"), cut.select("cell", "u", "v").where("false"), spark.createDataFrame([("a", 1, 5)], "cell string, origin long, destination long")).count() == 0


def test_few_jobs_for_any_depth(spark, monkeypatch):
    """A detour along a line of 60 nodes takes no more jobs than a short one, and rounds give the same costs."""
    line = [(k, k + 1, 1.0) for k in range(60)] + [(0, 300, 5.0), *((300 + k, 301 + k, 1.5) for k in range(30)), (330, 30, 1.5)]
    table = spark.createDataFrame(line, "u long, v long, length double")
    base = network.shortest_paths(table, spark.createDataFrame([(0,)], "origin long")).cache()
    closed = spark.createDataFrame([("a", 20, 21), ("b", 1, 2)], "cell string, u long, v long")
    asked = spark.createDataFrame([("a", 0, 60), ("b", 0, 60), ("b", 0, 25)], "cell string, origin long, destination long")
    tracker = spark.sparkContext.statusTracker()

    def costs(label):
        spark.sparkContext.setJobGroup(label, label)
        found = {(r.cell, r.destination): r.dist for r in repair.repaired_costs(base, table, closed, asked, "length", 1000.0, repair.cut_nodes(base, asked.select("cell", "origin").distinct().join(closed, "cell"))).collect()}
        jobs = len(tracker.getJobIdsForGroup(label))
        spark.sparkContext.setJobGroup("after", "after")
        return found, jobs

    found, jobs = costs("local")
    assert found == {("a", 60): 81.5, ("b", 60): 81.5, ("b", 25): 1025.0}
    monkeypatch.setattr(repair, "LOCAL", 45)  # of a 40 nodes are cut off, of b 59
    by_rounds, more = costs("rounds")
    assert by_rounds == found and jobs < more / 2


def test_trees_of_the_matrix_equal_shortest_paths(spark):
    edges = grid(7, 5) + [(100, 101, 1.0)]
    table = spark.createDataFrame(edges, "u long, v long, length double")
    origins = spark.createDataFrame([(0,), (24,), (100,), (999,), (24,)], "origin long")
    trees = hubs.matrix_trees(hubs.hub_index(table), origins)
    got = {(r.origin, r.node): (round(r.dist, 9), r.pred) for r in trees.collect()}
    assert got == {(r.origin, r.node): (round(r.dist, 9), r.pred) for r in network.shortest_paths(table, origins).collect()}
    for r in trees.collect():
        assert r.path[0] == r.node and r.path[-1] == r.origin and all(got[r.origin, a][1] == b for a, b in zip(r.path, r.path[1:]))
    assert hubs.matrix_trees(hubs.hub_index(spark.createDataFrame([(1, 2, 0.0), (2, 3, 1.0)], "u long, v long, length double")), origins) is None
