"""Estimates of centrality against the exact forms, ranks and pyramids against plain sorting."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import centrality, matching, network, pyramid, ranks
from tests.test_hubs import grid, table


def test_closeness_estimate(spark):
    edges = table(spark, [*grid(6, 5), (100, 101, 1.0), (7, 7, 1.0)])
    exact = {r.node: r.closeness for r in network.closeness(edges).collect()}
    got = {r.node: r for r in centrality.closeness_estimate(edges).collect()}
    assert {k: v.closeness for k, v in got.items()} == pytest.approx(exact, rel=1e-9)
    assert got[100].reached == 1 and got[0].distance == sum(a + b for a in range(6) for b in range(6))
    rough = {r.node: r.closeness for r in centrality.closeness_estimate(edges, precision=6).collect()}
    assert all(abs(rough[k] / v - 1) < 0.6 for k, v in exact.items() if k < 100)


def test_sampled_betweenness_is_within_its_error(spark):
    edges = table(spark, grid(6, 9))
    n, epsilon = 36, 0.06
    exact = {r.node: r.betweenness * (n - 2) / n for r in network.betweenness_nodes(edges).collect()}  # as a share of all n (n - 1) pairs
    got = {r.node: r.betweenness for r in centrality.sampled_betweenness(edges, epsilon=epsilon, seed=3).collect()}
    assert set(got) == set(exact) and max(abs(got[k] - exact[k]) for k in exact) <= epsilon
    by_edge = {(r.u, r.v): r.betweenness for r in network.betweenness_edges(edges).collect()}
    found = {(r.u, r.v): r.betweenness for r in centrality.sampled_betweenness_edges(edges, epsilon=epsilon, seed=3).collect()}
    assert set(by_edge) <= set(found) and max(abs(found[k] - by_edge.get(k, 0)) for k in found) <= epsilon
    assert centrality.sample_size(0.1, 0.1, 100) < centrality.sample_size(0.05, 0.1, 100) < centrality.sample_size(0.05, 0.01, 10**6)


def test_sampled_pairs(spark):
    nodes = spark.range(5).select(F.col("id").alias("node"))
    pairs = [tuple(r) for r in centrality.sampled_pairs(nodes, 4000, 1).collect()]
    assert len(pairs) == 4000 and all(a != b for _, a, b in pairs)
    counts = [sum(1 for _, a, b in pairs if (a, b) == x) for x in {(a, b) for _, a, b in pairs}]
    assert len(counts) == 20 and min(counts) > 120
    assert sorted(pairs) == sorted(tuple(r) for r in centrality.sampled_pairs(nodes, 4000, 1).collect())
    assert centrality.sampled_pairs(nodes.limit(1), 10).count() == 0


@pytest.mark.parametrize("kind", ["even", "ties", "wild", "few"])
def test_exact_median(spark, monkeypatch, kind):
    monkeypatch.setattr(ranks, "FEW", 50)
    r = random.Random(kind)
    values = {
        "even": [r.random() for _ in range(5000)], "ties": [r.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(5001)],
        "wild": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(4001)] + [0.0] * 30, "few": [3.0, 1.0],
    }[kind]
    df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double").repartition(7)
    assert ranks.exact_median(df, "x") == statistics.median(values)
    ordered = sorted(values)
    for k in (0, len(values) // 3, len(values) - 1):
        assert ranks.value_at(df.where("x is not null"), "x", k, len(values)) == ordered[k]


def test_beta(spark):
    moves = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "difference double")
    assert matching.beta_of(moves) == pytest.approx(2 / 0.6931471805599453) and matching.beta_of(moves.where("false")) is None


def test_far_points_meet_few_things(spark):
    """A thousand points far from a network of 2,500 nodes: the same nodes as by all pairs, from a fraction of the pairs."""
    r = random.Random(12)
    nodes = [(k, 14.0 + (k % 50) * 0.01 + r.random() * 0.005, 37.0 + (k // 50) * 0.01 + r.random() * 0.005) for k in range(2500)]
    points = [(k, r.uniform(-170, 170), r.uniform(-80, 80)) for k in range(150)] + [(k, 14 + r.uniform(-2, 3), 37 + r.uniform(-2, 3)) for k in range(150, 300)]
    n, p = spark.createDataFrame(nodes, "node long, x double, y double"), spark.createDataFrame(points, "id long, x double, y double")
    from roadpulse.functions.geo import haversine

    m = F.bround(haversine(F.col("px"), F.col("py"), F.col("x"), F.col("y")) * 1000, 3)
    pairs = p.select("id", F.col("x").alias("px"), F.col("y").alias("py")).crossJoin(n).withColumn("m", m)
    want = {x.id: (x.b.m, x.b.node) for x in pairs.groupBy("id").agg(F.min(F.struct("m", "node")).alias("b")).collect()}
    assert {x.id: (x.m, x.node) for x in network.nearest_node(p, n).collect()} == want
    low, high = pyramid.sphere_bounds()
    box = F.struct(F.lit(14.0).alias("ax"), F.lit(14.5).alias("bx"), F.lit(37.0).alias("ay"), F.lit(37.5).alias("by"))
    held = pairs.withColumn("box", box).withColumns({"low": low, "high": high}).where("m < low - 0.01 or m > high + 0.01")
    assert held.count() == 0
