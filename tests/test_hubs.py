"""Hub labels against Dijkstra's algorithm."""

import heapq
import random

import pytest

from roadpulse.operators import hubs, network


def table(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, length double")


def least(edges, origin):
    roads = {}
    for u, v, w in edges:
        if w is not None:
            roads.setdefault(u, []).append((v, w))
    best, heap = {}, [(0.0, origin)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in roads.get(u, []):
            heapq.heappush(heap, (d + w, v))
    return best


def grid(side, seed):
    r = random.Random(seed)
    near = [(n, n + d) for n in range(side * side) for d in (1, side) if n + d < side * side and (d == side or (n + 1) % side)]
    return [(a, b, r.choice([1.0, 2.0, 5.0]) + r.random()) for a, b in near] + [(b, a, r.choice([1.0, 2.0, 5.0]) + r.random()) for a, b in near if r.random() < 0.9]


def held(spark, edges, pairs, core):
    index = hubs.hub_index(table(spark, edges), core=core)
    asked = spark.createDataFrame(pairs, "origin long, destination long")
    costs = {(r.origin, r.destination): r.dist for r in hubs.pair_costs(index, asked).collect()}
    paths = {}
    for r in hubs.pair_paths(index, asked).collect():
        paths.setdefault((r.origin, r.destination), []).append((-r.back, r.u, r.v))
    weight = {}
    for u, v, w in edges:
        if w is not None:
            weight[u, v] = min(w, weight.get((u, v), w))
    want = {}
    for o in {o for o, _ in pairs}:
        found = least(edges, o)
        want.update({(a, t): found[t] for a, t in pairs if a == o and t in found})
    assert costs == pytest.approx(want)
    for pair, cost in want.items():
        path = [(u, v) for _, u, v in sorted(paths.get(pair, []))]
        if pair[0] == pair[1]:
            assert not path
            continue
        assert path[0][0] == pair[0] and path[-1][1] == pair[1] and all(a[1] == b[0] for a, b in zip(path, path[1:]))
        assert sum(weight[e] for e in path) == pytest.approx(cost)
        assert sorted(-b for b, _, _ in paths[pair]) == list(range(len(path)))
    assert set(paths) <= set(want)
    return index


def test_grid_in_rounds_and_in_the_core(spark):
    edges = grid(13, 1)
    r = random.Random(2)
    pairs = [(r.randrange(169), r.randrange(169)) for _ in range(250)] + [(5, 5), (5, 900), (900, 900), (-3, 5)]
    index = held(spark, edges, pairs, core=12)
    assert index.height > 2 and len(index.core) <= 12
    assert held(spark, edges, pairs, core=1000).height == 0


def test_one_way_parts_and_odd_rows(spark):
    edges = [(1, 2, 1.0), (2, 3, 0.0), (3, 1, 4.0), (7, 8, 1.0), (2, 2, 0.0), (1, 2, 9.0), (1, 2, None), (3, 4, 2.0), (4, 5, 0.0), (5, 6, 0.0), (-9, 1, 1.0), (6, -9, 1.0)]
    nodes = [1, 2, 3, 4, 5, 6, 7, 8, -9]
    for core in (1, 3, 100):
        held(spark, edges, [(a, b) for a in nodes for b in nodes], core)
    empty = hubs.hub_index(table(spark, []))
    asked = spark.createDataFrame([(1, 1), (1, 2), (None, 2)], "origin long, destination long")
    assert [tuple(r) for r in hubs.pair_costs(empty, asked).collect()] == [(1, 1, 0.0)]
    assert hubs.pair_paths(empty, asked).count() == 0


def test_long_line_needs_few_rounds(spark):
    """A path of 600 edges: rounds grow with the logarithm of its nodes."""
    edges = [(k, k + 1, 1.0) for k in range(600)]
    index = held(spark, edges, [(0, 600), (600, 0), (17, 580)], core=20)
    assert index.height <= 12
    totals = network.path_totals(hubs.pair_paths(index, spark.createDataFrame([(0, 600)], "origin long, destination long")), table(spark, edges), "length").collect()
    assert [(r.n_edges, r.km) for r in totals] == [(600, pytest.approx(0.6))]
