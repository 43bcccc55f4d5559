"""Density clusters against a table of all pairs."""

import math
import random

import pytest

from roadpulse.operators import clusters, places

SCHEMA = "id long, idterm long, longitude double, latitude double"


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def brute(points, eps, least):
    """(vehicle, id) to label, by a walk over all pairs."""
    out = {}
    for v in {p[1] for p in points}:
        mine = [p for p in points if p[1] == v and p[2] is not None]
        near = {p[0]: [q[0] for q in mine if metres(p[2:], q[2:]) <= eps] for p in mine}
        core = {i for i in near if len(near[i]) >= least}
        label = {}
        for i in sorted(core):
            todo = [] if i in label else [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += [j for j in near[k] if j in core]
        for i in near:
            got = [label[j] for j in near[i] if j in core]
            if got:
                out[v, i] = label[i] if i in core else min(got)
    return out


@pytest.mark.parametrize("least", [1, 4])
@pytest.mark.parametrize("base", [(14.9, 37.4), (-0.002, 0.001), (20.0, -67.0)])
def test_clusters_equal_brute_force(spark, least, base):
    r = random.Random(str(base))
    points, n = [], 0
    for v in range(3):
        spots = [(base[0] + r.random() * 0.02, base[1] + r.random() * 0.01) for _ in range(12)]
        for _ in range(140):
            x, y = r.choice(spots)
            spread = r.choice([0.0, 0.0003, 0.002])
            points.append((n, v, x + r.gauss(0, 1) * spread, y + r.gauss(0, 1) * spread))
            n += 1
    points += [(n, 0, None, 1.0), (n + 1, 9, base[0], base[1])]
    got = {(x.idterm, x.id): x.label for x in clusters.density_clusters(spark.createDataFrame(points, SCHEMA), 120, least).collect()}
    assert got == brute(points, 120, least)


def test_cells_at_the_limit(spark, monkeypatch):
    """Rows of points just within and just beyond the distance, told apart by splitting and, at last, point by point."""
    step = 120 / clusters.METRES_PER_DEGREE
    points = []
    for v, stretch in enumerate((0.9999999, 1.0000001)):
        points += [(1000 * v + 10 * k + j, v, 10.0 + j * 1e-5, 1.0 + k * step * stretch) for k in range(6) for j in range(5)]
    expected = brute(points, 120, 1)
    assert len(set(expected.values())) == 1 + 6
    for splits in (0, 1, 6):
        monkeypatch.setattr(clusters, "SPLITS", splits)
        got = {(x.idterm, x.id): x.label for x in clusters.density_clusters(spark.createDataFrame(points, SCHEMA), 120, 1).collect()}
        assert got == expected


def test_a_long_chain_and_many_jittering_points(spark):
    chain = [(k, 1, 12.0 + k * 0.001, 41.0) for k in range(300)]
    got = clusters.density_clusters(spark.createDataFrame(chain, SCHEMA), 120, 2).collect()
    assert {x.label for x in got} == {0} and len(got) == 300
    from pyspark.sql import functions as F

    jitter = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) / 1_000_003 - 0.5) * 0.003
    many = spark.range(100_000).select("id", F.lit(5).cast("long").alias("idterm"), (14.9 + jitter(1)).alias("longitude"), (37.4 + jitter(2)).alias("latitude"))
    found = clusters.density_clusters(many, 120, 5)
    assert [tuple(x) for x in found.groupBy("label").count().collect()] == [(0, 100_000)]


def test_night_place_takes_the_cluster_of_most_nights(spark):
    rows = [(1, 7, 10.0, 45.0, 1), (2, 7, 10.0005, 45.0, 1), (3, 7, 10.3, 45.0, 3), (4, 7, 10.0008, 45.0, 2), (5, 8, 1.0, 1.0, 9), (6, 8, 1.0, 1.0, 9)]
    out = places.night_place(spark.createDataFrame(rows, SCHEMA + ", n_nights long")).collect()
    assert [(x.idterm, x.n_points, x.n_nights) for x in out] == [(7, 3, 4)]  # the other vehicle has too few stops
