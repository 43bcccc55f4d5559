"""Centrality of large networks with a stated error: counters instead of tables of all pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.store import remove, written
from roadpulse.operators.cleaning import add_row_id
from roadpulse.operators.hubs import CORE, hub_index, pair_paths

#: Rounds of ``closeness_estimate`` between two written tables.
ROUNDS = 2


def closeness_estimate(edges: DataFrame, precision: int = 12) -> DataFrame:
    """Closeness of each node on the undirected graph by hops: node, reached, distance, closeness.

    Every node has a HyperLogLog counter of the nodes within r hops; a round merges it with its
    neighbours' counters, and what it grows by lies r hops away. No table of pairs is made: a round moves a
    counter of at most 2^precision bytes along each edge, and there are as many rounds as the widest distance. Counts
    have a relative standard error of about 1.04 / 2^(precision / 2), 1.6 % at 12; up to some hundreds
    of nodes they are exact. ``closeness`` is that of ``network.closeness``, with its estimate of reached nodes
    (the node itself left out) and of their summed distance.
    """
    spark = edges.sparkSession
    both, both_path = written(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "neighbours")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    start = nodes.groupBy("node").agg(F.hll_sketch_agg("node", precision).alias("seen"))
    state, path = written(start.select("node", "seen", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("distance"), F.lit(False).alias("grew")), "counters")
    r = 0
    while True:
        for _ in range(ROUNDS):
            r += 1
            sent = both.join(state.select(F.col("node").alias("u"), "seen"), "u").select(F.col("v").alias("node"), "seen").unionByName(state.select("node", "seen"))
            merged = sent.groupBy("node").agg(F.hll_union_agg("seen").alias("seen"))
            new = merged.join(state.select("node", F.col("n").alias("last"), "distance"), "node").withColumn("n", F.greatest("last", F.hll_sketch_estimate("seen")))
            state = new.select("node", "seen", "n", (F.col("distance") + r * (F.col("n") - F.col("last"))).alias("distance"), (F.col("n") > F.col("last")).alias("grew"))
        state, after = written(state, "counters")
        remove(spark, [path])
        path = after
        if state.where("grew").first() is None:
            break
    total = nodes.count()
    out = state.select("node", (F.col("n") - 1).alias("reached"), "distance")
    value = F.bround(F.coalesce(F.try_divide(F.col("reached"), F.col("distance")), F.lit(0.0)) * F.col("reached") / max(total - 1, 1), 9)
    out, _ = written(out.withColumn("closeness", value), "closeness")
    remove(spark, [path, both_path])
    return out


def sample_size(epsilon: float, delta: float, diameter: int) -> int:
    """Sampled paths by which every betweenness is off by ``epsilon`` at most with probability 1 - ``delta``.

    ``diameter`` bounds the nodes on a least path; the number of all nodes always does.
    """
    return max(1, math.ceil(0.5 / epsilon**2 * (math.floor(math.log2(max(diameter - 2, 1))) + 1 + math.log(1 / delta))))


def sampled_pairs(nodes: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` random pairs of different nodes: sample, origin, destination. The same seed gives the same pairs.

    Nodes are numbered in order; a sample's numbers are digits of an MD5 of the seed and its own number.
    """
    numbered, path = written(add_row_id(nodes.select("node").distinct(), ["node"], "row"), "numbered")
    n = numbered.count()
    spark = nodes.sparkSession
    if n < 2:
        return spark.createDataFrame([], "sample long, origin long, destination long")
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))
    draw = lambda at, most: F.pmod(F.conv(F.substring(digest, at, 12), 16, 10).cast("long"), F.lit(most))
    first = draw(1, n)
    second = F.pmod(first + 1 + draw(13, n - 1), F.lit(n))  # any node but the first
    drawn = spark.range(size).select(F.col("id").alias("sample"), (first + 1).alias("a"), (second + 1).alias("b"))
    side = lambda row, name: numbered.select(F.col("row").alias(row), F.col("node").alias(name))
    return drawn.join(side("a", "origin"), "a").join(side("b", "destination"), "b").select("sample", "origin", "destination")


def _sampled(edges: DataFrame, weight: str, epsilon: float, delta: float, seed: int, diameter: int | None, core: int) -> tuple[DataFrame, DataFrame, int]:
    nodes, _ = written(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct(), "nodes")
    size = sample_size(epsilon, delta, diameter or nodes.count())
    pairs, _ = written(sampled_pairs(nodes, size, seed), "samples")
    times = pairs.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("times"))
    return nodes, pair_paths(hub_index(edges, weight, core), pairs.select("origin", "destination")).join(times, ["origin", "destination"]), size


def sampled_betweenness(edges: DataFrame, weight: str = "length", epsilon: float = 0.05, delta: float = 0.1, seed: int = 0, diameter: int | None = None, core: int = CORE) -> DataFrame:
    """Betweenness of nodes, as the share of pairs whose least path passes through them, from sampled paths: node, betweenness.

    With probability 1 - ``delta`` no node is off by more than ``epsilon``. The sample grows with the
    logarithm of ``diameter`` (nodes on a least path; by default all nodes) and not with the network; its paths come from
    hub labels, so no origin's tree is grown. Where least paths tie, one of them counts.
    A path's ends aren't between; pairs without a path count as pairs.
    """
    nodes, paths, size = _sampled(edges, weight, epsilon, delta, seed, diameter, core)
    inner = paths.where("back > 0").groupBy(F.col("v").alias("node")).agg(F.sum("times").alias("n"))
    return nodes.join(inner, "node", "left").select("node", F.bround(F.coalesce("n", F.lit(0)) / size, 9).alias("betweenness"))


def sampled_betweenness_edges(edges: DataFrame, weight: str = "length", epsilon: float = 0.05, delta: float = 0.1, seed: int = 0, diameter: int | None = None, core: int = CORE) -> DataFrame:
    """As ``sampled_betweenness``, for edges: u, v, betweenness. Edges on no sampled path have 0."""
    _, paths, size = _sampled(edges, weight, epsilon, delta, seed, diameter, core)
    used = paths.groupBy("u", "v").agg(F.sum("times").alias("n"))
    return edges.select("u", "v").distinct().join(used, ["u", "v"], "left").select("u", "v", F.bround(F.coalesce("n", F.lit(0)) / size, 9).alias("betweenness"))
