"""Least costs after closures, by repair of the trees of least paths.

A closure changes only what lies below its edges in an origin's tree. Those nodes get new
costs: at first the old path with its penalties, or an edge from a node whose path is intact;
then edges among themselves, as long as something improves. Nothing else is computed again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.store import remove, written

#: Edges by which a round extends costs before it writes those that improve.
HOPS = 3
#: Nodes that a task repairs at once, and at most of a closure and origin for that; larger ones take rounds.
LOCAL = 100_000


def cut_nodes(base: DataFrame, cut: DataFrame) -> DataFrame:
    """Nodes below closed edges of trees: the columns of ``cut`` but u and v, node, and n, the closed edges on their path.

    ``base`` has origin, node and pred; ``cut`` has a scenario's columns, origin, u and v. The table of
    ancestors is doubled and with it how far above a closed edge may lie, so the joins grow with the
    logarithm of the trees' depth, and their rows are those of nodes that are cut off.
    """
    spark = base.sparkSession
    keys = [c for c in cut.columns if c not in ("u", "v")]
    jump, jump_path = written(base.select("origin", F.col("node").alias("at"), F.col("pred").alias("to")).where("pred is not null"), "jumps")
    own = cut.distinct().join(jump, (cut["origin"] == jump["origin"]) & (F.col("v") == F.col("at")) & (F.col("u") == F.col("to")), "left_semi")
    found, path = written(own.select(*keys, F.col("v").alias("node"), F.lit(1).cast("long").alias("n")), "cut")
    while True:
        lower = found.withColumnRenamed("node", "to").join(jump, ["origin", "to"]).select(*keys, F.col("at").alias("node"), "n")
        more, more_path = written(found.unionByName(lower).groupBy(*keys, "node").agg(F.sum("n").alias("n")), "cut")
        further = jump.join(jump.select("origin", F.col("at").alias("to"), F.col("to").alias("far")), ["origin", "to"]).select("origin", "at", F.col("far").alias("to"))
        farther, farther_path = written(further, "jumps")
        remove(spark, [path, jump_path])
        found, path, jump, jump_path = more, more_path, farther, farther_path
        if jump.first() is None:
            remove(spark, [jump_path])
            return found


def _relaxed(keys: list[str]):
    """Least costs of the nodes of many closures and origins at once, from their ``known`` costs and the edges among them."""

    def relax(known: pa.Table, edges: pa.Table) -> pa.Table:
        known, edges = known.drop_columns(["bucket"]), edges.drop_columns(["bucket"])
        if not known.num_rows or not edges.num_rows:
            return known
        n, code = known.num_rows, np.zeros(known.num_rows + edges.num_rows, np.int64)
        for c in keys:
            values = pa.concat_arrays([known[c].combine_chunks(), edges[c].combine_chunks()]).dictionary_encode()
            code = np.unique(code * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
        names, place = np.unique(np.concatenate([known["node"].to_numpy(), edges["u"].to_numpy(), edges["v"].to_numpy()]), return_inverse=True)
        own = code[:n] * len(names) + place[:n]
        by = np.argsort(own)
        find = lambda at: by[np.searchsorted(own[by], code[n:] * len(names) + at)]
        u, v = find(place[n : n + edges.num_rows]), find(place[n + edges.num_rows :])
        sort = np.argsort(v, kind="stable")
        u, v, w = u[sort], v[sort], edges["w"].to_numpy()[sort]
        ends, first = np.unique(v, return_index=True)
        dist = known["dist"].to_numpy().copy()
        while True:
            least = np.minimum.reduceat(dist[u] + w, first)
            if not (least < dist[ends]).any():
                return known.set_column(known.column_names.index("dist"), "dist", pa.array(dist))
            dist[ends] = np.minimum(dist[ends], least)

    return relax


def repaired_costs(base: DataFrame, edges: DataFrame, closed: DataFrame, asked: DataFrame, weight: str = "cost", penalty: float = 18000, below: DataFrame | None = None) -> DataFrame:
    """New least costs of ``asked`` (scenario columns, origin, destination) while the scenario's edges cost ``penalty`` more.

    ``base`` has the trees of ``shortest_paths`` (origin, node, dist, pred) and ``closed`` the scenario
    columns, u and v. Rows: scenario columns, origin, destination, dist. Destinations whose
    path is intact, and those that the origin doesn't reach, have none. No cost above the dearest old
    path that is asked for is followed. ``below`` is what ``cut_nodes`` finds, if it is known.
    Closures and origins are repaired many in a task; those with more than LOCAL nodes cut off by rounds of joins.
    """
    spark = base.sparkSession
    keys = [c for c in asked.columns if c not in ("origin", "destination")]
    key = [*keys, "origin"]
    roads, roads_path = written(edges.groupBy("u", "v").agg(F.min(weight).cast("double").alias("w")), "roads")
    more = closed.select(*keys, "u", "v", F.lit(float(penalty)).alias("more")).distinct()
    if below is None:
        cut = asked.select(*key).distinct().join(more.drop("more"), keys)
        below = cut_nodes(base, cut.select(*key, "u", "v"))
    old = base.select("origin", "node", "dist")
    bound = below.join(old, ["origin", "node"]).select(*key, "node", (F.col("dist") + F.col("n") * float(penalty)).alias("bound"))
    bound, bound_path = written(bound, "bounds")
    reach = bound.join(asked.withColumnRenamed("destination", "node"), [*key, "node"]).groupBy(*key).agg(F.max("bound").alias("reach"))
    nodes, nodes_path = written(bound.join(reach, key).select(*key, "node", "bound", "reach"), "nodes")  # scenarios that cut no asked path end here
    remove(spark, [bound_path])

    def extended(front: DataFrame) -> DataFrame:
        """What ``front`` (key, u, before) brings to the nodes that are cut off: key, node, dist."""
        step = front.join(roads, "u").join(more, [*keys, "u", "v"], "left")
        step = step.select(*key, F.col("v").alias("node"), (F.col("before") + F.col("w") + F.coalesce("more", F.lit(0.0))).alias("dist"))
        step = step.join(nodes.select(*key, "node", "reach"), [*key, "node"]).where("dist <= reach")
        return step.groupBy(*key, "node").agg(F.min("dist").alias("dist"))

    # edges into cut nodes from nodes with an intact path
    into = nodes.select(*key, F.col("node").alias("v")).join(roads, "v").select(*key, "u").distinct()
    border = into.join(nodes.select(*key, F.col("node").alias("u")), [*key, "u"], "left_anti").join(old.select("origin", F.col("node").alias("u"), F.col("dist").alias("before")), ["origin", "u"])
    seeds = nodes.select(*key, "node", F.col("bound").alias("dist")).unionByName(extended(border))
    known, known_path = written(seeds.groupBy(*key, "node").agg(F.min("dist").alias("dist")), "repaired")
    sizes = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    far = None
    if (most["most"] or 0) > LOCAL:
        large = sizes.where(F.col("n") > LOCAL).select(*key)
        far = _by_rounds(written(known.join(large, key, "left_semi"), "repaired")[0], extended, key)
        known = known.join(large, key, "left_anti")
    inner = nodes.select(*key, F.col("node").alias("u")).join(roads, "u").join(nodes.select(*key, F.col("node").alias("v")), [*key, "v"]).join(more, [*keys, "u", "v"], "left")
    inner = inner.select(*key, "u", "v", (F.col("w") + F.coalesce("more", F.lit(0.0))).alias("w"))
    if far is not None:
        inner = inner.join(large, key, "left_anti")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*key), F.lit(max(n, (most["n"] or 0) // LOCAL))).alias("bucket")
    parts = [t.withColumn("bucket", bucket).repartition(n, "bucket").groupBy("bucket") for t in (known, inner)]
    repaired = parts[0].cogroup(parts[1]).applyInArrow(_relaxed(key), known.schema)
    if far is not None:
        repaired = repaired.unionByName(far)
    out, _ = written(repaired.withColumnRenamed("node", "destination").join(asked, [*key, "destination"], "left_semi").select(*key, "destination", "dist"), "repaired")
    remove(spark, [known_path, roads_path, nodes_path])
    return out


def _by_rounds(known: DataFrame, extended, key: list[str]) -> DataFrame:
    """``known`` costs (key, node, dist) as they are when no edge improves any, in rounds of joins."""
    spark = known.sparkSession
    known_path = None
    front, front_path = known, None
    while True:
        found, steps = front, []
        for _ in range(HOPS):
            found = extended(found.select(*key, F.col("node").alias("u"), F.col("dist").alias("before")))
            steps.append(found)
        best = steps[0].unionByName(steps[1]).unionByName(steps[2]).groupBy(*key, "node").agg(F.min("dist").alias("dist"))
        better, better_path = written(best.join(known.select(*key, "node", F.col("dist").alias("known")), [*key, "node"]).where("dist < known").drop("known"), "better")
        if better.first() is None:
            remove(spark, [better_path])
            return known
        after, after_path = written(known.unionByName(better).groupBy(*key, "node").agg(F.min("dist").alias("dist")), "repaired")
        remove(spark, [x for x in (known_path, front_path) if x])
        known, known_path, front, front_path = after, after_path, better, better_path
