"""Least paths between given pairs of nodes by hub labels.

An index is made once: in rounds, nodes of least degree of which no two are neighbours are
taken out, and a shortcut replaces each two edges that met in one, unless two edges that stay are
no longer. What is left, at most
``core`` nodes, becomes a matrix of least costs. From a node, paths then climb: only along edges
to nodes that were taken out later. A node's label is what it reaches so with its cost; a
pair's least cost is the least sum over the hubs that both labels hold, or over two core
nodes and the cost between them. Paths are hops of the labels, whose shortcuts are unpacked.
Rounds and joins depend on the index, never on how many edges a path has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadpulse.functions.store import remove, written

#: Nodes that are left to one task as a matrix of 12 bytes a pair.
CORE = 1000
#: Passes over a round's nodes that look for more of which no two are neighbours, and edges of a node that are tried as witnesses.
PASSES, WITNESSES = 3, 32
#: Rounds of unpacking, and levels of climbing, between two written tables.
UNPACKED, CLIMBED = 3, 3
#: Rows of the core's matrix that are worked on at once.
STRIP = 32
#: Weights must differ from nothing by more than this share of all weights, or rounding could close a ring of predecessors.
ROUNDING = 1e-9
#: No node has this number.
NONE = np.iinfo(np.int64).min


@dataclass
class HubIndex:
    """Tables of a network's hierarchy: ``steps`` (u, v, w, mid: edges, and shortcuts by their middle node), ``climb`` (side,
    node, to, w, level, to_level; side 0 along edges, 1 against them), ``levels`` (node, level), their number, and the core."""

    steps: DataFrame
    climb: DataFrame
    levels: DataFrame
    height: int
    core: np.ndarray
    costs: np.ndarray
    direct: np.ndarray  # whether the least cost between two core nodes is that of an edge


def _closed(core: int):
    """All least paths among the last nodes, in one task: Floyd and Warshall's elimination in an order as good as random."""

    def close(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        u, v, w, mid = (table[c].combine_chunks() for c in ("u", "v", "w", "mid"))
        ids = np.unique(np.concatenate([u.to_numpy(), v.to_numpy()]))
        if len(ids) > core:
            raise ValueError(f"{len(ids)} nodes are left, more than {core}")
        at, to = np.searchsorted(ids, u.to_numpy()), np.searchsorted(ids, v.to_numpy())
        costs, via = np.full((len(ids), len(ids)), np.inf), np.full((len(ids), len(ids)), -1, np.int32)
        costs[at, to] = w.to_numpy()
        np.fill_diagonal(costs, 0.0)
        for k in np.random.default_rng(len(ids)).permutation(len(ids)).tolist():
            rows = np.flatnonzero(np.isfinite(costs[:, k]))
            for part in np.array_split(rows, len(rows) // STRIP + 1):  # strips that stay in the processor's cache
                through, old = costs[part, k][:, None] + costs[k], costs[part]
                better = through < old
                if better.any():
                    costs[part] = np.minimum(through, old)
                    via[part] = np.where(better, k, via[part])
        middle = np.full(costs.shape, NONE)
        middle[at, to] = mid.fill_null(int(NONE)).to_numpy()
        middle = np.where(via >= 0, ids[via], middle)
        i, j = np.nonzero(np.isfinite(costs) & ~np.eye(len(ids), dtype=bool))
        found = middle[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(costs[i, j]), pa.array(found, pa.int64(), mask=found == NONE)], ["u", "v", "w", "mid"])

    return close


def _independent(ends: DataFrame, seed: int) -> tuple[DataFrame, list[str]]:
    """Nodes (node) of ``ends`` (u, v: both ways) of which no two are neighbours, those of few neighbours first, and their tables' paths.

    In a pass each node that comes before all its neighbours still in question is taken, and its neighbours are out of question. A
    few passes find nearly as many nodes as can be found.
    """
    # of neighbours with one degree a hash decides, another one each round
    place = F.struct("n", F.xxhash64("u", F.lit(seed)).alias("h"), "u")
    places = ends.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", place.alias("own"))
    asked, path = written(ends.join(places, "u").join(places.select(F.col("u").alias("v"), F.col("own").alias("other")), "v"), "hub-places")
    found, used = [], []
    for k in range(PASSES):
        before = asked.groupBy("u").agg(F.first("own").alias("own"), F.min("other").alias("least"))
        picked, picked_path = written(before.where("least is null or own < least").select(F.col("u").alias("node")), "hub-nodes")
        found.append(picked)
        used.append(picked_path)
        if k + 1 < PASSES:
            gone = picked.union(ends.join(picked, F.col("v") == F.col("node")).select("u")).distinct()
            asked = asked.join(gone, F.col("u") == F.col("node"), "left_anti").join(gone, F.col("v") == F.col("node"), "left")
            asked = asked.select("u", "v", "own", F.when(F.col("node").isNull(), F.col("other")).alias("other"))
    remove(ends.sparkSession, [path])
    return _union(found), used


def _witnessed(shortcuts: DataFrame, rest: DataFrame) -> DataFrame:
    """(u, v) of the shortcuts that two edges which stay do as well as: leaving them out changes no least cost.

    Of a node only its WITNESSES least edges are tried, so nodes of many edges make no rows without bound; a shortcut kept in vain
    costs a row and no result.
    """
    rank = F.row_number().over(Window.partitionBy("u").orderBy("w", "v"))
    first = rest.withColumn("rank", rank).where(F.col("rank") <= WITNESSES).select("u", F.col("v").alias("x"), F.col("w").alias("w1"))
    second = rest.select(F.col("u").alias("x"), "v", F.col("w").alias("w2"))
    tried = shortcuts.select("u", "v", "w").join(first, "u").where("w1 <= w and x <> v")
    return tried.join(second, ["x", "v"]).where("w1 + w2 <= w").select("u", "v").distinct()


def hub_index(edges: DataFrame, weight: str = "length", core: int = CORE) -> HubIndex:
    """The index of a network (u, v and ``weight``, which must not be below zero).

    Of parallel edges the least counts; loops and rows with a null are ignored. An empty network
    gives an index in which nodes reach themselves alone. Each round writes the edges that
    are left and those that were taken out; the number of rounds grows with the logarithm of the nodes
    as long as separators are small, as they are in road networks.
    """
    spark = edges.sparkSession
    roads = edges.where(F.col(weight).isNotNull() & (F.col("u") != F.col("v"))).groupBy("u", "v").agg(F.min(weight).cast("double").alias("w"))
    now, path = written(roads.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "w", F.lit(None).cast("long").alias("mid")), "hub-edges")
    paths, taken, climbs, spent, height = [path], [], [], [], 0
    while True:
        ends, ends_path = written(now.select("u", "v").union(now.select("v", "u")).distinct(), "hub-ends")
        if ends.select("u").distinct().count() <= core:
            remove(spark, [ends_path])
            break
        chosen, used = _independent(ends, height)
        out = now.join(chosen, F.col("u") == F.col("node")).select("node", F.col("v").alias("to"), "w", "mid")
        into = now.join(chosen, F.col("v") == F.col("node")).select("node", F.col("u").alias("to"), "w", "mid")
        climb, climb_path = written(out.select(F.lit(0).alias("side"), "*").unionByName(into.select(F.lit(1).alias("side"), "*")).withColumn("level", F.lit(height)), "hub-climb")
        first, second = climb.where("side = 1").select("node", F.col("to").alias("u"), F.col("w").alias("w1")), climb.where("side = 0").select("node", F.col("to").alias("v"), F.col("w").alias("w2"))
        least = F.min(F.struct(F.col("w"), F.col("mid"))).alias("m")
        shortcuts = first.join(second, "node").where("u <> v").groupBy("u", "v").agg(F.min(F.struct((F.col("w1") + F.col("w2")).alias("w"), F.col("node").alias("mid"))).alias("m"))
        shortcuts, short_path = written(shortcuts.select("u", "v", "m.*"), "hub-shortcuts")
        rest = now.join(chosen.select(F.col("node").alias("u")), "u", "left_anti").join(chosen.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v", "w", "mid")
        rest, rest_path = written(rest, "hub-rest")
        needed = shortcuts.join(_witnessed(shortcuts, rest), ["u", "v"], "left_anti")
        now, path = written(rest.unionByName(needed).groupBy("u", "v").agg(least).select("u", "v", "m.*"), "hub-edges")
        remove(spark, [paths[-1], ends_path, short_path, rest_path])
        paths.append(path)
        taken.append(chosen.withColumn("level", F.lit(height)))
        climbs.append(climb)
        spent += [*used, climb_path]
        height += 1
    closed, _ = written(now.coalesce(1).mapInArrow(_closed(core), "u long, v long, w double, mid long"), "hub-core")
    remove(spark, [paths[-1]])
    union = lambda tables, kinds: _union(tables) if tables else spark.createDataFrame([], kinds)
    levels, _ = written(union(taken, "node long, level int"), "hub-levels")
    rows = union(climbs, "side int, node long, to long, w double, mid long, level int")
    above = levels.select(F.col("node").alias("to"), F.col("level").alias("to_level"))
    climb, _ = written(rows.join(above, "to", "left").select("side", "node", "to", "w", "mid", "level", F.coalesce("to_level", F.lit(height)).alias("to_level")), "hub-climb")
    remove(spark, spent)
    along = climb.where("side = 0").select(F.col("node").alias("u"), F.col("to").alias("v"), "w", "mid")
    steps = along.unionByName(climb.where("side = 1").select(F.col("to").alias("u"), F.col("node").alias("v"), "w", "mid")).unionByName(closed)
    table = closed.select("u", "v", "w", F.col("mid").isNull().alias("direct")).toArrow()  # at most core * core rows
    u, v = table["u"].to_numpy(), table["v"].to_numpy()
    ids = np.unique(np.concatenate([u, v]))
    costs, direct = np.full((len(ids), len(ids)), np.inf), np.zeros((len(ids), len(ids)), bool)
    costs[np.searchsorted(ids, u), np.searchsorted(ids, v)] = table["w"].to_numpy()
    direct[np.searchsorted(ids, u), np.searchsorted(ids, v)] = table["direct"].to_numpy(zero_copy_only=False)
    np.fill_diagonal(costs, 0.0)
    return HubIndex(steps, climb.drop("mid"), levels, height, ids, costs, direct)


def matrix_trees(index: HubIndex, origins: DataFrame) -> DataFrame | None:
    """Trees of least paths from ``origins`` (origin) where the matrix holds the whole network: origin, node, dist, pred and path,
    the nodes from ``node`` back to the origin.

    Of equal predecessors the smallest is taken, to within rounding. None for larger networks and where weights are next to nothing.
    """
    core, costs = index.core, index.costs
    v, u = np.nonzero(index.direct.T)  # by v, then u
    w = costs[u, v]
    if index.height or (len(w) and w.min() <= ROUNDING * w.sum()):
        return None
    ends, first = np.unique(v, return_index=True)
    width = np.diff(np.append(first, len(v)))

    def grow(batches):
        for batch in batches:
            columns = [[], [], [], [], []]
            for origin in batch.column(0).to_pylist():
                at = int(np.searchsorted(core, origin))
                if at == len(core) or core[at] != origin:
                    for c, x in zip(columns, (origin, origin, 0.0, None, [origin])):
                        c.append(x)
                    continue
                through = costs[at, u] + w
                least = np.minimum.reduceat(through, first)
                near = through <= np.repeat(least, width) * (1 + 1e-13)
                pred = np.full(len(core), -1)
                pred[ends] = u[np.minimum.reduceat(np.where(near, np.arange(len(v)), len(v)), first)]
                paths = {at: [origin]}
                for k in np.argsort(costs[at], kind="stable").tolist():
                    if np.isfinite(costs[at, k]):
                        if k != at:
                            paths[k] = [int(core[k]), *paths[int(pred[k])]]
                        for c, x in zip(columns, (origin, int(core[k]), float(costs[at, k]), None if k == at else int(core[pred[k]]), paths[k])):
                            c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["origin", "node", "dist", "pred", "path"])

    n = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = origins.select(F.col("origin").cast("long").alias("origin")).where("origin is not null").distinct().repartition(n, "origin")
    return asked.mapInArrow(grow, "origin long, node long, dist double, pred long, path array<long>")


def tree_edges(trees: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the edges of the paths of ``matrix_trees``: u, v, back (edges from the end)."""
    edge = F.transform("path", lambda x, k: F.struct(F.get("path", k + 1).alias("u"), x.alias("v"), k.alias("back")))
    return trees.where(F.size("path") > 1).select(*columns, F.inline(F.slice(edge, F.lit(1), F.size("path") - 1)))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def hub_labels(index: HubIndex, ends: DataFrame) -> DataFrame:
    """The labels of nodes ``ends`` (side, source): side, source, node, dist, via (the node before on the climb).

    One round a level: labels at its nodes are final then, and go on along the edges that climb from them.
    """
    spark = ends.sparkSession
    start = ends.distinct().join(index.levels.select(F.col("node").alias("source"), "level"), "source", "left")
    state = start.select("side", "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("via"), F.coalesce("level", F.lit(index.height)).alias("level"))
    state, path = written(state, "labels")
    for k in range(index.height):
        rise = index.climb.where(F.col("level") == k).drop("level")
        more = state.where(F.col("level") == k).join(rise, ["side", "node"])
        more = more.select("side", "source", F.col("to").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("node").alias("via"), F.col("to_level").alias("level"))
        least = state.unionByName(more).groupBy("side", "source", "node").agg(F.min(F.struct("dist", "via")).alias("m"), F.first("level").alias("level"))
        state = least.select("side", "source", "node", "m.*", "level")
        if (k + 1) % CLIMBED == 0 or k + 1 == index.height:
            state, after = written(state, "labels")
            remove(spark, [path])
            path = after
    return state.drop("level")


def _hops(label, at: int, source: int) -> list[int]:
    """The nodes of a climb, from its last to ``source``."""
    nodes, _, via = label
    out = [int(nodes[at])]
    while out[-1] != source:
        out.append(int(via[np.searchsorted(nodes, out[-1])]))
    return out


def _meetings(index_core: np.ndarray, costs: np.ndarray, hops: bool):
    """Meets two labels per row: the least cost and, with ``hops``, the nodes of the path as the index has it."""

    def places(nodes):
        at = np.minimum(np.searchsorted(index_core, nodes), max(len(index_core) - 1, 0))
        inside = np.flatnonzero(index_core[at] == nodes) if len(index_core) else np.empty(0, np.int64)
        return inside, at[inside]

    def meet(batches):
        known, reach = None, None
        for batch in batches:
            columns = [batch.column(k) for k in range(8)]
            lists = [(c.offsets.to_numpy() - c.offsets[0].as_py(), c.flatten().to_numpy(zero_copy_only=False)) for c in columns[2:]]
            origins, targets = columns[0].to_pylist(), columns[1].to_pylist()
            rows, best, found = [], [], []
            for k, (o, t) in enumerate(zip(origins, targets)):
                label = [x[offsets[k] : offsets[k + 1]] for offsets, x in lists]
                there, back = label[:3], label[3:]
                common, i, j = np.intersect1d(there[0], back[0], assume_unique=True, return_indices=True)
                least, ends = np.inf, None
                if len(common):
                    sums = there[1][i] + back[1][j]
                    m = int(sums.argmin())
                    least, ends = sums[m], (i[m], j[m])
                if known != o:  # pairs come sorted by origin
                    inside, at = places(there[0])
                    through = there[1][inside][:, None] + costs[at] if len(inside) else None
                    known, reach = o, (through.min(axis=0), inside[through.argmin(axis=0)]) if len(inside) else None
                inside, at = places(back[0])
                if reach is not None and len(inside):
                    sums = reach[0][at] + back[1][inside]
                    m = int(sums.argmin())
                    if sums[m] < least:
                        least, ends = sums[m], (reach[1][at[m]], inside[m])
                if ends is None or not np.isfinite(least):
                    continue
                rows.append(k)
                best.append(float(least))
                if hops:
                    nodes = [*_hops(there, ends[0], o)[::-1], *_hops(back, ends[1], t)]
                    found.append([x for n, x in enumerate(nodes) if not n or x != nodes[n - 1]])
            out = [columns[0].take(pa.array(rows, pa.int64())), columns[1].take(pa.array(rows, pa.int64())), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(found, pa.list_(pa.int64()))] if hops else []), ["origin", "destination", "dist", "hops"][: 3 + hops])

    return meet


def _met(index: HubIndex, pairs: DataFrame, hops: bool) -> DataFrame:
    asked = pairs.select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("destination")).where("origin is not null and destination is not null").distinct()
    ends = asked.select(F.lit(0).alias("side"), F.col("origin").alias("source")).union(asked.select(F.lit(1), "destination"))
    entries = F.array_sort(F.collect_list(F.struct("node", "dist", "via"))).alias("e")  # as many as a node's climbs reach
    labels, _ = written(hub_labels(index, ends).groupBy("side", "source").agg(entries), "labels")
    side = lambda k, name: labels.where(F.col("side") == k).select(F.col("source").alias(name), *(F.col(f"e.{c}").alias(f"{c}{k}") for c in ("node", "dist", "via")))
    both = asked.join(side(1, "destination"), "destination").join(side(0, "origin"), "origin").sortWithinPartitions("origin")
    both = both.select("origin", "destination", "node0", "dist0", F.transform("via0", lambda x: F.coalesce(x, F.lit(-1).cast("long"))).alias("via0"), "node1", "dist1", F.transform("via1", lambda x: F.coalesce(x, F.lit(-1).cast("long"))).alias("via1"))
    return both.mapInArrow(_meetings(index.core, index.costs, hops), "origin long, destination long, dist double" + (", hops array<long>" if hops else ""))


def pair_costs(index: HubIndex, pairs: DataFrame) -> DataFrame:
    """Least costs of ``pairs`` (origin, destination): origin, destination, dist.

    Pairs count once; those with a null and those without a path have no row; a node's cost to
    itself is 0, also where the network lacks it.
    """
    return _met(index, pairs, False)


def pair_paths(index: HubIndex, pairs: DataFrame) -> DataFrame:
    """The edges of a least path of each of ``pairs``: origin, destination, u, v, back (edges from the end).

    Where several paths tie one of them is taken, the same in every run. A round of unpacking replaces each shortcut by
    the two steps it stands for; the rounds are at most the index's levels and those of the core.
    """
    spark = pairs.sparkSession
    if (trees := matrix_trees(index, pairs.select("origin"))) is not None:
        asked = pairs.select(F.col("origin").cast("long").alias("origin"), F.col("destination").cast("long").alias("node")).distinct()
        return tree_edges(trees.join(asked, ["origin", "node"]).withColumnRenamed("node", "destination"), "origin", "destination")
    met, met_path = written(_met(index, pairs, True).where(F.size("hops") > 1), "met")
    hop = F.transform(F.sequence(F.lit(0), F.size("hops") - 2), lambda k: F.struct(F.get("hops", k).alias("u"), F.get("hops", k + 1).alias("v"), F.lpad(k.cast("string"), 6, "0").alias("place")))
    open_ = met.select("origin", "destination", F.inline(hop), F.lit(False).alias("whole"))
    shortcuts = index.steps.where("mid is not null").select("u", "v", "mid")
    done, open_path = [], met_path
    while True:
        for _ in range(UNPACKED):
            one = F.array(F.struct("u", "v", "place", F.lit(True).alias("whole")))
            halves = (F.struct(F.col("u"), F.col("mid").alias("v"), F.concat("place", F.lit("0")).alias("place"), F.lit(False).alias("whole")), F.struct(F.col("mid").alias("u"), F.col("v"), F.concat("place", F.lit("1")).alias("place"), F.lit(False).alias("whole")))
            open_ = open_.join(shortcuts, ["u", "v"], "left").select("origin", "destination", F.inline(F.when(F.col("mid").isNull(), one).otherwise(F.array(*halves))))
        found, path = written(open_, "unpacked")
        remove(spark, [open_path])
        done.append(found.where("whole"))
        open_, open_path = found.where("not whole"), path
        if open_.first() is None:
            break
        open_, open_path = written(open_, "open")
    back = F.row_number().over(Window.partitionBy("origin", "destination").orderBy(F.desc("place"))) - 1
    return _union(done).select("origin", "destination", "u", "v", back.alias("back"))
