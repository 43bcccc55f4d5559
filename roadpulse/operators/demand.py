"""Origin-destination demand, sub-networks and closure vulnerability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.store import kept
from roadpulse.operators import hubs
from roadpulse.operators.network import path_edges, shortest_paths
from roadpulse.operators.repair import repaired_costs
from roadpulse.operators.traffic import EDGE, edge_speed_time
from roadpulse.operators.traffic import trip_od as ends_of_trips


def trip_od(trav: DataFrame) -> DataFrame:
    """Distinct (u, v, ORIGIN, DESTINATION): the trips' ends for every edge they cross."""
    return trav.select("idtrajectory", *EDGE).join(ends_of_trips(trav), "idtrajectory").select(*EDGE, "ORIGIN", "DESTINATION").distinct()


def heavy_subnetwork(trav: DataFrame, edges: DataFrame, vehtype: int = 2) -> DataFrame:
    """Speed and travel time, over all traffic, of the edges that a vehicle type uses."""
    used = trav.where(F.col("vehtype") == vehtype).select(*EDGE).distinct()
    return edge_speed_time(trav.join(used, EDGE, "left_semi"), edges)


def peak_slice(trav: DataFrame, month: int, part: str = "morning") -> DataFrame:
    """Traversals of a month's working days at the morning (7 to 8) or evening (17 to 18) peak."""
    hours = (7, 8) if part == "morning" else (17, 18)
    return trav.where((F.month("timedate") == month) & (F.weekday("timedate") < 5) & F.hour("timedate").isin(*hours))


def travel_demand(paths: DataFrame, counts: DataFrame, months: int = 1, hours: int = 16, tags: tuple[str, ...] = ()) -> DataFrame:
    """Vehicles per hour along each path (origin, destination): summed counts of its edges / months / 30 / hours.

    ``tags`` are columns of ``counts``, such as the day, of whose values each has a demand of its own.
    """
    on = paths.join(counts, EDGE).groupBy(*tags, "origin", "destination")
    return on.agg((F.sum("counts") / months / 30 / hours).alias("demand"))


def travel_demand_15min(paths: DataFrame, trav: DataFrame) -> DataFrame:
    """Vehicles per hour along each path: the mean, over its quarters of an hour with traffic, of the records per edge and quarter / 0.25."""
    quarter = trav.groupBy(*EDGE, F.window(F.col("timedate").cast("timestamp"), "15 minutes").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    quarter = kept(quarter.select(*EDGE, F.col("q.start").alias("q"), "n"), "quarters")
    # paths are partitioned by pair before, in a set number of parts as their rows multiply; where quarters are few enough to be broadcast, the
    # rows of each edge and quarter of a path aren't shuffled
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = paths.repartition(n, "origin", "destination").join(quarter, EDGE).groupBy("origin", "destination", "q").agg(F.avg("n").alias("n"))
    return per.groupBy("origin", "destination").agg((F.avg("n") / 0.25).alias("demand"))


def delay(demand: Column, dt: Column, closed_h: float) -> Column:
    """Delay of a demand while edges are closed for ``closed_h`` hours: detours of ``dt`` hours, or waiting if those are longer."""
    return F.when(dt < closed_h, demand * dt * (closed_h - dt / 2)).otherwise(demand * closed_h * closed_h / 2)


def closure_detours(cell_edges: DataFrame, od: DataFrame, edges: DataFrame, penalty: float = 18000, weight: str = "cost") -> DataFrame:
    """(cell, origin, destination, dt) of closing all edges of a cell, for the cells on the pair's path; dt in hours.

    Trees of least paths are grown once, without closures; those of a network that the matrix of a hub index holds are read off it. A cell's closure makes its edges
    ``penalty`` seconds longer; only what lies below them in an origin's tree is computed again.
    """
    closed = cell_edges.select("cell", *EDGE).distinct()
    few = edges.select("u").union(edges.select("v")).distinct().limit(hubs.CORE + 1).count() <= hubs.CORE
    trees = hubs.matrix_trees(hubs.hub_index(edges, weight), od.select("origin")) if few else None
    if trees is None:
        base, below = shortest_paths(edges, od.select("origin"), weight), None
        along = path_edges(base, od.select("origin", "destination"))
        crossed = kept(along.join(closed, EDGE).select("cell", "origin", "destination").distinct(), "crossed")
    else:  # a small network's trees come with their paths
        base = kept(trees, "trees")
        below = hubs.tree_edges(base, "origin", "node").join(closed, EDGE).groupBy("cell", "origin", "node").agg(F.count(F.lit(1)).alias("n"))
        below = kept(below, "below")
        pairs = od.select("origin", F.col("destination").alias("node")).distinct()
        crossed = below.join(pairs, ["origin", "node"]).select("cell", "origin", F.col("node").alias("destination"))
    then = repaired_costs(base, edges, closed, crossed, weight, penalty, below)
    before = base.select("origin", F.col("node").alias("destination"), F.col("dist").alias("t0"))
    return then.join(before, ["origin", "destination"]).select("cell", "origin", "destination", ((F.col("dist") - F.col("t0")) / 3600).alias("dt"))


def detour_impact(detours: DataFrame, demand: DataFrame, penalty: float = 18000) -> DataFrame:
    """``detours`` with the delay of each pair's demand: (further columns of ``demand``), cell, origin, destination, dt, delay."""
    tags = [c for c in demand.columns if c not in ("origin", "destination", "demand")]
    out = detours.join(demand, ["origin", "destination"])
    return out.select(*tags, "cell", "origin", "destination", F.bround("dt", 9).alias("dt"), F.bround(delay(F.col("demand"), F.col("dt"), penalty / 3600), 6).alias("delay"))


def closure_impact(cell_edges: DataFrame, od: DataFrame, edges: DataFrame, demand: DataFrame, penalty: float = 18000) -> DataFrame:
    """(cell, origin, destination, dt, delay) of closing all edges of a cell; ``edges`` has cost in seconds. See ``closure_detours``."""
    return detour_impact(closure_detours(cell_edges, od, edges, penalty), demand, penalty)


def cell_importance(impacts: DataFrame, cell_edges: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """Summed delay of each cell, whole, for each of its edges; ``tags`` are columns of ``impacts`` of whose values each has sums of its own."""
    per = impacts.groupBy(*tags, "cell").agg(F.floor(F.sum("delay")).cast("long").alias("importance"))
    return cell_edges.select(*EDGE, "cell").distinct().join(per, "cell").select(*tags, *EDGE, "cell", "importance")


def normalise_vulnerability(df: DataFrame, tags: tuple[str, ...] = (), per_edge: bool = False) -> DataFrame:
    """Importance relative to the largest, and its scale, for each edge and cell or, with ``per_edge``, each edge (the sum over its cells).

    With ``tags`` (such as month and day) each of their values has a largest of its own.
    """
    key = [*EDGE] if per_edge else [*EDGE, "cell"]
    rows = df.groupBy(*tags, *EDGE).agg(F.sum("importance").alias("importance")) if per_edge else df
    top = rows.groupBy(*tags).agg(F.max("importance").alias("_top")) if tags else rows.agg(F.max("importance").alias("_top"))
    out = rows.join(top, list(tags)) if tags else rows.crossJoin(F.broadcast(top))
    share = F.col("importance") / F.col("_top")
    return out.select(*tags, *key, F.bround(share, 4).alias("importance"), F.bround(share * 3 + 0.1, 4).alias("scales"))


def vulnerability_difference(everyone: DataFrame, heavy: DataFrame) -> DataFrame:
    """Importance for all traffic less that for heavy traffic, where both have the edge and cell."""
    both = everyone.join(heavy.select(*EDGE, "cell", F.col("importance").alias("h")), [*EDGE, "cell"])
    return both.select(*EDGE, "cell", (F.col("importance") - F.col("h")).alias("difference"))


def vulnerability_summary(vuln: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean importance in percent by direction, month and day over the edges of ``pairs`` (u, v, direction)."""
    return vuln.join(pairs, EDGE).groupBy("direction", "month", "day").agg(F.bround(F.avg("importance") * 100, 4).alias("mean_pct"))


def route_vulnerability(vuln: DataFrame, route: DataFrame, edges: DataFrame) -> DataFrame:
    """Vulnerability of a route's edges, with their road class and length."""
    return vuln.join(route.select(*EDGE).distinct(), EDGE, "left_semi").join(edges.select(*EDGE, "highway", "length"), EDGE, "left")


def edge_endpoints(trav: DataFrame, nodes: DataFrame, keep: DataFrame) -> DataFrame:
    """For each edge of ``keep``: distinct origins and destinations of its trips, with their coordinates."""
    on = trav.join(keep.select(*EDGE).distinct(), EDGE, "left_semi").select(*EDGE, "idtrajectory").distinct()
    ends = on.join(ends_of_trips(trav), "idtrajectory").select(*EDGE, "ORIGIN", "DESTINATION").distinct()
    at = lambda col, p: nodes.select(F.col("node").alias(col), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
    return ends.join(at("ORIGIN", "o"), "ORIGIN").join(at("DESTINATION", "d"), "DESTINATION").select(*EDGE, "ORIGIN", "DESTINATION", "o_x", "o_y", "d_x", "d_y")
