"""Gateways: what flows through an edge, and what its closure does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.network import closure_routes
from roadpulse.operators.traffic import EDGE


def gateway_vehicles(trav: DataFrame, gateways: DataFrame, date: str | None = None) -> DataFrame:
    """Distinct (gateway, idterm) that cross a gateway (gateway, u, v), on a date or at all."""
    rows = trav if date is None else trav.where(F.to_date("timedate") == F.lit(date).cast("date"))
    return rows.join(gateways, EDGE).select("gateway", "idterm").distinct()


def downstream(trav: DataFrame, gateways: DataFrame) -> DataFrame:
    """Per gateway and vehicle: what follows its first crossing on that trip, the crossing included."""
    hits = trav.join(gateways, EDGE)
    at = F.struct("timedate", "idtrajectory", "sequenza")
    first = hits.groupBy("gateway", "idterm").agg(F.min_by(F.struct("idtrajectory", F.col("sequenza").alias("at")), at).alias("f")).select("gateway", "idterm", "f.idtrajectory", "f.at")
    return trav.join(first, ["idterm", "idtrajectory"]).where("sequenza >= at").drop("at")


def gateway_loads(down: DataFrame) -> DataFrame:
    """Counts per gateway and edge, relative to the gateway's largest: load (%) and scale (one decimal)."""
    per = down.groupBy("gateway", *EDGE).agg(F.count(F.lit(1)).alias("counts"))
    top = per.groupBy("gateway").agg(F.max("counts").alias("top"))
    share = F.col("counts") / F.col("top")
    return per.join(top, "gateway").select("gateway", *EDGE, "counts", F.bround(share, 1).alias("scales"), F.bround(share * 100, 4).alias("load"))


def merge_loads(loads: DataFrame, min_pct: float = 5) -> DataFrame:
    """Largest load of each edge over all gateways, above ``min_pct``."""
    return loads.groupBy(*EDGE).agg(F.max("load").alias("load")).where(F.col("load") > min_pct)


def trip_time_bands(down: DataFrame, loads: DataFrame, least_load: float = 26, most_min: float = 120, upto: int = 90) -> DataFrame:
    """Minutes of each trip after its gateway, whole, with the end of its band of five; trips under ``most_min`` over loaded edges."""
    good = down.join(loads.where(F.col("load") > least_load).select("gateway", *EDGE), ["gateway", *EDGE], "left_semi")
    time = good.groupBy("gateway", "idterm", "idtrajectory").agg(F.sum(F.col("length") / 1000 / F.col("mean_speed") * 60).alias("t")).where(F.col("t") < most_min)
    out = time.withColumn("minutes", F.floor(F.bround("t", 6)).cast("int")).drop("t")
    return out.withColumn("band", (F.ceil(F.col("minutes") / 5) * 5).cast("int")).where(F.col("band") <= upto)


def disrupted_loads(od: DataFrame, edges: DataFrame, closed: DataFrame, weight: str = "length") -> DataFrame:
    """Load (%) of each edge on the paths of distinct (origin, destination) with ``closed`` edges priced out."""
    return route_loads(disrupted_routes(od, edges, closed, weight))


def disrupted_routes(od: DataFrame, edges: DataFrame, closed: DataFrame, weight: str = "length") -> DataFrame:
    """The paths' edges (origin, destination, u, v, back) with ``closed`` edges priced out."""
    return closure_routes(edges, closed, od.select("origin", "destination").distinct(), weight)


def route_times(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Minutes, whole, of each path by the edges' cost in seconds."""
    cost = edges.groupBy(*EDGE).agg(F.min("cost").alias("_s"))
    return routes.join(cost, EDGE).groupBy("origin", "destination").agg(F.floor(F.bround(F.sum("_s") / 60, 6)).cast("int").alias("minutes"))


def route_loads(routes: DataFrame) -> DataFrame:
    """Paths on each edge, and their load in percent of the busiest edge."""
    per = routes.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("counts"))
    return per.crossJoin(F.broadcast(per.agg(F.max("counts").alias("top")))).select(*EDGE, "counts", F.bround(F.col("counts") / F.col("top") * 100, 4).alias("load"))


def high_load_routes(routes: DataFrame, least: float = 15, frac: float = 1 / 1.2) -> DataFrame:
    """Trips of which more than ``frac`` of the edges carry a load above ``least``: mean load, length and mean minutes of an edge.

    ``routes`` has idtrajectory, load, length and mean_speed (km/h).
    """
    per = routes.groupBy("idtrajectory").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("load") > least).alias("high"), F.bround(F.avg("load"), 6).alias("mean_load"), F.sum("length").alias("length"), F.bround(F.avg(F.col("length") / 1000 / F.col("mean_speed") * 60), 6).alias("mean_min"))
    return per.where(F.col("high") > F.col("n") * frac).select("idtrajectory", "mean_load", "length", "mean_min")


def road_loads(loads: DataFrame, edges: DataFrame, least: float = 51) -> DataFrame:
    """Roads (by ``name``) with a load above ``least``: their largest, rounded; blank names are dropped."""
    named = loads.join(edges.select(*EDGE, "name"), EDGE).where((F.col("load") > least) & (F.trim("name") != ""))
    return named.groupBy("name").agg(F.bround(F.max("load"), 0).alias("load"))
