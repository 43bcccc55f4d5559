"""Edge aggregates and traffic indicators over traversals (trip, edge, time, speed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["u", "v"]


def hour(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", F.hour("timedate"))


def enrich_traversals(trav: DataFrame, fixes: DataFrame, vehtype: int | None = None) -> DataFrame:
    """Each traversal with its fix's instant speed; traversals without a fix stay."""
    out = trav.join(fixes.select(F.col("id").alias("idtrace"), "speed"), "idtrace", "left")
    return out if vehtype is None else out.where(F.col("vehtype") == vehtype)


def _share_of_max(counts: DataFrame, by: list[str], least: int) -> DataFrame:
    top = counts.groupBy(*by).agg(F.max("counts").alias("top")) if by else counts.agg(F.max("counts").alias("top"))
    out = counts.join(top, by) if by else counts.crossJoin(F.broadcast(top))
    out = out.withColumn("frequency", F.bround(F.col("counts") / F.col("top") * 100, 0).cast("int"))
    return out.where(F.col("frequency") >= least).drop("top")


def edge_frequency(trav: DataFrame, min_pct: int = 35) -> DataFrame:
    """Traversals of each edge, in percent of the busiest edge; edges at ``min_pct`` or more."""
    return _share_of_max(trav.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("counts")), [], min_pct)


def edge_frequency_dow(trav: DataFrame, min_pct: int = 35) -> DataFrame:
    """As ``edge_frequency`` within each month and weekday (Monday 0)."""
    parts = trav.groupBy(F.month("timedate").alias("month"), F.weekday("timedate").alias("weekday"), *EDGE)
    return _share_of_max(parts.agg(F.count(F.lit(1)).alias("counts")), ["month", "weekday"], min_pct)


def edge_load(trav: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Load of each edge in percent of the largest count, and its scale from 0 to 7."""
    counts = trav.groupBy(*(by or []), *EDGE).agg(F.count(F.lit(1)).alias("counts"))
    out = counts.crossJoin(F.broadcast(counts.agg(F.max("counts").alias("top"))))
    return out.select(*(by or []), *EDGE, "counts", (F.bround(F.col("counts") / F.col("top"), 4) * 100).alias("load"), (F.col("counts") / F.col("top") * 7).alias("scales"))


def edge_count_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges with more traversals in period ``a`` than in ``b``."""
    one = a.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("ca"))
    two = b.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("cb"))
    diff = F.coalesce("ca", F.lit(0)) - F.coalesce("cb", F.lit(0))
    return one.join(two, EDGE, "full_outer").select(*EDGE, diff.alias("diff")).where("diff > 0")


def edge_speed_time(trav: DataFrame, edges: DataFrame) -> DataFrame:
    """Truncated mean speed (km/h), traversals and travel time (s) of each edge."""
    per = trav.groupBy(*EDGE).agg(F.floor(F.avg("mean_speed")).cast("int").alias("travel_speed"), F.count(F.lit(1)).alias("counts"))
    out = per.join(edges.select(*EDGE, "length"), EDGE)
    return out.withColumn("travel_time", F.bround(F.col("length") / 1000 / F.col("travel_speed") * 3600, 4))


def hourly_flux(trav: DataFrame, mode: str = "mean") -> DataFrame:
    """FLUX per edge and hour: the mean over dates of daily counts, or with ``total`` their sum."""
    daily = hour(trav).groupBy(*EDGE, "hour", F.to_date("timedate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    flux = F.avg("n") if mode == "mean" else F.sum("n").cast("double")
    return daily.groupBy(*EDGE, "hour").agg(flux.alias("FLUX"))


def hourly_profile(flux: DataFrame) -> DataFrame:
    """Total FLUX of the network in each hour."""
    return flux.groupBy("hour").agg(F.bround(F.sum("FLUX"), 6).alias("FLUX"))


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def peak_hours(flux: DataFrame) -> DataFrame:
    """Hour and FLUX of each edge's busiest and quietest hour, the earliest of equals."""
    return flux.groupBy(*EDGE).agg(
        F.min_by("hour", F.struct(-F.col("FLUX"), "hour")).alias("peak_hour"), F.max("FLUX").alias("peak_flux"),
        F.min_by("hour", F.struct("FLUX", "hour")).alias("low_hour"), F.min("FLUX").alias("low_flux"),
    )


def hourly_speed(enriched: DataFrame) -> DataFrame:
    """Truncated mean instant speed of each edge and hour."""
    return hour(enriched).groupBy(*EDGE, "hour").agg(F.floor(F.avg("speed")).cast("int").alias("speed"))


def congestion_index(flux: DataFrame, speed: DataFrame, min_flux: float = 10) -> DataFrame:
    """|1 - peak speed / off-peak speed| of edges whose peak FLUX is ``min_flux`` or more, and its share of the largest.

    Edges with a speed of zero at either hour and indices above 1 are left out.
    """
    peaks = peak_hours(flux)
    at = lambda name: speed.select(*EDGE, F.col("hour").alias(f"{name}_hour"), F.col("speed").alias(f"{name}_speed"))
    both = peaks.join(at("peak"), [*EDGE, "peak_hour"]).join(at("low"), [*EDGE, "low_hour"])
    both = both.where((F.col("peak_speed") != 0) & (F.col("low_speed") != 0) & (F.col("peak_flux") >= min_flux))
    ci = both.withColumn("ci", F.abs(1 - F.col("peak_speed") / F.col("low_speed"))).where("ci <= 1")
    out = ci.crossJoin(F.broadcast(ci.agg(F.max("ci").alias("top"))))
    return out.select(*EDGE, "peak_hour", "low_hour", "peak_flux", "peak_speed", "low_speed", F.bround("ci", 6).alias("ci"), F.bround(F.col("ci") / F.col("top"), 2).alias("congestion"))


def drop_stub_edges(edges: DataFrame, max_len: float = 28) -> DataFrame:
    """Without short edges into nodes that no edge leaves."""
    leaves = edges.select(F.col("u").alias("v")).distinct()
    stubs = edges.where(F.col("length") <= max_len).join(leaves, "v", "left_anti").select(*EDGE).distinct()
    return edges.join(stubs, EDGE, "left_anti")


def min_records(trav: DataFrame, least: int = 15) -> DataFrame:
    """Traversals of edges that have ``least`` or more."""
    seen = trav.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return trav.join(seen.select(*EDGE), EDGE, "left_semi")


def select_edges(trav: DataFrame, fixes: DataFrame, pairs: DataFrame, edges: DataFrame, vehicles: DataFrame, max_speed: int = 200) -> DataFrame:
    """Traversals of the edges in ``pairs``: their number and median speeds per edge and vehicle type, with road class and length.

    ``vehicles`` has idterm and vehtype (see ``vehicle_types``); the vehicle is the trip's ``idterm``.
    """
    found = trav.where(F.col("mean_speed") < max_speed).drop("vehtype").join(pairs.select(*EDGE).distinct(), EDGE, "left_semi")
    out = enrich_traversals(found, fixes).join(vehicles.select("idterm", "vehtype"), "idterm", "left").groupBy(*EDGE, "vehtype")
    out = out.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("idterm").alias("vehicles"), F.median("mean_speed").alias("median_speed"), F.median("speed").alias("median_instant"))
    return out.join(edges.select(*EDGE, "highway", "length"), EDGE, "left")


def speed_distribution(trav: DataFrame) -> DataFrame:
    """Per edge and mean speed: records and the percent of the edge's records."""
    per = trav.groupBy(*EDGE, "mean_speed").agg(F.count(F.lit(1)).alias("records"))
    total = trav.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("total"))
    return per.join(total, EDGE).withColumn("time_pct", F.bround(F.col("records") / F.col("total") * 100, 0).cast("int"))


def edge_density(trav: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean records of an edge at one moment (rounded, then whole) and that per kilometre."""
    same = trav.groupBy(*EDGE, "timedate").agg(F.count(F.lit(1)).alias("n"))
    mean = same.groupBy(*EDGE).agg(F.bround(F.avg("n"), 1).cast("int").alias("vehicles"))
    return mean.join(edges.select(*EDGE, "length"), EDGE).select(*EDGE, "vehicles", F.bround(F.col("vehicles") / (F.col("length") / 1000), 6).alias("density"))


def flux_15min(trav: DataFrame) -> DataFrame:
    """Vehicles per hour of each edge: the mean over its quarters of an hour of count / 0.25."""
    quarter = trav.groupBy(*EDGE, F.window(F.col("timedate").cast("timestamp"), "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return quarter.groupBy(*EDGE).agg(F.bround(F.avg(F.col("n") / 0.25), 6).alias("flux"))


#: km/h of each road class that its level of service is judged by (fixed values).
CLASS_LIMIT = {
    "residential": 50, "secondary": 90, "primary": 70, "tertiary": 70, "unclassified": 60, "secondary_link": 55, "trunk": 90, "tertiary_link": 50,
    "primary_link": 90, "motorway_link": 100, "trunk_link": 70, "motorway": 130, "living_street": 50, "road": 30, "other": 30, "service": 30,
}
#: Classes that are judged.
JUDGED = ("motorway", "motorway_link", "secondary", "primary", "tertiary", "residential", "unclassified", "trunk", "trunk_link", "tertiary_link", "secondary_link", "service")


def class_limits(edges: DataFrame) -> DataFrame:
    """Edges of judged classes with maxspeed, their class's limit."""
    table = F.create_map(*(F.lit(x) for pair in CLASS_LIMIT.items() for x in pair))
    return edges.where(F.col("highway").isin(*JUDGED)).withColumn("maxspeed", F.try_element_at(table, F.col("highway")))


#: Level of service: (grade, class, share of time in %, density, speed at limit 50, speed at limit 90),
#: each an open range (fixed values).
LOS_BANDS = (
    ("A", 1, (85, None), (None, 7), (42.2, None), (76.5, None)),
    ("B", 1, (67, 85), (7, 11), (33.5, 42.2), (60.3, 76.5)),
    ("C", 2, (50, 67), (11, 17), (25, 33.5), (45, 60.3)),
    ("D", 3, (40, 50), (17, 22), (20, 25), (36, 45)),
    ("E", 3, (30, 40), (22, 28), (15, 20), (27, 36)),
    ("F", 3, (None, 30), (28, None), (None, 15), (None, 27)),
)
#: The same for other limits, by share of time and speed alone (fixed values; a share of 35 counts for A).
LOS_OTHER = (("A", 1, (None, 35.0001), (90, None)), ("B", 1, (35, 50), (80, 90)), ("C", 2, (50, 65), (70, 80)), ("D", 3, (65, 80), (60, 70)), ("E", 3, (80, None), (None, 35)))


def _within(column: str, low, high) -> Column:
    x, good = F.col(column), F.lit(True)
    good = good & (x > low) if low is not None else good
    return good & (x < high) if high is not None else good


def level_of_service(edges: DataFrame) -> DataFrame:
    """Grade A to F and class 1 to 3 of edges with time_pct, maxspeed, speed and density.

    A band holds at one limit by the share of time alone, at the other by speed and density; the
    first band that holds counts, and an edge in none is graded A.
    """
    chosen = None
    for grade, number, time, density, at50, at90 in LOS_BANDS:
        for limit, other, speed in ((50, 90, at50), (90, 50, at90)):
            by_time = _within("time_pct", *time) & (F.col("maxspeed") == limit)
            if grade == "A":
                by_time = by_time if limit == 50 else F.lit(False)
            by_flow = (F.col("maxspeed") == other) & _within("speed", *speed) & _within("density", *density)
            if grade == "A" and limit == 90:
                by_flow = _within("time_pct", *time) & F.col("maxspeed").isin(50, 90) & _within("speed", *speed) & _within("density", *density)
            pick = F.struct(F.lit(grade).alias("LOS"), F.lit(number).alias("los_class"))
            chosen = F.when(by_time | by_flow, pick) if chosen is None else chosen.when(by_time | by_flow, pick)
    for grade, number, time, speed in LOS_OTHER:
        chosen = chosen.when(_within("time_pct", *time) & _within("speed", *speed), F.struct(F.lit(grade).alias("LOS"), F.lit(number).alias("los_class")))
    chosen = chosen.otherwise(F.struct(F.lit("A").alias("LOS"), F.lit(1).alias("los_class")))
    return edges.withColumn("_los", chosen).select(*edges.columns, "_los.LOS", "_los.los_class")


def chain_edges(edges: DataFrame) -> DataFrame:
    """Each edge with the edges that go on from its end, but not straight back."""
    after = edges.select(F.col("u").alias("v"), F.col("v").alias("next_v"))
    return edges.select(*EDGE).join(after, "v").where("next_v <> u").select(*EDGE, F.col("v").alias("next_u"), "next_v")


def trip_od(trav: DataFrame) -> DataFrame:
    """Origin and destination of each trip: start of its first edge, end of its last."""
    return trav.groupBy("idtrajectory").agg(F.min_by("u", "sequenza").alias("ORIGIN"), F.max_by("v", "sequenza").alias("DESTINATION"))


def top_od(trav: DataFrame) -> DataFrame:
    """Origin and destination pairs with the most trips, all of equals."""
    n = trip_od(trav).groupBy("ORIGIN", "DESTINATION").agg(F.count(F.lit(1)).alias("trips"))
    return n.join(F.broadcast(n.agg(F.max("trips").alias("trips"))), "trips").select("ORIGIN", "DESTINATION", "trips")


def daily_km(fixes: DataFrame, min_km: float = 10000) -> DataFrame:
    """Kilometres on the odometers per date, dates above ``min_km``."""
    return fixes.groupBy(F.to_date("timedate").alias("day")).agg((F.sum("progressive") / 1000).alias("km")).where(F.col("km") > min_km)
