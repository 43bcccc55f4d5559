"""Places of vehicles: homes, works, nights and points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import cell, haversine
from roadpulse.functions.store import kept
from roadpulse.operators.clusters import density_clusters


def _boxed(stops: DataFrame, dlon: float, dlat: float) -> DataFrame:
    """(idterm, a, b, bx, by, weight): stops b inside the box around stop a, by a join on grid cells of the box's size."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = stops.withColumn("_c", F.explode(around)).select("idterm", F.col("id").alias("a"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), (cell(F.col("lon"), dlon) + F.col("_c.i")).alias("cx"), (cell(F.col("lat"), dlat) + F.col("_c.j")).alias("cy"))
    b = stops.select("idterm", F.col("id").alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by"), "weight", cell(F.col("lon"), dlon).alias("cx"), cell(F.col("lat"), dlat).alias("cy"))
    near = (F.abs(F.col("ax") - F.col("bx")) <= dlon) & (F.abs(F.col("ay") - F.col("by")) <= dlat)
    return a.join(b, ["idterm", "cx", "cy"]).where(near).select("idterm", "a", "b", "bx", "by", "weight")


def home_locations(stops: DataFrame, dlon: float = 0.0065, dlat: float = 0.0045, rounds: int = 2, least: int = 2) -> DataFrame:
    """(idterm, rank, lon, lat, n): the fullest boxes around a vehicle's stops (id, idterm, lon, lat).

    The box with most stops, the smallest id of equals, is the first place; its stops are set
    aside and the rest gives the second. Boxes of fewer than ``least`` stops are none.
    """
    found = None
    # stops at the very same place are one point with a weight, so a depot's stops are not paired with each other
    rest = kept(stops.groupBy("idterm", "lon", "lat").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "points")
    for k in range(rounds):
        pairs = kept(_boxed(rest, dlon, dlat), "boxes")
        size = pairs.groupBy("idterm", "a").agg(F.sum("weight").alias("n")).where(F.col("n") >= least)
        best = size.groupBy("idterm").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a"))
        members = kept(pairs.join(best, ["idterm", "a"]), "members")
        mean = lambda c: F.bround(F.bround(F.sum(F.col(c) * F.col("weight")) / F.sum("weight"), 9), 6)
        place = members.groupBy("idterm").agg(F.lit(k + 1).alias("rank"), mean("bx").alias("lon"), mean("by").alias("lat"), F.sum("weight").alias("n"))
        found = place if found is None else found.unionByName(place)
        rest = kept(rest.join(members.select("idterm", F.col("b").alias("id")), ["idterm", "id"], "left_anti"), "points")
    return found


def work_locations(stops: DataFrame, min_h: float = 2, **box) -> DataFrame:
    """As ``home_locations`` over stops longer than ``min_h`` hours (column stop_h)."""
    return home_locations(stops.where(F.col("stop_h") > min_h), **box)


def label_stops(stops: DataFrame, homes: DataFrame, works: DataFrame, dlon: float = 0.0065, dlat: float = 0.0045) -> DataFrame:
    """``stops`` with the codes of the places they lie in, and start_class, the code at the vehicle's next record.

    ``stops`` has id, idterm, timedate, lon, lat, stop_class (220 night, 210 day, 0 none, 5 irregular)
    and flag (see ``trip_flags``). Night and day stops become 221 and 211 in the first home, 222
    and 212 in the second; of the others those with flag 21 become 227 and 217, and day stops 215
    and 216 in the works. The next record but irregular ones has the code less 100, or at a
    border crossing (flag 11) that of the border if the stop has no place.
    """
    out = stops
    for places, name in ((homes, "_h"), (works, "_w")):
        wide = places.groupBy("idterm").agg(*(F.max(F.when(F.col("rank") == k, F.struct("lon", "lat"))).alias(f"{name}{k}") for k in (1, 2)))
        out = out.join(wide, "idterm", "left")
    inside = lambda c: (F.abs(F.col("lon") - F.col(f"{c}.lon")) < dlon) & (F.abs(F.col("lat") - F.col(f"{c}.lat")) < dlat)
    old, plain = F.col("stop_class"), F.col("stop_class").isin(210, 220)
    code = F.when(plain & inside("_h1"), old + 1).when(plain & inside("_h2"), old + 2).when(plain & (F.col("flag") == 21), old + 7)
    code = code.when((old == 210) & inside("_w1"), 215).when((old == 210) & inside("_w2"), 216).otherwise(old)
    out = out.withColumn("stop_class", code).drop("_h1", "_h2", "_w1", "_w2")
    w = Window.partitionBy("idterm").orderBy("timedate", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("stop_class") != 5, F.col("stop_class")), ignorenulls=True).over(w)
    start = F.when(last >= 200, F.when((F.col("flag") == 11) & last.isin(210, 220), last - 93).otherwise(last - 100)).otherwise(0)
    return out.withColumn("start_class", F.when(F.col("stop_class") == 5, 5).otherwise(F.coalesce(start, F.lit(0))))


def poi_visits(stops: DataFrame, lon: float, lat: float, km: float = 1.0) -> DataFrame:
    """Stops inside a box of ``km`` kilometres around a point."""
    half_lat = km / 2 / 111.195
    return stops.where((F.abs(F.col("latitude") - lat) <= half_lat) & (F.abs(F.col("longitude") - lon) * F.cos(F.radians(F.lit(lat))) <= half_lat))


def vehicle_profile(fixes: DataFrame, labelled: DataFrame, homes: DataFrame, works: DataFrame, poi: DataFrame | None = None, min_fixes: int = 3) -> DataFrame:
    """Per vehicle: presence, kilometres, places, nights, border crossings, stops at a point of interest and working days.

    Columns: idterm, days (with more than ``min_fixes`` fixes), km (rises of the odometer), homes,
    works, nights_in and nights_out (night stops by flag 20, or 21 to 23), nights_home1,
    nights_home2, crossings, poi_stops, days_work1, days_work2. ``labelled`` is from
    ``label_stops``; ``poi`` from ``poi_visits``.
    """
    w = Window.partitionBy("idterm").orderBy("timedate", "id")
    rise = F.greatest(F.coalesce(F.col("progressive") - F.lag("progressive").over(w), F.lit(0)), F.lit(0))
    day = fixes.withColumn("_rise", rise).groupBy("idterm", F.to_date("timedate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("_rise").alias("m"))
    out = day.groupBy("idterm").agg(F.count_if(F.col("n") > min_fixes).alias("days"), (F.sum("m") / 1000).alias("km"))
    counted = lambda places, name: places.groupBy("idterm").agg(F.count(F.lit(1)).alias(name))
    night = F.col("stop_class").between(220, 229)
    at_work = lambda code: F.count_distinct(F.when(F.col("start_class") == code, F.to_date("timedate")))
    seen = labelled.groupBy("idterm").agg(
        F.count_if(night & (F.col("flag") == 20)).alias("nights_in"), F.count_if(night & F.col("flag").isin(21, 22, 23)).alias("nights_out"),
        F.count_if(F.col("stop_class") == 221).alias("nights_home1"), F.count_if(F.col("stop_class") == 222).alias("nights_home2"),
        F.count_if(F.col("start_class") == 117).alias("crossings"), at_work(115).alias("days_work1"), at_work(116).alias("days_work2"),
    )
    out = out.join(counted(homes, "homes"), "idterm", "left").join(counted(works, "works"), "idterm", "left").join(seen, "idterm", "left")
    out = out.join(counted(poi, "poi_stops"), "idterm", "left") if poi is not None else out.withColumn("poi_stops", F.lit(0).cast("long"))
    return out.na.fill(0, ["homes", "works", "nights_in", "nights_out", "nights_home1", "nights_home2", "crossings", "days_work1", "days_work2", "poi_stops"])


def rejected_vehicles(fixes: DataFrame, flagged: DataFrame, least: int = 3) -> DataFrame:
    """Vehicles left out, with their records: reason 1 for starts and ends that don't pair, 2 for fewer than ``least`` trips.

    ``flagged`` has idterm and flag (10 to 19 a start, 20 and above an end).
    """
    per = flagged.groupBy("idterm").agg(F.count_if(F.col("flag").between(10, 19)).alias("starts"), F.count_if(F.col("flag") >= 20).alias("ends"))
    reason = F.when(F.col("starts") != F.col("ends"), 1).when(F.col("starts") < least, 2)
    records = fixes.groupBy("idterm").agg(F.count(F.lit(1)).alias("records"))
    return records.join(per.withColumn("reason", reason).where("reason is not null"), "idterm").select("idterm", "records", "reason")


def parking_nights(route: DataFrame, fixes: DataFrame, least_s: int = 14400, shift_h: int = 2) -> DataFrame:
    """Nights of stops longer than four hours, at the trip's last fix, in local time.

    A stop of one day is a night if it begins before three; of two days, one if it ends before
    three and did not begin before, else one or two by whether it began before three; of more
    days, their number.
    """
    at = fixes.select(F.col("id").alias("idtrace_d"), "longitude", "latitude", (F.col("timedate") + F.expr(f"INTERVAL {shift_h} HOURS")).alias("from"))
    out = route.where(F.col("breaktime_s") > least_s).join(at, "idtrace_d").withColumn("to", F.col("from") + F.make_dt_interval(secs=F.col("breaktime_s")))
    days, early = F.datediff("to", "from"), F.hour("from") < 3
    nights = F.when((days == 0) & early, 1).when(days == 0, 0).when(early, days + 1).when((days == 1) & (F.hour("to") < 3), 1).otherwise(days)
    return out.withColumn("n_nights", nights).where("n_nights > 0").select("idterm", "idtrace_d", "longitude", "latitude", "n_nights")


def night_place(stops: DataFrame, eps_m: float = 120, min_records: int = 3, min_points: int = 1) -> DataFrame:
    """Per vehicle with enough stops: the DBSCAN cluster with most nights (id, idterm, longitude, latitude, n_nights).

    Clusters are those of ``density_clusters``; of equal ones that of the smallest label is taken.
    Returns idterm, n_points, n_nights and the centre.
    """
    w = Window.partitionBy("idterm")
    s = kept(stops.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= min_records).drop("_n"), "stops")
    reach = density_clusters(s, eps_m, min_points)
    size = reach.join(s, ["idterm", "id"]).groupBy("idterm", "label").agg(F.count(F.lit(1)).alias("n_points"), F.sum("n_nights").alias("n_nights"), F.bround(F.avg("longitude"), 6).alias("longitude"), F.bround(F.avg("latitude"), 6).alias("latitude"))
    best = F.min_by(F.struct("n_points", "n_nights", "longitude", "latitude"), F.struct(-F.col("n_nights"), "label")).alias("m")
    return size.groupBy("idterm").agg(best).select("idterm", "m.*")


def nearest_residence(residences: DataFrame, nights: DataFrame) -> DataFrame:
    """The nearest residence (id, idterm, longitude, latitude) to each vehicle's night place, whole metres."""
    n = nights.select("idterm", F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    d = residences.join(n, "idterm").withColumn("distance", F.floor(haversine(F.col("longitude"), F.col("latitude"), F.col("x"), F.col("y")) * 1000).cast("long"))
    return d.groupBy("idterm").agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance"))
