"""Trips from fixes: splits, identifiers, anomaly codes and the trip table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import haversine
from roadpulse.operators.cleaning import BY_TIME, epoch, vehicle


def _numbered(df: DataFrame, starts) -> DataFrame:
    """trip_no: how many rows of the vehicle up to this one start a trip."""
    upto = vehicle().rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("_start", F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0))
    return flagged.withColumn("trip_no", F.sum("_start").over(upto)).drop("_start")


def _gap():
    return epoch("timedate") - epoch(F.lag("timedate").over(vehicle()))


def split_trips_gap(fixes: DataFrame, gap_s: int = 600) -> DataFrame:
    """A trip starts where the time since the vehicle's last fix is ``gap_s`` seconds or more."""
    return _numbered(fixes, _gap() >= gap_s)


def split_trips_engine(fixes: DataFrame, gap_s: int = 180) -> DataFrame:
    """A gap starts a trip if the engine is off (panel 0) now or before; for the fleet only at a stand from which it then moves."""
    w = vehicle()
    off = (F.col("panel") == 0) | (F.lag("panel").over(w) == 0)
    leaves = (F.lead("speed").over(w) > 0) & (F.col("speed") == 0)
    return _numbered(fixes, (_gap() >= gap_s) & off & ((F.col("vehtype") != 2) | leaves))


def split_trips_panel(fixes: DataFrame, gap_s: int = 600, jump_m: int = 10000) -> DataFrame:
    """State machine on panel 0 on, 1 moving, 2 off.

    A trip starts at the first fix, at 0, at 2 after 2, at 1 after 2, at a long gap into 1 from
    0 or 1, and at a jump of the odometer while not at 0.
    """
    w = vehicle()
    last, jump = F.lag("panel").over(w), F.col("progressive") - F.lag("progressive").over(w)
    p = F.col("panel")
    starts = last.isNull() | (p == 0) | ((p == 2) & (last == 2)) | ((p == 1) & (last == 2)) | ((p == 1) & (last <= 1) & (_gap() > gap_s)) | ((p != 0) & (jump > jump_m))
    return _numbered(fixes, starts)


def assign_trip_ids(split: DataFrame, drop_unsplit: bool = False) -> DataFrame:
    """TRIP_ID ``idterm_n``, idtrajectory (id of the trip's first fix) and segment (place in it, from 0)."""
    trip = Window.partitionBy("idterm", "trip_no").orderBy(*BY_TIME)
    out = split.withColumns({"TRIP_ID": F.concat_ws("_", "idterm", "trip_no"), "idtrajectory": F.first("id").over(trip), "segment": F.row_number().over(trip) - 1})
    if drop_unsplit:
        out = out.withColumn("_most", F.max("trip_no").over(Window.partitionBy("idterm"))).where("_most > 0").drop("_most")
    return out


def concat_trips_odometer(trips: DataFrame) -> DataFrame:
    """Trips between two resets of the odometer become one: TRIP_ID ``idterm_conc_k``, idtrajectory the id at the reset.

    Rows after the last reset keep their trip.
    """
    w = vehicle()
    out = trips.withColumn("_reset", F.when(F.col("progressive") < F.lag("progressive").over(w), 1).otherwise(0))
    out = out.withColumn("_k", F.sum("_reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_last", F.max("_k").over(Window.partitionBy("idterm")))
    out = out.withColumn("_first", F.first("id").over(Window.partitionBy("idterm", "_k").orderBy(*BY_TIME)))
    joined = F.col("_k") < F.col("_last")
    return out.withColumns({"TRIP_ID": F.when(joined, F.concat_ws("_", F.col("idterm"), F.lit("conc"), F.col("_k"))).otherwise(F.col("TRIP_ID")), "idtrajectory": F.when(joined, F.col("_first")).otherwise(F.col("idtrajectory"))}).drop("_reset", "_k", "_last", "_first")


def anomaly_codes(trips: DataFrame, grade_ok: int = 15) -> DataFrame:
    """The seven-letter anomaly code of each fix, from its trip's previous fix.

    Letters: start, inside or end by panel (1 on, 0 off); quality; odometer short of or far
    beyond the straight line; long time between moving fixes; too fast; odometer jump or none.
    """
    w = Window.partitionBy("TRIP_ID").orderBy(*BY_TIME)
    df = trips.withColumns({"_p": F.lag("panel").over(w), "_t": epoch("timedate") - epoch(F.lag("timedate").over(w)), "_d": F.col("progressive") - F.lag("progressive").over(w)})
    line = haversine(F.lag("longitude").over(w), F.lag("latitude").over(w), F.col("longitude"), F.col("latitude")) * 1000
    df = df.withColumns({"_line": line, "_end": F.lead("id").over(w).isNull(), "_first": F.lag("id").over(w).isNull()})
    on, off = F.col("panel") == 1, F.col("panel") == 0
    first = F.when(F.col("_first") & on, "S").when(F.col("_end") | off, "E").when(on & (F.col("_p") == 0), "S").otherwise("I")
    ratio = F.try_divide(F.col("_d"), F.col("_line"))
    moving = on & (F.col("_p") == 1)
    code = F.concat(
        first,
        F.when(F.col("grade") <= grade_ok, "Q").otherwise("q"),
        F.when(ratio < 0.9, "c").otherwise("2"),
        F.when((ratio > 10) & (F.col("_d") > 2200), "C").otherwise("3"),
        F.when(moving & (F.col("_t") > 600), "T").otherwise("4"),
        F.when((F.col("_t") > 0) & (F.col("_d") * 3.6 / F.col("_t") > 250), "V").otherwise("5"),
        F.when(~on & (F.col("_d") > 10000), "D").when(~off & (F.col("_d") <= 0), "d").otherwise("6"),
    )
    return df.withColumn("anomaly", code).drop("_p", "_t", "_d", "_line", "_end", "_first")


def km_increment(fixes: DataFrame) -> DataFrame:
    """km since the last fix (never below 0, 0 at the first) and their running total."""
    w = vehicle()
    step = F.greatest(F.coalesce(F.col("progressive") - F.lag("progressive").over(w), F.lit(0)), F.lit(0)) / 1000
    out = fixes.withColumn("km", step)
    return out.withColumn("total_km", F.bround(F.sum("km").over(w.rowsBetween(Window.unboundedPreceding, 0)), 3))


def route_summary(clean: DataFrame, max_time_s: int = 25200, min_break_s: int = 60) -> DataFrame:
    """One row per trip of two fixes or more, with the break to the vehicle's next trip.

    Columns: idtrajectory, idterm, idtrace_o, idtrace_d, timedate_o, tripdistance_m (rises of the
    odometer), triptime_s, checkcode (anomaly at the origin), breaktime_s, deviation_pos_m
    (from the end to the next start) and path.
    """
    w = Window.partitionBy("TRIP_ID").orderBy(*BY_TIME)
    rise = F.greatest(F.coalesce(F.col("progressive") - F.lag("progressive").over(w), F.lit(0)), F.lit(0))
    at = F.struct("timedate", "id")
    per = clean.withColumn("_rise", rise).groupBy("idterm", "TRIP_ID", "idtrajectory").agg(
        F.min_by("id", at).alias("idtrace_o"), F.max_by("id", at).alias("idtrace_d"), F.min("timedate").alias("timedate_o"), F.max("timedate").alias("_end"),
        F.sum("_rise").alias("tripdistance_m"), F.min_by("anomaly", at).alias("checkcode"), F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("longitude", "latitude"), at).alias("_o"), F.max_by(F.struct("longitude", "latitude"), at).alias("_d"),
        F.array_sort(F.collect_list(F.struct("timedate", "id", F.col("longitude").alias("x"), F.col("latitude").alias("y")))).alias("_path"),
    )
    v = Window.partitionBy("idterm").orderBy("timedate_o", "idtrajectory")
    nxt = F.lead("_o").over(v)
    out = per.withColumns({
        "triptime_s": epoch("_end") - epoch("timedate_o"), "breaktime_s": epoch(F.lead("timedate_o").over(v)) - epoch("_end"),
        "deviation_pos_m": F.bround(haversine(F.col("_d.longitude"), F.col("_d.latitude"), nxt["longitude"], nxt["latitude"]) * 1000, 0).cast("long"),
    })
    good = (F.col("_n") >= 2) & (F.col("tripdistance_m") > 0) & (F.col("triptime_s") > 0) & (F.col("triptime_s") <= max_time_s) & (F.col("breaktime_s") > min_break_s)
    path = F.transform("_path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("path")
    return out.where(good).select("idtrajectory", "idterm", "idtrace_o", "idtrace_d", "timedate_o", "tripdistance_m", "triptime_s", "checkcode", "breaktime_s", "deviation_pos_m", path)


#: Open ranges of a plausible trip: kilometres, hours, km/h and seconds of break (fixed values); the second form looks at no break.
VALID = {"km": (0, 150), "hours": (60 / 3600, 20500 / 3600), "kmh": (15, 220), "break_s": (60, 100000)}
VALID_SHORT = {"km": (0, 150), "hours": (0.016, 5), "kmh": (15, 150)}


def valid_trips(trips: DataFrame, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Trips of plausible distance, time, speed and break; ``limits`` are VALID or, of the second form, VALID_SHORT."""
    km, h = F.col("tripdistance_m") / 1000, F.col("triptime_s") / 3600
    has = {"km": km, "hours": h, "kmh": F.try_divide(km, h), "break_s": F.col("breaktime_s")}
    out = trips
    for name, (low, high) in (VALID if limits is None else limits).items():
        out = out.where((has[name] > low) & (has[name] < high))
    return out


def stop_classes(trips: DataFrame, late_h: float = 26, strange_h: float = 4, strange_km: float = 60) -> DataFrame:
    """Class of the stop after each trip, 220 night or 210 day, and of its end before the trip (start_class), 120 or 110.

    A vehicle's last trip has no stop after it and its first none before it: both classes are 0.
    ``trips`` has idterm, trip_no, end_hour, stop_h, km and hours. A stop that lasts past two in
    the morning is a night; so is one before a trip of ``strange_h`` hours or more over at most
    ``strange_km``.
    """
    w = Window.partitionBy("idterm").orderBy("trip_no")
    strange = (F.lead("hours").over(w) >= strange_h) & (F.lead("km").over(w) <= strange_km)
    last = F.lead("trip_no").over(w).isNull()
    out = trips.withColumn("stop_class", F.when(last, 0).when(F.col("end_hour") + F.col("stop_h") > late_h, 220).when(strange, 220).otherwise(210))
    return out.withColumn("start_class", F.coalesce(F.lag("stop_class").over(w) - 100, F.lit(0)))


def trip_flags(fixes: DataFrame, d_sec: int = 300, box: tuple[float, float, float, float] = (14.86, 37.426, 15.25, 37.625), long_s: int = 7200, short_km: float = 0.01) -> DataFrame:
    """Flag of each fix at a trip's start or end (panel 1 on, 0 off), trip number and whether it lies in ``box``.

    Codes: 10 and 20 regular start and end (engine on and off); 12 and 22 a start and end by a
    gap of ``d_sec`` inside the box, 13 and 23 outside; 11 and 21 a border crossing (the other
    side of the box than the last fix, with a gap and over 0.5 km); 5 a trip of under
    ``short_km`` or one longer than ``long_s`` with a gap of twice ``d_sec`` inside; 0 within a
    trip. The corrections are aggregates over provisional trips joined back.
    """
    w = vehicle()
    inside = F.col("longitude").between(box[0], box[2]) & F.col("latitude").between(box[1], box[3])
    df = fixes.withColumn("inside", inside)
    gap = epoch("timedate") - epoch(F.lag("timedate").over(w))
    moved = F.greatest(F.coalesce(F.col("progressive") - F.lag("progressive").over(w), F.lit(0)), F.lit(0))
    df = df.withColumns({"_gap": gap, "_m": moved, "_was": F.lag("inside").over(w), "_panel": F.lag("panel").over(w)})
    crossing = (F.col("_was") != F.col("inside")) & (F.col("_gap") > d_sec) & (F.col("_m") > 500)
    split = F.month("timedate") != F.month(F.lag("timedate").over(w))
    start = (
        F.when(F.col("_panel").isNull() | ((F.col("panel") == 1) & (F.col("_panel") == 0)), 10).when(crossing, 11)
        .when(F.coalesce(split, F.lit(False)) | (F.col("_gap") > d_sec), F.when(F.col("inside"), 12).otherwise(13)).otherwise(0)
    )
    df = df.withColumn("_start", start)
    df = df.withColumn("trip_no", F.sum(F.when(F.col("_start") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.col("_start") == 0
    per = df.groupBy("idterm", "trip_no").agg(
        F.sum(F.when(inner, F.col("_m")).otherwise(0)).alias("_len"), (F.max(epoch("timedate")) - F.min(epoch("timedate"))).alias("_dur"),
        F.max(F.when(inner, F.col("_gap"))).alias("_longest"), F.max_by("id", F.struct("timedate", "id")).alias("_last_id"),
    )
    # whole metres are summed: 0.009 and 0.001 km add up to less than 0.01
    odd = (F.col("_len") / 1000 < short_km) | ((F.col("_dur") > long_s) & (F.coalesce("_longest", F.lit(0)) > 2 * d_sec))
    out = df.withColumn("_next", F.lead("_start").over(w)).join(per.withColumn("_odd", odd), ["idterm", "trip_no"])
    end = F.when(F.col("_next").isNull() | (F.col("_next") == 10), 20).when(F.col("_next") == 11, 21).when(F.col("inside"), 22).otherwise(23)
    ends = F.col("id") == F.col("_last_id")
    flag = F.when(F.col("_odd") & ((F.col("_start") > 0) | ends), 5).when(F.col("_start") > 0, F.col("_start")).when(ends, end).otherwise(0)
    return out.select("id", "idterm", "timedate", "longitude", "latitude", "progressive", "inside", "trip_no", flag.alias("flag"))


def trip_table(flagged: DataFrame, least: int = 3) -> DataFrame:
    """One row per regular trip of vehicles with ``least`` or more: times, ends, km, hours and the stops around it."""
    at = F.struct("timedate", "id")
    rise = F.greatest(F.coalesce(F.col("progressive") - F.lag("progressive").over(Window.partitionBy("idterm", "trip_no").orderBy(*BY_TIME)), F.lit(0)), F.lit(0))
    per = flagged.withColumn("_rise", rise).groupBy("idterm", "trip_no").agg(
        F.min("timedate").alias("start"), F.max("timedate").alias("end"), F.min_by("flag", at).alias("start_flag"), F.max_by("flag", at).alias("end_flag"),
        F.min_by(F.struct("longitude", "latitude"), at).alias("start_at"), F.max_by(F.struct("longitude", "latitude"), at).alias("end_at"), (F.sum("_rise") / 1000).alias("km"), F.count(F.lit(1)).alias("_n"),
    ).where((F.col("start_flag") != 5) & (F.col("_n") > 1)).drop("_n")
    w = Window.partitionBy("idterm").orderBy("start", "trip_no")
    per = per.withColumns({
        "k": F.row_number().over(w), "hours": (epoch("end") - epoch("start")) / 3600, "stop_before_h": (epoch("start") - epoch(F.lag("end").over(w))) / 3600,
        "stop_h": (epoch(F.lead("start").over(w)) - epoch("end")) / 3600, "day_of_year": F.dayofyear("start"), "week": F.weekofyear("start"), "_all": F.count(F.lit(1)).over(Window.partitionBy("idterm")),
    })
    return per.where(F.col("_all") >= least).drop("_all").withColumn("trip_id", F.concat_ws("_", "idterm", "k"))
