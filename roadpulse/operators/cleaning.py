"""Cleaning and projection of GPS fixes. Rows of a vehicle are ordered by (timedate, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.store import kept

BY_TIME = ["timedate", "id"]


def vehicle() -> Window:
    return Window.partitionBy("idterm").orderBy(*BY_TIME)


def dedup_fixes(df: DataFrame, keys: tuple[str, ...] = ("latitude", "longitude", "timedate"), keep: str = "last") -> DataFrame:
    """One row per vehicle and ``keys``: the first or the last in time."""
    order = [F.col(c).desc() if keep == "last" else F.col(c) for c in BY_TIME]
    w = Window.partitionBy("idterm", *keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filter_quality(df: DataFrame, grade: tuple[int, int] = (1, 15), drop_idle: bool = True, drop_zero_speed: bool = False, drop_zero_odometer: bool = False, drop_engine_off: bool = False, year: int | None = None) -> DataFrame:
    """Fixes of grades in a range; optionally none that stand while the odometer has run, none at speed 0, odometer 0 or panel 0, one year."""
    out = df.where(F.col("grade").between(*grade))
    out = out.where(~((F.col("progressive") != 0) & (F.col("speed") == 0))) if drop_idle else out
    out = out.where(F.col("speed") != 0) if drop_zero_speed else out
    out = out.where(F.col("progressive") != 0) if drop_zero_odometer else out
    out = out.where(F.col("panel") != 0) if drop_engine_off else out
    return out if year is None else out.where(F.year("timedate") == year)


def eligible_vehicles(df: DataFrame, min_fixes: int = 5, max_zero_frac: float = 0.2) -> DataFrame:
    """Fixes of vehicles with more than ``min_fixes``, a running odometer, and few zero readings."""
    per = df.groupBy("idterm").agg(F.count(F.lit(1)).alias("n"), F.sum("progressive").alias("sum"), F.count_if(F.col("progressive") == 0).alias("zero"))
    good = per.where((F.col("n") > min_fixes) & (F.col("sum") > 0) & (F.col("zero") / F.col("n") < max_zero_frac))
    return df.join(good.select("idterm"), "idterm", "left_semi")


def epoch(c: Column | str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def add_time_parts(df: DataFrame) -> DataFrame:
    """Adds totalseconds, date, year_month, year, hour, minute, seconds and path_time (seconds since the vehicle's first fix)."""
    t = F.col("timedate")
    out = df.withColumns({
        "totalseconds": epoch("timedate"), "date": F.to_date(t), "year_month": F.date_format(t, "yyyy-MM"), "year": F.year(t),
        "hour": F.hour(t), "minute": F.minute(t), "seconds": F.second(t),
    })
    return out.withColumn("path_time", F.col("totalseconds") - F.first("totalseconds").over(vehicle()))


def vehicle_types(fixes: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per vehicle: its least vehicle type and its load capacity if registered."""
    types = fixes.groupBy("idterm").agg(F.min("vehtype").alias("vehtype"))
    loads = registry.groupBy("idterm").agg(F.min("portata").alias("portata"))
    return types.join(loads, "idterm", "left").select("idterm", "vehtype", "portata")


#: Hours from UTC to local time by month (fixed values).
MONTH_HOURS = {2: 1, 11: 1, 5: 2, 8: 2}


def shift_by_month(df: DataFrame, hours: dict[int, int] | None = None, col: str = "timedate") -> DataFrame:
    """``col`` moved by its month's hours; months without an entry stay."""
    months = F.month(col)
    shift = F.lit(0)
    for month, h in (MONTH_HOURS if hours is None else hours).items():
        shift = F.when(months == month, h).otherwise(shift)
    return df.withColumn(col, F.col(col) + F.make_dt_interval(hours=shift))


def fill_gaps(df: DataFrame, keys: list[str], order: list[str], cols: list[str], mode: str = "forward") -> DataFrame:
    """Nulls filled from the last value before, then the first after; ``mean`` takes both sides' mean."""
    back = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    for c in cols:
        before, after = F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)
        both = F.coalesce(before, after) if mode == "forward" else F.coalesce((before + after) / 2, before, after)
        df = df.withColumn(c, both)
    return df


def distinct_days(df: DataFrame) -> DataFrame:
    """The calendar days that have data, and their months."""
    return df.select(F.to_date("timedate").alias("day")).distinct().withColumn("month", F.month("day"))


def clip_rect(edges: DataFrame, nodes: DataFrame, xmin: float = 14.86, xmax: float = 15.25, ymin: float = 37.426, ymax: float = 37.625) -> DataFrame:
    """Edges that meet a rectangle, with the share of each inside (Liang-Barsky)."""
    at = lambda side, node: nodes.select(F.col("node").alias(node), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"))
    df = edges.join(at(1, "u"), "u").join(at(2, "v"), "v")
    low, high, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in (("x1 - x2", f"x1 - {xmin}D"), ("x2 - x1", f"{xmax}D - x1"), ("y1 - y2", f"y1 - {ymin}D"), ("y2 - y1", f"{ymax}D - y1")):
        p, q = F.expr(p), F.expr(q)
        r = F.try_divide(q, p)
        outside = outside | ((p == 0) & (q < 0))
        low = F.when(p < 0, F.greatest(low, r)).otherwise(low)
        high = F.when(p > 0, F.least(high, r)).otherwise(high)
    return df.where(~outside & (low <= high)).select("u", "v", F.bround(high - low, 6).alias("inside"))


def between_times(df: DataFrame, first: str, last: str, idterm: int | None = None) -> DataFrame:
    """Fixes of a span of time, both ends included, of all vehicles or one."""
    out = df.where(F.col("timedate").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    return out if idterm is None else out.where(F.col("idterm") == idterm)


def add_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 1 in ``order``.

    Rows are sorted by range over all partitions and written with their place in their partition;
    sizes and numbers both come from that table, as a second sort might cut its ranges
    elsewhere. Each partition starts after the rows of those before it, so no task holds them all.
    """
    place = "_place"
    ordered = kept(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "row-ids")
    part, at = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)  # the id's low 33 bits number a partition's rows
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = ordered.join(F.broadcast(before), part == F.col("_part"))  # a row a partition
    return numbered.select(*(ordered[c] for c in df.columns), (F.col("_before") + at + 1).alias(name))


def pending_keys(all_keys: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Keys not yet processed."""
    return all_keys.select(*keys).distinct().join(done.select(*keys), keys, "left_anti")
