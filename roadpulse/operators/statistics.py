"""Trip, fleet and sensor statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trip_histogram(trips: DataFrame, col: str, width: float, upto: float, closed: str = "both") -> DataFrame:
    """Counts per vehicle type and bin [b - width, b], in percent of all counts.

    With ``closed='both'`` a value on an edge counts in both bins, the first bin takes all up
    to zero; with ``'right'`` it counts in the lower bin only.
    """
    x = F.col(col).cast("double")
    top = F.greatest(F.ceil(x / width) * width, F.lit(0).cast("long")).cast("double")
    bins = F.when((x % width == 0) & (x >= 0) & F.lit(closed == "both"), F.array(top, top + width)).otherwise(F.array(top))
    per = trips.select("vehtype", F.explode(bins).alias("bin")).where(F.col("bin") <= upto).groupBy("vehtype", "bin").agg(F.count(F.lit(1)).alias("counts"))
    total = per.agg(F.sum("counts").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("vehtype", "bin", "counts", F.bround(F.col("counts") / F.col("total") * 100, 1).alias("pct"))


def _shares(trips: DataFrame, part: str) -> DataFrame:
    km = F.col("tripdistance_m") / 1000
    base = trips.withColumn("month", F.month("timedate_o"))
    base = base.withColumn("weekday", F.weekday("timedate_o")) if part == "weekday" else base.withColumn("hour", F.hour("timedate_o"))
    per = base.groupBy("month", part).agg(F.count(F.lit(1)).alias("n"), F.sum(km).alias("km"))
    total = per.groupBy("month").agg(F.sum("n").alias("all_n"), F.sum("km").alias("all_km"))
    return per.join(total, "month").select("month", part, F.bround(F.col("n") / F.col("all_n") * 100, 4).alias("trips_pct"), F.bround(F.col("km") / F.col("all_km") * 100, 4).alias("km_pct"))


def weekday_shares(trips: DataFrame) -> DataFrame:
    """Percent of a month's trips and kilometres on each weekday (Monday 0)."""
    return _shares(trips, "weekday")


def hour_shares(trips: DataFrame) -> DataFrame:
    """Percent of a month's trips and kilometres in each hour."""
    return _shares(trips, "hour")


def weekday_means(trips: DataFrame) -> DataFrame:
    """Trips and mean kilometres per month and weekday."""
    return trips.groupBy(F.month("timedate_o").alias("month"), F.weekday("timedate_o").alias("weekday")).agg(F.count(F.lit(1)).alias("trips"), F.bround(F.avg(F.col("tripdistance_m") / 1000), 6).alias("mean_km"))


def short_break_share(trips: DataFrame, minutes: float = 10) -> DataFrame:
    """Percent of trips whose break is shorter than ``minutes``."""
    return trips.agg((F.count_if(F.col("breaktime_s") < minutes * 60) / F.count(F.lit(1)) * 100).alias("pct"))


def anomaly_rates(clean: DataFrame) -> DataFrame:
    """Percent of fixes whose anomaly code has each letter, in one pass."""
    a = F.col("anomaly")
    rate = lambda cond: F.bround(F.count_if(cond) / F.count(F.lit(1)) * 100, 4)
    each = [rate(a.contains(x)).alias(f"pct_{name}") for x, name in (("c", "short"), ("C", "long"), ("T", "time"), ("V", "speed"), ("d", "no_way"), ("D", "jump"))]
    both = a.contains("V") & a.contains("C") & a.contains("D") & a.contains("c")
    return clean.agg(*each, rate(a.startswith("E")).alias("pct_ends"), rate(both).alias("pct_all"))


def grade_rates(clean: DataFrame) -> DataFrame:
    """Fixes of each grade, in percent."""
    per = clean.groupBy("grade").agg(F.count(F.lit(1)).alias("fixes"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("fixes").alias("total")))).select("grade", "fixes", F.bround(F.col("fixes") / F.col("total") * 100, 4).alias("pct"))


def fleet_counts(fixes: DataFrame) -> DataFrame:
    """Fixes and vehicles per vehicle type, the busiest vehicle and the largest speed under 160."""
    per = fixes.groupBy("vehtype", "idterm").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("speed") < 160, F.col("speed"))).alias("top"))
    return per.groupBy("vehtype").agg(F.sum("n").alias("fixes"), F.count(F.lit(1)).alias("vehicles"), F.min_by("idterm", F.struct(-F.col("n"), "idterm")).alias("busiest"), F.max("top").alias("max_speed"))


def speed_counts(fixes: DataFrame) -> DataFrame:
    """Fixes per vehicle and speed."""
    return fixes.groupBy("idterm", "speed").agg(F.count(F.lit(1)).alias("fixes"))


def distinct_trips(trav: DataFrame) -> DataFrame:
    """Trips and vehicles per vehicle type."""
    return trav.groupBy("vehtype").agg(F.count_distinct("idtrajectory").alias("trips"), F.count_distinct("idterm").alias("vehicles"))


def sample_trips(trips: DataFrame, percent: int = 20) -> DataFrame:
    """The trips whose number modulo 100 is below ``percent``: the same ones every time."""
    return trips.where(F.col("idtrajectory") % 100 < percent)


def web_slice(loads: DataFrame, least: float = 17, first: int = 6, last: int = 21) -> DataFrame:
    """Loads of ``least`` percent or more in daytime hours."""
    return loads.where((F.col("load") >= least) & F.col("hour").between(first, last))


def classed(sensor: DataFrame) -> DataFrame:
    """Sensor rows with classes 2 and 3 as cars, 4 to 8 as heavy; others are dropped."""
    kind = F.when(F.col("classe").isin("2", "3"), "car").when(F.col("classe").isin("4", "5", "6", "7", "8"), "heavy")
    return sensor.withColumn("class", kind).where("class is not null")


def sensor_hourly(sensor: DataFrame) -> DataFrame:
    """Vehicles per hour, direction, lane and class."""
    hour = F.date_format("timedate", "yyyy-MM-dd HH")
    return classed(sensor).groupBy(hour.alias("hour"), "direzione", "corsia", "class").agg(F.count(F.lit(1)).alias("n"))


def sensor_totals(sensor: DataFrame) -> DataFrame:
    """Vehicles per direction and class, per direction (class null), per class (direction null) and of all."""
    return sensor_hourly(sensor).cube("direzione", "class").agg(F.sum("n").alias("n"))


def sensor_15min(sensor: DataFrame) -> DataFrame:
    """Vehicles per quarter hour, summed by direction, month, day and hour."""
    quarter = classed(sensor).withColumn("q", F.floor(F.minute("timedate") / 15))
    per = quarter.groupBy("direzione", "corsia", "class", F.month("timedate").alias("month"), F.dayofmonth("timedate").alias("day"), F.hour("timedate").alias("hour"), "q").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("direzione", "month", "day", "hour").agg(F.sum("n").alias("n"))


def penetration(fcd: DataFrame, sensor: DataFrame, cap: float = 8) -> DataFrame:
    """Observed vehicles in percent of sensor counts per (hour, direzione, class), values under ``cap``."""
    keys = ["hour", "direzione", "class"]
    out = fcd.join(sensor, keys, "left").withColumn("ratio", F.bround(F.col("fcd") / F.col("n") * 100, 1))
    return out.where(F.col("ratio").isNotNull() & (F.col("ratio") < cap)).select(*keys, "ratio")


def stacked(sections: dict[str, DataFrame]) -> DataFrame:
    """The ratios of several sections as one table, each row with its section's name."""
    out = None
    for name, df in sections.items():
        rows = df.withColumn("section", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def normal_fit(df: DataFrame, by: str, col: str) -> DataFrame:
    """Gaussian fit per section: mean, sd, and their standard errors."""
    n, sd = F.count(col), F.stddev_pop(col)
    return df.groupBy(by).agg(F.bround(F.avg(col), 6).alias("mean"), F.bround(sd, 6).alias("sd"), F.bround(sd / F.sqrt(n), 6).alias("se_mean"), F.bround(sd / F.sqrt(2 * n), 6).alias("se_sd"))


def _profile(rows: DataFrame, by: list[str]) -> DataFrame:
    day = classed(rows).groupBy(*by, "direzione", "class", F.to_date("timedate").alias("date"), F.hour("timedate").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    mean = day.groupBy(*by, "direzione", "class", "hour").agg(F.avg("n").alias("n")).groupBy(*by, "direzione", "class").agg(F.sum("n").alias("n"))
    total = mean.groupBy(*by, "direzione").agg(F.sum("n").alias("total"))
    return mean.join(total, [*by, "direzione"]).select(*by, "direzione", "class", F.bround("n", 6).alias("n"), F.bround(F.col("n") / F.col("total") * 100, 4).alias("pct"))


def mean_hour_profile(sensor: DataFrame) -> DataFrame:
    """Per month, weekday (0 is Monday), direction and class: the mean count of each hour over the weekday's dates, summed over hours, and its percent of the direction's on that weekday."""
    return _profile(sensor.withColumns({"month": F.month("timedate"), "weekday": F.weekday("timedate")}), ["month", "weekday"])


def weekday_profile(sensor: DataFrame) -> DataFrame:
    """As ``mean_hour_profile``, of a month's working days and of its weekends."""
    return _profile(sensor.withColumns({"month": F.month("timedate"), "part": F.when(F.weekday("timedate") < 5, "weekday").otherwise("weekend")}), ["month", "part"])


def class_bins(df: DataFrame, col: str, n: int = 13) -> DataFrame:
    """Number (1 to ``n``) of the equal-width bin of each value between the least and the largest."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    x = F.floor((F.col(col) - F.col("lo")) * n / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))) + 1
    return df.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.coalesce(x, F.lit(1).cast("long")), F.lit(n).cast("long"))).drop("lo", "hi")
