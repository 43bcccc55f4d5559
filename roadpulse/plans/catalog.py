"""All registered queries over the traffic operators, with their oracle statements.

A query is a function of the derived tables; its oracle is DuckDB text over the same tables,
listed before it by ``duck``. Queries without a statement are iterative or run Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import haversine
from roadpulse.functions.store import kept, new_path
from roadpulse.operators import centrality, cleaning, demand, disruption, hubs, matching, network, parts, places, ranks, resilience, statistics, traffic, trips
from roadpulse.plans.fixtures import Fixtures, duck
from roadpulse.sources import commits, files, sensors
from roadpulse.streaming import streams

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
GAP = 21600  # the test fixes are hours apart
CAR = "CASE panel WHEN 1 THEN 1 ELSE 0 END"


def query(sql: str | None = None, *tables: str):
    """Registers a function of Fixtures under its name."""

    def add(f: Callable[[Fixtures], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            _ORACLES[f.__name__] = duck(sql, *tables)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- A, B: files, rows and cleaning

_FIX_ROWS = "SELECT id AS idrequest, idterm, CAST(FLOOR(epoch(timedate)) AS BIGINT) AS seconds, speed, grade, panel, vehtype, progressive, round_even(longitude, 6) AS longitude FROM fixes"


def _read_back(df):
    return df.select("idrequest", "idterm", cleaning.epoch("timedate").alias("seconds"), "speed", "grade", F.col("panel").cast("int"), F.col("vehtype").cast("int"), "progressive", F.bround("longitude", 6).alias("longitude"))


def _csv(df, label, **options):
    path = new_path(df.sparkSession, label)
    df.write.csv(path, **options)
    return path


def _raw_fixes(t):
    when = F.date_format("timedate", "yyyy-MM-dd HH:mm:ss").alias("timedate")
    return t.fixes.select(F.col("id").alias("idrequest"), "idterm", when, "latitude", "longitude", "speed", F.lit(0).alias("direction"), "grade", "panel", F.lit(0).alias("event"), "vehtype", "progressive")


@query(_FIX_ROWS, "fixes")
def a1_read_fixes(t):
    return _read_back(files.read_fixes(t.spark, _csv(_raw_fixes(t), "fixes", sep=";")))


@query(_FIX_ROWS, "fixes")
def a2_read_fixes_legacy(t):
    lines = _raw_fixes(t).drop("event").select(F.concat_ws(",", "idrequest", "idterm", "timedate", "latitude", "longitude", "speed", "direction", "grade", "panel", "vehtype", "progressive").alias("value"))
    broken = t.fixes.where("id % 10 = 0").select(F.concat_ws(",", "id", "idterm", F.lit("cut")).alias("value"))
    path = new_path(t.spark, "legacy")
    lines.union(broken).write.text(path)
    return _read_back(files.read_fixes_legacy(t.spark, path))


@query("SELECT id, idterm, speed FROM fixes", "fixes")
def a3_read_many(t):
    one = _csv(t.fixes.where("id % 2 = 0").select("id", "idterm", "speed"), "even", sep=";", header=True)
    two = _csv(t.fixes.where("id % 2 <> 0").select("speed", "id", "idterm"), "odd", sep=";", header=True)
    return files.read_many(t.spark, [one, two]).select(*(F.col(c).cast("long").alias(c) for c in ("id", "idterm", "speed")))


@query("SELECT idterm, portata, 'Citroën' AS brand FROM registry", "registry")
def a4_read_registry(t):
    rows = t.registry.select("idterm", F.lit("d").alias("devicetype"), F.lit("c").alias("idvehcategory"), F.lit("Citroën").alias("brand"), F.lit(2010).alias("anno"), "portata", F.lit("F").alias("gender"), F.lit("30").alias("age"))
    return files.read_registry(t.spark, _csv(rows, "registry", sep=";", header=True, encoding="ISO-8859-1")).select("idterm", "portata", "brand")


@query("SELECT CAST(FLOOR(epoch(timedate)) AS BIGINT) AS seconds, direzione, corsia, classe, COUNT(*) AS n FROM sensor GROUP BY 1, 2, 3, 4", "sensor")
def a6_read_sensor_counts(t):
    day = F.dayofmonth("timedate").alias("day")
    rows = t.sensor.select(day, F.lit(48).alias("at"), F.concat_ws(";", F.date_format("timedate", "dd/MM/yyyy HH:mm:ss"), "direzione", F.concat(F.lit(" "), "corsia"), "classe", F.lit("more")).alias("value"))
    head = t.sensor.select(day).distinct().withColumn("at", F.explode(F.sequence(F.lit(-1), F.lit(47))))
    head = head.withColumn("value", F.when(F.col("at") == 47, "Data Ora;Direzione;Corsia;Classe!;Other").otherwise(F.concat(F.lit("preamble "), "at"))).where("at >= 0").unionByName(head.where("at = -1").select("day", F.lit(0).alias("at"), F.lit("Station").alias("value")))
    path = new_path(t.spark, "sensor")  # a file a day, each with its preamble
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    head.unionByName(rows).repartition(n, "day").sortWithinPartitions("day", "at").select("day", "value").write.partitionBy("day").text(path)
    back = files.read_sensor_counts(t.spark, path, skip=48, columns=4)
    return back.groupBy(cleaning.epoch("timedate").alias("seconds"), "direzione", "corsia", "classe").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, idterm, speed FROM fixes", "fixes")
def a3_read_folder(t):
    """A glob over folders of files whose columns stand in three orders."""
    path = new_path(t.spark, "many")
    for k, names in enumerate((("id", "idterm", "speed"), ("speed", "id", "idterm"), ("idterm", "speed", "id"))):
        t.fixes.where(f"id % 3 = {k}").select(*names).write.csv(f"{path}/part {k}", sep=";", header=True)
    return files.read_many(t.spark, f"{path}/*/*.csv").select(*(F.col(c).cast("long").alias(c) for c in ("id", "idterm", "speed")))


_SENSOR_FILES = """SELECT CAST(FLOOR(epoch(timedate)) AS BIGINT) AS seconds, direzione, corsia, classe, COUNT(*) AS n, 0 AS rejected FROM sensor GROUP BY 1, 2, 3, 4
UNION ALL SELECT NULL, NULL, NULL, NULL, n, n FROM (SELECT COUNT(DISTINCT CAST(FLOOR(epoch(timedate) / 86400) AS BIGINT)) AS n FROM sensor) WHERE n > 0"""


@query(_SENSOR_FILES, "sensor")
def a6_sensor_files(t):
    """A file a day; odd days have a longer preamble and another order of columns, each day a line without a time."""
    day, odd = F.dayofmonth("timedate").alias("day"), F.dayofmonth("timedate") % 2 == 1
    when = F.date_format("timedate", "dd/MM/yyyy HH:mm:ss")
    line = F.when(odd, F.concat_ws(";", "corsia", when, F.lit("more"), "classe", "direzione")).otherwise(F.concat_ws(";", when, "direzione", F.concat(F.lit(" "), "corsia"), "classe", F.lit("more")))
    top = F.when(odd, F.array(F.lit("Station"), F.lit("Unit; 7"), F.lit(""), F.lit("Corsia;Data Ora;Other;Classe!;Direzione"), F.lit("1;no time;x;2;A"))).otherwise(F.array(F.lit("Station"), F.lit("Data Ora;Direzione;Corsia;Classe!;Other"), F.lit("no time;A;1;2;x")))
    heads = t.sensor.select(day, top.alias("top")).distinct().select("day", F.posexplode("top").alias("at", "value"))
    path, n = new_path(t.spark, "sensors"), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    heads.unionByName(t.sensor.select(day, F.lit(9).alias("at"), line.alias("value"))).repartition(n, "day").sortWithinPartitions("day", "at").select("day", "value").write.partitionBy("day").text(path)
    back = sensors.read_sensor_files(t.spark, path, time="data_ora", names=["direzione", "corsia", "classe"])
    keys = [cleaning.epoch("timedate").alias("seconds"), "direzione", "corsia", "classe"]
    return back.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("rejected").alias("rejected"))


@query("SELECT vehtype, COUNT(*) AS n, SUM(mean_speed)::BIGINT AS speeds FROM traversals GROUP BY vehtype", "traversals")
def a7_write_table(t):
    path = new_path(t.spark, "table")
    for part in (t.traversals.where("u % 2 = 0"), t.traversals.where("u % 2 <> 0")):
        files.write_table(part.select("idtrajectory", "sequenza", "mean_speed", "vehtype"), path, ["vehtype"])
    return t.spark.read.parquet(path).groupBy("vehtype").agg(F.count(F.lit(1)).alias("n"), F.sum("mean_speed").alias("speeds"))


@query("SELECT vehtype, COUNT(*) AS n, SUM(mean_speed)::BIGINT AS speeds FROM traversals GROUP BY vehtype", "traversals")
def a7_write_units(t):
    """Two units of which one is written again after a run that ended before its commit."""
    path, rows = new_path(t.spark, "units"), t.traversals.select("idtrajectory", "sequenza", "mean_speed", "vehtype", "u")
    half = lambda k: rows.where(F.col("u") % 2 == k).drop("u")
    half(1).write.partitionBy("vehtype").parquet(f"{path}/attempt=cut")
    for k in (0, 1, 0):
        commits.write_unit(half(k), path, f"u{k}", ["vehtype"])
    kept_rows = commits.read_units(t.spark, path, "idtrajectory long, sequenza int, mean_speed long, vehtype int")
    return kept_rows.groupBy("vehtype").agg(F.count(F.lit(1)).alias("n"), F.sum("mean_speed").alias("speeds"))


@query("SELECT e.u, e.v, round_even(a.x, 6) AS x1, round_even(b.y, 6) AS y2 FROM edges e JOIN nodes a ON e.u = a.node JOIN nodes b ON e.v = b.node", "edges", "nodes")
def a8_geojson(t):
    ends = network.with_ends(t.edges, t.nodes)
    path = new_path(t.spark, "geojson")
    files.write_geojson(ends.select("u", "v", F.lit("LineString").alias("geometry_type"), F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("coordinates")), path, ["u", "v"])
    back = files.read_geojson(t.spark, path, "u: long, v: long")
    return back.select("u", "v", F.bround(F.col("coordinates")[0][0], 6).alias("x1"), F.bround(F.col("coordinates")[1][1], 6).alias("y2"))


@query("SELECT id, round_even(longitude, 9) AS x, round_even(latitude, 9) AS y FROM fixes", "fixes")
def a9_wkb(t):
    hexes = t.fixes.select("id", files.points_to_wkb_hex(F.array(F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")))).alias("hex"))
    back = hexes.select("id", files.wkb_hex_to_points("hex")[0].alias("p"))
    return back.select("id", F.bround("p.x", 9).alias("x"), F.bround("p.y", 9).alias("y"))


@query("SELECT id, idterm, ROW_NUMBER() OVER (ORDER BY timedate, id) AS row_id FROM fixes", "fixes")
def a5_row_id(t):
    return cleaning.add_row_id(t.fixes.select("id", "idterm", "timedate"), ["timedate", "id"]).select("id", "idterm", "row_id")


@query("SELECT DISTINCT idterm FROM fixes WHERE idterm NOT IN (SELECT idterm FROM traversals)", "fixes", "traversals")
def a10_pending_keys(t):
    return cleaning.pending_keys(t.fixes, t.traversals, ["idterm"])


@query("SELECT id, idterm, latitude, longitude FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idterm, latitude, longitude ORDER BY timedate, id) AS n FROM fixes) WHERE n = 1", "fixes")
def b1_dedup_fixes(t):
    return cleaning.dedup_fixes(t.fixes, ("latitude", "longitude"), "first").select("id", "idterm", "latitude", "longitude")


@query("SELECT id, idterm, speed, grade FROM fixes WHERE grade BETWEEN 1 AND 15 AND NOT (progressive <> 0 AND speed = 0)", "fixes")
def b2_filter_quality(t):
    return cleaning.filter_quality(t.fixes).select("id", "idterm", "speed", "grade")


@query("SELECT id, idterm, speed, grade FROM fixes WHERE grade BETWEEN 2 AND 12 AND speed <> 0 AND progressive <> 0 AND panel <> 0 AND year(timedate) = 2024", "fixes")
def b2_filter_strict(t):
    return cleaning.filter_quality(t.fixes, (2, 12), False, True, True, True, 2024).select("id", "idterm", "speed", "grade")


@query("""SELECT id, idterm FROM fixes WHERE idterm IN (SELECT idterm FROM fixes GROUP BY idterm
  HAVING COUNT(*) > 5 AND SUM(progressive) > 0 AND SUM(CASE WHEN progressive = 0 THEN 1 ELSE 0 END) * 1.0 / COUNT(*) < 0.2)""", "fixes")
def b3_eligible_vehicles(t):
    return cleaning.eligible_vehicles(t.fixes).select("id", "idterm")


@query("""SELECT id, s AS totalseconds, CAST(hour(timedate) AS INTEGER) AS hour, CAST(minute(timedate) AS INTEGER) AS minute,
  s - FIRST_VALUE(s) OVER (PARTITION BY idterm ORDER BY timedate, id) AS path_time FROM (SELECT *, CAST(FLOOR(epoch(timedate)) AS BIGINT) AS s FROM fixes)""", "fixes")
def b4_time_parts(t):
    return cleaning.add_time_parts(t.fixes).select("id", "totalseconds", "hour", "minute", "path_time")


@query("SELECT f.idterm, f.vehtype, r.portata FROM (SELECT idterm, MIN(vehtype) AS vehtype FROM fixes GROUP BY idterm) f LEFT JOIN (SELECT idterm, MIN(portata) AS portata FROM registry GROUP BY idterm) r ON f.idterm = r.idterm", "fixes", "registry")
def b5_vehicle_types(t):
    return cleaning.vehicle_types(t.fixes, t.registry)


@query("SELECT id, CAST(hour(timedate + CASE month(timedate) WHEN 2 THEN INTERVAL 1 HOUR WHEN 11 THEN INTERVAL 1 HOUR WHEN 5 THEN INTERVAL 2 HOUR WHEN 8 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END) AS INTEGER) AS hour FROM fixes", "fixes")
def b6_shift_by_month(t):
    return cleaning.shift_by_month(t.fixes).select("id", F.hour("timedate").alias("hour"))


@query("""SELECT id, COALESCE((SELECT g.s FROM g WHERE g.idterm = h.idterm AND g.n <= h.n AND g.s IS NOT NULL ORDER BY g.n DESC LIMIT 1),
  (SELECT g.s FROM g WHERE g.idterm = h.idterm AND g.n >= h.n AND g.s IS NOT NULL ORDER BY g.n LIMIT 1)) AS speed FROM g h""".replace("SELECT id,", "WITH g AS (SELECT id, idterm, CASE WHEN grade <= 10 THEN speed END AS s, ROW_NUMBER() OVER (PARTITION BY idterm ORDER BY timedate, id) AS n FROM fixes)\nSELECT id,", 1), "fixes")
def b7_fill_gaps(t):
    holes = t.fixes.withColumn("speed", F.when(F.col("grade") <= 10, F.col("speed")))
    return cleaning.fill_gaps(holes, ["idterm"], ["timedate", "id"], ["speed"]).select("id", "speed")


@query("SELECT DISTINCT CAST(timedate AS DATE) AS day, CAST(month(timedate) AS INTEGER) AS month FROM fixes", "fixes")
def b8_distinct_days(t):
    return cleaning.distinct_days(t.fixes)


@query("""WITH s AS (SELECT e.u, e.v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges e JOIN nodes a ON e.u = a.node JOIN nodes b ON e.v = b.node),
  p AS (SELECT u, v, unnest([x1 - x2, x2 - x1, y1 - y2, y2 - y1]) AS p, unnest([x1 - 14.905::DOUBLE, 14.925::DOUBLE - x1, y1 - 37.455::DOUBLE, 37.475::DOUBLE - y1]) AS q FROM s),
  c AS (SELECT u, v, MAX(CASE WHEN p = 0 AND q < 0 THEN 1 ELSE 0 END) AS outside, greatest(0, MAX(CASE WHEN p < 0 THEN q / p END)) AS low, least(1, MIN(CASE WHEN p > 0 THEN q / p END)) AS high FROM p GROUP BY u, v)
  SELECT u, v, round_even(high - low, 6) AS inside FROM c WHERE outside = 0 AND low <= high""", "edges", "nodes")
def b9_clip_rect(t):
    return cleaning.clip_rect(t.edges, t.nodes, xmin=14.905, xmax=14.925, ymin=37.455, ymax=37.475)


@query("SELECT id, idterm FROM fixes WHERE timedate BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-06-30 00:00:00'", "fixes")
def b10_between_times(t):
    return cleaning.between_times(t.fixes, "2024-01-01 00:00:00", "2024-06-30 00:00:00").select("id", "idterm")


# --- C: trips

_LAG = "LAG({c}) OVER (PARTITION BY idterm ORDER BY timedate, id)"
_NUMBERED = """WITH a AS (SELECT *, CAST(FLOOR(epoch(timedate)) AS BIGINT) AS s FROM fixes), b AS (SELECT *, s - LAG(s) OVER w AS gap, LAG(panel) OVER w AS last, LEAD(speed) OVER w AS next_speed, progressive - LAG(progressive) OVER w AS jump
  FROM a WINDOW w AS (PARTITION BY idterm ORDER BY timedate, id)), c AS (SELECT *, CASE WHEN {starts} THEN 1 ELSE 0 END AS st FROM b)
  SELECT id, idterm, CAST(SUM(st) OVER (PARTITION BY idterm ORDER BY timedate, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS trip_no FROM c"""


@query(_NUMBERED.format(starts=f"gap >= {GAP}"), "fixes")
def c1_split_gap(t):
    return trips.split_trips_gap(t.fixes, GAP).select("id", "idterm", "trip_no")


@query(_NUMBERED.format(starts=f"gap >= {GAP} AND (panel <> 1 OR (last IS NOT NULL AND last <> 1)) AND (vehtype <> 2 OR (next_speed > 0 AND speed = 0))"), "fixes")
def c2_split_engine(t):
    return trips.split_trips_engine(_off_on(t), GAP).select("id", "idterm", "trip_no")


def _off_on(t):
    return t.fixes.withColumn("panel", F.when(F.col("panel") == 1, 1).otherwise(0))


def _trips(t):
    return trips.assign_trip_ids(trips.split_trips_gap(_off_on(t), GAP))


_TRIP_IDS = "SELECT id, idterm || '_' || trip_no AS TRIP_ID, FIRST_VALUE(id) OVER x AS idtrajectory, ROW_NUMBER() OVER x - 1 AS segment FROM (" + _NUMBERED.format(starts=f"gap >= {GAP}").replace("SELECT id, idterm, CAST", "SELECT id, idterm, timedate, CAST") + ") WINDOW x AS (PARTITION BY idterm, trip_no ORDER BY timedate, id)"


@query(_TRIP_IDS, "fixes")
def c3_trip_ids(t):
    return _trips(t).select("id", "TRIP_ID", "idtrajectory", F.col("segment").cast("long"))


@query("""WITH a AS (SELECT *, CASE WHEN progressive < LAG(progressive) OVER (PARTITION BY idterm ORDER BY timedate, id) THEN 1 ELSE 0 END AS r FROM fixes),
  b AS (SELECT *, SUM(r) OVER (PARTITION BY idterm ORDER BY timedate, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM a)
  SELECT id, idterm || '_conc_' || CAST(k AS BIGINT) AS TRIP_ID FROM b WHERE k < (SELECT MAX(k) FROM b x WHERE x.idterm = b.idterm)""", "fixes")
def c4_concat_odometer(t):
    return trips.concat_trips_odometer(_trips(t)).where(F.col("TRIP_ID").contains("conc")).select("id", "TRIP_ID")


def _far(x1: str, y1: str, x2: str, y2: str) -> str:
    """Kilometres on a sphere in DuckDB."""
    return f"2 * 6371.0::DOUBLE * asin(sqrt(least(power(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * power(sin(radians({x2} - {x1}) / 2), 2), 1.0::DOUBLE)))"


@query(f"SELECT id, round_even({_far('longitude', 'latitude', '15.0::DOUBLE', '37.5::DOUBLE')}, 6) AS km FROM fixes", "fixes")
def c8_haversine(t):
    return t.fixes.select("id", F.bround(haversine(F.col("longitude"), F.col("latitude"), F.lit(15.0), F.lit(37.5)), 6).alias("km"))


_CODED = f"""tr AS ({_TRIP_IDS}), x AS (SELECT f.id, f.idterm, f.timedate, f.longitude, f.latitude, f.grade, f.progressive, CASE WHEN f.panel = 1 THEN 1 ELSE 0 END AS p, tr.TRIP_ID, tr.idtrajectory, CAST(FLOOR(epoch(f.timedate)) AS BIGINT) AS s FROM fixes f JOIN tr ON f.id = tr.id),
  l AS (SELECT *, LAG(p) OVER w AS lp, s - LAG(s) OVER w AS t, progressive - LAG(progressive) OVER w AS d, LAG(longitude) OVER w AS lx, LAG(latitude) OVER w AS ly, LEAD(id) OVER w IS NULL AS at_end, LAG(id) OVER w IS NULL AS at_start FROM x WINDOW w AS (PARTITION BY TRIP_ID ORDER BY timedate, id)),
  h AS (SELECT *, {_far('lx', 'ly', 'longitude', 'latitude')} * 1000 AS line FROM l),
  coded AS (SELECT *, CASE WHEN at_start AND p = 1 THEN 'S' WHEN at_end OR p = 0 THEN 'E' WHEN lp = 0 THEN 'S' ELSE 'I' END || CASE WHEN grade <= 15 THEN 'Q' ELSE 'q' END
    || CASE WHEN line > 0 AND d / line < 0.9 THEN 'c' ELSE '2' END || CASE WHEN line > 0 AND d / line > 10 AND d > 2200 THEN 'C' ELSE '3' END || CASE WHEN p = 1 AND lp = 1 AND t > 600 THEN 'T' ELSE '4' END
    || CASE WHEN t > 0 AND d * 3.6::DOUBLE / t > 250 THEN 'V' ELSE '5' END || CASE WHEN p = 0 AND d > 10000 THEN 'D' WHEN p = 1 AND d <= 0 THEN 'd' ELSE '6' END AS anomaly FROM h)"""


@query("WITH " + _CODED + " SELECT id, TRIP_ID, anomaly FROM coded", "fixes")
def c5_anomaly_codes(t):
    return trips.anomaly_codes(_trips(t)).select("id", "TRIP_ID", "anomaly")


@query(_NUMBERED.format(starts=f"last IS NULL OR panel = 0 OR (panel = 2 AND last = 2) OR (panel = 1 AND last = 2) OR (panel = 1 AND last <= 1 AND gap > {GAP}) OR (panel <> 0 AND jump > 10000)"), "fixes")
def c6_split_panel(t):
    return trips.split_trips_panel(t.fixes, GAP).select("id", "idterm", "trip_no")


_ROUTES = _CODED + """, per AS (SELECT idterm, TRIP_ID, idtrajectory, MAX(CASE WHEN at_end THEN id END) AS idtrace_d, MIN(timedate) AS o, MAX(timedate) AS e, MIN(s) AS so, MAX(s) AS se, CAST(SUM(greatest(COALESCE(d, 0), 0)) AS BIGINT) AS dist, COUNT(*) AS n FROM coded GROUP BY 1, 2, 3),
  routes AS (SELECT *, se - so AS dur, LEAD(so) OVER (PARTITION BY idterm ORDER BY o, idtrajectory) - se AS brk FROM per),
  good AS (SELECT * FROM routes WHERE n >= 2 AND dist > 0 AND dur > 0 AND dur <= 10000000 AND brk > 60)"""


@query("WITH " + _ROUTES + " SELECT idtrajectory, idterm, idtrajectory AS idtrace_o, idtrace_d, dist AS tripdistance_m, dur AS triptime_s, brk AS breaktime_s, CAST(n AS INTEGER) AS points FROM good", "fixes")
def c7_route_summary(t):
    clean = trips.anomaly_codes(_trips(t))
    return trips.route_summary(clean, max_time_s=10**7).select("idtrajectory", "idterm", "idtrace_o", "idtrace_d", "tripdistance_m", "triptime_s", "breaktime_s", F.size("path").alias("points"))


@query("""SELECT idterm, CAST(SUM(greatest(d, 0)) AS BIGINT) AS metres FROM (SELECT idterm, COALESCE(progressive - LAG(progressive) OVER (PARTITION BY idterm ORDER BY timedate, id), 0) AS d FROM fixes) GROUP BY idterm""", "fixes")
def c10_km_increment(t):
    return trips.km_increment(t.fixes).groupBy("idterm").agg(F.bround(F.sum("km") * 1000, 0).cast("long").alias("metres"))


_FLAGS = f"""a AS (SELECT *, CASE WHEN panel = 1 THEN 1 ELSE 0 END AS p, CAST(FLOOR(epoch(timedate)) AS BIGINT) AS s, longitude BETWEEN 14.86::DOUBLE AND 15.25::DOUBLE AND latitude BETWEEN 37.426::DOUBLE AND 37.625::DOUBLE AS inside FROM fixes),
  b AS (SELECT *, s - LAG(s) OVER w AS gap, greatest(COALESCE(progressive - LAG(progressive) OVER w, 0), 0) AS m, LAG(inside) OVER w AS was, LAG(p) OVER w AS lp, month(timedate) <> month(LAG(timedate) OVER w) AS hole FROM a WINDOW w AS (PARTITION BY idterm ORDER BY timedate, id)),
  c AS (SELECT *, CASE WHEN lp IS NULL OR (p = 1 AND lp = 0) THEN 10 WHEN was <> inside AND gap > {GAP} AND m > 500 THEN 11 WHEN COALESCE(hole, FALSE) OR gap > {GAP} THEN CASE WHEN inside THEN 12 ELSE 13 END ELSE 0 END AS st FROM b),
  d AS (SELECT *, CAST(SUM(CASE WHEN st > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY idterm ORDER BY timedate, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS trip_no, LEAD(st) OVER (PARTITION BY idterm ORDER BY timedate, id) AS nxt FROM c),
  o AS (SELECT idterm, trip_no, SUM(CASE WHEN st = 0 THEN m ELSE 0 END) < 10 OR (MAX(s) - MIN(s) > {4 * GAP} AND COALESCE(MAX(CASE WHEN st = 0 THEN gap END), 0) > {2 * GAP}) AS odd FROM d GROUP BY 1, 2),
  e AS (SELECT d.*, o.odd, ROW_NUMBER() OVER (PARTITION BY d.idterm, d.trip_no ORDER BY d.timedate DESC, d.id DESC) = 1 AS at_end FROM d JOIN o ON d.idterm = o.idterm AND d.trip_no = o.trip_no),
  flags AS (SELECT *, CASE WHEN odd AND (st > 0 OR at_end) THEN 5 WHEN st > 0 THEN st WHEN NOT at_end THEN 0 WHEN nxt IS NULL OR nxt = 10 THEN 20 WHEN nxt = 11 THEN 21 WHEN inside THEN 22 ELSE 23 END AS flag FROM e)"""


def _flags(t):
    return trips.trip_flags(_off_on(t), d_sec=GAP, long_s=4 * GAP)


@query("WITH " + _FLAGS + " SELECT id, trip_no, flag FROM flags", "fixes")
def c9_trip_flags(t):
    return _flags(t).select("id", "trip_no", "flag")


_TABLE = _FLAGS + """, r AS (SELECT *, greatest(COALESCE(progressive - LAG(progressive) OVER w, 0), 0) AS rise, LAG(id) OVER w IS NULL AS at_start FROM flags WINDOW w AS (PARTITION BY idterm, trip_no ORDER BY timedate, id)),
  g AS (SELECT idterm, trip_no, MIN(timedate) AS o, MAX(timedate) AS f, MIN(s) AS so, MAX(s) AS se, MAX(CASE WHEN at_start THEN flag END) AS start_flag, MAX(CASE WHEN at_end THEN flag END) AS end_flag, SUM(rise) / 1000.0::DOUBLE AS km, COUNT(*) AS n FROM r GROUP BY 1, 2),
  k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY idterm ORDER BY o, trip_no) AS k, COUNT(*) OVER (PARTITION BY idterm) AS everything, LEAD(so) OVER (PARTITION BY idterm ORDER BY o, trip_no) AS next_so FROM g WHERE start_flag <> 5 AND n > 1)"""


@query("WITH " + _TABLE + " SELECT idterm || '_' || k AS trip_id, so AS start_s, se AS end_s, round_even(km, 6) AS km, start_flag, end_flag, round_even((next_so - se) / 3600.0::DOUBLE, 6) AS stop_h FROM k WHERE everything >= 3", "fixes")
def c11_trip_table(t):
    return trips.trip_table(_flags(t)).select("trip_id", cleaning.epoch("start").alias("start_s"), cleaning.epoch("end").alias("end_s"), F.bround("km", 6).alias("km"), "start_flag", "end_flag", F.bround("stop_h", 6).alias("stop_h"))


@query("""WITH m AS (SELECT id AS trip_no, idterm, CAST(hour(timedate) AS INTEGER) AS end_hour, speed % 12 AS stop_h, grade AS km, speed % 7 AS hours FROM fixes),
  c AS (SELECT idterm, trip_no, CASE WHEN LEAD(trip_no) OVER w IS NULL THEN 0 WHEN end_hour + stop_h > 26 THEN 220 WHEN LEAD(hours) OVER w >= 4 AND LEAD(km) OVER w <= 60 THEN 220 ELSE 210 END AS stop_class FROM m WINDOW w AS (PARTITION BY idterm ORDER BY trip_no))
  SELECT *, COALESCE(LAG(stop_class) OVER (PARTITION BY idterm ORDER BY trip_no) - 100, 0) AS start_class FROM c""", "fixes")
def c12_stop_classes(t):
    made = t.fixes.select(F.col("id").alias("trip_no"), "idterm", F.hour("timedate").alias("end_hour"), (F.col("speed") % 12).alias("stop_h"), F.col("grade").alias("km"), (F.col("speed") % 7).alias("hours"))
    return trips.stop_classes(made).select("idterm", "trip_no", "stop_class", "start_class")


_VALID = "SELECT idtrajectory, tripdistance_m FROM (SELECT idtrajectory, tripdistance_m, breaktime_s, CAST(FLOOR(triptime_s / 40.0) AS BIGINT) AS s FROM trips) WHERE tripdistance_m > 0 AND tripdistance_m < 150000 AND "


@query(_VALID + "s > 60 AND s < 20500 AND tripdistance_m * 3.6 > 15 * s AND tripdistance_m * 3.6 < 220 * s AND breaktime_s > 60 AND breaktime_s < 100000", "trips")
def c13_valid_trips(t):
    return trips.valid_trips(t.trips.withColumn("triptime_s", F.floor(F.col("triptime_s") / 40))).select("idtrajectory", "tripdistance_m")


@query(_VALID + "s > 57.6 AND s < 18000 AND tripdistance_m * 3.6 > 15 * s AND tripdistance_m * 3.6 < 150 * s", "trips")
def c13_valid_short(t):
    return trips.valid_trips(t.trips.withColumn("triptime_s", F.floor(F.col("triptime_s") / 40)), trips.VALID_SHORT).select("idtrajectory", "tripdistance_m")


# --- D: places

def _boxes_sql(stops: str) -> str:
    """Two rounds of the fullest box of each vehicle, as common tables ending in ``places``."""

    def round_(k: int, source: str) -> str:
        return f"""p{k} AS (SELECT a.idterm, a.id AS a, b.id AS b, b.lon AS x, b.lat AS y FROM {source} a JOIN {source} b ON a.idterm = b.idterm AND abs(a.lon - b.lon) <= 0.0065::DOUBLE AND abs(a.lat - b.lat) <= 0.0045::DOUBLE),
  f{k} AS (SELECT idterm, a FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idterm ORDER BY n DESC, a) AS r FROM (SELECT idterm, a, COUNT(*) AS n FROM p{k} GROUP BY 1, 2 HAVING COUNT(*) >= 2)) WHERE r = 1),
  m{k} AS (SELECT p{k}.* FROM p{k} JOIN f{k} ON p{k}.idterm = f{k}.idterm AND p{k}.a = f{k}.a)"""

    return f"""st AS ({stops}), {round_(1, 'st')}, rest AS (SELECT * FROM st WHERE (idterm, id) NOT IN (SELECT (idterm, b) FROM m1)), {round_(2, 'rest')},
  places AS (SELECT idterm, 1 AS rank, round_even(round_even(AVG(x), 9), 6) AS lon, round_even(round_even(AVG(y), 9), 6) AS lat, COUNT(*) AS n FROM m1 GROUP BY 1 UNION ALL SELECT idterm, 2, round_even(round_even(AVG(x), 9), 6), round_even(round_even(AVG(y), 9), 6), COUNT(*) FROM m2 GROUP BY 1)"""


_STOPS = "SELECT id, idterm, longitude AS lon, latitude AS lat, speed % 12 AS stop_h FROM fixes"


def _stops(t):
    """Every fix as a stop: night or day by its hour, border and irregular ones by its number."""
    kind = F.when(F.col("id") % 17 == 0, 5).when(F.hour("timedate") >= 18, 220).when(F.hour("timedate") >= 8, 210).otherwise(0)
    flag = F.when(F.col("id") % 13 == 0, 21).when(F.col("id") % 11 == 0, 11).otherwise(20)
    return t.fixes.select("id", "idterm", "timedate", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), (F.col("speed") % 12).alias("stop_h"), kind.alias("stop_class"), flag.alias("flag"))


@query("WITH " + _boxes_sql(_STOPS) + " SELECT * FROM places", "fixes")
def d1_home_locations(t):
    return places.home_locations(_stops(t))


@query("WITH " + _boxes_sql(_STOPS + " WHERE speed % 12 > 6") + " SELECT * FROM places", "fixes")
def d2_work_locations(t):
    return places.work_locations(_stops(t), 6)


_LABELS = "hw AS (SELECT * FROM (WITH " + _boxes_sql(_STOPS) + " SELECT * FROM places)), ww AS (SELECT * FROM (WITH " + _boxes_sql(_STOPS + " WHERE speed % 12 > 6") + """ SELECT * FROM places)),
  raw AS (SELECT id, idterm, timedate, longitude AS lon, latitude AS lat, CASE WHEN id % 17 = 0 THEN 5 WHEN hour(timedate) >= 18 THEN 220 WHEN hour(timedate) >= 8 THEN 210 ELSE 0 END AS c, CASE WHEN id % 13 = 0 THEN 21 WHEN id % 11 = 0 THEN 11 ELSE 20 END AS flag FROM fixes),
  inn AS (SELECT r.*, (SELECT MIN(rank) FROM hw WHERE hw.idterm = r.idterm AND abs(r.lon - hw.lon) < 0.0065::DOUBLE AND abs(r.lat - hw.lat) < 0.0045::DOUBLE) AS h, (SELECT MIN(rank) FROM ww WHERE ww.idterm = r.idterm AND abs(r.lon - ww.lon) < 0.0065::DOUBLE AND abs(r.lat - ww.lat) < 0.0045::DOUBLE) AS k FROM raw r),
  coded AS (SELECT *, CASE WHEN c NOT IN (210, 220) THEN c WHEN h IS NOT NULL THEN c + h WHEN flag = 21 THEN c + 7 WHEN c = 210 AND k IS NOT NULL THEN 214 + k ELSE c END AS stop_class FROM inn),
  labelled AS (SELECT *, CASE WHEN stop_class = 5 THEN 5 WHEN last >= 200 THEN CASE WHEN flag = 11 AND last IN (210, 220) THEN last - 93 ELSE last - 100 END ELSE 0 END AS start_class
    FROM (SELECT *, LAST_VALUE(CASE WHEN stop_class <> 5 THEN stop_class END IGNORE NULLS) OVER (PARTITION BY idterm ORDER BY timedate, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM coded))"""


def _labelled(t):
    return places.label_stops(_stops(t), places.home_locations(_stops(t)), places.work_locations(_stops(t), 6))


@query("WITH " + _LABELS + " SELECT id, idterm, CAST(stop_class AS INTEGER) AS stop_class, CAST(start_class AS INTEGER) AS start_class FROM labelled", "fixes")
def d3_label_stops(t):
    return _labelled(t).select("id", "idterm", "stop_class", "start_class")


_POI = "abs(latitude - 37.5::DOUBLE) <= 20.0::DOUBLE / 2 / 111.195::DOUBLE AND abs(longitude - 14.95::DOUBLE) * cos(radians(37.5::DOUBLE)) <= 20.0::DOUBLE / 2 / 111.195::DOUBLE"


@query("SELECT id, idterm FROM fixes WHERE " + _POI, "fixes")
def d4_poi_visits(t):
    return places.poi_visits(t.fixes, 14.95, 37.5, 20.0).select("id", "idterm")


@query("WITH " + _LABELS + f""", r AS (SELECT idterm, CAST(timedate AS DATE) AS d, greatest(COALESCE(progressive - LAG(progressive) OVER (PARTITION BY idterm ORDER BY timedate, id), 0), 0) AS rise FROM fixes),
  pd AS (SELECT idterm, d, COUNT(*) AS n, SUM(rise) AS m FROM r GROUP BY 1, 2), p AS (SELECT idterm, SUM(CASE WHEN n > 3 THEN 1 ELSE 0 END)::BIGINT AS days, SUM(m) / 1000.0::DOUBLE AS km FROM pd GROUP BY 1),
  l AS (SELECT idterm, SUM(CASE WHEN stop_class BETWEEN 220 AND 229 AND flag = 20 THEN 1 ELSE 0 END)::BIGINT AS nights_in, SUM(CASE WHEN stop_class BETWEEN 220 AND 229 AND flag IN (21, 22, 23) THEN 1 ELSE 0 END)::BIGINT AS nights_out,
    SUM(CASE WHEN stop_class = 221 THEN 1 ELSE 0 END)::BIGINT AS nights_home1, SUM(CASE WHEN stop_class = 222 THEN 1 ELSE 0 END)::BIGINT AS nights_home2, SUM(CASE WHEN start_class = 117 THEN 1 ELSE 0 END)::BIGINT AS crossings,
    COUNT(DISTINCT CASE WHEN start_class = 115 THEN CAST(timedate AS DATE) END) AS days_work1, COUNT(DISTINCT CASE WHEN start_class = 116 THEN CAST(timedate AS DATE) END) AS days_work2 FROM labelled GROUP BY 1)
  SELECT p.*, l.* EXCLUDE (idterm), COALESCE((SELECT COUNT(*) FROM hw WHERE hw.idterm = p.idterm), 0) AS homes, COALESCE((SELECT COUNT(*) FROM ww WHERE ww.idterm = p.idterm), 0) AS works,
    COALESCE((SELECT COUNT(*) FROM fixes f WHERE f.idterm = p.idterm AND {_POI}), 0) AS poi_stops FROM p JOIN l ON p.idterm = l.idterm""", "fixes")
def d5_vehicle_profile(t):
    homes, works = kept(places.home_locations(_stops(t)), "homes"), kept(places.work_locations(_stops(t), 6), "works")
    return places.vehicle_profile(t.fixes, places.label_stops(_stops(t), homes, works), homes, works, places.poi_visits(t.fixes, 14.95, 37.5, 20.0))


@query("WITH " + _FLAGS + """, n AS (SELECT idterm, COUNT(*) AS records, SUM(CASE WHEN flag BETWEEN 10 AND 19 THEN 1 ELSE 0 END) AS starts, SUM(CASE WHEN flag >= 20 THEN 1 ELSE 0 END) AS ends FROM flags GROUP BY 1)
  SELECT idterm, records, CASE WHEN starts <> ends THEN 1 ELSE 2 END AS reason FROM n WHERE starts <> ends OR starts < 30""", "fixes")
def d6_rejected_vehicles(t):
    return places.rejected_vehicles(t.fixes, _flags(t), 30)


@query("WITH " + _ROUTES + """, pa AS (SELECT g.idterm, g.idtrace_d, f.longitude, f.latitude, f.timedate + INTERVAL 2 HOUR AS a, f.timedate + INTERVAL 2 HOUR + to_seconds(g.brk) AS b FROM good g JOIN fixes f ON g.idtrace_d = f.id WHERE g.brk > 14400),
  q AS (SELECT *, date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) AS days, hour(a) < 3 AS early, hour(b) < 3 AS late FROM pa)
  SELECT idterm, idtrace_d, longitude, latitude, CAST(CASE WHEN days = 0 AND early THEN 1 WHEN days = 0 THEN 0 WHEN early THEN days + 1 WHEN days = 1 AND late THEN 1 ELSE days END AS INTEGER) AS n_nights FROM q WHERE days > 0 OR early""", "fixes")
def d7_parking_nights(t):
    route = trips.route_summary(trips.anomaly_codes(_trips(t)), max_time_s=10**7)
    return places.parking_nights(route, t.fixes)


# places of a vehicle, each with what stands there; places nearer than 120 m reach each other
@query(f"""WITH RECURSIVE few AS (SELECT *, COUNT(*) OVER (PARTITION BY idterm) AS n FROM fixes), stood AS (SELECT idterm, longitude AS x, latitude AS y, MIN(id) AS place, COUNT(*) AS w, CAST(SUM(speed % 3) AS BIGINT) AS nights FROM few WHERE n >= 3 GROUP BY 1, 2, 3),
  near AS (SELECT a.idterm, a.place AS a, b.place AS b FROM stood a JOIN stood b ON a.idterm = b.idterm AND {_far('a.x', 'a.y', 'b.x', 'b.y')} * 1000 <= 120),
  reach(idterm, a, b) AS (SELECT idterm, place, place FROM stood UNION SELECT r.idterm, r.a, n.b FROM reach r JOIN near n ON n.idterm = r.idterm AND n.a = r.b),
  label AS (SELECT idterm, a, MIN(b) AS label FROM reach GROUP BY 1, 2),
  size AS (SELECT t.idterm, l.label, CAST(SUM(t.w) AS BIGINT) AS n_points, CAST(SUM(t.nights) AS BIGINT) AS n_nights FROM stood t JOIN label l ON l.idterm = t.idterm AND l.a = t.place GROUP BY 1, 2),
  middle AS (SELECT t.idterm, l.label, round_even(AVG(f.longitude), 6) AS longitude, round_even(AVG(f.latitude), 6) AS latitude FROM fixes f JOIN stood t ON f.idterm = t.idterm AND f.longitude = t.x AND f.latitude = t.y JOIN label l ON l.idterm = t.idterm AND l.a = t.place GROUP BY 1, 2)
  SELECT idterm, n_points, n_nights, longitude, latitude FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idterm ORDER BY n_nights DESC, label) AS r FROM size JOIN middle USING (idterm, label)) WHERE r = 1""", "fixes")
def d8_night_place(t):
    return places.night_place(t.fixes.select("id", "idterm", "longitude", "latitude", (F.col("speed") % 3).alias("n_nights")))


@query(f"""WITH n AS (SELECT idterm, MIN(longitude) AS x, MIN(latitude) AS y FROM fixes GROUP BY 1), d AS (SELECT f.id, f.idterm, CAST(FLOOR({_far('f.longitude', 'f.latitude', 'n.x', 'n.y')} * 1000) AS BIGINT) AS distance FROM fixes f JOIN n ON f.idterm = n.idterm)
  SELECT idterm, id, distance FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idterm ORDER BY distance, id) AS r FROM d) WHERE r = 1""", "fixes")
def d9_nearest_residence(t):
    nights = t.fixes.groupBy("idterm").agg(F.min("longitude").alias("longitude"), F.min("latitude").alias("latitude"))
    return places.nearest_residence(t.fixes.select("id", "idterm", "longitude", "latitude"), nights)


# --- E: network

def _costed(t):
    return network.edge_cost(network.unique_edges(t.edges))


_COST = "SELECT *, length / (CASE WHEN highway = 'service' THEN 30 WHEN maxspeed IS NOT NULL THEN maxspeed WHEN highway = 'motorway' THEN 110 WHEN highway = 'trunk' THEN 70 WHEN highway = 'primary' THEN 50 WHEN highway = 'secondary' THEN 40 ELSE 30 END * 1000.0::DOUBLE / 3600) AS cost FROM edges"


@query("SELECT u, v, round_even(cost, 6) AS cost FROM (" + _COST + ")", "edges")
def e2_edge_cost(t):
    return _costed(t).select("u", "v", F.bround("cost", 6).alias("cost"))


@query("SELECT u, v, MIN(key) AS key FROM edges GROUP BY u, v", "edges")
def e1_unique_edges(t):
    return network.unique_edges(t.edges).select("u", "v", "key")


@query("SELECT u, v, highway FROM edges WHERE highway NOT IN ('footway', 'service')", "edges")
def e3_filter_highways(t):
    return network.filter_highways(t.edges).select("u", "v", "highway")


@query("""SELECT c.u, c.v, round_even(COALESCE(s.t, c.cost), 4) AS observed_cost FROM (""" + _COST + """) c LEFT JOIN (SELECT u, v, round_even(length / 1000.0::DOUBLE / s * 3600, 4) AS t FROM (SELECT u, v, MIN(length) AS length, FLOOR(AVG(mean_speed)) AS s FROM traversals GROUP BY u, v)) s ON c.u = s.u AND c.v = s.v""", "edges", "traversals")
def e4_observed_cost(t):
    return network.observed_cost(_costed(t), traffic.edge_speed_time(t.traversals, t.edges)).select("u", "v", F.bround("observed_cost", 4).alias("observed_cost"))


@query("""SELECT highway, n, km, round_even(n * 100.0::DOUBLE / SUM(n) OVER (), 4) AS n_pct, round_even(km / SUM(km) OVER () * 100, 4) AS km_pct, mean_limit, max_limit, min_limit
  FROM (SELECT highway, COUNT(*) AS n, SUM(length) / 1000.0::DOUBLE AS km, round_even(AVG(maxspeed), 4) AS mean_limit, MAX(maxspeed) AS max_limit, MIN(maxspeed) AS min_limit FROM edges GROUP BY highway)""", "edges")
def e5_road_class_stats(t):
    return network.road_class_stats(t.edges)


@query("""SELECT area, n, km, round_even(n * 100.0::DOUBLE / SUM(n) OVER (), 4) AS n_pct, round_even(km / SUM(km) OVER () * 100, 4) AS km_pct
  FROM (SELECT CASE WHEN round_even(length / cost * 3.6::DOUBLE, 6) <= 50 THEN 'urban' ELSE 'extra-urban' END AS area, COUNT(*) AS n, SUM(length) / 1000.0::DOUBLE AS km FROM (""" + _COST + ") GROUP BY 1)", "edges")
def e5_urban_totals(t):
    return network.urban_totals(_costed(t))


def _od(t):
    return traffic.trip_od(t.traversals).select(F.col("ORIGIN").alias("origin"), F.col("DESTINATION").alias("destination")).distinct()


#: Doublings of the paths' most edges in the statements: enough for networks of 32 nodes a side.
_DOUBLINGS = 6


def _least(weight: str, roads: str = "edges", name: str = "d") -> str:
    """Least costs between all nodes by min-plus squares, as common tables that end in ``name`` (o, t, c)."""
    first = f"{name}0 AS (SELECT o, t, MIN(c) AS c FROM (SELECT u AS o, v AS t, ({weight})::DOUBLE AS c FROM {roads} UNION ALL SELECT node, node, 0 FROM nodes) GROUP BY 1, 2)"
    square = lambda k, to: f"{to} AS (SELECT a.o, b.t, MIN(a.c + b.c) AS c FROM {name}{k} a JOIN {name}{k} b ON a.t = b.o GROUP BY 1, 2)"
    return ", ".join([first, *(square(k, f"{name}{k + 1}" if k + 1 < _DOUBLINGS else name) for k in range(_DOUBLINGS))])


_PAIRS = "od AS (SELECT DISTINCT ORIGIN AS origin, DESTINATION AS destination FROM ({od}))"


def _on_paths(weight: str, roads: str = "edges", pairs: str = "od", name: str = "d") -> str:
    """The edges of the least paths of ``pairs``, which are unique here: origin, destination, u, v, back."""
    return f"""SELECT p.origin, p.destination, e.u, e.v, CAST(ROW_NUMBER() OVER (PARTITION BY p.origin, p.destination ORDER BY b.c, b.o) - 1 AS INTEGER) AS back
  FROM {pairs} p JOIN {name} x ON x.o = p.origin AND x.t = p.destination JOIN {name} a ON a.o = p.origin JOIN {roads} e ON e.u = a.t JOIN {name} b ON b.o = e.v AND b.t = p.destination WHERE abs(a.c + ({weight}) + b.c - x.c) < 1e-7"""


@query("WITH " + _least("length") + " SELECT o AS origin, t AS node, c AS dist FROM d", "nodes", "edges")
def e6_shortest_paths(t):
    return network.shortest_paths(t.edges, t.nodes.select(F.col("node").alias("origin"))).select("origin", "node", "dist")


# least costs from the depots of the wide network, each round those that improve
_WIDE = """far(o, t, c) USING KEY (o, t) AS (SELECT DISTINCT origin, origin, 0::DOUBLE FROM rides
    UNION SELECT f.o, f.t, f.c FROM (SELECT w.o, e.v AS t, MIN(w.c + e.metres) AS c FROM far w JOIN wide_edges e ON e.u = w.t GROUP BY 1, 2) f LEFT JOIN recurring.far k ON k.o = f.o AND k.t = f.t WHERE k.c IS NULL OR f.c < k.c)"""
_WALKED = """pred AS (SELECT w.o, e.v, arg_min(e.u, w.c + e.metres) AS u FROM far w JOIN wide_edges e ON e.u = w.t WHERE e.v <> w.o GROUP BY 1, 2), asked AS (SELECT DISTINCT origin, destination FROM rides),
  walked AS (SELECT a.origin, a.destination, p.u, p.v, 0 AS back FROM asked a JOIN pred p ON p.o = a.origin AND p.v = a.destination
    UNION ALL SELECT w.origin, w.destination, p.u, p.v, w.back + 1 FROM walked w JOIN pred p ON p.o = w.origin AND p.v = w.u)"""


@query(f"WITH RECURSIVE {_WIDE} SELECT DISTINCT r.origin, r.destination, round_even(far.c, 4) AS dist FROM rides r JOIN far ON far.o = r.origin AND far.t = r.destination", "wide_edges", "rides")
def e6_pair_costs(t):
    return parts.pair_costs(parts.part_index(t.wide_edges, t.wide_nodes, "metres"), t.rides).withColumn("dist", F.bround("dist", 4))


@query(f"WITH RECURSIVE {_WIDE}, {_WALKED} SELECT * FROM walked", "wide_edges", "rides")
def e7_pair_paths(t):
    return parts.pair_paths(parts.part_index(t.wide_edges, t.wide_nodes, "metres"), t.rides)


def _paths(t):
    """Pairs of the traversals, and the edges of their least paths by cost."""
    od = kept(_od(t), "od")
    return od, kept(hubs.pair_paths(hubs.hub_index(_costed(t), "cost"), od), "paths")


_OD = "SELECT idtrajectory, MAX(CASE WHEN a = 1 THEN u END) AS ORIGIN, MAX(CASE WHEN b = 1 THEN v END) AS DESTINATION FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY idtrajectory ORDER BY sequenza) AS a, ROW_NUMBER() OVER (PARTITION BY idtrajectory ORDER BY sequenza DESC) AS b FROM traversals) GROUP BY idtrajectory"
_PAIRS = _PAIRS.format(od=_OD)
_BY_COST = f"costed AS ({_COST}), {_least('cost', 'costed')}, {_PAIRS}, paths AS ({_on_paths('e.cost', 'costed')})"


@query(f"WITH {_BY_COST} SELECT * FROM paths", "nodes", "edges", "traversals")
def e7_path_edges(t):
    return _paths(t)[1]


@query(f"WITH {_BY_COST} SELECT p.origin, p.destination, COUNT(*) AS n_edges, round_even(SUM(c.length) / 1000.0::DOUBLE, 6) AS km, round_even(round_even(SUM(c.cost) / 3600, 10), 6) AS hours, round_even(SUM(c.length) / 1000.0::DOUBLE / (SUM(c.cost) / 3600), 4) AS kmh FROM paths p JOIN costed c ON p.u = c.u AND p.v = c.v GROUP BY 1, 2", "nodes", "edges", "traversals")
def e7_path_totals(t):
    out = network.path_totals(_paths(t)[1], _costed(t))
    return out.select("origin", "destination", "n_edges", F.bround("km", 6).alias("km"), F.bround(F.bround("hours", 10), 6).alias("hours"), F.bround("kmh", 4).alias("kmh"))


@query("WITH " + _least("1") + ", n AS (SELECT COUNT(*) AS n FROM nodes) SELECT o AS node, round_even(COUNT(*) / SUM(c) * COUNT(*) / MAX(n.n - 1), 9) AS closeness FROM d CROSS JOIN n WHERE c > 0 GROUP BY o", "nodes", "edges")
def e8_closeness(t):
    return network.closeness(t.edges)


# up to some hundreds of nodes the counters are exact
@query("WITH " + _least("1") + ", n AS (SELECT COUNT(*) AS n FROM nodes) SELECT o AS node, COUNT(*) AS reached, CAST(SUM(c) AS BIGINT) AS distance, round_even(COUNT(*) / SUM(c) * COUNT(*) / MAX(n.n - 1), 9) AS closeness FROM d CROSS JOIN n WHERE c > 0 GROUP BY o", "nodes", "edges")
def e8_closeness_estimate(t):
    return centrality.closeness_estimate(t.edges)


# sigma: how many least paths; a node's share of a pair is the product of those to and from it over all
def _sigma(weight: str) -> str:
    rounds = 2**5
    steps = ", ".join(f"s{k + 1} AS (SELECT s.o, e.v AS t, SUM(s.n) AS n FROM s{k} s JOIN tight e ON e.o = s.o AND e.u = s.t GROUP BY 1, 2)" for k in range(rounds))
    union = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(rounds + 1))
    return f"""{_least(weight)}, tight AS (SELECT a.o, e.u, e.v FROM d a JOIN edges e ON e.u = a.t JOIN d b ON b.o = a.o AND b.t = e.v WHERE abs(a.c + ({weight}) - b.c) < 1e-7),
  s0 AS (SELECT node AS o, node AS t, 1::DOUBLE AS n FROM nodes), {steps}, sigma AS (SELECT o, t, SUM(n) AS n FROM ({union}) GROUP BY 1, 2)"""


_BETWEEN = "WITH " + _sigma("length") + ", n AS (SELECT COUNT(*)::DOUBLE AS n FROM nodes), pairs AS (SELECT d.o, d.t, d.c, sigma.n AS s FROM d JOIN sigma ON d.o = sigma.o AND d.t = sigma.t)"


@query(_BETWEEN + """, share AS (SELECT a.t AS node, a.s * b.s / p.s AS x FROM pairs p JOIN pairs a ON a.o = p.o JOIN pairs b ON b.o = a.t AND b.t = p.t WHERE p.o <> p.t AND a.t <> p.o AND a.t <> p.t AND abs(a.c + b.c - p.c) < 1e-7)
  SELECT nodes.node, round_even(COALESCE(SUM(share.x), 0) / MAX((n.n - 1) * (n.n - 2)), 9) AS betweenness FROM nodes CROSS JOIN n LEFT JOIN share ON share.node = nodes.node GROUP BY 1""", "nodes", "edges")
def e9_betweenness_nodes(t):
    return network.betweenness_nodes(t.edges)


@query(_BETWEEN + """, share AS (SELECT e.u, e.v, a.s * b.s / p.s AS x FROM pairs p JOIN pairs a ON a.o = p.o JOIN edges e ON e.u = a.t JOIN pairs b ON b.o = e.v AND b.t = p.t WHERE p.o <> p.t AND abs(a.c + e.length + b.c - p.c) < 1e-7)
  SELECT u, v, round_even(SUM(x) / MAX(n.n * (n.n - 1)), 9) AS betweenness FROM share CROSS JOIN n GROUP BY 1, 2""", "nodes", "edges")
def e10_betweenness_edges(t):
    return network.betweenness_edges(t.edges)


#: Samples for an error of 0.1 with probability 0.9, by the number of nodes.
_SAMPLES = """numbered AS (SELECT node, ROW_NUMBER() OVER (ORDER BY node) - 1 AS k, COUNT(*) OVER () AS n FROM nodes),
  size AS (SELECT CAST(ceil(50 * (floor(log2(greatest(MAX(n) - 2, 1))) + 1 + ln(10::DOUBLE))) AS BIGINT) AS size, MAX(n) AS n FROM numbered),
  drawn AS (SELECT CAST('0x' || substr(h, 1, 12) AS BIGINT) % n AS a, CAST('0x' || substr(h, 13, 12) AS BIGINT) % (n - 1) AS b, n FROM (SELECT md5('0-' || unnest(range(size))) AS h, n FROM size)),
  times AS (SELECT x.node AS origin, y.node AS destination, COUNT(*) AS times FROM drawn d JOIN numbered x ON x.k = d.a JOIN numbered y ON y.k = (d.a + 1 + d.b) % d.n GROUP BY 1, 2)"""
_SAMPLED = f"WITH costed AS ({_COST}), {_least('cost', 'costed')}, {_SAMPLES}, walked AS ({_on_paths('e.cost', 'costed', 'times')})"


@query(_SAMPLED + """ SELECT nodes.node, round_even(COALESCE(SUM(t.times), 0)::DOUBLE / MAX(size.size), 9) AS betweenness FROM nodes CROSS JOIN size LEFT JOIN walked w ON w.v = nodes.node AND w.back > 0
  LEFT JOIN times t ON t.origin = w.origin AND t.destination = w.destination GROUP BY 1""", "nodes", "edges")
def e9_sampled_betweenness(t):
    return centrality.sampled_betweenness(_costed(t), "cost", epsilon=0.1)


@query(_SAMPLED + """ SELECT e.u, e.v, round_even(COALESCE(SUM(t.times), 0)::DOUBLE / MAX(size.size), 9) AS betweenness FROM edges e CROSS JOIN size LEFT JOIN walked w ON w.u = e.u AND w.v = e.v
  LEFT JOIN times t ON t.origin = w.origin AND t.destination = w.destination GROUP BY 1, 2""", "nodes", "edges")
def e10_sampled_betweenness(t):
    return centrality.sampled_betweenness_edges(_costed(t), "cost", epsilon=0.1)


_COUNTS = "SELECT u, v, COUNT(*) AS counts FROM traversals GROUP BY u, v"


@query(f"SELECT u, v, round_even(counts / m * 3 + 0.1::DOUBLE, 1) AS scales, round_even(counts / m, 3) AS share FROM (SELECT u, v, counts::DOUBLE AS counts, MAX(counts) OVER ()::DOUBLE AS m FROM ({_COUNTS}))", "traversals")
def e11_scale_scores(t):
    counts = t.traversals.groupBy("u", "v").agg(F.count(F.lit(1)).alias("counts"))
    return network.scale_scores(counts, "counts").select("u", "v", "scales", "share")


# closures make ties: the path of the smallest predecessors, walked back from the destination
_CLOSED = f"""closed AS (SELECT u, v, length + CASE WHEN edge_idx % {{n}} = 0 THEN 864000 ELSE 0 END AS cost, length FROM edges), {_least('cost', 'closed')}, {_PAIRS},
  pred AS (SELECT a.o, e.v, MIN(e.u) AS u FROM d a JOIN closed e ON e.u = a.t JOIN d x ON x.o = a.o AND x.t = e.v WHERE a.c + e.cost = x.c GROUP BY 1, 2),
  paths AS (SELECT p.origin, p.destination, r.u, r.v, 0 AS back FROM od p JOIN pred r ON r.o = p.origin AND r.v = p.destination
    UNION ALL SELECT w.origin, w.destination, r.u, r.v, w.back + 1 FROM paths w JOIN pred r ON r.o = w.origin AND r.v = w.u)"""


@query("WITH RECURSIVE " + _CLOSED.format(n=7) + " SELECT * FROM paths", "nodes", "edges", "traversals")
def e12_closure_routes(t):
    return network.closure_routes(t.edges, t.edges.where("edge_idx % 7 = 0"), _od(t))


@query(f"""SELECT id, node, m FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY m, node) AS r FROM (SELECT f.id, n.node, round_even({_far('f.longitude', 'f.latitude', 'n.x', 'n.y')} * 1000, 3) AS m FROM fixes f CROSS JOIN nodes n)) WHERE r = 1""", "fixes", "nodes")
def e13_nearest_node(t):
    return network.nearest_node(t.fixes.select("id", F.col("longitude").alias("x"), F.col("latitude").alias("y")), t.nodes)


_ENDS = "s AS (SELECT e.u, e.v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM edges e JOIN nodes a ON e.u = a.node JOIN nodes b ON e.v = b.node)"


def _beside(p: str) -> str:
    """Common tables near0 to near: per point of ``p`` (id, px, py) and edge the metres (m) and the share along."""
    return f"""{_ENDS}, near0 AS (SELECT p.*, s.*, (px - x1) * cos(radians(py)) AS ax, py - y1 AS ay, (x2 - x1) * cos(radians(py)) AS bx, y2 - y1 AS by_ FROM {p} p CROSS JOIN s),
  near1 AS (SELECT *, greatest(0, least(1, (ax * bx + ay * by_) / (bx * bx + by_ * by_))) AS along FROM near0), near AS (SELECT *, sqrt(power(ax - along * bx, 2) + power(ay - along * by_, 2)) * 111195.0::DOUBLE AS m FROM near1)"""


@query("WITH pt AS (SELECT id, longitude AS px, latitude AS py FROM fixes), " + _beside("pt") + f""", best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY round_even(m, 3), u, v) AS r FROM near)
  SELECT id, u, v, round_even(m, 3) AS m, CASE WHEN a < b OR (a = b AND u < v) THEN u ELSE v END AS node FROM (SELECT *, round_even({_far('px', 'py', 'x1', 'y1')} * 1000, 3) AS a, round_even({_far('px', 'py', 'x2', 'y2')} * 1000, 3) AS b FROM best WHERE r = 1)""", "fixes", "nodes", "edges")
def e13_nearest_edge(t):
    return network.nearest_edge(t.fixes.select("id", F.col("longitude").alias("x"), F.col("latitude").alias("y")), t.edges, t.nodes)


_HEX = f"""b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM nodes),
  c AS (SELECT *, CAST(FLOOR({_far('x0', 'y0', 'x1', 'y0')} * 1000 / ({{d}} * sqrt(3::DOUBLE) / 2)) AS BIGINT) + 1 AS n_cols, CAST(FLOOR({_far('x0', 'y0', 'x0', 'y1')} * 1000 / {{d}}) AS BIGINT) + 10 AS n_rows FROM b),
  g AS (SELECT *, (x1 - x0) / n_cols AS w FROM c), hexes AS (SELECT r * n_cols + k AS cell, CAST(r AS INTEGER) AS row, CAST(k AS INTEGER) AS col, round_even(x0 + k * w + CASE WHEN r % 2 = 1 THEN w / 2 ELSE 0 END, 9) AS x, round_even(y0 + r * (w / (sqrt(3::DOUBLE) / 2)) * 0.75::DOUBLE, 9) AS y, round_even(w, 9) AS w
    FROM (SELECT *, unnest(range(n_rows)) AS r FROM g) CROSS JOIN LATERAL (SELECT unnest(range(n_cols)) AS k))"""


@query("WITH " + _HEX.format(d=400) + " SELECT CAST(cell AS INTEGER) AS cell, row, col, x, y, w FROM hexes", "nodes")
def e14_hex_grid(t):
    return network.hex_grid(t.nodes)


_CELL_EDGES = _HEX + f""", {_ENDS}, side AS (SELECT unnest([1, -1, 0.5, -0.5, 0.5, -0.5])::DOUBLE AS nx, unnest([0, 0, 1, 1, -1, -1]) * sqrt(3::DOUBLE) / 2 AS ny),
  q AS (SELECT h.cell, s.u, s.v, h.w / 2 - ((s.x1 - h.x) * nx + (s.y1 - h.y) * ny) AS room, (s.x2 - s.x1) * nx + (s.y2 - s.y1) * ny AS go FROM hexes h CROSS JOIN s CROSS JOIN side),
  cells AS (SELECT cell, u, v FROM q GROUP BY 1, 2, 3 HAVING MAX(CASE WHEN go = 0 AND room < 0 THEN 1 ELSE 0 END) = 0 AND greatest(0, MAX(CASE WHEN go < 0 THEN room / go END)) <= least(1, MIN(CASE WHEN go > 0 THEN room / go END)))"""


@query("WITH " + _CELL_EDGES.format(d=400) + " SELECT CAST(cell AS INTEGER) AS cell, u, v FROM cells", "nodes", "edges")
def e15_cell_edges(t):
    return network.cell_edges(network.hex_grid(t.nodes), t.edges, t.nodes)


# --- F: matching

@query("WITH " + _CODED + """ SELECT c.TRIP_ID, COUNT(*) AS n FROM coded c JOIN fixes f ON c.id = f.id
  WHERE NOT (c.anomaly IN ('EQc3456', 'EQc3T5d') OR (c.anomaly = 'IQ2C4V6' AND f.vehtype = 1)) GROUP BY 1 HAVING COUNT(*) >= 2""", "fixes")
def f1_matchable_trips(t):
    return matching.matchable_trips(trips.anomaly_codes(_trips(t)), 2).groupBy("TRIP_ID").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT TRIP_ID, MIN(longitude) - 0.0042::DOUBLE AS x0, MAX(longitude) + 0.0042::DOUBLE AS x1, MIN(latitude) - 0.0042::DOUBLE AS y0, MAX(latitude) + 0.0042::DOUBLE AS y1 FROM drives GROUP BY 1)
  SELECT TRIP_ID, node FROM b JOIN nodes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""", "drives", "nodes")
def f2_bbox_nodes(t):
    return matching.trip_bbox_nodes(t.drives, t.nodes, 0.0042)


_NEAR = "WITH pt AS (SELECT DISTINCT longitude AS px, latitude AS py FROM drives), " + _beside("pt") + ", cands AS (SELECT d.TRIP_ID, d.id, n.u, n.v, n.m FROM drives d JOIN near n ON d.longitude = n.px AND d.latitude = n.py WHERE n.m <= {r})"


def _candidates(t, radius_m=9.0):
    return matching.candidates(t.drives, t.edges, t.nodes, radius_m=radius_m)


@query(_NEAR.format(r=9) + " SELECT TRIP_ID, id, u, v, round_even(m, 3) AS distance FROM cands", "drives", "nodes", "edges")
def f3_candidates(t):
    return _candidates(t).select("TRIP_ID", "id", "u", "v", F.bround("distance", 3).alias("distance"))


@query(_NEAR.format(r=150) + " SELECT TRIP_ID, id, u, v FROM (SELECT *, COUNT(*) OVER (PARTITION BY TRIP_ID, id) AS n FROM cands) WHERE n <= 3", "drives", "nodes", "edges")
def f4_drop_ambiguous(t):
    return matching.drop_ambiguous(_candidates(t, 150.0)).select("TRIP_ID", "id", "u", "v")


@query(_NEAR.format(r=150) + " SELECT TRIP_ID, round_even(median(m) * 1.4826::DOUBLE, 4) AS sigma FROM cands GROUP BY 1", "drives", "nodes", "edges")
def f5_sigma_z(t):
    return matching.sigma_z(_candidates(t, 150.0)).select("TRIP_ID", F.bround("sigma", 4).alias("sigma"))


@query(_NEAR.format(r=150) + ", wide AS (SELECT TRIP_ID, greatest(median(m) * 1.4826::DOUBLE, 1) AS sigma FROM cands GROUP BY 1) SELECT c.TRIP_ID, c.id, c.u, c.v, round_even(exp(-power(c.m / w.sigma, 2) / 2), 9) AS p FROM cands c JOIN wide w ON c.TRIP_ID = w.TRIP_ID", "drives", "nodes", "edges")
def f6_emission(t):
    wide = F.greatest(F.median("distance").over(Window.partitionBy("TRIP_ID")) * matching.SPREAD, F.lit(1.0))  # sigma_z of each trip, in its partition
    near = _candidates(t, 150.0).select("TRIP_ID", "id", "u", "v", "distance", wide.alias("sigma"))
    return near.select("TRIP_ID", "id", "u", "v", F.bround(matching.emission(F.col("distance"), F.col("sigma")), 9).alias("p"))


_STEPS = "WITH pt AS (SELECT DISTINCT longitude AS px, latitude AS py FROM drives), " + _beside("pt") + ", " + _least("length") + """,
  few AS (SELECT * FROM (SELECT d.TRIP_ID, d.id, d.timedate, d.progressive, n.u, n.v, n.along, e.length::DOUBLE AS length, COUNT(*) OVER (PARTITION BY d.TRIP_ID, d.id) AS n FROM drives d JOIN near n ON d.longitude = n.px AND d.latitude = n.py JOIN edges e ON e.u = n.u AND e.v = n.v WHERE n.m <= 9) WHERE n <= 3),
  fx AS (SELECT TRIP_ID, id, LAG(id) OVER w AS last_id, progressive - LAG(progressive) OVER w AS odo FROM (SELECT DISTINCT TRIP_ID, id, timedate, progressive FROM few) WINDOW w AS (PARTITION BY TRIP_ID ORDER BY timedate, id)),
  stepped AS (SELECT a.TRIP_ID, a.id, a.u, a.v, b.u AS from_u, b.v AS from_v, f.odo, CASE WHEN a.u = b.u AND a.v = b.v AND a.along >= b.along THEN (a.along - b.along) * a.length ELSE (1 - b.along) * b.length + x.c + a.along * a.length END AS route
    FROM fx f JOIN few a ON a.TRIP_ID = f.TRIP_ID AND a.id = f.id JOIN few b ON b.TRIP_ID = f.TRIP_ID AND b.id = f.last_id LEFT JOIN d x ON x.o = b.v AND x.t = a.u WHERE f.odo >= 0)"""


def _steps(t):
    return matching.steps(matching.drop_ambiguous(_candidates(t)), t.edges)


@query(_STEPS + " SELECT TRIP_ID, id, u, v, from_u, from_v, round_even(exp(-abs(least(route, odo) - odo) / 1000 / 0.05::DOUBLE), 6) AS p FROM stepped WHERE route <= odo + 5", "drives", "nodes", "edges")
def f7_transition(t):
    near = F.least("route_km", "odometer_km")
    return _steps(t).select("TRIP_ID", "id", "u", "v", "from_u", "from_v", F.bround(matching.transition(near, F.col("odometer_km"), 0.05), 6).alias("p"))


@query(_STEPS + " SELECT round_even(median(abs(route - odo) / 1000) / ln(2::DOUBLE), 9) AS beta FROM stepped WHERE route <= odo + 5", "drives", "nodes", "edges")
def f7_beta(t):
    moves = kept(_steps(t).select(F.abs(F.col("route_km") - F.col("odometer_km")).alias("difference")), "moves")
    return t.spark.createDataFrame([(matching.beta_of(moves),)], "beta double").select(F.bround("beta", 9).alias("beta"))


def _two(t):
    """Drives of two fixes or more: of one alone the direction can't be told."""
    n = F.count(F.lit(1)).over(Window.partitionBy("TRIP_ID"))
    return t.drives.withColumn("n", n).where("n > 1").drop("n")


def _matched(t, drives=None):
    cands = matching.candidates(_two(t) if drives is None else drives, t.edges, t.nodes)
    return matching.match_trips(matching.drop_ambiguous(cands), t.edges)


def _written_drives(t):
    """What ``_two`` keeps, written once for queries that need it after the matching, too."""
    return kept(_two(t).select("TRIP_ID", "id", "timedate", "longitude", "latitude", "progressive", "speed"), "drives")


_LONG = "long AS (SELECT * FROM drives WHERE TRIP_ID IN (SELECT TRIP_ID FROM drives GROUP BY 1 HAVING COUNT(*) > 1))"


@query("WITH " + _LONG + " SELECT TRIP_ID, id, u, v FROM long", "drives")
def f8_match_trips(t):
    """The drives follow the network, so the statement is their own edges."""
    return _matched(t).select("TRIP_ID", "id", "u", "v")


_FIRSTS = "firsts AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY TRIP_ID, u, v ORDER BY k) AS r, LEAD(progressive) OVER w - progressive AS m, CAST(FLOOR(epoch(LEAD(timedate) OVER w)) AS BIGINT) - CAST(FLOOR(epoch(timedate)) AS BIGINT) AS s FROM long WINDOW w AS (PARTITION BY TRIP_ID ORDER BY k)) WHERE r = 1)"


@query("WITH " + _LONG + ", " + _FIRSTS + ' SELECT TRIP_ID, u, v, CAST(ROW_NUMBER() OVER (PARTITION BY TRIP_ID ORDER BY k) AS INTEGER) AS "order" FROM firsts', "drives")
def f9_matched_route(t):
    drives = _written_drives(t)
    return matching.matched_route(matching.stretches(_matched(t, drives), drives), t.edges)


@query("WITH " + _LONG + ", " + _FIRSTS + ", o AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY TRIP_ID ORDER BY k) - 1 AS INTEGER) AS sequenza, COALESCE(CAST(FLOOR(m * 3.6::DOUBLE / s) AS BIGINT), speed) AS mean_speed FROM firsts) SELECT TRIP_ID, sequenza, u, v, id AS idtrace, timedate, mean_speed FROM o WHERE mean_speed > 0 AND mean_speed < 190", "drives")
def f10_traversals(t):
    drives = _written_drives(t)
    return matching.traversals(_matched(t, drives), drives, t.edges)


_ACC = """SELECT m.idtrajectory, m.matched, d.driven, CAST(FLOOR(m.matched * 100.0::DOUBLE / d.driven) AS BIGINT) AS accuracy FROM
  (SELECT idtrajectory, SUM(length) AS matched FROM (SELECT DISTINCT idtrajectory, u, v, length FROM traversals) GROUP BY 1) m
  JOIN (SELECT idtrajectory, SUM(d) AS driven FROM (SELECT idterm AS idtrajectory, greatest(COALESCE(progressive - LAG(progressive) OVER (PARTITION BY idterm ORDER BY timedate, id), 0), 0) AS d FROM fixes) GROUP BY 1) d ON m.idtrajectory = d.idtrajectory WHERE d.driven > 0"""


def _acc(t):
    return matching.match_accuracy(t.traversals, t.fixes.withColumn("idtrajectory", F.col("idterm")))


@query(f"SELECT idtrajectory, accuracy FROM ({_ACC})", "traversals", "fixes")
def f11_match_accuracy(t):
    return _acc(t).select("idtrajectory", "accuracy")


@query(f"SELECT round_even(SUM(CASE WHEN accuracy BETWEEN 80 AND 120 THEN 1 ELSE 0 END) * 100.0::DOUBLE / COUNT(*), 4) AS goodness, COUNT(*) AS trips FROM ({_ACC}) WHERE accuracy > 0 AND accuracy < 100", "traversals", "fixes")
def f12_goodness(t):
    return matching.accuracy_goodness(_acc(t))


@query(f"SELECT idtrajectory, accuracy FROM ({_ACC}) WHERE accuracy > 1 AND accuracy <= 40 AND matched < 25000 AND matched > 1600", "traversals", "fixes")
def f13_bands(t):
    return matching.accuracy_bands(_acc(t), 1, 40).select("idtrajectory", "accuracy")


# --- G: traffic indicators

_ENRICHED = "SELECT t.*, f.speed FROM traversals t LEFT JOIN fixes f ON t.idtrace = f.id"
_FLUX = "SELECT u, v, hour, AVG(n) AS FLUX FROM (SELECT u, v, CAST(hour(timedate) AS INTEGER) AS hour, CAST(timedate AS DATE) AS d, COUNT(*) AS n FROM traversals GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"
_SPEED = f"SELECT u, v, CAST(hour(timedate) AS INTEGER) AS hour, CAST(FLOOR(AVG(speed)) AS INTEGER) AS speed FROM ({_ENRICHED}) GROUP BY 1, 2, 3"


def _flux(t):
    return traffic.hourly_flux(t.traversals)


def _speed(t):
    return traffic.hourly_speed(traffic.enrich_traversals(t.traversals, t.fixes))


@query(f"SELECT idtrajectory, sequenza, u, v, speed FROM ({_ENRICHED}) WHERE vehtype = 2", "traversals", "fixes")
def g1_enrich(t):
    return traffic.enrich_traversals(t.traversals, t.fixes, 2).select("idtrajectory", "sequenza", "u", "v", "speed")


_FREQ = "SELECT * FROM (SELECT *, CAST(round_even(counts * 100.0::DOUBLE / MAX(counts) OVER ({over}), 0) AS INTEGER) AS frequency FROM ({counts})) WHERE frequency >= {least}"


@query(_FREQ.format(over="", counts=_COUNTS, least=90), "traversals")
def g2_edge_frequency(t):
    return traffic.edge_frequency(t.traversals, 90)


@query(_FREQ.format(over="PARTITION BY month, weekday", counts="SELECT CAST(month(timedate) AS INTEGER) AS month, CAST(isodow(timedate) - 1 AS INTEGER) AS weekday, u, v, COUNT(*) AS counts FROM traversals GROUP BY 1, 2, 3, 4", least=80), "traversals")
def g3_edge_frequency_dow(t):
    return traffic.edge_frequency_dow(t.traversals, 80)


@query("SELECT vehtype, u, v, counts, round_even(counts::DOUBLE / MAX(counts) OVER (), 4) * 100 AS load, counts::DOUBLE / MAX(counts) OVER () * 7 AS scales FROM (SELECT vehtype, u, v, COUNT(*) AS counts FROM traversals GROUP BY 1, 2, 3)", "traversals")
def g4_edge_load(t):
    return traffic.edge_load(t.traversals, ["vehtype"])


@query("SELECT u, v, a - b AS diff FROM (SELECT u, v, SUM(CASE WHEN day(timedate) <= 14 THEN 1 ELSE 0 END)::BIGINT AS a, SUM(CASE WHEN day(timedate) > 14 THEN 1 ELSE 0 END)::BIGINT AS b FROM traversals GROUP BY 1, 2) WHERE a > b", "traversals")
def g5_count_diff(t):
    day = F.dayofmonth("timedate")
    return traffic.edge_count_diff(t.traversals.where(day <= 14), t.traversals.where(day > 14))


_SPEED_TIME = "SELECT u, v, s AS travel_speed, counts, length, round_even(length / 1000.0::DOUBLE / s * 3600, 4) AS travel_time FROM (SELECT u, v, CAST(FLOOR(AVG(mean_speed)) AS INTEGER) AS s, COUNT(*) AS counts, MIN(length) AS length FROM {t} GROUP BY u, v)"


@query(_SPEED_TIME.format(t="traversals"), "traversals")
def g6_speed_time(t):
    return traffic.edge_speed_time(t.traversals, t.edges)


@query(_FLUX, "traversals")
def g7_hourly_flux(t):
    return _flux(t)


@query(f"SELECT hour, round_even(SUM(FLUX), 6) AS FLUX FROM ({_FLUX}) GROUP BY hour", "traversals")
def g8_hourly_profile(t):
    return traffic.hourly_profile(_flux(t))


_PEAKS = f"""SELECT u, v, MAX(CASE WHEN a = 1 THEN hour END) AS peak_hour, MAX(FLUX) AS peak_flux, MAX(CASE WHEN b = 1 THEN hour END) AS low_hour, MIN(FLUX) AS low_flux
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY u, v ORDER BY FLUX DESC, hour) AS a, ROW_NUMBER() OVER (PARTITION BY u, v ORDER BY FLUX, hour) AS b FROM ({_FLUX})) GROUP BY u, v"""


@query(_PEAKS, "traversals")
def g9_peak_hours(t):
    return traffic.peak_hours(_flux(t))


@query(_SPEED, "traversals", "fixes")
def g10_hourly_speed(t):
    return _speed(t)


@query(f"""WITH c AS (SELECT p.u, p.v, p.peak_hour, p.low_hour, p.peak_flux, a.speed AS peak_speed, b.speed AS low_speed, abs(1 - a.speed::DOUBLE / b.speed) AS ci
  FROM ({_PEAKS}) p JOIN ({_SPEED}) a ON p.u = a.u AND p.v = a.v AND p.peak_hour = a.hour JOIN ({_SPEED}) b ON p.u = b.u AND p.v = b.v AND p.low_hour = b.hour
  WHERE a.speed <> 0 AND b.speed <> 0 AND p.peak_flux >= 1)
  SELECT u, v, peak_hour, low_hour, peak_flux, peak_speed, low_speed, round_even(ci, 6) AS ci, round_even(ci / (SELECT MAX(ci) FROM c WHERE ci <= 1), 2) AS congestion FROM c WHERE ci <= 1""", "traversals", "fixes")
def g11_congestion_index(t):
    return traffic.congestion_index(_flux(t), _speed(t), min_flux=1)


@query("WITH x AS (SELECT u, v, length FROM edges UNION ALL SELECT u, v + 500000, 5 + length % 50 FROM edges WHERE edge_idx % 3 = 0) SELECT u, v FROM x WHERE NOT (length <= 28 AND v NOT IN (SELECT u FROM x))", "edges")
def g12_drop_stub_edges(t):
    stubs = t.edges.where("edge_idx % 3 = 0").select("u", (F.col("v") + 500000).alias("v"), (5 + F.col("length") % 50).alias("length"))  # dead ends of 5 to 54 metres
    return traffic.drop_stub_edges(t.edges.select("u", "v", "length").unionByName(stubs)).select("u", "v")


@query(f"SELECT t.idtrajectory, t.sequenza FROM traversals t JOIN (SELECT u, v FROM ({_COUNTS}) WHERE counts >= (SELECT median(counts) FROM ({_COUNTS}))) c ON t.u = c.u AND t.v = c.v", "traversals")
def g13_min_records(t):
    counts = kept(t.traversals.groupBy("u", "v").agg(F.count(F.lit(1)).alias("counts")), "counts")
    return traffic.min_records(t.traversals, ranks.exact_median(counts, "counts") or 0).select("idtrajectory", "sequenza")


@query(f"""SELECT t.u, t.v, f.vehtype, MIN(e.highway) AS highway, MIN(e.length) AS length, COUNT(*) AS records, COUNT(DISTINCT t.idterm) AS vehicles, median(t.mean_speed) AS median_speed, median(t.speed) AS median_instant
  FROM ({_ENRICHED}) t LEFT JOIN (SELECT idterm, MIN(vehtype) AS vehtype FROM fixes GROUP BY 1) f ON t.idterm = f.idterm JOIN edges e ON t.u = e.u AND t.v = e.v WHERE t.mean_speed < 100 GROUP BY 1, 2, 3""", "traversals", "fixes", "edges")
def g14_select_edges(t):
    return traffic.select_edges(t.traversals, t.fixes, t.edges, t.edges, cleaning.vehicle_types(t.fixes, t.registry), 100)


@query("SELECT s.u, s.v, s.mean_speed, s.records, e.total, CAST(round_even(s.records * 100.0::DOUBLE / e.total, 0) AS INTEGER) AS time_pct FROM (SELECT u, v, mean_speed, COUNT(*) AS records FROM traversals GROUP BY 1, 2, 3) s JOIN (SELECT u, v, COUNT(*) AS total FROM traversals GROUP BY 1, 2) e ON s.u = e.u AND s.v = e.v", "traversals")
def g15_speed_distribution(t):
    return traffic.speed_distribution(t.traversals)


@query("SELECT u, v, CAST(FLOOR(round_even(AVG(n), 1)) AS INTEGER) AS vehicles, round_even(FLOOR(round_even(AVG(n), 1)) / (MIN(length) / 1000.0::DOUBLE), 6) AS density FROM (SELECT u, v, timedate, COUNT(*) AS n, MIN(length) AS length FROM traversals GROUP BY 1, 2, 3) GROUP BY u, v", "traversals")
def g16_edge_density(t):
    return traffic.edge_density(t.traversals, t.edges)


@query("SELECT u, v, round_even(AVG(n / 0.25::DOUBLE), 6) AS flux FROM (SELECT u, v, time_bucket(INTERVAL 15 MINUTE, timedate) AS q, COUNT(*) AS n FROM traversals GROUP BY 1, 2, 3) GROUP BY u, v", "traversals")
def g17_flux_15min(t):
    return traffic.flux_15min(t.traversals)


# written from the rules themselves, in their order, and not from the operator's table
_LOS = """CASE WHEN (t > 85 AND m = 50) OR (m = 90 AND s > 42.2 AND d < 7) THEN 'A' WHEN t > 85 AND m IN (50, 90) AND s > 76.5 AND d < 7 THEN 'A'
  WHEN (t < 85 AND t > 67 AND m = 50) OR (m = 90 AND s < 42.2 AND s > 33.5 AND d < 11 AND d > 7) THEN 'B' WHEN (t < 85 AND t > 67 AND m = 90) OR (m = 50 AND s < 76.5 AND s > 60.3 AND d < 11 AND d > 7) THEN 'B'
  WHEN (t < 67 AND t > 50 AND m = 50) OR (m = 90 AND s < 33.5 AND s > 25 AND d < 17 AND d > 11) THEN 'C' WHEN (t < 67 AND t > 50 AND m = 90) OR (m = 50 AND s < 60.3 AND s > 45 AND d < 17 AND d > 11) THEN 'C'
  WHEN (t < 50 AND t > 40 AND m = 50) OR (m = 90 AND s < 25 AND s > 20 AND d < 22 AND d > 17) THEN 'D' WHEN (t < 50 AND t > 40 AND m = 90) OR (m = 50 AND s < 45 AND s > 36 AND d < 22 AND d > 17) THEN 'D'
  WHEN (t < 40 AND t > 30 AND m = 50) OR (m = 90 AND s < 20 AND s > 15 AND d < 28 AND d > 22) THEN 'E' WHEN (t < 40 AND t > 30 AND m = 90) OR (m = 50 AND s < 36 AND s > 27 AND d < 28 AND d > 22) THEN 'E'
  WHEN (t < 30 AND m = 50) OR (m = 90 AND s < 15 AND d > 28) THEN 'F' WHEN (t < 30 AND m = 90) OR (m = 50 AND s < 27 AND d > 28) THEN 'F'
  WHEN t <= 35 AND s > 90 THEN 'A' WHEN t < 50 AND t > 35 AND s < 90 AND s > 80 THEN 'B' WHEN t < 65 AND t > 50 AND s < 80 AND s > 70 THEN 'C' WHEN t < 80 AND t > 65 AND s < 70 AND s > 60 THEN 'D' WHEN t > 80 AND s < 35 THEN 'E' ELSE 'A' END"""
_LOS_CLASS = "CASE LOS WHEN 'A' THEN 1 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END AS los_class"


@query(f"SELECT id, LOS, {_LOS_CLASS} FROM (SELECT id, {_LOS} AS LOS FROM (SELECT id, speed AS s, grade * 5 AS t, 30 + 20 * (id % 4) AS m, (id % 31)::DOUBLE AS d FROM fixes))", "fixes")
def g18_level_of_service(t):
    made = t.fixes.select("id", "speed", (F.col("grade") * 5).alias("time_pct"), (30 + 20 * (F.col("id") % 4)).alias("maxspeed"), (F.col("id") % 31).cast("double").alias("density"))
    return traffic.level_of_service(made).select("id", "LOS", "los_class")


@query(f"""WITH x AS (SELECT s.u, s.v, s.mean_speed AS s, CAST(round_even(s.records * 100.0::DOUBLE / e.total, 0) AS INTEGER) AS t FROM (SELECT u, v, mean_speed, COUNT(*) AS records FROM traversals GROUP BY 1, 2, 3) s JOIN (SELECT u, v, COUNT(*) AS total FROM traversals GROUP BY 1, 2) e ON s.u = e.u AND s.v = e.v),
  y AS (SELECT u, v, round_even(FLOOR(round_even(AVG(n), 1)) / (MIN(length) / 1000.0::DOUBLE), 6) AS d FROM (SELECT u, v, timedate, COUNT(*) AS n, MIN(length) AS length FROM traversals GROUP BY 1, 2, 3) GROUP BY u, v),
  z AS (SELECT u, v, CASE highway WHEN 'motorway' THEN 130 WHEN 'trunk' THEN 90 WHEN 'primary' THEN 70 WHEN 'secondary' THEN 90 WHEN 'residential' THEN 50 ELSE 30 END AS m FROM edges)
  SELECT u, v, mean_speed, maxspeed, LOS, {_LOS_CLASS} FROM (SELECT x.u, x.v, x.s AS mean_speed, z.m AS maxspeed, {_LOS} AS LOS FROM x JOIN y ON x.u = y.u AND x.v = y.v JOIN z ON x.u = z.u AND x.v = z.v)""", "traversals", "edges")
def g18_edge_service(t):
    limits = traffic.class_limits(t.edges).select("u", "v", "maxspeed")
    seen = traffic.speed_distribution(t.traversals).join(limits, ["u", "v"]).join(traffic.edge_density(t.traversals, t.edges).drop("vehicles"), ["u", "v"])
    return traffic.level_of_service(seen.withColumn("speed", F.col("mean_speed"))).select("u", "v", "mean_speed", "maxspeed", "LOS", "los_class")


@query("SELECT a.u, a.v, a.v AS next_u, b.v AS next_v FROM edges a JOIN edges b ON a.v = b.u WHERE b.v <> a.u", "edges")
def g19_chain_edges(t):
    return traffic.chain_edges(t.edges)


@query(f"SELECT ORIGIN, DESTINATION, trips FROM (SELECT ORIGIN, DESTINATION, COUNT(*) AS trips, MAX(COUNT(*)) OVER () AS m FROM ({_OD}) GROUP BY 1, 2) WHERE trips = m", "traversals")
def g20_top_od(t):
    return traffic.top_od(t.traversals)


@query("SELECT CAST(timedate AS DATE) AS day, SUM(progressive) / 1000.0::DOUBLE AS km FROM fixes GROUP BY 1 HAVING SUM(progressive) / 1000.0::DOUBLE > 100", "fixes")
def g21_daily_km(t):
    return traffic.daily_km(t.fixes, 100)


# --- H: resilience

_DENSE = f"SELECT f.u, f.v, f.hour, f.FLUX, s.speed, f.FLUX / s.speed AS density FROM ({_FLUX}) f JOIN ({_SPEED}) s ON f.u = s.u AND f.v = s.v AND f.hour = s.hour WHERE s.speed > 0 AND f.FLUX >= 1"
_H = f"""WITH d AS ({_DENSE}), vol AS (SELECT u, v, MAX(FLUX) AS mf, (MAX(FLUX) - MIN(FLUX)) / 2 AS vol FROM d GROUP BY u, v),
  pk AS (SELECT u, v, density AS pd, speed AS ps, FLUX AS mf FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY u, v ORDER BY FLUX DESC, hour) AS n FROM d) WHERE n = 1),
  cd AS (SELECT u, MAX(FLUX) - MIN(FLUX) AS cd FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY u ORDER BY FLUX DESC, v, hour) AS n FROM d) WHERE n <= 2 GROUP BY u HAVING COUNT(*) = 2),
  r AS (SELECT d.u, d.v, AVG(((d.FLUX + vol.vol) / d.speed) / ((pk.mf + vol.vol) / pk.ps)) AS r FROM d JOIN vol ON d.u = vol.u AND d.v = vol.v JOIN pk ON d.u = pk.u AND d.v = pk.v JOIN cd ON d.u = cd.u WHERE pk.mf > cd.cd GROUP BY d.u, d.v),
  fi AS (SELECT v AS u, hour, AVG(FLUX) AS fi FROM d GROUP BY v, hour),
  c AS (SELECT d.u, d.v, AVG(((d.FLUX + (fi.fi - d.FLUX)) / d.speed) / ((pk.mf - cd.cd) / pk.ps)) AS c FROM d JOIN fi ON d.u = fi.u AND d.hour = fi.hour JOIN pk ON d.u = pk.u AND d.v = pk.v JOIN cd ON d.u = cd.u WHERE pk.mf > cd.cd GROUP BY d.u, d.v)
"""


def _dense(t):
    return resilience.density(_flux(t), _speed(t), 1)


@query(f"SELECT u, v, MAX(FLUX) AS max_flux, (MAX(FLUX) - MIN(FLUX)) / 2 AS volatility FROM ({_FLUX}) GROUP BY u, v", "traversals")
def h1_volatility(t):
    return resilience.flux_volatility(_flux(t))


@query(_H + "SELECT u, v, hour, round_even(density, 9) AS density FROM d", "traversals", "fixes")
def h2_density(t):
    return _dense(t).select("u", "v", "hour", F.bround("density", 9).alias("density"))


@query(_H + "SELECT u, cd AS capacity_drop FROM cd", "traversals", "fixes")
def h3_capacity_drop(t):
    return resilience.capacity_drop(_dense(t))


@query(_H + "SELECT u, v, round_even(r, 6) AS resistance FROM r", "traversals", "fixes")
def h4_resistance(t):
    return resilience.resistance(_dense(t)).select("u", "v", F.bround("resistance", 6).alias("resistance"))


@query(_H + "SELECT u, v, round_even(c, 6) AS recovery FROM c", "traversals", "fixes")
def h5_recovery(t):
    return resilience.recovery(_dense(t)).select("u", "v", F.bround("recovery", 6).alias("recovery"))


@query(_H + """SELECT u, v, round_even(CASE WHEN x <= 1 THEN 1 - x ELSE x END, 6) AS resilience, CASE WHEN x <= 1 THEN 'low' ELSE 'high' END AS part FROM
  (SELECT r.u, r.v, CASE WHEN m.md <= pk.pd THEN r.r ELSE c.c END AS x FROM (SELECT u, v, AVG(density) AS md FROM d GROUP BY u, v) m JOIN pk ON m.u = pk.u AND m.v = pk.v JOIN r ON m.u = r.u AND m.v = r.v JOIN c ON m.u = c.u AND m.v = c.v)""", "traversals", "fixes")
def h6_resilience(t):
    return resilience.resilience(_dense(t)).select("u", "v", F.bround("resilience", 6).alias("resilience"), "part")


# --- I: demand and vulnerability

@query(f"SELECT DISTINCT t.u, t.v, o.ORIGIN, o.DESTINATION FROM traversals t JOIN ({_OD}) o ON t.idtrajectory = o.idtrajectory", "traversals")
def i1_trip_od(t):
    return demand.trip_od(t.traversals)


@query(_SPEED_TIME.format(t="(SELECT * FROM traversals WHERE (u, v) IN (SELECT (u, v) FROM traversals WHERE vehtype = 2 AND mean_speed > 100))"), "traversals")
def i2_heavy_subnetwork(t):
    used = t.traversals.withColumn("vehtype", F.when(F.col("mean_speed") > 100, F.col("vehtype")).otherwise(1))
    return demand.heavy_subnetwork(used, t.edges)


@query("SELECT idtrajectory, sequenza FROM traversals WHERE month(timedate) = 2 AND isodow(timedate) <= 5 AND hour(timedate) IN (7, 8)", "traversals")
def i3_peak_slice(t):
    return demand.peak_slice(t.traversals, 2).select("idtrajectory", "sequenza")


def _edge_counts(t):
    return t.traversals.groupBy("u", "v").agg(F.count(F.lit(1)).alias("counts"))


_DEMAND = f"n AS ({_COUNTS}), demand AS (SELECT p.origin, p.destination, SUM(n.counts) / 1 / 30.0::DOUBLE / 16 AS demand FROM paths p JOIN n ON p.u = n.u AND p.v = n.v GROUP BY 1, 2)"


@query(f"WITH {_BY_COST}, {_DEMAND} SELECT origin, destination, round_even(demand, 9) AS demand FROM demand", "nodes", "edges", "traversals")
def i4_travel_demand(t):
    return demand.travel_demand(_paths(t)[1], _edge_counts(t)).withColumn("demand", F.bround("demand", 9))


@query(f"""WITH {_BY_COST}, q AS (SELECT u, v, time_bucket(INTERVAL 15 MINUTE, timedate) AS q, COUNT(*) AS n FROM traversals GROUP BY 1, 2, 3)
  SELECT origin, destination, round_even(round_even(AVG(n) / 0.25::DOUBLE, 9), 6) AS demand FROM (SELECT p.origin, p.destination, q.q, AVG(q.n) AS n FROM paths p JOIN q ON p.u = q.u AND p.v = q.v GROUP BY 1, 2, 3) GROUP BY 1, 2""", "nodes", "edges", "traversals")
def i4_travel_demand_15min(t):
    return demand.travel_demand_15min(_paths(t)[1], t.traversals).withColumn("demand", F.bround(F.bround("demand", 9), 6))  # sums in any order give one value


def _cells(t):
    return kept(network.cell_edges(network.hex_grid(t.nodes, 1800), t.edges, t.nodes), "cells")


#: Costs with a cell's edges closed, from the origins whose paths it cuts, each round those that improve.
_DETOURS = f"""{_BY_COST}, {_CELL_EDGES.format(d=1800)}, crossed AS (SELECT DISTINCT k.cell, p.origin, p.destination FROM paths p JOIN cells k ON p.u = k.u AND p.v = k.v),
  shut(cell, o, t, c) USING KEY (cell, o, t) AS (SELECT DISTINCT cell, origin, origin, 0::DOUBLE FROM crossed
    UNION SELECT f.cell, f.o, f.t, f.c FROM (SELECT w.cell, w.o, e.v AS t, MIN(w.c + e.cost + CASE WHEN k.cell IS NULL THEN 0 ELSE 18000 END) AS c FROM shut w JOIN costed e ON e.u = w.t LEFT JOIN cells k ON k.cell = w.cell AND k.u = e.u AND k.v = e.v GROUP BY 1, 2, 3) f
      LEFT JOIN recurring.shut x ON x.cell = f.cell AND x.o = f.o AND x.t = f.t WHERE x.c IS NULL OR f.c < x.c),
  detours AS (SELECT k.cell, k.origin, k.destination, (y.c - x.c) / 3600 AS dt FROM crossed k JOIN shut y ON y.cell = k.cell AND y.o = k.origin AND y.t = k.destination JOIN d x ON x.o = k.origin AND x.t = k.destination)"""


def _impact_sql(which: str = "TRUE", day: str = "0", name: str = "") -> str:
    """Common tables impacts and imp (with ``name`` at the end) of the traffic ``which``, for each ``day``."""
    counted = f"(SELECT {day} AS day, u, v, COUNT(*) AS counts FROM traversals WHERE {which} GROUP BY 1, 2, 3)"
    return f"""demand{name} AS (SELECT n.day, p.origin, p.destination, SUM(n.counts) / 1 / 30.0::DOUBLE / 16 AS demand FROM paths p JOIN {counted} n ON p.u = n.u AND p.v = n.v GROUP BY 1, 2, 3),
  impacts{name} AS (SELECT m.day, k.cell, k.origin, k.destination, round_even(k.dt, 9) AS dt, round_even(CASE WHEN k.dt < 5 THEN m.demand * k.dt * (5 - k.dt / 2) ELSE m.demand * 12.5::DOUBLE END, 6) AS delay FROM detours k JOIN demand{name} m ON m.origin = k.origin AND m.destination = k.destination),
  imp{name} AS (SELECT s.day, k.u, k.v, CAST(k.cell AS INTEGER) AS cell, s.importance FROM cells k JOIN (SELECT day, cell, CAST(FLOOR(SUM(delay)) AS BIGINT) AS importance FROM impacts{name} GROUP BY 1, 2) s ON k.cell = s.cell)"""


_IMPACTS = f"WITH RECURSIVE {_DETOURS}, {_impact_sql()}"
_BY_DAY = f"WITH RECURSIVE {_DETOURS}, {_impact_sql(day='CASE WHEN isodow(timedate) <= 5 THEN 0 ELSE 1 END')}"
_NETWORK = ("nodes", "edges", "traversals")


def _detours(t):
    """Pairs' detours around each cell, the pairs' paths, and the cells."""
    od, paths = _paths(t)
    cells = _cells(t)
    return kept(demand.closure_detours(cells, od, _costed(t)), "detours"), paths, cells


def _impacts(t, detours, paths, which="true", tags=()):
    """Delays by the demand of the traffic ``which``; with ``tags`` those of each of their values."""
    counts = t.traversals.where(which).withColumn("day", F.when(F.weekday("timedate") < 5, 0).otherwise(1)).groupBy(*tags, "u", "v").agg(F.count(F.lit(1)).alias("counts"))
    return demand.detour_impact(detours, demand.travel_demand(paths, counts, tags=tags))


@query(f"{_IMPACTS} SELECT CAST(cell AS INTEGER) AS cell, origin, destination, dt, delay FROM impacts", *_NETWORK)
def i5_closure_impact(t):
    od, paths = _paths(t)
    return demand.closure_impact(_cells(t), od, _costed(t), demand.travel_demand(paths, _edge_counts(t)))


def _importance(t, *which, tags=()):
    """Importance of the cells for each kind of traffic, from one set of detours."""
    detours, paths, cells = _detours(t)
    out = [demand.cell_importance(_impacts(t, detours, paths, w, tags), cells, tags) for w in which or ("true",)]
    return out if len(out) > 1 else out[0]


@query(f"{_IMPACTS} SELECT u, v, cell, importance FROM imp", *_NETWORK)
def i6_cell_importance(t):
    return _importance(t)


@query(f"{_IMPACTS} SELECT u, v, cell, round_even(importance::DOUBLE / MAX(importance) OVER (), 4) AS importance, round_even(importance::DOUBLE / MAX(importance) OVER () * 3 + 0.1::DOUBLE, 4) AS scales FROM imp", *_NETWORK)
def i7_normalised(t):
    return demand.normalise_vulnerability(_importance(t))


_PER_EDGE = "r AS (SELECT u, v, 2 AS month, day, SUM(importance) AS x FROM imp GROUP BY 1, 2, 3, 4), e7 AS (SELECT u, v, month, day, round_even(x::DOUBLE / MAX(x) OVER (PARTITION BY month, day), 4) AS importance, round_even(x::DOUBLE / MAX(x) OVER (PARTITION BY month, day) * 3 + 0.1::DOUBLE, 4) AS scales FROM r)"


def _per_edge(t):
    """Of working days (0) and of weekends (1)."""
    return demand.normalise_vulnerability(_importance(t, tags=("day",)).withColumn("month", F.lit(2)), ("month", "day"), per_edge=True)


@query(f"{_BY_DAY}, {_PER_EDGE} SELECT u, v, month, day, importance, scales FROM e7", *_NETWORK)
def i7_normalised_edges(t):
    return _per_edge(t)


@query(f"WITH RECURSIVE {_DETOURS}, {_impact_sql()}, {_impact_sql('vehtype = 2', name='2')} SELECT a.u, a.v, a.cell, a.importance - b.importance AS difference FROM imp a JOIN imp2 b ON a.u = b.u AND a.v = b.v AND a.cell = b.cell", *_NETWORK)
def i8_difference(t):
    return demand.vulnerability_difference(*_importance(t, "true", "vehtype = 2"))


@query(f"{_BY_DAY}, {_PER_EDGE} SELECT CASE WHEN u < v THEN 'A' ELSE 'D' END AS direction, month, day, round_even(AVG(importance) * 100, 4) AS mean_pct FROM e7 GROUP BY 1, 2, 3", *_NETWORK)
def i9_summary(t):
    pairs = t.edges.select("u", "v", F.when(F.col("u") < F.col("v"), "A").otherwise("D").alias("direction"))
    return demand.vulnerability_summary(_per_edge(t), pairs)


@query(f"{_IMPACTS} SELECT i.u, i.v, i.cell, i.importance, e.highway, e.length FROM imp i JOIN edges e ON i.u = e.u AND i.v = e.v JOIN (SELECT DISTINCT u, v FROM drives) d ON d.u = e.u AND d.v = e.v", *_NETWORK, "drives")
def i10_route_vulnerability(t):
    return demand.route_vulnerability(_importance(t), t.drives, t.edges).select("u", "v", "cell", "importance", "highway", "length")


@query(f"SELECT DISTINCT t.u, t.v, o.ORIGIN, o.DESTINATION, a.x AS o_x, a.y AS o_y, b.x AS d_x, b.y AS d_y FROM traversals t JOIN ({_OD}) o ON t.idtrajectory = o.idtrajectory JOIN nodes a ON o.ORIGIN = a.node JOIN nodes b ON o.DESTINATION = b.node", "traversals", "nodes")
def i11_endpoints(t):
    return demand.edge_endpoints(t.traversals, t.nodes, t.edges)


# --- J: gateways and disruption

_GATES = "(SELECT u, v, 'g' || (edge_idx % 3) AS gateway FROM edges WHERE edge_idx IN (0, 10, 20))"
_DOWN = f"""SELECT t.*, f.gateway FROM traversals t JOIN (SELECT * FROM (SELECT g.gateway, x.idterm, x.idtrajectory, x.sequenza AS at, ROW_NUMBER() OVER (PARTITION BY g.gateway, x.idterm ORDER BY x.timedate, x.idtrajectory, x.sequenza) AS n
  FROM traversals x JOIN {_GATES} g ON x.u = g.u AND x.v = g.v) WHERE n = 1) f ON t.idterm = f.idterm AND t.idtrajectory = f.idtrajectory AND t.sequenza >= f.at"""
_LOADS = f"SELECT gateway, u, v, counts, round_even(counts::DOUBLE / MAX(counts) OVER (PARTITION BY gateway), 1) AS scales, round_even(counts * 1.0::DOUBLE / MAX(counts) OVER (PARTITION BY gateway) * 100, 4) AS load FROM (SELECT gateway, u, v, COUNT(*) AS counts FROM ({_DOWN}) GROUP BY 1, 2, 3)"


def _gates(t):
    return t.edges.where("edge_idx in (0, 10, 20)").select("u", "v", F.concat(F.lit("g"), F.col("edge_idx") % 3).alias("gateway"))


def _down(t):
    return disruption.downstream(t.traversals, _gates(t))


@query(f"SELECT DISTINCT g.gateway, x.idterm FROM traversals x JOIN {_GATES} g ON x.u = g.u AND x.v = g.v WHERE CAST(x.timedate AS DATE) = DATE '2019-02-03'", "traversals", "edges")
def j1_gateway_vehicles(t):
    return disruption.gateway_vehicles(t.traversals, _gates(t), "2019-02-03")


@query(f"SELECT gateway, idterm, idtrajectory, sequenza FROM ({_DOWN})", "traversals", "edges")
def j2_downstream(t):
    return _down(t).select("gateway", "idterm", "idtrajectory", "sequenza")


@query(_LOADS, "traversals", "edges")
def j3_gateway_loads(t):
    return disruption.gateway_loads(_down(t))


@query(f"SELECT u, v, MAX(load) AS load FROM ({_LOADS}) GROUP BY u, v HAVING MAX(load) > 5", "traversals", "edges")
def j4_merge_loads(t):
    return disruption.merge_loads(disruption.gateway_loads(_down(t)))


@query(f"""SELECT gateway, idterm, idtrajectory, minutes, CAST(ceil(minutes / 5.0) * 5 AS INTEGER) AS band FROM (SELECT d.gateway, d.idterm, d.idtrajectory, CAST(FLOOR(round_even(SUM(d.length / 1000.0::DOUBLE / d.mean_speed * 60), 6)) AS INTEGER) AS minutes
  FROM ({_DOWN}) d JOIN ({_LOADS}) l ON d.gateway = l.gateway AND d.u = l.u AND d.v = l.v WHERE l.load > 3 GROUP BY 1, 2, 3 HAVING SUM(d.length / 1000.0::DOUBLE / d.mean_speed * 60) < 120) WHERE ceil(minutes / 5.0) * 5 <= 90""", "traversals", "edges")
def j5_time_bands(t):
    down = kept(_down(t), "downstream")
    return disruption.trip_time_bands(down, disruption.gateway_loads(down), least_load=3)


_REROUTED = _CLOSED.format(n=11)


@query("WITH RECURSIVE " + _REROUTED + ", c AS (SELECT u, v, COUNT(*) AS counts FROM paths GROUP BY 1, 2) SELECT u, v, counts, round_even(counts::DOUBLE / MAX(counts) OVER () * 100, 4) AS load FROM c", "nodes", "edges", "traversals")
def j6_disrupted_loads(t):
    return disruption.disrupted_loads(_od(t), t.edges, t.edges.where("edge_idx % 11 = 0"))


@query("WITH RECURSIVE " + _REROUTED + f", priced AS ({_COST}) SELECT p.origin, p.destination, CAST(FLOOR(round_even(SUM(c.cost) / 60, 6)) AS INTEGER) AS minutes FROM paths p JOIN priced c ON p.u = c.u AND p.v = c.v GROUP BY 1, 2", "nodes", "edges", "traversals")
def j6_route_times(t):
    return disruption.route_times(disruption.disrupted_routes(_od(t), t.edges, t.edges.where("edge_idx % 11 = 0")), _costed(t))


@query(f"""SELECT d.idtrajectory, round_even(AVG(l.load), 6) AS mean_load, SUM(d.length)::BIGINT AS length, round_even(AVG(d.length / 1000.0::DOUBLE / d.mean_speed * 60), 6) AS mean_min FROM ({_DOWN}) d JOIN ({_LOADS}) l ON l.gateway = d.gateway AND l.u = d.u AND l.v = d.v
  GROUP BY 1 HAVING SUM(CASE WHEN l.load > 15 THEN 1 ELSE 0 END) > COUNT(*) * (1 / 1.2::DOUBLE)""", "traversals", "edges")
def j7_high_load_routes(t):
    down = kept(_down(t), "downstream")
    loads = disruption.gateway_loads(down).select("gateway", "u", "v", "load")
    return disruption.high_load_routes(down.join(loads, ["gateway", "u", "v"]).select("idtrajectory", "load", "length", "mean_speed"))


@query(f"SELECT name, round_even(MAX(load), 0) AS load FROM (SELECT highway AS name, counts * 100.0::DOUBLE / MAX(counts) OVER () AS load FROM (SELECT e.highway, t.u, t.v, COUNT(*) AS counts FROM traversals t JOIN edges e ON t.u = e.u AND t.v = e.v GROUP BY 1, 2, 3)) WHERE load > 51 GROUP BY name", "traversals", "edges")
def j8_road_loads(t):
    counts = _edge_counts(t)
    loads = counts.crossJoin(F.broadcast(counts.agg(F.max("counts").alias("m")))).select("u", "v", (F.col("counts") * 100.0 / F.col("m")).alias("load"))
    return disruption.road_loads(loads, t.edges.withColumn("name", F.col("highway")))


# --- K: statistics

@query("""SELECT vehtype, bin, counts, round_even(counts * 100.0::DOUBLE / SUM(counts) OVER (), 1) AS pct FROM (SELECT vehtype, bin, COUNT(*) AS counts FROM (SELECT vehtype, greatest(ceil(speed / 10.0) * 10, 0)::DOUBLE AS bin FROM fixes
  UNION ALL SELECT vehtype, (ceil(speed / 10.0) * 10 + 10)::DOUBLE FROM fixes WHERE speed % 10 = 0 AND speed >= 0) WHERE bin <= 140 GROUP BY 1, 2)""", "fixes")
def k1_histogram(t):
    return statistics.trip_histogram(t.fixes, "speed", 10, 140)


_SHARE = "SELECT month, {p}, round_even(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY month), 4) AS trips_pct, round_even(km * 100.0::DOUBLE / SUM(km) OVER (PARTITION BY month), 4) AS km_pct FROM (SELECT CAST(month(timedate_o) AS INTEGER) AS month, CAST({e} AS INTEGER) AS {p}, COUNT(*) AS n, SUM(tripdistance_m) AS km FROM trips GROUP BY 1, 2)"


@query(_SHARE.format(p="weekday", e="isodow(timedate_o) - 1"), "trips")
def k2_weekday_shares(t):
    return statistics.weekday_shares(t.trips)


@query("SELECT CAST(month(timedate_o) AS INTEGER) AS month, CAST(isodow(timedate_o) - 1 AS INTEGER) AS weekday, COUNT(*) AS trips, round_even(AVG(tripdistance_m / 1000.0::DOUBLE), 6) AS mean_km FROM trips GROUP BY 1, 2", "trips")
def k3_weekday_means(t):
    return statistics.weekday_means(t.trips)


@query(_SHARE.format(p="hour", e="hour(timedate_o)"), "trips")
def k4_hour_shares(t):
    return statistics.hour_shares(t.trips)


@query("SELECT SUM(CASE WHEN breaktime_s < 6000 THEN 1 ELSE 0 END) * 1.0::DOUBLE / COUNT(*) * 100 AS pct FROM trips", "trips")
def k5_short_breaks(t):
    return statistics.short_break_share(t.trips, 100)


_RATES = ", ".join(f"round_even(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) * 100, 4) AS pct_{name}" for cond, name in (
    ("contains(anomaly, 'c')", "short"), ("contains(anomaly, 'C')", "long"), ("contains(anomaly, 'T')", "time"), ("contains(anomaly, 'V')", "speed"), ("contains(anomaly, 'd')", "no_way"), ("contains(anomaly, 'D')", "jump"),
    ("starts_with(anomaly, 'E')", "ends"), ("contains(anomaly, 'V') AND contains(anomaly, 'C') AND contains(anomaly, 'D') AND contains(anomaly, 'c')", "all")))


@query("WITH " + _CODED + f" SELECT {_RATES} FROM coded", "fixes")
def k6_anomaly_rates(t):
    return statistics.anomaly_rates(trips.anomaly_codes(_trips(t)))


@query("SELECT grade, fixes, round_even(fixes * 100.0::DOUBLE / SUM(fixes) OVER (), 4) AS pct FROM (SELECT grade, COUNT(*) AS fixes FROM fixes GROUP BY grade)", "fixes")
def k7_grade_rates(t):
    return statistics.grade_rates(t.fixes)


@query("SELECT vehtype, SUM(n)::BIGINT AS fixes, COUNT(*) AS vehicles, MIN(CASE WHEN r = 1 THEN idterm END) AS busiest, MAX(top) AS max_speed FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehtype ORDER BY n DESC, idterm) AS r FROM (SELECT vehtype, idterm, COUNT(*) AS n, MAX(CASE WHEN speed < 160 THEN speed END) AS top FROM fixes GROUP BY 1, 2)) GROUP BY vehtype", "fixes")
def k8_fleet_counts(t):
    return statistics.fleet_counts(t.fixes)


@query("SELECT idterm, speed, COUNT(*) AS fixes FROM fixes GROUP BY 1, 2", "fixes")
def k8_speed_counts(t):
    return statistics.speed_counts(t.fixes)


@query("SELECT vehtype, COUNT(DISTINCT idtrajectory) AS trips, COUNT(DISTINCT idterm) AS vehicles FROM traversals GROUP BY 1", "traversals")
def k8_distinct_trips(t):
    return statistics.distinct_trips(t.traversals)


@query("SELECT idtrajectory, idterm FROM trips WHERE idtrajectory % 100 < 20", "trips")
def k9_sample_trips(t):
    return statistics.sample_trips(t.trips).select("idtrajectory", "idterm")


@query("SELECT u, v, hour, load FROM (SELECT u, v, hour, round_even(counts::DOUBLE / MAX(counts) OVER (), 4) * 100 AS load FROM (SELECT CAST(hour(timedate) AS INTEGER) AS hour, u, v, COUNT(*) AS counts FROM traversals GROUP BY 1, 2, 3)) WHERE load >= 17 AND hour BETWEEN 6 AND 21", "traversals")
def k10_web_slice(t):
    return statistics.web_slice(traffic.edge_load(traffic.hour(t.traversals), ["hour"])).select("u", "v", "hour", "load")


_CLASSED = "SELECT *, CASE WHEN classe IN ('2', '3') THEN 'car' ELSE 'heavy' END AS class FROM sensor WHERE classe IN ('2', '3', '4', '5', '6', '7', '8')"
_HOURLY = f"SELECT strftime(timedate, '%Y-%m-%d %H') AS hour, direzione, corsia, class, COUNT(*) AS n FROM ({_CLASSED}) GROUP BY 1, 2, 3, 4"


@query(_HOURLY, "sensor")
def k11_sensor_hourly(t):
    return statistics.sensor_hourly(t.sensor)


@query(f"SELECT direzione, class, COUNT(*) AS n FROM ({_CLASSED}) GROUP BY CUBE (direzione, class)", "sensor")
def k11_sensor_totals(t):
    return statistics.sensor_totals(t.sensor)


def _ratio(t):
    hourly = statistics.sensor_hourly(t.sensor).groupBy("hour", "direzione", "class").agg(F.sum("n").alias("n"))
    fcd = t.traversals.groupBy(F.date_format("timedate", "yyyy-MM-dd HH").alias("hour"), F.when(F.col("u") % 2 == 0, "A").otherwise("D").alias("direzione"), F.when(F.col("vehtype") == 2, "heavy").otherwise("car").alias("class"))
    return statistics.penetration(fcd.agg(F.count(F.lit(1)).alias("fcd")), hourly, 500)


_RATIO = f"""SELECT hour, direzione, class, ratio FROM (SELECT f.hour, f.direzione, f.class, round_even(f.fcd * 100.0::DOUBLE / s.n, 1) AS ratio FROM (SELECT strftime(timedate, '%Y-%m-%d %H') AS hour, CASE WHEN u % 2 = 0 THEN 'A' ELSE 'D' END AS direzione, CASE WHEN vehtype = 2 THEN 'heavy' ELSE 'car' END AS class, COUNT(*) AS fcd FROM traversals GROUP BY 1, 2, 3) f
  LEFT JOIN (SELECT hour, direzione, class, SUM(n) AS n FROM ({_HOURLY}) GROUP BY 1, 2, 3) s ON f.hour = s.hour AND f.direzione = s.direzione AND f.class = s.class) WHERE ratio IS NOT NULL AND ratio < 500"""


@query(_RATIO.replace("f.fcd * 100.0::DOUBLE / s.n", "f.fcd::DOUBLE / s.n::DOUBLE * 100"), "traversals", "sensor")
def k12_penetration(t):
    return _ratio(t)


@query(f"WITH r AS ({_RATIO.replace('f.fcd * 100.0::DOUBLE / s.n', 'f.fcd::DOUBLE / s.n::DOUBLE * 100')}) SELECT *, 'north' AS section FROM r WHERE direzione = 'A' UNION ALL SELECT *, 'south' FROM r WHERE direzione = 'D'", "traversals", "sensor")
def k12_stacked(t):
    ratio = _ratio(t)
    return statistics.stacked({"north": ratio.where("direzione = 'A'"), "south": ratio.where("direzione = 'D'")})


@query("SELECT grade, round_even(AVG(speed), 6) AS mean, round_even(stddev_pop(speed), 6) AS sd, round_even(stddev_pop(speed) / sqrt(COUNT(speed)), 6) AS se_mean, round_even(stddev_pop(speed) / sqrt(2 * COUNT(speed)), 6) AS se_sd FROM fixes GROUP BY grade", "fixes")
def k13_normal_fit(t):
    return statistics.normal_fit(t.fixes, "grade", "speed")


def _profile_sql(by: str, name: str) -> str:
    return f"""SELECT month, {name}, direzione, class, round_even(n, 6) AS n, round_even(n / SUM(n) OVER (PARTITION BY month, {name}, direzione) * 100, 4) AS pct FROM (SELECT month, {name}, direzione, class, SUM(m) AS n FROM (SELECT month, {name}, direzione, class, hour, AVG(n) AS m FROM
  (SELECT CAST(month(timedate) AS INTEGER) AS month, {by} AS {name}, direzione, class, CAST(timedate AS DATE) AS d, hour(timedate) AS hour, COUNT(*) AS n FROM ({_CLASSED}) GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4)"""


@query(_profile_sql("CAST(isodow(timedate) - 1 AS INTEGER)", "weekday"), "sensor")
def k14_hour_profile(t):
    return statistics.mean_hour_profile(t.sensor)


@query(_profile_sql("CASE WHEN isodow(timedate) <= 5 THEN 'weekday' ELSE 'weekend' END", "part"), "sensor")
def k14_weekday_profile(t):
    return statistics.weekday_profile(t.sensor)


@query("SELECT id, least(CAST(FLOOR((speed - (SELECT MIN(speed) FROM fixes)) * 13 / ((SELECT MAX(speed) FROM fixes) - (SELECT MIN(speed) FROM fixes))::DOUBLE) AS BIGINT) + 1, 13) AS bin FROM fixes", "fixes")
def k15_class_bins(t):
    return statistics.class_bins(t.fixes, "speed").select("id", "bin")


@query(f"SELECT direzione, CAST(month(timedate) AS INTEGER) AS month, CAST(day(timedate) AS INTEGER) AS day, CAST(hour(timedate) AS INTEGER) AS hour, COUNT(*) AS n FROM ({_CLASSED}) GROUP BY 1, 2, 3, 4", "sensor")
def k16_sensor_15min(t):
    return statistics.sensor_15min(t.sensor)


# --- L: streams, run to the end of what is there

def _streamed(t, df, make, label):
    """What a stream operator has told when all rows of ``df`` have come and the watermark has passed."""
    given, out, state = (new_path(t.spark, f"{label}-{x}") for x in ("in", "out", "state"))
    df.write.parquet(given)
    stream = make(t.spark.readStream.schema(df.schema).parquet(given))
    with streams.rocksdb(t.spark):
        running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("""SELECT u, v, q AS start, n / 0.25::DOUBLE AS flux FROM (SELECT u, v, time_bucket(INTERVAL 15 MINUTE, timedate) AS q, COUNT(*) AS n FROM traversals GROUP BY 1, 2, 3)
  WHERE q + INTERVAL 15 MINUTE <= (SELECT MAX(timedate) FROM traversals) - INTERVAL 1 HOUR""", "traversals")
def l1_stream_flux(t):
    out = _streamed(t, t.traversals.select("u", "v", "timedate"), streams.stream_flux_15min, "flux")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""WITH g AS (SELECT *, CASE WHEN timedate - LAG(timedate) OVER (PARTITION BY idterm ORDER BY timedate, id) < to_seconds({GAP}) THEN 0 ELSE 1 END AS st FROM fixes),
  n AS (SELECT *, SUM(st) OVER (PARTITION BY idterm ORDER BY timedate, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
  SELECT idterm, CAST(FLOOR(epoch(MIN(timedate))) AS BIGINT) AS start_s, CAST(FLOOR(epoch(MAX(timedate))) AS BIGINT) AS end_s, COUNT(*) AS fixes, MAX(progressive) - MIN(progressive) AS metres FROM n GROUP BY idterm, k
  HAVING MAX(timedate) + to_seconds({GAP}) <= (SELECT MAX(timedate) FROM fixes) - INTERVAL 1 HOUR""", "fixes")
def l2_stream_trips(t):
    out = _streamed(t, t.fixes.select("idterm", "timedate", "progressive"), lambda df: streams.stream_trips(df, GAP), "trips")
    return out.select("idterm", F.unix_timestamp("start").alias("start_s"), F.unix_timestamp("end").alias("end_s"), "fixes", "metres")


_PASSED = "(SELECT MAX(timedate) FROM fixes) - INTERVAL 1 HOUR"


def _split(sql: str, behind: str) -> str:
    return f"SELECT n.id, n.idterm, n.trip_no FROM ({sql}) n JOIN (SELECT id, timedate, LEAD(timedate) OVER (PARTITION BY idterm ORDER BY timedate, id) AS following FROM fixes) f ON f.id = n.id WHERE f.{behind} < {_PASSED}"


@query(_split(_NUMBERED.format(starts=f"last IS NULL OR panel = 0 OR (panel = 2 AND last = 2) OR (panel = 1 AND last = 2) OR (panel = 1 AND last <= 1 AND gap > {GAP}) OR (panel <> 0 AND jump > 10000)"), "timedate"), "fixes")
def l3_stream_panel(t):
    return _streamed(t, t.fixes, lambda df: streams.stream_split_panel(df, GAP), "panel")


@query(_split(_NUMBERED.format(starts=f"gap >= {GAP} AND (panel <> 1 OR (last IS NOT NULL AND last <> 1)) AND (vehtype <> 2 OR (next_speed > 0 AND speed = 0))"), "following"), "fixes")
def l4_stream_engine(t):
    return _streamed(t, _off_on(t), lambda df: streams.stream_split_engine(df, GAP), "engine")
