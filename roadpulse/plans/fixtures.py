"""Traffic tables derived from the given test tables, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.store import kept

_FIXES = """
SELECT event_id AS id, user_id AS idterm, ts AS timedate,
  {D1470} + ((user_id*37) % 60)*{D001} + ((event_id*13) % 20)*{D0001} AS longitude,
  {D3730} + ((user_id*53) % 50)*{D001} + ((event_id*29) % 20)*{D0001} AS latitude,
  CAST(FLOOR(value) AS BIGINT) % 131 AS speed,
  1 + event_id % 20 AS grade,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 2 ELSE 1 END AS panel,
  CASE WHEN user_id % 5 = 0 THEN 2 ELSE 1 END AS vehtype,
  CAST(SUM(CAST(FLOOR(value*10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) % 20000 AS progressive
FROM {events}"""
#: Nodes a side of the square network that trips drive on, and of the wide one of which each customer is a node.
_SIDE = "(SELECT 2 + CAST(FLOOR(POWER(COUNT(*), 0.2)) AS BIGINT) FROM {customer})"
_WIDE_SIDE = "(SELECT CAST(FLOOR(SQRT(COUNT(*))) AS BIGINT) FROM {customer})"


def _places(side: str) -> str:
    return "(SELECT CAST(c_custkey AS BIGINT) AS n, " + side + " AS side FROM {customer})"


def _nodes(side: str) -> str:
    return """
SELECT 1000 + n AS node, {D1490} + (n % side)*{D001} AS x, {D3745} + CAST(FLOOR(n / side) AS BIGINT)*{D001} AS y
FROM """ + _places(side) + """ g WHERE n < side*side"""


def _edges(side: str, more: str = "") -> str:
    return """
SELECT u, v, 0 AS key, 100 + (u*31 + v*17) % 900 AS length,
  CASE (u+v) % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'residential' ELSE 'service' END AS highway,
  CASE WHEN (u*v) % 4 = 0 THEN 30 + 10*((u + 2*v) % 8) END AS maxspeed,
  ROW_NUMBER() OVER (ORDER BY u, v) - 1 AS edge_idx""" + more + """
FROM (SELECT 1000 + n AS u, 1000 + n + dx + dy*side AS v
      FROM (SELECT n, side, n % side AS c, CAST(FLOOR(n / side) AS BIGINT) AS r, dx, dy FROM """ + _places(side) + """ g
            CROSS JOIN (SELECT 1 AS dx, 0 AS dy UNION ALL SELECT -1, 0 UNION ALL SELECT 0, 1 UNION ALL SELECT 0, -1) d WHERE n < side*side) w
      WHERE c + dx BETWEEN 0 AND side - 1 AND r + dy BETWEEN 0 AND side - 1) p"""


_NODES, _EDGES = _nodes(_SIDE), _edges(_SIDE)
#: The wide network has metres besides, of which no two paths have the same sum.
_WIDE_NODES, _WIDE_EDGES = _nodes(_WIDE_SIDE), _edges(_WIDE_SIDE, ", 100 + (u*31 + v*17) % 900 + ((u*7919 + v*104729) % 100003) / {D100003} AS metres")
#: Rides of the wide network, one an order, each from a depot (a node divisible by 20) to any node.
_RIDES = """
SELECT CAST(o_orderkey AS BIGINT) AS ride, 1000 + 20*((o_custkey*7) % CAST(CEIL(side*side / {D20}) AS BIGINT)) AS origin, 1000 + (o_orderkey*13 + o_custkey) % (side*side) AS destination
FROM (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, """ + _WIDE_SIDE + """ AS side FROM {orders}) o"""
_TRAVERSALS = """
SELECT t.idtrajectory, t.idterm, t.sequenza, e.u, e.v, e.length, t.timedate, t.mean_speed, t.vehtype, t.idtrace
FROM (SELECT l_orderkey AS idtrajectory, l_suppkey AS idterm,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS sequenza,
  (l_partkey*7 + l_suppkey*3 + l_linenumber) % (SELECT COUNT(*) FROM {edges}) AS edge,
  {TIME} AS timedate,
  5 + CAST(l_quantity AS BIGINT)*2 AS mean_speed,
  CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 1 END AS vehtype,
  (l_orderkey*11 + l_linenumber*7) % (SELECT COUNT(*) FROM {events}) AS idtrace
  FROM {lineitem}) t JOIN {edges} e ON t.edge = e.edge_idx"""
#: Trips along rows and columns of the network, back and forth, one fix an edge.
_DRIVES = """
SELECT trip*64 + k AS id, trip % 500 AS idterm, CONCAT('t', trip) AS TRIP_ID, {DTIME} AS timedate,
  {D1490} + (a % side)*{D001} + ((b % side) - (a % side))*tenth*{D0001} + (CASE flat WHEN 1 THEN 0 ELSE (trip + k) % 5 - 2 END)*{D00001} AS longitude,
  {D3745} + CAST(FLOOR(a / side) AS BIGINT)*{D001} + (CAST(FLOOR(b / side) AS BIGINT) - CAST(FLOOR(a / side) AS BIGINT))*tenth*{D0001} + (CASE flat WHEN 1 THEN (trip + k) % 5 - 2 ELSE 0 END)*{D00001} AS latitude,
  20 + (trip + k) % 60 AS speed, 1 AS panel, 1 AS vehtype, k, e.u, e.v, e.length,
  CAST(SUM(e.length) OVER (PARTITION BY trip ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - e.length + FLOOR(tenth*e.length / 10) AS BIGINT) AS progressive
FROM (SELECT *, CASE flat WHEN 1 THEN line*side + p ELSE p*side + line END AS a, CASE flat WHEN 1 THEN line*side + q ELSE q*side + line END AS b
  FROM (SELECT trip, k, side, (trip*7 + k*3) % 8 + 1 AS tenth, trip % 2 AS flat, CAST(FLOOR(trip / 7) AS BIGINT) % side AS line,
      abs((trip + k) % (2*(side - 1)) - (side - 1)) AS p, abs((trip + k + 1) % (2*(side - 1)) - (side - 1)) AS q
    FROM (SELECT CAST(l_orderkey AS BIGINT) AS trip, """ + _SIDE + """ AS side,
        ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS k FROM {lineitem}) b) c) d
  JOIN {edges} e ON e.u = 1000 + d.a AND e.v = 1000 + d.b"""
_SENSOR = """
SELECT {STIME} AS timedate, CASE o_orderkey % 2 WHEN 0 THEN 'A' ELSE 'D' END AS direzione,
  CAST(1 + o_orderkey % 3 AS VARCHAR(9)) AS corsia, CAST(1 + o_orderkey % 10 AS VARCHAR(9)) AS classe FROM {orders}"""
_REGISTRY = "SELECT s_suppkey AS idterm, CASE WHEN s_acctbal >= 0 THEN CAST(FLOOR(s_acctbal) AS BIGINT) END AS portata FROM {supplier}"
_TRIPS = """
SELECT idtrajectory, MIN(idterm) AS idterm, MIN(vehtype) AS vehtype, MIN(timedate) AS timedate_o, SUM(length) AS tripdistance_m,
  CAST(SUM(length * 4) AS BIGINT) AS triptime_s, CAST(60 * SUM(mean_speed) AS BIGINT) AS breaktime_s, MIN(u) AS idtrace_o, MAX(v) AS idtrace_d
FROM {traversals} GROUP BY idtrajectory"""

_SECONDS = "(l_orderkey % 28)*86400 + (l_partkey % 24)*3600 + (l_linenumber % 60)*60"
_SENSOR_SECONDS = "(o_orderkey % 28)*86400 + (o_custkey % 24)*3600"
_DRIVE_SECONDS = "(trip % 28)*86400 + k*60"
_SPARK = {
    "D1470": "14.70D", "D3730": "37.30D", "D1490": "14.90D", "D3745": "37.45D", "D001": "0.01D", "D0001": "0.001D", "D00001": "0.00001D", "D100003": "100003D", "D20": "20D", "DTIME": f"timestampadd(SECOND, {_DRIVE_SECONDS}, TIMESTAMP_NTZ '2019-02-01 00:00:00')",
    "TIME": f"timestampadd(SECOND, {_SECONDS}, TIMESTAMP_NTZ '2019-02-01 00:00:00')", "STIME": f"timestampadd(SECOND, {_SENSOR_SECONDS}, TIMESTAMP_NTZ '2019-02-01 00:00:00')",
}
_DUCK = {
    "D1470": "14.70::DOUBLE", "D3730": "37.30::DOUBLE", "D1490": "14.90::DOUBLE", "D3745": "37.45::DOUBLE", "D001": "0.01::DOUBLE", "D0001": "0.001::DOUBLE", "D00001": "0.00001::DOUBLE", "D100003": "100003::DOUBLE", "D20": "20::DOUBLE", "DTIME": f"TIMESTAMP '2019-02-01 00:00:00' + to_seconds({_DRIVE_SECONDS})",
    "TIME": f"TIMESTAMP '2019-02-01 00:00:00' + to_seconds({_SECONDS})", "STIME": f"TIMESTAMP '2019-02-01 00:00:00' + to_seconds({_SENSOR_SECONDS})",
}
_ALL = {"fixes": _FIXES, "nodes": _NODES, "edges": _EDGES, "wide_nodes": _WIDE_NODES, "wide_edges": _WIDE_EDGES, "rides": _RIDES, "traversals": _TRAVERSALS, "drives": _DRIVES, "sensor": _SENSOR, "registry": _REGISTRY, "trips": _TRIPS}
_NEEDS = {"fixes": ["events"], "nodes": ["customer"], "edges": ["customer"], "wide_nodes": ["customer"], "wide_edges": ["customer"], "rides": ["orders", "customer"], "traversals": ["edges", "events", "lineitem"], "drives": ["edges", "lineitem", "customer"], "sensor": ["orders"], "registry": ["supplier"], "trips": ["traversals"]}


class Fixtures:
    """The derived tables of one folder: ``Fixtures(spark, sf_dir).fixes`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in _ALL:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if name == "events" else df
        needed = {k: getattr(self, k) for k in _NEEDS[name]}
        text = _ALL[name].format(**_SPARK, **{k: "{" + k + "}" for k in needed})
        df = self.spark.sql(text, **needed)
        if name in ("nodes", "edges"):  # small tables, written once so that the planner knows their size
            df = self.__dict__[name] = kept(df, name)
        return df


def duck(body: str, *names: str) -> str:
    """A DuckDB statement: the derived tables ``names`` (with what they need) before ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name in _ALL and name not in order:
            order.append(name)

    for n in names:
        add(n)
    given = {k: k for k in ("events", "customer", "lineitem", "orders", "supplier", *_ALL)}
    ctes = [f"{n} AS ({_ALL[n].format(**_DUCK, **given)})" for n in order]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:]]) if ctes else body
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body
