"""Road network: costs, shortest paths, centrality, nearest edges and hexagons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import EARTH_KM, cell, haversine, to_segment
from roadpulse.functions.store import kept, remove, written
from roadpulse.operators import pyramid

#: km/h of each road class where an edge has no usable limit (fixed values).
CLASS_SPEED = {
    "residential": 30, "secondary": 40, "primary": 50, "tertiary": 35, "unclassified": 40, "secondary_link": 40, "trunk": 70, "tertiary_link": 35,
    "primary_link": 50, "motorway_link": 80, "trunk_link": 42, "motorway": 110, "living_street": 20, "road": 30, "other": 30,
}
OTHER_SPEED = 30
#: The sine of 60 degrees; metres of a degree of latitude.
HALF_ROOT, METRES_PER_DEGREE = 3**0.5 / 2, 111195.0
#: Classes that vehicles don't drive on.
EXCLUDED = ("footway", "service", "path", "steps", "cycleway", "pedestrian", "track")


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per (u, v): that of the smallest key."""
    w = Window.partitionBy("u", "v").orderBy("key")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def edge_cost(edges: DataFrame) -> DataFrame:
    """Adds cost, seconds: length over the limit where the class is known and has one, else over the class speed.

    ``highway`` and ``maxspeed`` may be arrays: the first class and the mean limit count.
    """
    kinds = dict(edges.dtypes)
    road = F.get(F.col("highway"), F.lit(0)) if kinds["highway"].startswith("array") else F.col("highway")
    if kinds["maxspeed"].startswith("array"):
        limits = F.transform(F.col("maxspeed"), lambda x: x.cast("double"))
        limit = F.aggregate(limits, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(limits), F.lit(0))
    else:
        limit = F.col("maxspeed").cast("double")
    table = F.create_map(*(F.lit(x) for pair in CLASS_SPEED.items() for x in pair))
    known = F.try_element_at(table, road)
    speed = F.when(known.isNull(), OTHER_SPEED).otherwise(F.coalesce(limit, known.cast("double")))
    return edges.withColumn("cost", F.col("length") / (speed * 1000 / 3600))


def filter_highways(edges: DataFrame, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    return edges.where(~F.col("highway").isin(*exclude))


def observed_cost(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds observed_cost: the observed travel time, else the cost."""
    return edges.join(seen.select("u", "v", "travel_time"), ["u", "v"], "left").withColumn("observed_cost", F.coalesce("travel_time", "cost")).drop("travel_time")


def road_class_stats(edges: DataFrame) -> DataFrame:
    """Edges and kilometres of each class and their percent, with its limits."""
    per = edges.groupBy("highway").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("length") / 1000).alias("km"), F.bround(F.avg("maxspeed"), 4).alias("mean_limit"), F.max("maxspeed").alias("max_limit"), F.min("maxspeed").alias("min_limit")
    )
    total = per.agg(F.sum("n").alias("all_n"), F.sum("km").alias("all_km"))
    return per.crossJoin(F.broadcast(total)).select("highway", "n", "km", F.bround(F.col("n") / F.col("all_n") * 100, 4).alias("n_pct"), F.bround(F.col("km") / F.col("all_km") * 100, 4).alias("km_pct"), "mean_limit", "max_limit", "min_limit")


def urban_totals(costed: DataFrame, urban_kmh: float = 50) -> DataFrame:
    """Edges and kilometres of urban (speed by length and cost up to ``urban_kmh``) and extra-urban roads, and their percent."""
    kmh = F.bround(F.col("length") / F.col("cost") * 3.6, 6)
    per = costed.groupBy(F.when(kmh <= urban_kmh, "urban").otherwise("extra-urban").alias("area")).agg(F.count(F.lit(1)).alias("n"), (F.sum("length") / 1000).alias("km"))
    total = per.agg(F.sum("n").alias("all_n"), F.sum("km").alias("all_km"))
    return per.crossJoin(F.broadcast(total)).select("area", "n", "km", F.bround(F.col("n") / F.col("all_n") * 100, 4).alias("n_pct"), F.bround(F.col("km") / F.col("all_km") * 100, 4).alias("km_pct"))


#: Rounds of ``shortest_paths`` after which its labels become one table again.
COMPACT = 8
#: Edges by which a round extends labels before it writes those that improve.
HOPS = 3


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def shortest_paths(edges: DataFrame, origins: DataFrame, weight: str = "length", max_iter: int = 1_000_000, extra: DataFrame | None = None) -> DataFrame:
    """Least cost from each origin (column ``origin``, and any other key columns) to every node it reaches.

    Batched relaxation: every round extends the labels that improved last by up to HOPS edges and
    writes those that improve now. Of several predecessors on least paths the smallest is taken,
    whatever round found it. Rows: keys, node, dist, pred. If ``edges`` has key columns in common with ``origins`` (a scenario), paths use
    their own edges; ``extra`` (keys in common, u, v, extra) makes edges dearer in a scenario
    without a copy of the others. If ``origins`` has a column ``reach``, nodes beyond that cost are left out.
    """
    spark = edges.sparkSession
    keys = [c for c in origins.columns if c not in ("origin", "reach")]
    shared = [c for c in keys if c in edges.columns]
    key = [*keys, "origin"]
    reach = ["reach"] if "reach" in origins.columns else []
    roads = edges.groupBy(*shared, "u", "v").agg(F.min(weight).cast("double").alias("w"))
    dearer = [c for c in keys if extra is not None and c in extra.columns]
    starts = origins.groupBy(*key).agg(F.max("reach").alias("reach")) if reach else origins.select(*key).distinct()
    front, path = written(starts.select(*key, *reach, F.col("origin").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred")), "paths")
    roads, roads_path = written(roads, "roads")
    tables, paths = [front], [path]
    for k in range(max_iter):
        found, steps = front.select(*key, *reach, "node", "dist"), []
        for _ in range(HOPS):
            step = found.withColumnRenamed("node", "u").join(roads, [*shared, "u"])
            if extra is not None:
                step = step.join(extra, [*dearer, "u", "v"], "left").withColumn("w", F.col("w") + F.coalesce("extra", F.lit(0.0)))
            step = step.select(*key, *reach, F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("u").alias("pred"))
            step = step.where("dist <= reach") if reach else step
            steps.append(step.groupBy(*key, *reach, "node").agg(F.min(F.struct("dist", "pred")).alias("m")).select(*key, *reach, "node", "m.*"))
            found = steps[-1].drop("pred")
        found = _all(steps).groupBy(*key, *reach, "node").agg(F.min(F.struct("dist", "pred")).alias("m")).select(*key, *reach, "node", "m.*")
        known = _all(tables).groupBy(*key, "node").agg(F.min("dist").alias("known"))
        better = found.join(known, [*key, "node"], "left").where("known is null or dist < known").drop("known")
        front, path = written(better, "paths")
        if front.first() is None:
            remove(spark, [path])
            break
        tables.append(front)
        paths.append(path)
        if len(tables) > COMPACT:
            best, path = written(_best(tables, [*key, *reach]), "paths")
            remove(spark, paths[:-1])  # the last is the front
            tables, paths = [best, front], [path, paths[-1]]
    else:
        raise RuntimeError(f"paths still improve after {max_iter} rounds")
    best, path = written(_best(tables, key), "paths")
    on = best.select(*key, F.col("node").alias("u"), F.col("dist").alias("before")).join(roads, [*shared, "u"])
    if extra is not None:
        on = on.join(extra, [*dearer, "u", "v"], "left").withColumn("w", F.col("w") + F.coalesce("extra", F.lit(0.0)))
    on = on.select(*key, F.col("v").alias("node"), "before", (F.col("before") + F.col("w")).alias("dist"), "u")
    # edges of no cost keep the predecessor of the round that found them, so that none closes a ring
    first = best.select(*key, "node", "dist").join(on.where("before < dist"), [*key, "node", "dist"]).groupBy(*key, "node").agg(F.min("u").alias("first"))
    out, _ = written(best.join(first, [*key, "node"], "left").select(*key, "node", "dist", F.coalesce("first", "pred").alias("pred")), "paths")
    remove(spark, [*paths, path, roads_path])
    return out


def _best(tables: list[DataFrame], key: list[str]) -> DataFrame:
    return _all(tables).groupBy(*key, "node").agg(F.min(F.struct("dist", "pred")).alias("m")).select(*key, "node", "m.*")


def path_edges(best: DataFrame, od: DataFrame) -> DataFrame:
    """The edges of the least path of each (origin, destination) and further keys of ``od``: keys, u, v, back (edges from the end).

    Predecessors of predecessors are joined, so a path of any length takes a number of joins that
    grows with its logarithm. Destinations that can't be reached have no rows.
    """
    keys = [c for c in od.columns if c != "destination"]
    jump, _ = written(best.select(*keys, F.col("node").alias("at"), F.col("pred").alias("to")).where("pred is not null"), "jumps")
    labels, jumps = jump, [jump]
    while True:  # each table leaps twice as far as the one before
        onward = jump.select(*keys, F.col("at").alias("to"), F.col("to").alias("far"))
        jump, _ = written(jump.join(onward, [*keys, "to"]).select(*keys, "at", F.col("far").alias("to")), "jumps")
        if jump.first() is None:
            break
        jumps.append(jump)
    walk = od.distinct().withColumns({"at": F.col("destination"), "back": F.lit(0)})
    for k in range(len(jumps) - 1, -1, -1):
        further = walk.join(jumps[k], [*keys, "at"]).select(*keys, "destination", F.col("to").alias("at"), (F.col("back") + (1 << k)).alias("back"))
        walk, _ = written(walk.unionByName(further), "walk")
    return walk.join(labels, [*keys, "at"]).select(*keys, "destination", F.col("to").alias("u"), F.col("at").alias("v"), "back")


def path_totals(paths: DataFrame, edges: DataFrame, cost: str = "cost") -> DataFrame:
    """Kilometres, hours and mean speed (km/h) of each path: keys, destination, n_edges, km, hours, kmh."""
    keys = [c for c in paths.columns if c not in ("u", "v", "back")]
    priced = edges.groupBy("u", "v").agg(F.min("length").alias("_m"), F.min(cost).alias("_s"))
    per = paths.join(priced, ["u", "v"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"), (F.sum("_m") / 1000).alias("km"), (F.sum("_s") / 3600).alias("hours"))
    return per.withColumn("kmh", F.try_divide("km", "hours"))


def closeness(edges: DataFrame) -> DataFrame:
    """Closeness of each node on the undirected graph: reached nodes over their summed distance, scaled by the reached share."""
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct().withColumn("one", F.lit(1))
    nodes = both.select(F.col("u").alias("origin")).distinct()
    n = nodes.count()
    reach = shortest_paths(both, nodes, "one").where("dist > 0").groupBy("origin").agg(F.count(F.lit(1)).alias("r"), F.sum("dist").alias("d"))
    return reach.select(F.col("origin").alias("node"), F.bround(F.col("r") / F.col("d") * F.col("r") / max(n - 1, 1), 9).alias("closeness"))


def _waves(tight: DataFrame, value: DataFrame, src: str, dst: str, given) -> DataFrame:
    """``value`` (origin, node, n) summed along ``tight`` edges from src to dst.

    A node passes its value on once all edges into it have brought theirs; ``given`` is the
    column expression of what an edge brings, of n (the sender's value) and the edge's columns.
    """
    waiting, waves = tight, []
    while True:
        blocked = waiting.select("origin", F.col(dst).alias("node")).distinct()
        now, path = written(value.join(blocked, ["origin", "node"], "left_anti"), "wave")
        waves.append(path)
        if waiting.limit(1).count() == 0:
            return now.sparkSession.read.schema(now.schema).parquet(*waves)  # one scan, however many waves
        sent = waiting.join(now.withColumnRenamed("node", src), ["origin", src])
        add = sent.groupBy("origin", F.col(dst).alias("node")).agg(F.sum(given).alias("add"))
        left = value.join(now.select("origin", "node"), ["origin", "node"], "left_anti").join(add, ["origin", "node"], "left")
        value = kept(left.select("origin", "node", (F.col("n") + F.coalesce("add", F.lit(0.0))).alias("n")), "value")
        waiting = kept(waiting.join(now.select("origin", F.col("node").alias(src)), ["origin", src], "left_anti"), "waiting")


def _shares(edges: DataFrame, weight: str, sources: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Brandes: (origin, node, n: dependency) and (origin, u, v, share) of the edges on least paths."""
    nodes = edges.select(F.col("u").alias("origin")).union(edges.select("v")).distinct()
    best = shortest_paths(edges, nodes if sources is None else sources, weight)
    roads = edges.where("u <> v").groupBy("u", "v").agg(F.min(weight).cast("double").alias("w"))
    a = best.select("origin", F.col("node").alias("u"), F.col("dist").alias("du"))
    b = best.select("origin", F.col("node").alias("v"), F.col("dist").alias("dv"))
    tight = kept(roads.join(a, "u").join(b, ["origin", "v"]).where(F.abs(F.col("du") + F.col("w") - F.col("dv")) < 1e-9).select("origin", "u", "v"), "tight")
    start = best.select("origin", "node", F.when(F.col("origin") == F.col("node"), 1.0).otherwise(0.0).alias("n"))
    sigma = kept(_waves(tight, start, "u", "v", F.col("n")), "sigma")
    su, sv = sigma.select("origin", F.col("node").alias("u"), F.col("n").alias("su")), sigma.select("origin", F.col("node").alias("v"), F.col("n").alias("sv"))
    weighted = kept(tight.join(su, ["origin", "u"]).join(sv, ["origin", "v"]), "weighted")
    passed = F.col("su") / F.col("sv") * (1 + F.col("n"))
    delta = kept(_waves(weighted, best.select("origin", "node", F.lit(0.0).alias("n")), "v", "u", passed), "delta")
    share = weighted.join(delta.withColumnRenamed("node", "v"), ["origin", "v"]).select("origin", "u", "v", passed.alias("share"))
    return delta, share


def betweenness_nodes(edges: DataFrame, weight: str = "length", sources: DataFrame | None = None, normalized: bool = True, endpoints: bool = False) -> DataFrame:
    """Betweenness of nodes over all or given source nodes (column ``origin``); with ``endpoints`` a path's ends count as on it."""
    delta, _ = _shares(edges, weight, sources)
    n = edges.select("u").union(edges.select("v")).distinct().count()
    scale = (1 / (n * (n - 1)) if endpoints else 1 / ((n - 1) * (n - 2))) if normalized and n > 2 else 1.0
    if sources is not None:
        scale *= n / max(sources.count(), 1)
    own = F.col("node") == F.col("origin")
    if endpoints:  # a node that an origin reaches ends a path there; an origin begins as many as it reaches nodes
        reached = delta.where(~own).groupBy("origin").agg(F.count(F.lit(1)).cast("double").alias("r"))
        delta = delta.join(reached, "origin", "left").withColumn("n", F.when(own, F.coalesce("r", F.lit(0.0))).otherwise(F.col("n") + 1))
        value = F.col("n")
    else:
        value = F.when(own, 0.0).otherwise(F.col("n"))
    return delta.groupBy("node").agg(F.bround(F.sum(value) * scale, 9).alias("betweenness"))


def betweenness_edges(edges: DataFrame, weight: str = "length", sources: DataFrame | None = None, normalized: bool = True) -> DataFrame:
    """Betweenness of edges over all or given source nodes."""
    _, share = _shares(edges, weight, sources)
    n = edges.select("u").union(edges.select("v")).distinct().count()
    scale = 1 / (n * (n - 1)) if normalized and n > 1 else 1.0
    if sources is not None:
        scale *= n / max(sources.count(), 1)
    return share.groupBy("u", "v").agg(F.bround(F.sum("share") * scale, 9).alias("betweenness"))


def scale_scores(df: DataFrame, col: str) -> DataFrame:
    """Adds scales (x / max * 3 + 0.1, one decimal) and share (x / max, three decimals); keeps shares above 0."""
    out = df.crossJoin(F.broadcast(df.agg(F.max(col).alias("_top"))))
    return out.withColumns({"scales": F.bround(F.col(col) / F.col("_top") * 3 + 0.1, 1), "share": F.bround(F.col(col) / F.col("_top"), 3)}).where("share > 0").drop("_top")


def closure_routes(edges: DataFrame, closures: DataFrame, legs: DataFrame, weight: str = "length", penalty: float = 864000) -> DataFrame:
    """Edges of the least path of each leg (origin, destination) when edges of ``closures`` cost ``penalty`` more."""
    closed = edges.join(closures.select("u", "v", F.lit(penalty).alias("_more")), ["u", "v"], "left")
    priced = closed.withColumn("_price", F.col(weight) + F.coalesce("_more", F.lit(0.0)))
    best = shortest_paths(priced, legs.select("origin"), "_price")
    return path_edges(best, legs.select("origin", "destination"))


def _nearest(points: DataFrame, things: DataFrame, extent: DataFrame, size: float, distance: Column, bound, bounds: tuple[Column, Column], pick: list[str]) -> DataFrame:
    """The nearest of ``things`` for each point (id, px, py): id, ``pick`` columns, m (distance, metres).

    ``things`` has their box (ax, bx, ay, by). Points are held against what lies in their square
    and the eight around; where the best is farther than what lies outside of those may be, or
    there is none, the point goes down a pyramid of the occupied squares.
    """
    ends = extent.first()
    if ends["ax"] is None:
        return None
    width = max(ends["bx"] - ends["ax"], ends["by"] - ends["ay"])
    span = lambda a, b: F.sequence(cell(F.col(a), size), cell(F.col(b), size))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    squares = things.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    asked = points.withColumn("_c", F.explode(around)).withColumns({"cx": cell(F.col("px"), size) + F.col("_c.i"), "cy": cell(F.col("py"), size) + F.col("_c.j")}).drop("_c")
    met = asked.join(squares, ["cx", "cy"]).withColumn("m", distance)
    best = met.groupBy("id").agg(F.min(F.struct("m", *pick)).alias("b"))
    found = kept(points.join(best, "id", "left").withColumn("sure", F.coalesce(F.col("b.m") <= bound(size), F.lit(False))), "nearest")
    sure = found.where("sure").select("id", *(F.col(f"b.{c}").alias(c) for c in pick), "b.m")
    rest = found.where("not sure").select("id", "px", "py")
    if rest.first() is None:
        return sure
    return sure.unionByName(pyramid.nearest(rest, things, size, width, distance, bounds, pick))


def nearest_node(points: DataFrame, nodes: DataFrame, size: float = 0.02) -> DataFrame:
    """The nearest node of each point (id, x, y) by great circle, ties to the smallest: id, node, m (metres)."""
    p = points.where("x is not null and y is not null").groupBy("id").agg(F.first("x").alias("px"), F.first("y").alias("py"))
    n = nodes.select("node", "x", "y", F.col("x").alias("ax"), F.col("x").alias("bx"), F.col("y").alias("ay"), F.col("y").alias("by"))
    far = F.bround(haversine(F.col("px"), F.col("py"), F.col("x"), F.col("y")) * 1000, 3)
    # what lies outside is a whole square off in one direction: a parallel or a meridian away
    off = lambda s: F.least(F.radians(F.lit(s)), F.asin(F.cos(F.radians("py")) * F.sin(F.radians(F.lit(min(s, 90.0)))))) * (EARTH_KM * 1000 * 0.999999)
    out = _nearest(p, n, n.agg(F.min("ax").alias("ax"), F.max("bx").alias("bx"), F.min("ay").alias("ay"), F.max("by").alias("by")), size, far, off, pyramid.sphere_bounds(), ["node"])
    return p.select("id", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("m")).where("false") if out is None else out


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (u, v) with the coordinates of both ends (x1, y1, x2, y2)."""
    at = lambda side, node: nodes.select(F.col("node").alias(node), F.col("x").alias(f"x{side}"), F.col("y").alias(f"y{side}"))
    return edges.select("u", "v").distinct().join(at(1, "u"), "u").join(at(2, "v"), "v")


def nearest_edge(points: DataFrame, edges: DataFrame, nodes: DataFrame, size: float = 0.01) -> DataFrame:
    """The nearest edge of each point (id, x, y) on the local plane, and its nearer end by great circle: id, u, v, m, node."""
    p = points.where("x is not null and y is not null").groupBy("id").agg(F.first("x").alias("px"), F.first("y").alias("py"))
    e = with_ends(edges, nodes)
    e = e.withColumns({"ax": F.least("x1", "x2"), "bx": F.greatest("x1", "x2"), "ay": F.least("y1", "y2"), "by": F.greatest("y1", "y2")})
    far = F.bround(to_segment(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2"))), 3)
    off = lambda s: F.lit(s) * F.cos(F.radians("py")) * (METRES_PER_DEGREE * 0.999999)
    out = _nearest(p, e, e.agg(F.min("ax").alias("ax"), F.max("bx").alias("bx"), F.min("ay").alias("ay"), F.max("by").alias("by")), size, far, off, pyramid.plane_bounds(METRES_PER_DEGREE), ["u", "v"])
    if out is None:
        return p.select("id", *(F.lit(None).cast(t).alias(c) for c, t in (("u", "long"), ("v", "long"), ("m", "double"), ("node", "long")))).where("false")
    ends = out.join(e.select("u", "v", "x1", "y1", "x2", "y2"), ["u", "v"]).join(p, "id")
    one, two = (F.bround(haversine(F.col("px"), F.col("py"), F.col(x), F.col(y)) * 1000, 3) for x, y in (("x1", "y1"), ("x2", "y2")))
    return ends.select("id", "u", "v", "m", F.when((one < two) | ((one == two) & (F.col("u") < F.col("v"))), F.col("u")).otherwise(F.col("v")).alias("node"))


def hex_grid(nodes: DataFrame, d_m: float = 400) -> DataFrame:
    """Centres of hexagons of ``d_m`` metres over the extent of ``nodes``: cell, row, col, x, y, w (degrees)."""
    e = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    sin60 = 3**0.5 / 2
    ew = haversine(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y0")) * 1000
    ns = haversine(F.col("x0"), F.col("y0"), F.col("x0"), F.col("y1")) * 1000
    e = e.withColumns({"n_cols": (F.floor(ew / (d_m * sin60)) + 1).cast("int"), "n_rows": (F.floor(ns / d_m) + 10).cast("int")})
    e = e.withColumn("w", (F.col("x1") - F.col("x0")) / F.col("n_cols")).withColumn("d", F.col("w") / sin60)
    rows = e.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    x = F.col("x0") + F.col("col") * F.col("w") + F.when(F.col("row") % 2 == 1, F.col("w") / 2).otherwise(0.0)
    y = F.col("y0") + F.col("row") * F.col("d") * 0.75
    return rows.select((F.col("row") * F.col("n_cols") + F.col("col")).alias("cell"), "row", "col", F.bround(x, 9).alias("x"), F.bround(y, 9).alias("y"), F.bround("w", 9).alias("w"))


def cell_edges(hexes: DataFrame, edges: DataFrame, nodes: DataFrame, size: float = 0.01) -> DataFrame:
    """(cell, u, v) of the edges that meet each hexagon, by a join on grid squares and a clip by the six sides."""
    ends = with_ends(edges, nodes)
    boxes = ends.withColumns({"ax": F.least("x1", "x2"), "bx": F.greatest("x1", "x2"), "ay": F.least("y1", "y2"), "by": F.greatest("y1", "y2")})
    half_h = F.col("w") / (3**0.5)
    h = hexes.select("cell", F.col("x").alias("hx"), F.col("y").alias("hy"), "w", (F.col("x") - F.col("w") / 2).alias("hx0"), (F.col("x") + F.col("w") / 2).alias("hx1"), (F.col("y") - half_h).alias("hy0"), (F.col("y") + half_h).alias("hy1"))
    squares = lambda df, a, b, c, d: df.withColumn("sx", F.explode(F.sequence(cell(F.col(a), size), cell(F.col(b), size)))).withColumn("sy", F.explode(F.sequence(cell(F.col(c), size), cell(F.col(d), size))))
    met = squares(boxes, "ax", "bx", "ay", "by").join(squares(h, "hx0", "hx1", "hy0", "hy1"), ["sx", "sy"])
    ends_at, begins_at, outside = [F.lit(1.0)], [F.lit(0.0)], F.lit(False)
    for nx, ny in ((1.0, 0.0), (-1.0, 0.0), (0.5, HALF_ROOT), (-0.5, HALF_ROOT), (0.5, -HALF_ROOT), (-0.5, -HALF_ROOT)):
        room = F.col("w") / 2 - ((F.col("x1") - F.col("hx")) * nx + (F.col("y1") - F.col("hy")) * ny)
        go = (F.col("x2") - F.col("x1")) * nx + (F.col("y2") - F.col("y1")) * ny
        outside = outside | ((go == 0) & (room < 0))
        begins_at.append(F.when(go < 0, F.try_divide(room, go)))
        ends_at.append(F.when(go > 0, F.try_divide(room, go)))
    low, high = F.greatest(*begins_at), F.least(*ends_at)  # nulls don't count
    return met.where(~outside & (low <= high)).select("cell", "u", "v").distinct()
