"""Density clusters of places by grid cells, without a table of neighbouring points.

Cells are so small that two points of one are neighbours. A cell with enough points is all
core, so only cells are linked, where their closest core points are near enough. Whether they
are is told by boxes around their points, which are split where the bounds leave it open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.geo import EARTH_KM, haversine
from roadpulse.functions.store import kept, remove, written

#: Into how many parts a box is split each way, and how often before its points are compared one by one.
PARTS, SPLITS = 4, 6
METRES_PER_DEGREE = EARTH_KM * 1000 * 3.141592653589793 / 180


def _width(row: Column, side: float) -> Column:
    """Degrees of longitude of the cells of a row, ``side`` degrees of latitude high: as wide as high where it is widest."""
    edge = F.when(row >= 0, row * side).otherwise(-(row + 1) * side)
    return F.lit(side) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6))


def _around(df: DataFrame, x0: str, x1: str, eps: float, side: float) -> DataFrame:
    """``df`` with a row per cell (near_row, near_col) that ``eps`` degrees of latitude around its extent may reach."""
    out = df.withColumn("near_row", F.explode(F.sequence(F.col("row") - 2, F.col("row") + 2)))
    pole = F.greatest(F.abs(F.col("row") - 2), F.abs(F.col("row") + 3)) * side
    wide = F.lit(eps) / F.greatest(F.cos(F.radians(F.least(pole, F.lit(90.0)))), F.lit(1e-6))
    width = _width(F.col("near_row"), side)
    return out.withColumn("near_col", F.explode(F.sequence(F.floor((F.col(x0) - wide) / width).cast("long"), F.floor((F.col(x1) + wide) / width).cast("long"))))


def _bounds(a: str, b: str) -> tuple[Column, Column]:
    """The least and the largest metres between the boxes (x0, x1, y0, y1) in columns ``a`` and ``b``."""
    gap = lambda c: F.greatest(F.col(f"{a}.{c}0") - F.col(f"{b}.{c}1"), F.col(f"{b}.{c}0") - F.col(f"{a}.{c}1"), F.lit(0.0))
    span = lambda c: F.greatest(F.col(f"{a}.{c}1"), F.col(f"{b}.{c}1")) - F.least(F.col(f"{a}.{c}0"), F.col(f"{b}.{c}0"))
    flat = lambda k: F.cos(F.radians(F.greatest(F.abs(F.col(f"{k}.y0")), F.abs(F.col(f"{k}.y1")))))
    round_ = lambda k: F.cos(F.radians(F.when(F.signum(f"{k}.y0") != F.signum(f"{k}.y1"), 0.0).otherwise(F.least(F.abs(F.col(f"{k}.y0")), F.abs(F.col(f"{k}.y1"))))))
    metres = lambda dx, dy, cosines: F.asin(F.sqrt(F.least(F.pow(F.sin(F.radians(dy) / 2), 2) + cosines * F.pow(F.sin(F.radians(dx) / 2), 2), F.lit(1.0)))) * (2000 * EARTH_KM)
    return metres(gap("x"), gap("y"), flat(a) * flat(b)), metres(span("x"), span("y"), round_(a) * round_(b))


def _box() -> Column:
    return F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def least_labels(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The smallest node of each node's component: idterm, node, label.

    ``links`` has idterm, a and b, in both directions; ``nodes`` idterm and node. A round takes
    the neighbours' least label and then that label's own, so labels leap over paths twice as long each round.
    """
    spark = links.sparkSession
    state, path = written(nodes.select("idterm", "node", F.col("node").alias("label")), "labels")
    while True:
        beside = links.join(state.select("idterm", F.col("node").alias("b"), "label"), ["idterm", "b"]).groupBy("idterm", F.col("a").alias("node")).agg(F.min("label").alias("least"))
        near = state.join(beside, ["idterm", "node"], "left").select("idterm", "node", F.col("label").alias("last"), F.least("label", "least").alias("label"))
        near, near_path = written(near, "labels")
        far = near.select("idterm", F.col("node").alias("label"), F.col("label").alias("own"))
        after, after_path = written(near.join(far, ["idterm", "label"]).select("idterm", "node", F.col("own").alias("label"), "last"), "labels")
        remove(spark, [path, near_path])
        state, path = after.drop("last"), after_path
        if after.where("label <> last").first() is None:
            return state


def _linked(points: DataFrame, cells: DataFrame, eps_m: float, side: float) -> DataFrame:
    """Pairs of cells (idterm, a, b, in both directions) with core points no farther apart than ``eps_m``.

    ``points`` has idterm, cell, x, y and gx, gy (their place in widths and heights of cells);
    ``cells`` idterm, cell, row, col and box.
    """
    spark = points.sparkSession
    other = cells.select("idterm", F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("cell").alias("b"), F.col("box").alias("box_b"))
    wide = cells.withColumns({"x0": F.col("box.x0"), "x1": F.col("box.x1")})
    pairs = _around(wide, "x0", "x1", eps_m / METRES_PER_DEGREE, side).join(other, ["idterm", "near_row", "near_col"]).where("cell < b")
    low, high = _bounds("box_a", "box_b")
    pairs = pairs.select("idterm", F.col("cell").alias("a"), "b", F.col("box").alias("box_a"), "box_b").select("idterm", "a", "b", low.alias("low"), high.alias("high")).where(F.col("low") <= eps_m)
    zero = F.lit(None).cast("struct<i:bigint,j:bigint>")
    state, path = written(pairs.select("idterm", "a", "b", "low", "high", zero.alias("part_a"), zero.alias("part_b")), "cell-pairs")
    found = [state.where(F.col("high") <= eps_m).select("idterm", "a", "b").distinct()]
    for k in range(1, SPLITS + 2):
        # the parts of pairs that the bounds leave open, unless another of their parts has linked the two cells
        sure = state.where(F.col("high") <= eps_m).select("idterm", "a", "b")
        rest, rest_path = written(state.where(F.col("high") > eps_m).join(sure, ["idterm", "a", "b"], "left_anti"), "open-pairs")
        if rest.first() is None:
            remove(spark, [rest_path])
            break
        asked = rest.select("idterm", F.col("a").alias("cell")).union(rest.select("idterm", "b")).distinct()
        of = points.join(asked, ["idterm", "cell"], "left_semi")
        part = lambda level: F.struct(F.floor(F.col("gx") * PARTS**level).cast("long").alias("i"), F.floor(F.col("gy") * PARTS**level).cast("long").alias("j"))
        last = k > SPLITS
        if last:  # what is still open is smaller than any position is known: point by point
            boxes = of.select("idterm", "cell", part(k - 1).alias("parent"), F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")).alias("part"), F.struct(F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1")).alias("box"))
        else:
            boxes = of.groupBy("idterm", "cell", part(k).alias("part")).agg(_box().alias("box"))
            up = F.struct(F.floor(F.col("part.i") / PARTS).cast("long").alias("i"), F.floor(F.col("part.j") / PARTS).cast("long").alias("j"))
            boxes = boxes.withColumn("parent", up)
        side_of = lambda s: boxes.select("idterm", F.col("cell").alias(s), F.col("parent").alias(f"part_{s}"), F.col("part").alias(f"new_{s}"), F.col("box").alias(f"box_{s}"))
        if k == 1:
            both = rest.drop("part_a", "part_b").join(side_of("a").drop("part_a"), ["idterm", "a"]).join(side_of("b").drop("part_b"), ["idterm", "b"])
        else:
            both = rest.join(side_of("a"), ["idterm", "a", "part_a"]).join(side_of("b"), ["idterm", "b", "part_b"])
        low, high = _bounds("box_a", "box_b")
        both = both.select("idterm", "a", "b", low.alias("low"), high.alias("high"), F.col("new_a").alias("part_a"), F.col("new_b").alias("part_b")).where(F.col("low") <= eps_m)
        both = both.withColumn("high", F.col("low")) if last else both
        state, path = written(both, "cell-pairs")
        remove(spark, [rest_path])
        found.append(state.where(F.col("high") <= eps_m).select("idterm", "a", "b").distinct())
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    return kept(links.union(links.select("idterm", "b", "a")).distinct(), "cell-links")


def density_clusters(points: DataFrame, eps_m: float = 120, min_points: int = 1) -> DataFrame:
    """DBSCAN's clusters of each vehicle's points (id, idterm, longitude, latitude): idterm, id, label.

    A point with ``min_points`` or more within ``eps_m`` metres (itself included, great circle)
    is core; core points that near are of one cluster, whose label is its smallest core id (where several
    stand at one place, that place's smallest). Other points take the smallest label of the
    core points near them, or have no row, like points without a position. Points at
    one place count each but are compared once. Clusters don't reach across the date line.
    """
    eps, side = eps_m / METRES_PER_DEGREE, eps_m * 0.999 / 2**0.5 / METRES_PER_DEGREE
    whole = points.where("longitude is not null and latitude is not null").select("idterm", "id", F.col("longitude").cast("double").alias("x"), F.col("latitude").cast("double").alias("y"))
    places = whole.groupBy("idterm", "x", "y").agg(F.min("id").alias("place"), F.count(F.lit(1)).alias("weight"))
    places = places.withColumn("gy", F.col("y") / side).withColumn("row", F.floor("gy").cast("long"))
    places = kept(places.withColumn("gx", F.col("x") / _width(F.col("row"), side)).withColumn("col", F.floor("gx").cast("long")), "places")
    cell = ["idterm", "row", "col"]
    if min_points > 1:
        counts = places.groupBy(*cell).agg(F.sum("weight").alias("n"))
        dense = places.join(counts.where(F.col("n") >= min_points).select(*cell), cell, "left_semi")
        sparse = places.join(counts.where(F.col("n") < min_points).select(*cell), cell, "left_semi")  # fewer than min_points a cell
        beside = places.select("idterm", F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("weight").alias("other"))
        near = _around(sparse, "x", "x", eps, side).join(beside, ["idterm", "near_row", "near_col"]).where(haversine(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) * 1000 <= eps_m)
        full = near.groupBy("idterm", "place").agg(F.sum("other").alias("n")).where(F.col("n") >= min_points).select("idterm", "place")
        core = kept(dense.unionByName(sparse.join(full, ["idterm", "place"], "left_semi")), "core")
    else:
        core = places
    cells = kept(core.groupBy(*cell).agg(F.min("place").alias("cell"), _box().alias("box")), "cells")
    inside = core.join(cells.select(*cell, "cell"), cell)
    labels = least_labels(_linked(inside, cells, eps_m, side), cells.select("idterm", F.col("cell").alias("node")))
    marked = inside.join(labels.withColumnRenamed("node", "cell"), ["idterm", "cell"]).select("idterm", "x", "y", "row", "col", "label")
    found = marked.select("idterm", "x", "y", "label")
    if min_points > 1:
        marked = kept(marked, "marked")
        found = marked.select("idterm", "x", "y", "label")
        edge = places.join(core.select("idterm", "place"), ["idterm", "place"], "left_anti")
        beside = marked.select("idterm", F.col("row").alias("near_row"), F.col("col").alias("near_col"), F.col("x").alias("bx"), F.col("y").alias("by"), "label")
        near = _around(edge, "x", "x", eps, side).join(beside, ["idterm", "near_row", "near_col"]).where(haversine(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) * 1000 <= eps_m)
        found = found.unionByName(near.groupBy("idterm", "x", "y").agg(F.min("label").alias("label")))
    return whole.join(found, ["idterm", "x", "y"]).select("idterm", "id", "label")
