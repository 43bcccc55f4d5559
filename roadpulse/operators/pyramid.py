"""Nearest things by a pyramid of occupied cells.

Each level has the cells in which things lie, four times as wide as those of the level below,
with the box of what they hold. A point goes down from the top: of the cells it meets it keeps
those whose box may be nearer than the farthest that some other's can be, and looks at
their parts alone. It ends at the few things that may be the nearest, however far away they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.geo import EARTH_KM, cell
from roadpulse.functions.store import kept

#: Cells a side of a cell's parent; metres by which bounds are loosened, as distances are rounded to a millimetre.
FAN, SLACK = 4, 0.01


def sphere_bounds(box: str = "box") -> tuple[Column, Column]:
    """The least and largest metres by great circle from (px, py) to a place in a box (ax, bx, ay, by)."""
    at = lambda c: F.col(f"{box}.{c}")
    gap_y = F.greatest(at("ay") - F.col("py"), F.col("py") - at("by"), F.lit(0.0))
    span_y = F.greatest(F.abs(F.col("py") - at("ay")), F.abs(F.col("py") - at("by")))
    gap_x = F.greatest(at("ax") - F.col("px"), F.col("px") - at("bx"), F.lit(0.0))
    span_x = F.greatest(F.abs(F.col("px") - at("ax")), F.abs(F.col("px") - at("bx")))
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    turned = (gap_x <= 180) & (span_x >= 180)  # half way round lies between
    near_x = F.when(span_x > 180, F.least(half(gap_x), half(span_x))).otherwise(half(gap_x))
    far_x = F.when(turned, F.lit(1.0)).otherwise(F.greatest(half(gap_x), half(span_x)))
    cosine = lambda y: F.cos(F.radians(y))
    flat = cosine(F.greatest(F.abs(at("ay")), F.abs(at("by"))))
    wide = cosine(F.when(F.signum(at("ay")) != F.signum(at("by")), 0.0).otherwise(F.least(F.abs(at("ay")), F.abs(at("by")))))
    metres = lambda h: F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2000 * EARTH_KM)
    return metres(half(gap_y) + cosine(F.col("py")) * flat * near_x), metres(half(span_y) + cosine(F.col("py")) * wide * far_x)


def plane_bounds(metres_per_degree: float, box: str = "box") -> tuple[Column, Column]:
    """The least and largest metres on the point's local plane from (px, py) to a box (ax, bx, ay, by)."""
    at = lambda c: F.col(f"{box}.{c}")
    k = F.cos(F.radians("py"))
    gap = lambda a, b, p: F.greatest(at(a) - F.col(p), F.col(p) - at(b), F.lit(0.0))
    span = lambda a, b, p: F.greatest(F.abs(F.col(p) - at(a)), F.abs(F.col(p) - at(b)))
    metres = lambda f: F.sqrt(F.pow(f("ax", "bx", "px") * k, 2) + F.pow(f("ay", "by", "py"), 2)) * metres_per_degree
    return metres(gap), metres(span)


def _levels(leaves: DataFrame, width: float, size: float) -> list[DataFrame]:
    """Tables (i, j, box, up_i, up_j) of the pyramid's levels, the leaves' first; the last has cells without a parent."""
    whole = lambda: F.struct(*(f(F.col(f"box.{c}")).alias(c) for c, f in (("ax", F.min), ("bx", F.max), ("ay", F.min), ("by", F.max))))
    up = {"up_i": F.floor(F.col("i") / FAN).cast("long"), "up_j": F.floor(F.col("j") / FAN).cast("long")}
    out = [kept(leaves.withColumns(up), "pyramid")]
    while size < width:
        size *= FAN
        out.append(kept(out[-1].groupBy(F.col("up_i").alias("i"), F.col("up_j").alias("j")).agg(whole().alias("box")).withColumns(up), "pyramid"))
    return out


def nearest(points: DataFrame, things: DataFrame, size: float, width: float, distance: Column, bounds: tuple[Column, Column], pick: list[str]) -> DataFrame:
    """The nearest of ``things`` for each point (id, px, py), ties to the smallest ``pick`` columns: id, ``pick``, m.

    ``things`` has their box (ax, bx, ay, by) and what ``distance`` reads; ``bounds`` are those of a
    struct ``box``. Cells are ``size`` degrees wide at the bottom and the pyramid ends where one is wider than
    ``width``, the things' extent. All levels are one plan.
    """
    low, high = bounds
    middle = lambda a, b: cell((F.col(a) + F.col(b)) / 2, size)
    placed = kept(things.withColumns({"i": middle("ax", "bx"), "j": middle("ay", "by")}), "things")
    box = F.struct(*(f(c).alias(c) for c, f in (("ax", F.min), ("bx", F.max), ("ay", F.min), ("by", F.max))))
    levels = _levels(placed.groupBy("i", "j").agg(box.alias("box")), width, size)
    top = levels[-1].select("i", "j", "box")  # at most four cells
    state = points.select("id", "px", "py").crossJoin(F.broadcast(top))
    mine = Window.partitionBy("id")
    for k in range(len(levels) - 1, -1, -1):
        state = state.withColumn("low", low).withColumn("best", F.min(high).over(mine)).where(F.col("low") <= F.col("best") + SLACK).select("id", "px", "py", "i", "j")
        if k:
            parts = levels[k - 1].select(F.col("up_i"), F.col("up_j"), F.col("i").alias("ni"), F.col("j").alias("nj"), "box")
            state = state.join(parts, (F.col("i") == F.col("up_i")) & (F.col("j") == F.col("up_j"))).select("id", "px", "py", F.col("ni").alias("i"), F.col("nj").alias("j"), "box")
    met = state.join(placed, ["i", "j"]).withColumn("m", distance)
    return met.groupBy("id").agg(F.min(F.struct("m", *pick)).alias("b")).select("id", *(F.col(f"b.{c}").alias(c) for c in pick), "b.m")
