"""Resilience of edges from hourly FLUX and speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.store import kept
from roadpulse.operators.traffic import EDGE


def flux_volatility(flux: DataFrame) -> DataFrame:
    """Half the span between an edge's largest and smallest FLUX."""
    return flux.groupBy(*EDGE).agg(F.max("FLUX").alias("max_flux"), ((F.max("FLUX") - F.min("FLUX")) / 2).alias("volatility"))


def density(flux: DataFrame, speed: DataFrame, min_flux: float = 10) -> DataFrame:
    """FLUX / speed per edge and hour, where the speed isn't zero and FLUX is ``min_flux`` or more."""
    both = flux.join(speed, [*EDGE, "hour"]).where((F.col("speed") > 0) & (F.col("FLUX") >= min_flux))
    return both.withColumn("density", F.col("FLUX") / F.col("speed"))


def peak_density(dense: DataFrame) -> DataFrame:
    """Density and speed of each edge at its busiest hour, the earliest of equals."""
    at = F.struct(-F.col("FLUX"), "hour")
    return dense.groupBy(*EDGE).agg(F.min_by("density", at).alias("peak_density"), F.min_by("speed", at).alias("peak_speed"), F.max("FLUX").alias("max_flux"))


def capacity_drop(flux: DataFrame) -> DataFrame:
    """Per start node: largest FLUX less the second largest, nodes with two rows or more."""
    w = Window.partitionBy("u").orderBy(F.col("FLUX").desc(), "v", "hour")
    top = flux.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy("u")
    return top.agg(F.max("FLUX").alias("first"), F.min("FLUX").alias("second"), F.count(F.lit(1)).alias("rows")).where("rows = 2").select("u", (F.col("first") - F.col("second")).alias("capacity_drop"))


def resistance(dense: DataFrame) -> DataFrame:
    """Mean of ((F + volatility) / s) / ((max F + volatility) / peak s) per edge whose max FLUX exceeds its node's drop."""
    out = dense.join(flux_volatility(dense).drop("max_flux"), EDGE).join(peak_density(dense), EDGE).join(capacity_drop(dense), "u")
    out = out.where(F.col("max_flux") > F.col("capacity_drop"))
    one = (F.col("FLUX") + F.col("volatility")) / F.col("speed")
    return out.groupBy(*EDGE).agg(F.avg(one / ((F.col("max_flux") + F.col("volatility")) / F.col("peak_speed"))).alias("resistance"))


def recovery(dense: DataFrame) -> DataFrame:
    """Mean of ((F + F_in - F) / s) / ((max F - drop) / peak s) per edge; F_in: mean FLUX of edges that end where it starts."""
    flows_in = dense.groupBy(F.col("v").alias("u"), "hour").agg(F.avg("FLUX").alias("flux_in"))
    out = dense.join(flows_in, ["u", "hour"]).join(peak_density(dense), EDGE).join(capacity_drop(dense), "u")
    out = out.where(F.col("max_flux") > F.col("capacity_drop"))
    one = (F.col("FLUX") + (F.col("flux_in") - F.col("FLUX"))) / F.col("speed")
    return out.groupBy(*EDGE).agg(F.avg(one / ((F.col("max_flux") - F.col("capacity_drop")) / F.col("peak_speed"))).alias("recovery"))


def resilience(dense: DataFrame) -> DataFrame:
    """Resistance of edges whose mean density is up to their peak density, else recovery; values up to 1 are stored as 1 - x."""
    dense = kept(dense, "dense")  # read ten times below
    mean = dense.groupBy(*EDGE).agg(F.avg("density").alias("density"))
    out = mean.join(peak_density(dense), EDGE).join(resistance(dense), EDGE).join(recovery(dense), EDGE)
    x = F.when(F.col("density") <= F.col("peak_density"), F.col("resistance")).otherwise(F.col("recovery"))
    return out.withColumn("x", x).select(*EDGE, F.when(F.col("x") <= 1, 1 - F.col("x")).otherwise(F.col("x")).alias("resilience"), F.when(F.col("x") <= 1, "low").otherwise("high").alias("part"))
