"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.store import kept as stored
from roadpulse.functions.store import new_path

__all__ = ["few_rows", "free_name", "new_path", "stored", "tables", "words"]


def few_rows(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` (a written table of ids) marked for broadcast if it has ``most`` rows or fewer; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """Maximal runs of other than ASCII white space, in order; null and blank texts give none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+", -1), "")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
