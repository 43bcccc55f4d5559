"""Tables that are written unit by unit, where a rerun unit replaces itself.

A unit (a day, a block of vehicles) is written under a name of its own for each attempt and
counts only once the log names that attempt. What a failed attempt left behind is never read;
of several attempts of a unit the one logged last counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "unit string, attempt string, version long, n_rows long, at timestamp"


def _log(spark: SparkSession, path: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_log")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LOG).json(f"{path}/_log") if there else spark.createDataFrame([], LOG)


def committed_units(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts of each unit: unit, attempt, version, n_rows, at."""
    last = F.max_by(F.struct("attempt", "version", "n_rows", "at"), F.struct("version", "attempt"))
    return _log(spark, path).groupBy("unit").agg(last.alias("m")).select("unit", "m.*")


def write_unit(df: DataFrame, path: str, unit: str, partition_by: list[str] | None = None) -> str:
    """Writes ``df`` as a unit's rows in place of those it had, and returns the attempt's name.

    Readers see all of it or nothing: the log gets its one line after the rows are written.
    ``partition_by`` has to be the same for all units of a table. A column ``unit`` or ``attempt`` of ``df`` is refused, as the folders have these names.
    """
    spark = df.sparkSession
    if {"unit", "attempt"} & {c.lower() for c in df.columns}:
        raise ValueError("unit and attempt are names of folders")
    attempt = uuid.uuid4().hex
    df.write.partitionBy(*(partition_by or [])).parquet(f"{path}/attempt={attempt}")
    rows = spark.read.schema(df.schema).parquet(f"{path}/attempt={attempt}").count()
    version = (_log(spark, path).where(F.col("unit") == unit).agg(F.max("version")).first()[0] or 0) + 1
    line = spark.range(1).select(F.lit(unit).alias("unit"), F.lit(attempt).alias("attempt"), F.lit(version).cast("long").alias("version"), F.lit(rows).cast("long").alias("n_rows"), F.current_timestamp().alias("at"))
    line.coalesce(1).write.mode("append").json(f"{path}/_log")
    return attempt


def read_units(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed units with their ``unit``; ``schema`` is that of the rows.

    The folders of attempts are a partition column, so those that don't count are pruned by the join with the log.
    """
    known = committed_units(spark, path).select("unit", "attempt")
    if known.first() is None:
        return spark.createDataFrame([], f"{schema}, unit string")
    rows = spark.read.schema(f"{schema}, attempt string").option("basePath", path).parquet(path)
    return rows.join(known, "attempt").drop("attempt")


def pending_units(spark: SparkSession, path: str, units: DataFrame) -> DataFrame:
    """The rows of ``units`` (column unit) that have no commit yet: what is left to do after a failure."""
    return units.join(committed_units(spark, path).select("unit"), "unit", "left_anti")
