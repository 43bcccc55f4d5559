"""Units of work that fail midway, are rerun, and are read once."""

import pytest
from pyspark.sql import functions as F

from roadpulse.sources import commits

ROWS = "idterm long, day string, v long"


def test_rerun_units_replace_themselves(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit string")
    assert commits.read_units(spark, path, ROWS).count() == 0 and commits.pending_units(spark, path, units).count() == 3
    part = lambda k, n: spark.range(n).select(F.col("id").alias("idterm"), F.lit("d1").alias("day"), (F.col("id") * k).alias("v")).repartition(3)
    first = commits.write_unit(part(1, 5), path, "a", ["day"])
    commits.write_unit(part(2, 4), path, "b", ["day"])
    broken = part(3, 50).withColumn("v", F.when(F.col("idterm") == 49, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        commits.write_unit(broken, path, "c", ["day"])
    part(9, 7).write.partitionBy("day").parquet(f"{path}/attempt=left_behind")  # rows of a run that died before its commit
    assert [r.unit for r in commits.pending_units(spark, path, units).collect()] == ["c"]
    second = commits.write_unit(part(5, 6), path, "a", ["day"])
    commits.write_unit(part(3, 2), path, "c", ["day"])
    assert first != second and commits.pending_units(spark, path, units).count() == 0
    got = {(r.unit, r.n, r.s, r.day) for r in commits.read_units(spark, path, ROWS).groupBy("unit", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()}
    assert got == {("a", 6, 75, "d1"), ("b", 4, 12, "d1"), ("c", 2, 3, "d1")}
    log = {r.unit: r for r in commits.committed_units(spark, path).collect()}
    assert log["a"].version == 2 and log["a"].attempt == second and log["a"].n_rows == 6
    with pytest.raises(ValueError):
        commits.write_unit(units, path, "d")


def test_empty_unit(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    commits.write_unit(spark.createDataFrame([], ROWS), path, "a")
    assert commits.read_units(spark, path, ROWS).count() == 0 and commits.committed_units(spark, path).first().n_rows == 0
