"""Readers and writers of the files that traffic data comes in."""

from __future__ import annotations

import csv
import re
import struct
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.sources.sensors import file_heads

FIXES = "idrequest long, idterm long, timedate timestamp_ntz, latitude double, longitude double, speed long, direction long, grade long, panel int, event int, vehtype int, progressive long"
LEGACY = "idRequest long, deviceId long, dateTime timestamp_ntz, latitude double, longitude double, speedKmh long, heading long, accuracyDop long, engineStatus int, type int, odometer long"
LEGACY_NAMES = {"idRequest": "idrequest", "deviceId": "idterm", "dateTime": "timedate", "speedKmh": "speed", "heading": "direction", "accuracyDop": "grade", "engineStatus": "panel", "type": "vehtype", "odometer": "progressive"}
REGISTRY = "idterm long, devicetype string, idvehcategory string, brand string, anno long, portata long, gender string, age string"


def read_fixes(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Header-less fixes of twelve columns."""
    return spark.read.schema(FIXES).csv(path, sep=sep)


def read_fixes_legacy(spark: SparkSession, path: str) -> DataFrame:
    """The older feed of eleven columns; rows of another width are dropped."""
    lines = spark.read.text(path).where(F.size(F.split("value", ",", -1)) == 11)
    rows = lines.select(F.from_csv("value", LEGACY, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.withColumnsRenamed(LEGACY_NAMES)


def read_many(spark: SparkSession, paths: str | list[str], sep: str = ";", fill: bool = False) -> DataFrame:
    """CSV files with headers, of the same columns in any order, as one table of texts.

    ``paths`` are files, folders or globs. One pass finds each file's header; the files of each different header are one scan,
    however many they are. A column that some file lacks is an error that names both, or null with ``fill``. Files without a line have no rows;
    where no file has a line the table has no columns. Folders named key=value give no columns.
    """
    heads = file_heads(spark.read.text(paths), F.trim("value") != "").where("head is not null")
    groups = sorted(((next(csv.reader([r.head], delimiter=sep)), sorted(r.files)) for r in heads.groupBy("head").agg(F.collect_list("file").alias("files")).collect()), key=lambda g: g[1])
    names = list(dict.fromkeys(n for head, _ in groups for n in head))
    out = spark.createDataFrame([], T.StructType([]))
    for k, (head, found) in enumerate(groups):
        if len(set(head)) < len(head):
            raise ValueError(f"{found[0]} has a column twice")
        if not fill and (lacking := [n for n in names if n not in head]):
            raise ValueError(f"{found[0]} has no column {', '.join(lacking)}")
        plain = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", unquote(f)) for f in found]
        rows = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in head])).csv(plain, sep=sep, header=True)
        out = out.unionByName(rows, allowMissingColumns=True) if k else rows
    return out.select(*(F.col("`" + n.replace("`", "``") + "`") for n in names))


def read_registry(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """The vehicle registry, in Latin-1."""
    return spark.read.schema(REGISTRY).csv(path, sep=sep, encoding="ISO-8859-1", header=True)


def read_sensor_counts(spark: SparkSession, path: str, skip: int = 48, sep: str = ";", columns: int = 10) -> DataFrame:
    """Sensor rows below a preamble of ``skip`` lines and a header: its first columns, names in lower case with underscores, timedate parsed."""
    name = lambda x: "".join(c if c.isalnum() else "_" for c in x.strip().lower()).strip("_")
    text = spark.read.text(path)
    first = spark.read.text(text.inputFiles()[0]).limit(skip + 1).collect() if text.inputFiles() else []  # the preamble is of fixed length
    if len(first) <= skip:
        raise ValueError(f"{path} has no header below {skip} lines")
    head = first[skip][0]
    names = [name(x) for x in head.split(sep)][:columns]
    rows = text.where(F.col("value") != head)  # lines of a preamble have no time in front
    cells = F.split("value", sep, -1)
    out = rows.where(F.size(cells) >= len(names)).select(*(F.trim(cells[k]).alias(n) for k, n in enumerate(names)))
    when = F.coalesce(*(F.try_to_timestamp(F.col(names[0]), F.lit(f)) for f in ("dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss")))
    return out.withColumn(names[0], when.cast("timestamp_ntz")).where(F.col(names[0]).isNotNull()).withColumnRenamed(names[0], "timedate")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Appends ``df`` to a Parquet table."""
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def read_geojson(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<double>>") -> DataFrame:
    """One row per feature: its properties (a schema text) and the geometry's type and coordinates.

    Files hold one collection over several lines, or one on each line (as ``write_geojson`` writes them).
    """
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: {coordinates}>>>"
    lines = spark.read.text(path).where(F.get_json_object("value", "$.type") == "FeatureCollection").first() is not None
    features = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def write_geojson(df: DataFrame, path: str, properties: list[str]) -> None:
    """A FeatureCollection of one feature as a line of JSON per row (geometry_type, coordinates and ``properties``)."""
    geometry = F.struct(F.col("geometry_type").alias("type"), "coordinates")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))
    df.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value")).write.text(path)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def wkb_hex_to_points(hexes: pd.Series) -> pd.Series:
    """Points of hexadecimal WKB points and line strings, either byte order; others are null."""

    def points(text):
        if text is None:
            return None
        data = bytes.fromhex(text)
        order = "<" if data[0] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, 1)[0]
        at = 9 if kind & 0x20000000 else 5
        kind &= 0xFF
        if kind not in (1, 2):
            return None
        n, at = (1, at) if kind == 1 else (struct.unpack_from(order + "I", data, at)[0], at + 4)
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
        return [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2])]

    return hexes.map(points)


@F.pandas_udf(T.StringType())
def points_to_wkb_hex(lines: pd.Series) -> pd.Series:
    """Little-endian hexadecimal WKB: one point as a point, more as a line string."""

    def text(points):
        if points is None or not len(points):
            return None
        flat = [c for p in points for c in (p["x"], p["y"])]
        head = struct.pack("<BI", 1, 1) if len(points) == 1 else struct.pack("<BII", 1, 2, len(points))
        return (head + struct.pack(f"<{len(flat)}d", *flat)).hex()

    return lines.map(text)
