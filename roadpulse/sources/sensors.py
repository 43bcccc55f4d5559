"""Sensor files of which each has a preamble and a header of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.functions.store import kept

#: How times are written in sensor files.
TIMES = ("dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss")


def column_name(text: Column) -> Column:
    """A header's cell in lower case, anything but letters and digits as underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def _unique(names: list[str]) -> list[str]:
    """Later columns of one name get a number."""
    out: list[str] = []
    for n in names:
        k = sum(x == n for x in names[: len(out)])
        out.append(f"{n}_{k}" if k else n)
    return out


def file_heads(lines: DataFrame, head: Column) -> DataFrame:
    """One row a file: file, head (the first of its lines for which ``head`` holds, else null).

    ``lines`` is what the text reader gives. Blocks are ordered by their start and lines inside a block by the order
    in which its task reads them, so no file has to be in one task.
    """
    at = F.struct("start", "line")
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return placed.groupBy("file").agg(F.min_by("value", F.when(head, at)).alias("head"))


def read_sensor_files(spark: SparkSession, path: str | list[str], time: str = "riferimento_temporale", sep: str = ";", columns: int = 10, names: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Rows of sensor files whose preambles differ in length and whose columns differ in order: timedate, the other
    columns as trimmed texts, and rejected.

    A file's header is its first line with a cell named ``time`` (names as ``column_name`` makes them), wherever it
    stands; ``names``, by default the first ``columns`` of the first file's header by path, are read from all files. A line with the header's number of
    cells but no time, or with a time but too few cells, is a row of nulls with the whole line as ``rejected``; other
    lines without a time (preambles, notes, blank lines) and repeated headers give no rows. A file without a header, or without one of
    the columns, is an error that names it; no files at all give no rows.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    cells = F.split("value", F.lit("\\Q" + sep + "\\E"), -1)
    is_head = F.array_contains(F.transform(cells, column_name), time)
    heads = kept(file_heads(lines, is_head), "sensor-heads")
    found = F.transform(F.split("head", F.lit("\\Q" + sep + "\\E"), -1), column_name)
    kinds = heads.groupBy("head").agg(F.min("file").alias("file")).withColumn("names", found).orderBy("file").collect()  # a row per different header
    if bare := [r.file for r in kinds if r.head is None]:
        raise ValueError(f"{bare[0]} has no header with {time}")
    wanted = list(names or (_unique(list(kinds[0].names))[:columns] if kinds else [time]))
    wanted += [time] if time not in wanted else []
    places = []
    for r in kinds:
        own = _unique(list(r.names))
        if lacking := [n for n in wanted if n not in own]:
            raise ValueError(f"{r.file} has no column {', '.join(lacking)}")
        places.append((r.head, len(own), [own.index(n) for n in wanted]))
    order = heads.join(spark.createDataFrame(places, "head string, width int, places array<int>"), "head").select("file", "width", "places")
    rows = lines.select("value", F.col("_metadata.file_path").alias("file")).where(~is_head).join(order, "file").withColumn("cells", cells)
    when = F.get("cells", F.get("places", F.lit(wanted.index(time))))
    when = F.coalesce(*(F.try_to_timestamp(F.trim(when), F.lit(f)) for f in TIMES)).cast("timestamp_ntz")
    full = F.size("cells") > F.array_max("places")
    rows = rows.withColumns({"at": when, "whole": full}).where("at is not null or size(cells) >= width")
    good = F.col("at").isNotNull() & F.col("whole")
    out = {n: F.when(good, F.trim(F.get("cells", F.get("places", F.lit(k))))) for k, n in enumerate(wanted) if n != time}
    return rows.select(F.when(good, F.col("at")).alias("timedate"), *(c.alias(n) for n, c in out.items()), F.when(~good, F.col("value")).alias("rejected"))
