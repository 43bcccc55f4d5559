"""Site-relative boilerplate lines.

Within a host, a line's ratio is the share of the host's documents that contain it. Lines above
a ratio are boilerplate, and every copy of them is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import free_name, stored

#: A line is boilerplate if more than this share of its host's documents have it,
RATIO = 0.08
#: and at least so many: a share says nothing on a host of few pages.
LEAST_DOCS = 5
#: Lists of boilerplate up to this size are sent to every executor.
BROADCAST_BYTES = 8 << 20


def _lines(df: DataFrame, text: str):
    """Lines of the text; a null text has none."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line):
    """A line without the white space at its ends; blank lines have none."""
    return F.nullif(F.btrim(line, F.lit(" \t\x0b\x0c\r")), F.lit(""))


def line_ratios(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """host, line_hash, n_docs, host_docs and ratio of every line that LEAST_DOCS documents have.

    Counts are summed where the rows lie before anything is shuffled, so a host or line with a
    third of all rows is no heavier than another.
    """
    source = docs.select(F.col(host).alias("host"), _lines(docs, text).alias("lines"))
    keys = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(_key(x))))
    blank = F.xxhash64(F.lit(None).cast("string"))
    each = source.select("host", F.explode(F.array_remove(keys, blank)).alias("line_hash"))
    counts = each.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= LEAST_DOCS)
    totals = source.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return counts.join(totals, counts["host"].eqNullSafe(totals["host"])).select(counts["host"], "line_hash", "n_docs", "host_docs", (F.col("n_docs") / F.col("host_docs")).alias("ratio"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, host: str = "source", text: str = "text") -> DataFrame:
    """host and hash of the lines above ``ratio``: at most 1 / ratio as many a host as its documents have lines on average."""
    return line_ratios(docs, host, text).where(F.col("ratio") > ratio).select("host", "line_hash")


def _listed(lines: DataFrame) -> DataFrame:
    """listed_host and drop_list of ``lines`` (host, line_hash), marked for broadcast if they are few; more are joined by a shuffle."""
    hosts = lines.groupBy("host").agg(F.collect_set("line_hash").alias("drop_list"))
    hosts = stored(hosts.select(F.col("host").alias("listed_host"), "drop_list"), "boilerplate")
    size = hosts.agg(F.sum(16 + F.octet_length("listed_host") + 8 * F.size("drop_list"))).first()[0] or 0
    return F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts


def boilerplate_beside_copies(docs: DataFrame, ratio: float = RATIO, host: str = "source", text: str = "text") -> DataFrame:
    """host and hash of the lines above ``ratio`` among pages that say something else each.

    Lines above half the ratio are suspects, as copies may be half of a host. A page counts if its
    other lines have half of its characters or more, and pages with the same other lines count
    once. So exact and near copies of a page, whose lines are all suspects, never make its text
    boilerplate, however many they are.
    """
    suspects = _listed(boilerplate(docs, ratio / 2, host, text))
    source = docs.select(F.col(host).alias("host"), _lines(docs, text).alias("lines"))
    joined = source.join(suspects, source["host"].eqNullSafe(suspects["listed_host"]), "left")
    drop_list = F.coalesce("drop_list", F.array().cast("array<bigint>"))
    suspect = lambda x: F.array_contains(F.col("drop_list"), F.xxhash64(_key(x)))
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(F.coalesce(_key(x), F.lit(""))))
    parts = joined.withColumn("drop_list", drop_list).withColumn("own", F.filter("lines", lambda x: ~suspect(x)))
    pages = parts.where((size(F.col("own")) > 0) & (2 * size(F.col("own")) >= size(F.col("lines"))))
    pages = pages.select("host", F.xxhash64("own").alias("own"), F.array_distinct(F.transform(F.filter("lines", suspect), lambda x: F.xxhash64(_key(x)))).alias("shared"))
    pages = stored(pages, "pages")
    totals = pages.select("host", "own").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    each = pages.select("host", "own", F.explode("shared").alias("line_hash")).distinct()
    n = each.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= LEAST_DOCS)
    found = n.join(totals, n["host"].eqNullSafe(totals["host"])).where(F.col("n_docs") / F.col("host_docs") > ratio)
    return found.select(n["host"], "line_hash")


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, host: str = "source", text: str = "text", counts: bool = False, copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``, all rows and columns kept.

    Blank lines stay; a null text stays null; a null host is a host; repeated rows each count
    as a document unless ``copies`` is false (see ``boilerplate_beside_copies``). With
    ``counts``, columns n_lines and n_dropped are added, with underscores before them where
    ``docs`` has such. The lines to drop are gathered per host, in short lists (see ``boilerplate``).
    Lines are told apart by 64-bit hashes.
    """
    out, n_lines, n_dropped, listed, drop = (free_name(docs, c) for c in ("kept_lines", "n_lines", "n_dropped", "listed_host", "drop_list"))
    hosts = _listed((boilerplate if copies else boilerplate_beside_copies)(docs, ratio, host, text)).withColumnsRenamed({"listed_host": listed, "drop_list": drop})
    joined = docs.join(hosts, docs[host].eqNullSafe(hosts[listed]), "left")
    lines = _lines(docs, text)
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(drop, F.xxhash64(_key(x)))))
    joined = joined.withColumn(out, kept)
    columns = [F.when(docs[c].isNotNull(), F.array_join(F.col(out), "\n")).alias(c) if c == text else docs[c] for c in docs.columns]
    if counts:
        columns += [F.size(lines).cast("long").alias(n_lines), (F.size(lines) - F.size(out)).cast("long").alias(n_dropped)]
    return joined.select(*columns)


def op4_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_lines, n_dropped and the remaining text of every document."""
    return drop_boilerplate(docs.select("doc_id", "source", "text"), counts=True)
