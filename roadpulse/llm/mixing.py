"""Mixing sources to target weights.

Every document gets a random key from a hash of its id. Rows are sorted by range over source
and key, so a large source lies in many partitions; the sums of sizes of the partitions before,
and those of the rows before inside one, place each document in its source's order. A
source's budget is cut there to the word, after as many whole epochs as fit in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.common import free_name, stored, words
from roadpulse.operators.cleaning import add_row_id

#: Weights of the sources in their order, repeating; what they share, of all sizes; the most of a source's size.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of sources (columns source, source_size): source, source_size, target.

    Sources weigh by their order (code points, null last), ``weights`` repeating, and share
    ``share`` of all sizes. Targets above ``most`` times a source's size stop there and the
    excess goes to the others by weight, until none is above; sources of no words get none. If
    ``share`` is above ``most``, all stop. A round is one row of sums, whatever the sources' number.
    """
    order = add_row_id(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_at").drop("_null")
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_at") - 1, F.lit(len(weights)))).cast("int"))
    rows = stored(order.select("source", "source_size", weight.alias("_weight")), "sources")
    cap, level = F.col("source_size") * float(most), None
    while True:
        open_ = F.lit(True) if level is None else F.col("_weight") * level <= cap
        sums = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(~open_, F.col("source_size"))).alias("stopped"), F.sum(F.when(open_, F.col("_weight"))).alias("weight")).first()
        if not sums["weight"]:
            break
        # one division of exact sums, so that every engine finds the same number
        after = (share * sums["all"] - float(most) * (sums["stopped"] or 0)) / sums["weight"]
        if level is not None and after <= level:
            break
        level = after
    target = cap if level is None or not sums["weight"] else F.when(F.col("_weight") * level <= cap, F.col("_weight") * level).otherwise(cap)
    return rows.select("source", "source_size", target.alias("target"))


def random_key(doc_id: Column) -> Column:
    """The same for an id in every run: its decimal digits' MD5; a null counts as empty."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _placed(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """``rows`` (source, key, doc_id, size) with their source's columns of ``aims`` and before: the sizes of its earlier rows."""
    order = ["source", "key", "doc_id", "size"]
    ranged = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("source").orderBy("part")  # as many rows as partitions at most
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("sum")).withColumn("start", F.sum("sum").over(w) - F.col("sum"))
    aims = aims.withColumnRenamed("source", "_source")
    starts = sums.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "sum").withColumnsRenamed({"source": "_source", "part": "_part"})
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))
    return placed.join(starts, same).withColumn("before", F.col("start") + F.col("inside"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What a mix of target weights takes of each document: doc_id, source, size, source_size, target, epochs, rest, taken.

    ``size`` counts words; a document is taken whole ``epochs`` times and its first ``rest``
    words once more, ``taken`` words in all. A source's taken words are its target's whole part:
    the last document of its random order is cut. Null and empty texts have no words; null
    sources are one source; rows with a null or the same id are ordered by size, so reruns
    agree; other columns are ignored.
    """
    found = F.size(words(F.col(text))).cast("long").alias("size")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), found)
    rows = stored(rows.withColumn("key", random_key(F.col("doc_id"))), "sizes")
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    placed = _placed(rows, aims)
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))).cast("long"), F.lit(0).cast("long"))
    left = budget - epochs * F.col("source_size")
    placed = placed.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left - F.col("before"))))
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", (F.col("epochs") * F.col("size") + F.col("rest")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` once for each time a document is taken, with the number of the epoch.

    Where an epoch takes a part of a document its text ends after the last word taken. Ids have
    to be distinct and not null; documents that aren't taken have no row. The number's column
    is ``epoch``, with underscores before it where ``docs`` has one.
    """
    epoch, key, whole, rest, size = (free_name(docs, c) for c in ("epoch", "_taken_id", "_whole", "_rest", "_size"))
    taken = mix(docs, doc_id=doc_id, text=text, source=source, **how).where("taken > 0")
    rows = docs.join(taken.select(*(F.col(a).alias(b) for a, b in (("doc_id", key), ("epochs", whole), ("rest", rest), ("size", size)))), F.col(doc_id) == F.col(key))
    rows = rows.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col(whole) + F.when(F.col(rest) > 0, 0).otherwise(-1))))
    space = " \t\n\x0b\x0c\r"
    # words and, as the last part, what follows them; white space at the start makes an empty first part
    lead = F.length(F.ltrim(F.col(text), F.lit(space))) < F.length(text)
    after = F.element_at(F.split(F.col(text), "[ \t-\r]+", (F.col(rest) + F.when(lead, 2).otherwise(1)).cast("int")), -1)
    first = F.rtrim(F.left(F.col(text), F.length(text) - F.length(after)), F.lit(space))
    return rows.withColumn(text, F.when((F.col(epoch) < F.col(whole)) | (F.col(rest) == F.col(size)), F.col(text)).otherwise(first)).drop(key, whole, rest, size)
