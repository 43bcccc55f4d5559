"""Exact values at a rank over all rows, without gathering them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted on the driver at the end; how finely a pass brackets the rank.
FEW, ACCURACY = 10_000, 1000


def value_at(df: DataFrame, col: str, rank: int, n: int) -> float:
    """The value of number ``rank`` (from 0) of the ``n`` sorted values of a column without nulls.

    A pass brackets the rank with two values of bounded sketches and counts what lies below,
    at and between them; the next pass reads the rows between alone, about 1 / 250 of them.
    Equal values are counted, never gathered, and no row is left out whatever the sketches say.
    """
    part = df.select(F.col(col).cast("double").alias("x"))
    while n > FEW:
        near = [min(max(rank / n + d, 0.0), 1.0) for d in (-2 / ACCURACY, 2 / ACCURACY)]
        low, high = part.agg(F.percentile_approx("x", near, ACCURACY).alias("q")).first()["q"]
        counts = part.agg(*(F.count_if(c).alias(k) for k, c in (("below", F.col("x") < low), ("low", F.col("x") <= low), ("inner", F.col("x") < high), ("high", F.col("x") <= high)))).first()
        if rank < counts["below"]:
            part, n = part.where(F.col("x") < low), counts["below"]
        elif rank < counts["low"]:
            return low
        elif rank < counts["inner"]:
            part, n, rank = part.where((F.col("x") > low) & (F.col("x") < high)), counts["inner"] - counts["low"], rank - counts["low"]
        elif rank < counts["high"]:
            return high
        else:
            part, n, rank = part.where(F.col("x") > high), n - counts["high"], rank - counts["high"]
    return sorted(r["x"] for r in part.collect())[rank]  # FEW rows at most


def exact_median(df: DataFrame, col: str) -> float | None:
    """The median of a column's values but nulls, the mean of the middle two where their number is even; None without values."""
    rows = df.where(F.col(col).isNotNull())
    n = rows.count()
    if not n:
        return None
    low = value_at(rows, col, (n - 1) // 2, n)
    return low if n % 2 else (low + value_at(rows, col, n // 2, n)) / 2
