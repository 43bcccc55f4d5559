"""Best-fit packing of token pieces into sequences, with certified lower bounds.

Pieces shorter than a sequence are dealt to groups of bounded size. Each group packs by best
fit decreasing and holds its number of sequences against lower bounds from dual feasible
functions. Groups at their bound are final. Groups with a gap keep the sequences they filled,
exchange the pieces of the others, and pack again, until nothing is gained.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import stored
from roadpulse.llm.tokens import token_pieces

#: Pieces in a group: enough for good fits, a few MB of memory.
GROUP_ROWS = 50_000
#: Exchanges after the first packing.
ROUNDS = 3


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: each, longest first, goes where it leaves least room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms: list[int] = []  # the rooms that some bin has, sorted
    n = 0
    for k in order.tolist():
        x = int(lengths[k])
        at = bisect_left(rooms, x)
        if at == len(rooms):
            b, room = n, size
            n += 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[k], offsets[k] = b, size - room
        left = room - x
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The most sequences that dual feasible functions show to be needed.

    Each function maps lengths so that what fits one sequence maps to at most 1, so the sum
    over all lengths bounds the sequences from below. Used: the identity; for each threshold t,
    lengths above size - t count 1 and those below t nothing; and rounding to 1/k.
    """
    counts = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((counts * x).sum()) // size)
    above = np.cumsum(counts[::-1])[::-1]
    mass = np.concatenate([[0], np.cumsum(counts * x)])
    t = np.arange(1, size // 2 + 1)
    big = np.where(size - t + 1 <= size, above[np.minimum(size - t + 1, size)], 0)
    best = max(best, int((big + -(-(mass[size - t + 1] - mass[t]) // size)).max(initial=0)))
    for k in range(1, 21):
        y = (k + 1) * x
        scaled = np.where(y % size == 0, x * k, (y // size) * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((counts * scaled).sum()) // (k * size)))
    return best


def _pack(size: int, last: bool):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, size)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(lengths, size)
        certified = last or len(fill) <= bound
        done = np.full(len(lengths), True) if certified else fill[bins] == size
        return group.assign(bin=bins, offset=offsets, done=done, bound=bound, bins=len(fill))

    return pack


def pack_pieces(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (any columns with ``length``, 1 to ``size``).

    Full pieces are sequences of their own. An empty table gives an empty result; equal rows
    are separate pieces. All columns of ``pieces`` stay; they must not be named group, bin,
    offset, done, bound, bins or sequence_id.
    """
    spark = pieces.sparkSession
    source = stored(pieces.withColumn("pack_row", F.monotonically_increasing_id()), "pieces")
    full = source.where(F.col("length") == size).select("pack_row", F.col("pack_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = source.where(F.col("length") < size).select("pack_row", "length")
    schema = "pack_row long, length long, group long, bin long, offset long, done boolean, bound long, bins long"
    placed = full
    for k in range(ROUNDS + 1):
        n = rest.count()
        if not n:
            break
        groups = -(-n // GROUP_ROWS)
        last = k == ROUNDS or (k > 0 and groups == 1)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("pack_row", F.lit(k)), F.lit(groups)))
        packed = stored(dealt.groupBy("group").applyInPandas(_pack(size, last), schema), f"packed-{k}")
        # rounds, groups and bins number the sequences below zero, apart from the full pieces'
        number = -1 - ((F.lit(k) * F.lit(1 << 56)) + F.col("group") * GROUP_ROWS * 4 + F.col("bin"))
        placed = placed.unionByName(packed.where("done").select("pack_row", number.alias("sequence_id"), "offset"))
        if last:
            break
        rest = packed.where("not done").select("pack_row", "length")
    return source.join(placed, "pack_row").drop("pack_row")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises every text, ends it with ``end_id``, and packs its pieces into sequences.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the end id alone; a null id and repeated rows are packed like any other.
    """
    pieces = token_pieces(docs, path, doc_id, text, size, end_id, [])
    return pack_pieces(pieces, size).select(F.col(doc_id).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
