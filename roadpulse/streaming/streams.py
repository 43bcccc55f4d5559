"""Structured Streaming forms of flux and trips."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def stream_flux_15min(trav: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(u, v, start, flux): vehicles per hour of each edge and quarter of an hour; rows later than ``lateness`` are dropped."""
    ts = trav.withColumn("ts", F.col("timedate").cast("timestamp")).withWatermark("ts", lateness)
    return ts.groupBy(F.window("ts", "15 minutes"), "u", "v").agg((F.count(F.lit(1)) / 0.25).alias("flux")).select("u", "v", F.col("window.start").alias("start"), "flux")


def stream_trips(fixes: DataFrame, gap_s: int = 600, lateness: str = "1 hour") -> DataFrame:
    """(idterm, start, end, fixes, metres) of trips as session windows.

    Spark joins events exactly one gap apart, but a gap of ``gap_s`` splits: the window is a
    microsecond shorter.
    """
    ts = fixes.withColumn("ts", F.col("timedate").cast("timestamp")).withWatermark("ts", lateness)
    gap = f"{gap_s - 1} seconds 999 milliseconds 999 microseconds"
    out = ts.groupBy(F.session_window("ts", gap), "idterm").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("fixes"), (F.max("progressive") - F.min("progressive")).alias("metres"))
    return out.select("idterm", "start", "end", "fixes", "metres")


#: Where Spark keeps its own state of keyed processors.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside use the RocksDB state store, which keyed processors need; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])


COLUMNS = ("id", "s", "ms", "panel", "vehtype", "speed", "progressive")
#: The trip number so far, the fix before the held one, and the held fix, which waits for its successor.
HELD = "trip_no long, last_s long, last_panel long, last_progressive long, " + ", ".join(f"{c} long" for c in COLUMNS)
#: Of a value that is null.
NULL = np.iinfo(np.int64).min


def panel_rule(gap_s: int, jump_m: int):
    """Whether a fix starts a trip, as ``trips.split_trips_panel`` has it; fixes are dictionaries."""

    def starts(last: dict | None, fix: dict, following: dict | None) -> bool:
        if last is None or last["panel"] is None:
            return True
        p, before = fix["panel"], last["panel"]
        if p is None:
            return False
        jump = fix["progressive"] - last["progressive"] if None not in (fix["progressive"], last["progressive"]) else 0
        return p == 0 or (before == 2 and p in (1, 2)) or (p == 1 and before <= 1 and fix["s"] - last["s"] > gap_s) or jump > jump_m

    return starts


def engine_rule(gap_s: int):
    """As ``trips.split_trips_engine``: of the fleet's fixes only those at a stand from which the next one moves."""

    def starts(last: dict | None, fix: dict, following: dict | None) -> bool:
        if last is None or fix["s"] - last["s"] < gap_s or 0 not in (fix["panel"], last["panel"]):
            return False
        leaves = following is not None and (following["speed"] or 0) > 0 and fix["speed"] == 0
        return fix["vehtype"] != 2 or leaves

    return starts


class TripNumbers(StatefulProcessor):
    """Numbers a vehicle's trips by a rule on a fix, the one before and, with ``ahead``, the one after.

    Fixes wait until the watermark has passed them, so a late one still takes its place; a timer
    at the earliest of them wakes the vehicle. Kept: the waiting fixes, and the last two done with.
    """

    def __init__(self, rule, ahead: bool):
        self.rule, self.ahead = rule, ahead

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "fixes binary, least long")  # a batch's fixes are one entry
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            if len(batch):
                self._wait(np.column_stack([batch[c].fillna(NULL).to_numpy(np.int64) for c in COLUMNS]))
        return iter(())

    def _wait(self, fixes: np.ndarray) -> None:
        least = int(fixes[:, 2].min())
        self.waiting.appendValue((fixes.tobytes(), least))
        self.handle.registerTimer(least + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        entries = list(self.waiting.get())
        if not any(least < passed for _, least in entries):
            return
        fixes = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, len(COLUMNS)) for x, _ in entries])
        ready = fixes[fixes[:, 2] < passed]
        ready = ready[np.lexsort((ready[:, 0], ready[:, 2]))]
        ready = [dict(zip(COLUMNS, (None if v == NULL else v for v in r))) for r in ready.tolist()]
        self.waiting.clear()
        if len(fixes) > len(ready):
            self._wait(fixes[fixes[:, 2] >= passed])
        state = self.held.get() if self.held.exists() else None
        number, last, fix = 0, None, None
        if state is not None:
            number, s, panel, progressive = state[:4]
            last = None if s is None else {"s": s, "panel": panel, "progressive": progressive}
            fix = dict(zip(COLUMNS, state[4:]))
        out = []
        for following in ready:
            if self.ahead:
                if fix is not None:
                    number += self.rule(last, fix, following)
                    out.append((key[0], fix["id"], number))
                    last = fix
            else:
                number += self.rule(fix, following, None)
                out.append((key[0], following["id"], number))
            fix = following
        before = (None, None, None) if last is None else (last["s"], last["panel"], last["progressive"])
        self.held.update((number, *before, *fix.values()))
        if out:
            yield pd.DataFrame(out, columns=["idterm", "id", "trip_no"])

    def close(self) -> None:
        pass


def _numbered(fixes: DataFrame, rule, ahead: bool, lateness: str) -> DataFrame:
    ts = fixes.withColumn("ts", F.col("timedate").cast("timestamp")).withWatermark("ts", lateness)
    whole = ts.select("idterm", "ts", "id", F.floor(F.unix_micros("ts") / 1_000_000).cast("long").alias("s"), F.unix_millis("ts").alias("ms"), *(F.col(c).cast("long").alias(c) for c in ("panel", "vehtype", "speed", "progressive")))
    return whole.groupBy("idterm").transformWithStateInPandas(TripNumbers(rule, ahead), "idterm long, id long, trip_no long", "Append", "EventTime")


def stream_split_panel(fixes: DataFrame, gap_s: int = 600, jump_m: int = 10000, lateness: str = "1 hour") -> DataFrame:
    """(idterm, id, trip_no) of fixes that the watermark has passed, numbered as by ``trips.split_trips_panel``.

    Fixes come in any order up to ``lateness``; later ones are dropped. The session needs the RocksDB state store.
    Times are told apart to the millisecond, equal ones by id.
    """
    return _numbered(fixes, panel_rule(gap_s, jump_m), False, lateness)


def stream_split_engine(fixes: DataFrame, gap_s: int = 180, lateness: str = "1 hour") -> DataFrame:
    """As ``stream_split_panel``, by ``trips.split_trips_engine``; a fix is numbered once the next one is passed, too."""
    return _numbered(fixes, engine_rule(gap_s), True, lateness)
