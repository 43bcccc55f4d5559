"""Trip splitting as a stream against the windows of the batch form."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadpulse.operators import trips
from roadpulse.streaming import streams

ROWS = "id long, idterm long, timedate timestamp_ntz, panel int, vehtype int, speed long, progressive long"


@pytest.mark.parametrize("kind", ["panel", "engine"])
def test_splits_equal_the_batch_form(spark, tmp_path, kind):
    r, start, rows = random.Random(kind), dt.datetime(2019, 2, 1), []
    for v in range(6):
        at, far = 0.0, 0
        for k in range(80):
            at += r.choice([0, 20, 60, 700, 4000])
            far += r.choice([0, 100, 20_000])
            rows.append((100 * v + k, v, start + dt.timedelta(seconds=at), r.choice([0, 1, 1, 2]), 1 + v % 2, r.choice([0, 0, 30, None]), r.choice([far, far, None])))
    rows.append((9999, 99, start + dt.timedelta(days=9), 1, 1, 1, 1))  # moves the watermark over all others
    batch = spark.createDataFrame(rows, ROWS)
    jittered = sorted(rows[:-1], key=lambda x: x[2] + dt.timedelta(seconds=r.uniform(0, 1500))) + rows[-1:]
    for n, at in enumerate(range(0, len(jittered), 97)):  # files in turn, rows up to 25 minutes out of order
        spark.createDataFrame(jittered[at : at + 97], ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    numbered = streams.stream_split_panel(source, 600, lateness="30 minutes") if kind == "panel" else streams.stream_split_engine(source, 180, "30 minutes")
    with streams.rocksdb(spark):
        running = numbered.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    got = {x.id: x.trip_no for x in spark.read.schema(numbered.schema).parquet(f"file://{tmp_path}/out").collect()}
    whole = trips.split_trips_panel(batch, 600) if kind == "panel" else trips.split_trips_engine(batch, 180)
    want = {x.id: x.trip_no for x in whole.where("id < 9999").collect()}
    if kind == "engine":  # a vehicle's last fix waits for the next one
        last = {x.id for x in batch.where("id < 9999").groupBy("idterm").agg(F.max_by("id", F.struct("timedate", "id")).alias("id")).collect()}
        want = {k: v for k, v in want.items() if k not in last}
    assert got == want and len(set(got.values())) > 5


def test_fixes_of_a_batch_are_one_entry_of_state():
    class Kept:
        def __init__(self):
            self.rows, self.value = [], None
        def appendValue(self, row):
            self.rows.append(row)
        def clear(self):
            self.rows.clear()
        def exists(self):
            return self.value is not None
        def update(self, value):
            self.value = value
        def get(self):
            return list(self.rows) if self.value is None and self.rows else self.value

    class Handle:
        def __init__(self):
            self.timers, self.waiting, self.held = [], Kept(), Kept()
        def getListState(self, name, schema):
            return self.waiting
        def getValueState(self, name, schema):
            return self.held
        def registerTimer(self, ms):
            self.timers.append(ms)

    class Watermark:
        def getCurrentWatermarkInMs(self):
            return 60_000

    handle = Handle()
    numbers = streams.TripNumbers(streams.panel_rule(600, 10_000), False)
    numbers.init(handle)
    rows = [(k, k, 1000 * k, 0 if k == 30 else 1, 1, None, 2**60 + k) for k in range(100)]
    numbers.handleInputRows((7,), [pd.DataFrame(rows[50:] + rows[:50], columns=list(streams.COLUMNS))], None)
    assert len(handle.waiting.rows) == 1 and handle.timers == [1]
    (out,) = numbers.handleExpiredTimer((7,), Watermark(), None)
    assert out.values.tolist() == [[7, k, 1 + (k >= 30)] for k in range(60)]
    assert len(handle.waiting.rows) == 1 and handle.waiting.rows[0][1] == 60_000 and handle.held.value[-1] == 2**60 + 59
