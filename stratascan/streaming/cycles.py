"""Cycles of slices over a stream of points, with the open cycle of every slice and file as state.

Points arrive in order of time from one batch to the next, in any order within a batch. A cycle is handed on when the next MS1 time closes it. The last cycle of a slice and file is
closed by a timer, when the watermark has passed the end of the slice's window: only points soon after its MS1 time are in it. A file without an MS1 point in a slice is handed on as cycle -1, which
leaves the slice out, as in :func:`stratascan.operators.slices.bin_cycles`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stratascan.operators.slices import LAST_CYCLE_SEC, SLICE

KEY = [*SLICE, "file"]
OUT = "swath int, rt_window int, file string, cycle int, points long, intensity double"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_MS1 = -1


class OpenCycle(StatefulProcessor):
    """State: number and MS1 time of the open cycle, its points and intensity so far, and those of them that stay if it is the last."""

    def __init__(self, window_sec: float, last_cycle_sec: float) -> None:
        self.window_sec, self.last_cycle_sec = window_sec, last_cycle_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "cycle int, rt double, points long, intensity double, near long, near_intensity double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not key[2]:  # a marker: it could not be left out before, as filters go below the watermark
            return
        if not self.open.exists():
            self.handle.registerTimer(int((key[1] + 1) * self.window_sec * 1000))  # the end of the window
            cycle, rt, sums = NO_MS1, 0.0, [0, 0.0, 0, 0.0]
        else:
            cycle, rt, *sums = self.open.get()
        points = pd.concat(list(rows)).sort_values(["rt", "level"])
        times = points.loc[points["level"] == 1, "rt"].drop_duplicates()
        closed = []
        edges = [*(times[times > rt] if cycle != NO_MS1 else times), float("inf")]
        for i, until in enumerate(edges):
            own = points[(points["rt"] < until) & (points["rt"] >= (edges[i - 1] if i else float("-inf")))]
            if cycle != NO_MS1:
                near = own[own["rt"] < rt + self.last_cycle_sec]
                sums = [sums[0] + len(own), sums[1] + float(own["intensity"].sum()), sums[2] + len(near), sums[3] + float(near["intensity"].sum())]
            if until != float("inf"):
                if cycle != NO_MS1:
                    closed.append((*key, cycle, *sums[:2]))
                cycle, rt, sums = cycle + 1, float(until), [0, 0.0, 0, 0.0]
        self.open.update((cycle, rt, *sums))
        if closed:
            yield pd.DataFrame(closed, columns=[*KEY, "cycle", "points", "intensity"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        cycle, _, _, _, near, intensity = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(*key, cycle, near, intensity)], columns=[*KEY, "cycle", "points", "intensity"])

    def close(self) -> None:
        pass


def stream_cycles(points: DataFrame, path: str, checkpoint: str, window_sec: float, last_cycle_sec: float = LAST_CYCLE_SEC, late_sec: float = 0.0) -> StreamingQuery:
    """Append the closed cycles (swath, rt_window, file, cycle, points, intensity) of a stream of sliced points (swath, rt_window, file, level, rt, intensity) to ``path``, with what has arrived so far;
    a later run with the same ``checkpoint`` takes up the open ones. Times are seconds from 0 on. A point later than all windows, such as one of a marker's, closes what is open; rows without a file
    only move the watermark."""
    points.sparkSession.conf.set(STATE_STORE, ROCKSDB)  # what keeps values and timers
    timed = points.withColumn("ts", F.timestamp_micros((F.col("rt") * 1_000_000).cast("long"))).withWatermark("ts", f"{int(late_sec * 1000)} milliseconds")
    # keys without nulls, which the state's rows are not told apart by
    rows = timed.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in SLICE], F.coalesce("file", F.lit("")).alias("file"), F.col("level").cast("int").alias("level"), "rt", "intensity", "ts")
    closed = rows.groupBy(*KEY).transformWithStateInPandas(OpenCycle(window_sec, last_cycle_sec), outputStructType=OUT, outputMode="append", timeMode="eventTime")
    return closed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def whole_slices(cycles: DataFrame) -> DataFrame:
    """Cycles with points, of the slices in which every file has an MS1 point."""
    without = cycles.where(F.col("cycle") == NO_MS1).select(*SLICE).distinct()
    return cycles.where("points > 0").join(without, SLICE, "left_anti")
