"""Slices from a stream of points: tumbling windows over event time, with a watermark for late points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_points(points: DataFrame, size_sec: int, late_sec: int) -> DataFrame:
    """(start, end, file, level, points, intensity) of a stream with the event time ``ts``; points later than ``late_sec`` behind the
    newest one are dropped, as points are whose window opened in the neighbouring slice."""
    window = F.window("ts", f"{size_sec} seconds")
    rows = points.withWatermark("ts", f"{late_sec} seconds").groupBy(window, "file", "level").agg(F.count(F.lit(1)).alias("points"), F.sum("intensity").alias("intensity"))
    return rows.select("window.start", "window.end", "file", "level", "points", "intensity")


def append_slices(points: DataFrame, path: str, checkpoint: str, size_sec: float) -> StreamingQuery:
    """Append a stream of points to a table of slices by window; restarts take up where the last run ended."""
    rows = points.withColumn("rt_window", F.floor(F.col("rt") / size_sec).cast("int"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("rt_window").trigger(availableNow=True).start()
