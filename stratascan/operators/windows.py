"""Isolation windows: adjustment to non-overlapping bounds, interval joins, retention-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CENTI = 100


def distinct_windows(scan: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., start, end): the isolation windows that occur."""
    return scan.select(*by, F.col("prec_isolation_window_start").alias("start"), F.col("prec_isolation_window_end").alias("end")).na.drop().distinct()


def adjust_windows(windows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., start, swath_lower_adjusted, swath_upper_adjusted): neighbours share the mean of one's end and the next one's start.

    One row per distinct start, so a small table; with ``by`` each sample's windows are adjusted by themselves.
    """
    keys = [F.col(c) for c in by]
    ordered = W.partitionBy(*keys).orderBy("start", "end")
    edges = windows.withColumn("next_start", F.lead("start").over(ordered)).select(*keys, "start", F.explode(F.array("next_start", "end")).alias("edge"))
    upper = edges.groupBy(*keys, "start").agg(F.bround(F.avg("edge"), 2).alias("swath_upper_adjusted"))
    lower = F.coalesce(F.lag("swath_upper_adjusted").over(W.partitionBy(*keys).orderBy("start")), F.col("start"))
    return upper.withColumn("swath_lower_adjusted", lower)


def with_adjusted(scan: DataFrame, adjusted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every point with the adjusted bounds of its window; points without a window keep null bounds."""
    a = adjusted.withColumnRenamed("start", "prec_isolation_window_start")
    return scan.join(a, [*by, "prec_isolation_window_start"], "left")


def swath_key(bound: Column) -> Column:
    """A window's lower bound as whole hundredths."""
    return F.bround(bound * CENTI).cast("int")


def first_match_segments(windows: DataFrame) -> DataFrame:
    """(lo, hi, start, end): disjoint stretches, each with the window that a first-match search finds there, which is the
    one with the lowest start, then the lowest end. Windows are half-open. The distinct windows of an acquisition, some hundreds, are one list."""
    edges = windows.select("start", "end").where("start < end").distinct()
    held = edges.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("w"))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform("w", lambda w: F.array(w["start"], w["end"])))))
    rows = held.where(F.size("w") > 0).select("w", cuts.alias("c")).select("w", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 1)).alias("n"))
    rows = rows.select("w", F.get("c", F.col("n") - 1).alias("lo"), F.get("c", F.col("n")).alias("hi"))
    first = F.get(F.filter("w", lambda w: (w["start"] <= F.col("lo")) & (F.col("lo") < w["end"])), F.lit(0))
    return rows.select("lo", "hi", first.alias("f")).where("f IS NOT NULL").select("lo", "hi", "f.start", "f.end")


def interval_join(points: DataFrame, windows: DataFrame, on: str, bin_width: float) -> DataFrame:
    """Points with ``start`` and ``end`` of the first window that holds ``on``; points without one are left out.

    Stretches are laid over bins of equal width, so it is an equality join that neither side has to be small for, and a
    point meets at most the stretches of its bin.
    """
    bins = first_match_segments(windows).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_width), F.floor(F.col("hi") / bin_width))))
    rows = points.withColumn("_bin", F.floor(F.col(on) / bin_width))
    found = rows.join(bins, "_bin").where((F.col(on) >= F.col("lo")) & (F.col(on) < F.col("hi")))
    return found.drop("_bin", "lo", "hi")


def tolerance_join(left: DataFrame, right: DataFrame, a: str, b: str, rtol: float = 1e-5, atol: float = 1e-8, width: float = 1.0) -> DataFrame:
    """Rows of ``left`` with the row of ``right`` whose ``b`` is the lowest with |a - b| <= atol + rtol * |b|.

    ``right`` is laid over the bins that its tolerance touches; ``width`` should exceed the tolerance. A bin's rows of ``right`` are one list in order, from which a
    row of ``left`` picks the first that is near, so pairs are never rows. Of rows with one ``b`` the least goes on, so the list has the bin's distinct values.
    """
    right = right.groupBy(b).agg(F.min(F.struct(*right.columns)).alias("_r")).select("_r.*")
    tol = F.lit(atol) + F.lit(rtol) * F.abs(F.col(b))
    bins = right.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(b) - tol) / width), F.floor((F.col(b) + tol) / width))))
    lists = bins.groupBy("_bin").agg(F.array_sort(F.collect_list(F.struct(F.col(b).alias("_b"), F.struct(*right.columns).alias("_row")))).alias("_near"))
    rows = left.withColumn("_bin", F.floor(F.col(a) / width)).join(lists, "_bin")
    near = F.filter("_near", lambda r: F.abs(F.col(a) - r["_b"]) <= F.lit(atol) + F.lit(rtol) * F.abs(r["_b"]))
    rows = rows.withColumn("_first", F.try_element_at(near, F.lit(1))).where("_first IS NOT NULL")
    return rows.select(*left.columns, *[F.col(f"_first._row.{c}").alias(c) for c in right.columns])


def rt_window(rt: Column, size: float, max_rt: Column | float | None = None) -> Column:
    """Number of the retention-time window; with ``max_rt`` the last window includes its upper end."""
    n = F.floor(rt / size).cast("int")
    if max_rt is None:
        return n
    top = max_rt if isinstance(max_rt, Column) else F.lit(float(max_rt))
    return F.least(n, F.greatest(F.ceil(top / size).cast("int") - 1, F.lit(0)))


def rt_windows(max_rt: DataFrame, size: float) -> DataFrame:
    """(rt_window) of a one-row frame (max_rt): one row per window that starts before it."""
    n = F.greatest(F.ceil(F.col("max_rt") / size).cast("int"), F.lit(1))
    return max_rt.select(F.explode(F.sequence(F.lit(0), n - 1)).alias("rt_window"))


def restrict_to_swath(scan: DataFrame, lower: float, upper: float) -> DataFrame:
    """MS1 points by m/z and MS2 points by precursor, both ends included."""
    return scan.where(F.when(F.col("level") == 1, F.col("mz")).otherwise(F.col("prec_mz")).between(lower, upper))


def swath_list(adjusted: DataFrame) -> DataFrame:
    """Distinct adjusted windows by lower bound, without missing ones."""
    bounds = adjusted.select("swath_lower_adjusted", "swath_upper_adjusted").na.drop()
    return bounds.groupBy("swath_lower_adjusted").agg(F.min("swath_upper_adjusted").alias("swath_upper_adjusted")).orderBy("swath_lower_adjusted")


def filter_level_intensity(scan: DataFrame, least: float) -> DataFrame:
    """Drop weak MS2 points; MS1 points stay; an MS1 point is its own precursor."""
    kept = scan.where(~((F.col("level") == 2) & (F.col("intensity") < least)))
    return kept.withColumn("prec_mz", F.when(F.col("level") == 1, F.col("mz")).otherwise(F.col("prec_mz")))


def assign_slices(scan: DataFrame, window_size_sec: float, by_sample: bool = False) -> DataFrame:
    """The scan map cut into slices: adjusted windows joined, then (swath, rt_window) as whole numbers; points outside windows go."""
    by = ("file",) if by_sample else ()
    adjusted = adjust_windows(distinct_windows(scan, by), by)
    rows = with_adjusted(scan, adjusted, by).where("swath_lower_adjusted IS NOT NULL")
    return rows.withColumn("swath", swath_key(F.col("swath_lower_adjusted"))).withColumn("rt_window", rt_window(F.col("rt"), window_size_sec))
