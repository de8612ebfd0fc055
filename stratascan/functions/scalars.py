"""Scalar expressions on columns: labels, keys, tolerances, text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(x: Column) -> Column:
    """Two decimals as text, without group separators; halves to even."""
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def mz_label(mz: Column, level: Column) -> Column:
    """``100.0100_ms1``"""
    return F.format_string("%.4f_ms%d", mz, level.cast("int"))


def label_mz(label: Column) -> Column:
    return F.split(label, "_ms")[0].cast("double")


def label_level(label: Column) -> Column:
    return F.split(label, "_ms")[1].cast("int")


def label_sort_value(mz: Column, level: Column) -> Column:
    """Sorts labels of level 1 before those of level 2."""
    return F.when(level == 2, mz * 100).otherwise(mz)


def ppm_tolerance(mz: Column, ppm: float = 40.0) -> Column:
    return mz * ppm / 1e6


def undo_min_max(x: Column, low: Column, high: Column) -> Column:
    return x * (high - low) + low


def without_commas(sequence: Column) -> Column:
    return F.replace(sequence, F.lit(","), F.lit(""))


def without_mod(sequence: Column) -> Column:
    return F.replace(sequence, F.lit("mod"), F.lit(""))


def without_ptm(sequence: Column, greedy: bool = True) -> Column:
    """Greedy: from the first bracket to the last, residues between two modifications included."""
    return F.regexp_replace(sequence, r"\(.+\)" if greedy else r"\(.+?\)", "")


def title_scan(title: Column) -> Column:
    """What stands between ``scan=`` and the next underscore of a spectrum's title."""
    return F.split_part(F.split_part(title, F.lit("scan="), F.lit(2)), F.lit("_"), F.lit(1))


def quality_digit(path: Column) -> Column:
    """Last digit of the first ``_Q<digits>`` in a path."""
    return F.regexp_extract(path, r"_Q\d*(\d)", 1)


def path_keys(path: Column) -> tuple[Column, Column]:
    """(swath, rt_window) of a path with ``key=value/`` twice; thousands separators are dropped."""
    number = lambda i: F.replace(F.regexp_extract(path, r"=([0-9.,]+)/[^=]*=([0-9.,]+)/", i), F.lit(","), F.lit("")).cast("double")
    return F.bround(number(1) * 100).cast("int"), number(2).cast("int")


def is_close_to_any(x: Column, points: list[float], tolerance: float = 1e-5) -> Column:
    """Within ``tolerance`` of one of a few given points."""
    return F.exists(F.array(*[F.lit(float(p)) for p in points]), lambda p: F.abs(x - p) <= tolerance)


def nearest_index(rows: DataFrame, column: str, index: str, value: float) -> DataFrame:
    """(index) of the value nearest to ``value``; the first of several."""
    return rows.agg(F.min_by(index, F.struct(F.abs(F.col(column) - value), F.col(index))).alias(index))


def rounded_sum(rows: DataFrame, keys: list[str], column: str = "mz", value: str = "intensity", decimals: int = 2) -> DataFrame:
    """``value`` summed over rows that agree in ``keys`` and in the rounded ``column``."""
    return rows.withColumn(column, F.bround(column, decimals)).groupBy(*keys, column).agg(F.sum(value).alias(value))


def rounded_mean(rows: DataFrame, keys: list[str], column: str = "rt", value: str = "intensity", decimals: int = 4) -> DataFrame:
    return rows.withColumn(column, F.bround(column, decimals)).groupBy(*keys, column).agg(F.avg(value).alias(value))


def time_points(scan: DataFrame) -> DataFrame:
    """(file, time_points)"""
    return scan.groupBy("file").agg(F.count_distinct("rt").alias("time_points"))


def file_with_most_time_points(scan: DataFrame) -> DataFrame:
    return time_points(scan).orderBy(F.desc("time_points"), "file").limit(1)


def chromatograms(scan: DataFrame, mz: float, level: int, rt_range: tuple[float, float] | None = None, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Points of a level at an m/z, within the inclusive time range, by file and time."""
    rows = scan.where((F.col("level") == level) & (F.abs(F.col("mz") - mz) <= atol + rtol * abs(mz)))
    if rt_range:
        rows = rows.where(F.col("rt").between(*rt_range))
    return rows.orderBy("file", "rt")


def seeded_sample(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows without replacement, the same ones on every run: those with the least digests of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(size)


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Names that ``after`` has and ``before`` has not, in order."""
    return [c for c in after.columns if c not in before.columns]


def aligned(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with different columns; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
