"""From slices to sparse sample x time x m/z tensors. The slice is a pair of key columns in every step; nothing loops over slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.operators.mz_walk import walked
from stratascan.plans.boundary import boundary

SLICE = ["swath", "rt_window"]
#: Seconds that the last cycle of a slice stays open.
LAST_CYCLE_SEC = 0.1
MIN_POINTS = 5


def sample_numbers(points: DataFrame) -> DataFrame:
    """``sample_no``: 0-based rank of the file within its slice."""
    return points.withColumn("sample_no", F.dense_rank().over(W.partitionBy(*SLICE).orderBy("file")) - 1)


def bin_cycles(points: DataFrame, last_cycle_sec: float = LAST_CYCLE_SEC) -> DataFrame:
    """``cycle``: 0-based number of the last MS1 time at or before a point, in its slice and file; points before the first or
    too late after the last are dropped, and so are slices in which a file has no MS1 point.

    One shuffle by slice and file serves both windows: the finer keys are within it. Which slices are whole is a row per slice.
    """
    lasts = points.groupBy(*SLICE, "file").agg(F.max(F.when(F.col("level") == 1, F.col("rt"))).alias("_last"))
    whole = lasts.groupBy(*SLICE).agg(F.count_if(F.col("_last").isNull()).alias("_without")).where("_without = 0").select(*SLICE)
    rows = points.join(lasts.join(whole, SLICE, "left_semi"), [*SLICE, "file"]).repartition(*SLICE, "file")
    nth = F.row_number().over(W.partitionBy(*SLICE, "file", "level", "rt").orderBy("mz"))
    rows = rows.withColumn("_first", F.when((F.col("level") == 1) & (nth == 1), 1).otherwise(0))
    upto = W.partitionBy(*SLICE, "file").orderBy("rt").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("cycle", (F.sum("_first").over(upto) - 1).cast("int"))
    return rows.where((F.col("cycle") >= 0) & (F.col("rt") < F.col("_last") + last_cycle_sec)).select(*points.columns, "cycle")


def dropped_spectra(points: DataFrame, last_cycle_sec: float = LAST_CYCLE_SEC) -> DataFrame:
    """Share of distinct spectra per slice and file that no cycle takes."""
    kept = bin_cycles(points, last_cycle_sec).select(*SLICE, "file", "spectrum_index").distinct().withColumn("in_cycle", F.lit(1))
    seen = points.select(*SLICE, "file", "spectrum_index").distinct().join(kept, [*SLICE, "file", "spectrum_index"], "left")
    return seen.groupBy(*SLICE, "file").agg(F.count(F.lit(1)).alias("spectra"), F.sum(F.when(F.col("in_cycle").isNull(), 1).otherwise(0)).alias("dropped"))


def both_levels_of(partitions: DataFrame) -> DataFrame:
    """(swath, rt_window) of the slices with partitions of both levels."""
    return partitions.groupBy(*SLICE).agg(F.count_distinct("level").alias("_levels")).where("_levels = 2").select(*SLICE)


def mz_partitions(points: DataFrame, ppm: float, both_levels: bool = False) -> DataFrame:
    """(swath, rt_window, level, start). With ``both_levels`` a slice without points of both levels has no partitions."""
    found = walked(points, ppm).select(*SLICE, "level", "start").distinct()
    if not both_levels:
        return found
    found = boundary(found, "partitions")
    return found.join(both_levels_of(found), SLICE, "left_semi")


def aggregate_partitions(points: DataFrame, agg=F.sum) -> DataFrame:
    """(swath, rt_window, file, cycle, level, start, intensity), aggregated over the points of each; nulls are ignored."""
    return points.groupBy(*SLICE, "file", "cycle", "level", "start").agg(agg("intensity").alias("intensity"))


def frequent_partitions(sums: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Rows of partitions that reach ``min_points`` cycles in at least one file; they stay in all files."""
    part = [*SLICE, "level", "start"]
    seen = sums.groupBy(*part, "file").agg(F.count_distinct("cycle").alias("n")).groupBy(*part).agg(F.max("n").alias("n"))
    return sums.join(seen.where(F.col("n") >= min_points).select(*part), part, "left_semi")


def to_coo(sums: DataFrame, align_cycles: bool = False) -> DataFrame:
    """``i``, ``j``, ``k``: sample, time and m/z ordinals of a slice. Time is the ordinal among a sample's surviving cycles;
    with ``align_cycles`` it is the cycle itself, so that samples with gaps stay aligned."""
    sample = F.dense_rank().over(W.partitionBy(*SLICE).orderBy("file")) - 1
    time = F.col("cycle") if align_cycles else F.dense_rank().over(W.partitionBy(*SLICE, "file").orderBy("cycle")) - 1
    mass = F.dense_rank().over(W.partitionBy(*SLICE).orderBy("level", "start")) - 1
    return sums.select(*SLICE, "file", "cycle", "level", "start", sample.cast("int").alias("i"), time.cast("int").alias("j"), mass.cast("int").alias("k"), F.col("intensity").alias("v"))


def partition_sums(points: DataFrame, ppm: float, last_cycle_sec: float = LAST_CYCLE_SEC) -> DataFrame:
    """Summed intensity per slice, file, cycle and m/z partition, of the slices with points of both levels. Points are binned once and written,
    then get their partitions in one more shuffle."""
    rows = boundary(bin_cycles(points, last_cycle_sec), "cycles")
    sums = boundary(aggregate_partitions(walked(rows, ppm)), "sums")
    return sums.join(both_levels_of(sums), SLICE, "left_semi")


def tensorize(points: DataFrame, ppm: float, min_points: int = MIN_POINTS, last_cycle_sec: float = LAST_CYCLE_SEC, align_cycles: bool = False) -> DataFrame:
    """Slices to sparse tensors; a slice without points of both levels has none."""
    return to_coo(frequent_partitions(partition_sums(points, ppm, last_cycle_sec), min_points), align_cycles)


def worth_decomposing(coo: DataFrame, samples: int = 2, times: int = 3, masses: int = 3) -> DataFrame:
    """Slices that are no trivial tensors."""
    dims = coo.groupBy(*SLICE).agg(F.max("i").alias("ni"), F.max("j").alias("nj"), F.max("k").alias("nk"))
    good = dims.where((F.col("ni") >= samples - 1) & (F.col("nj") >= times - 1) & (F.col("nk") >= masses - 1)).select(*SLICE)
    return coo.join(good, SLICE, "left_semi")


def pivot_slice(coo: DataFrame, columns: list[int]) -> DataFrame:
    """Wide form: a row per sample and time, a column per m/z ordinal in ``columns``."""
    return coo.groupBy(*SLICE, "i", "j").pivot("k", columns).agg(F.sum("v"))


def wide_slice(coo: DataFrame) -> DataFrame:
    """Wide form of whole slices: a row per sample and time, with all its m/z ordinals ``ks``, ascending, and their values ``vs``."""
    cells = F.array_sort(F.collect_list(F.struct("k", "v")))
    return coo.groupBy(*SLICE, "i", "j").agg(cells.alias("_cells")).select(*SLICE, "i", "j", F.col("_cells.k").alias("ks"), F.col("_cells.v").alias("vs"))


def axes(coo: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three axis tables of all slices: (slice, i, file), (slice, j) and (slice, k, level, start)."""
    return coo.select(*SLICE, "i", "file").distinct(), coo.select(*SLICE, "j").distinct(), coo.select(*SLICE, "k", "level", "start").distinct()


#: Gaussian of sigma 0.5 over five taps, normalised to 1.
_RAW = np.exp(-0.5 * (np.arange(-2, 3) / 0.5) ** 2)
TAPS = (_RAW / _RAW.sum()).tolist()


def impute(coo: DataFrame) -> DataFrame:
    """(slice, i, j, k, v) of the full grid: missing cells from their neighbours in time, observed cells unchanged.

    The grid is the join of a slice's own axes, so its size is the dense tensor's, slice by slice.
    """
    i, j, k = axes(coo)
    grid = i.select(*SLICE, "i").join(j, SLICE).join(k.select(*SLICE, "k"), SLICE)
    cells = grid.join(coo.select(*SLICE, "i", "j", "k", "v"), [*SLICE, "i", "j", "k"], "left")
    line = W.partitionBy(*SLICE, "i", "k").orderBy("j")
    at = [F.lag("v", 2), F.lag("v", 1), None, F.lead("v", 1), F.lead("v", 2)]
    near = sum((F.coalesce(f.over(line), F.lit(0.0)) * TAPS[d] for d, f in enumerate(at) if f is not None), F.lit(0.0))
    return cells.withColumn("v", F.greatest(F.coalesce("v", near), F.lit(0.0)))


def impute_sparse(coo: DataFrame) -> DataFrame:
    """(slice, i, j, k, v): what :func:`impute` gives, without the missing cells that stay 0. Each observed cell is scattered to its neighbours in time, so there are at most
    five times as many rows as observed cells."""
    times = coo.select(*SLICE, "j").distinct().withColumn("_at", F.row_number().over(W.partitionBy(*SLICE).orderBy("j")))  # a slice's own axis
    shifts = F.array(*[F.struct(F.lit(2 - d).alias("by"), F.lit(w).alias("weight")) for d, w in enumerate(TAPS)])
    rows = coo.select(*SLICE, "i", "j", "k", "v").join(times, [*SLICE, "j"]).select(*SLICE, "i", "k", "v", "_at", F.explode(shifts).alias("s"))
    own = F.when(F.col("s.by") == 0, F.col("v"))
    cells = rows.groupBy(*SLICE, "i", "k", (F.col("_at") + F.col("s.by")).alias("_at")).agg(F.sum(own).alias("_own"), F.sum(F.when(F.col("s.by") != 0, F.col("v") * F.col("s.weight"))).alias("_near"))
    cells = cells.join(times, [*SLICE, "_at"])
    cells = cells.withColumn("v", F.greatest(F.coalesce("_own", "_near"), F.lit(0.0)))
    return cells.where("_own IS NOT NULL OR v > 0").select(*SLICE, "i", "j", "k", "v")


def rms_scale(coo: DataFrame, level: int | None = None) -> DataFrame:
    """``v`` divided by the root mean square of its m/z fibre."""
    fibre = W.partitionBy(*SLICE, "k")
    scaled = F.col("v") / F.sqrt(F.avg(F.col("v") * F.col("v")).over(fibre))
    return coo.withColumn("v", scaled if level is None else F.when(F.col("level") == level, scaled).otherwise(F.col("v")))


def without_ms1(coo: DataFrame) -> DataFrame:
    return coo.where("level = 2")


def mz_index_of_level(coo: DataFrame, level: int) -> DataFrame:
    """(slice, k) of one level, which keep their positions."""
    return coo.where(F.col("level") == level).select(*SLICE, "k").distinct()

