"""Spectra: intensity cut-offs, summaries, pseudo-precursors, charge variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.functions.scalars import title_scan
from stratascan.plans.boundary import boundary


def drop_lower_bins(points: DataFrame, keys: list[str], cutoff_bin: int = 0, bins: int = 100) -> DataFrame:
    """MS1 points, and MS2 points strictly above the left edge of a bin of their spectrum's MS2 intensities."""
    spectrum = W.partitionBy(*keys)
    ms2 = F.when(F.col("level") == 2, F.col("intensity"))
    rows = points.withColumn("_lo", F.min(ms2).over(spectrum)).withColumn("_hi", F.max(ms2).over(spectrum))
    edge = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * cutoff_bin / bins
    return rows.where((F.col("level") == 1) | (F.col("intensity") > edge)).drop("_lo", "_hi")


def histogram(points: DataFrame, keys: list[str], bins: int = 100) -> DataFrame:
    """(keys.., bin, n) of equal widths between the least and the largest intensity; the last bin includes its upper edge.

    The range is a row per key, summed up before its shuffle, so a key with many points is in many tasks; keys are not null.
    """
    ranges = points.groupBy(*keys).agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
    rows = points.join(ranges, keys)
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("intensity") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return rows.groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def at_least(points: DataFrame, cutoff: float) -> DataFrame:
    return points.where(F.col("intensity") >= cutoff)


def summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Number of peaks, range of m/z, base peak (the lowest m/z of the highest) and total intensity."""
    base = F.max(F.struct("intensity", (-F.col("mz")).alias("neg_mz")))
    rows = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("peaks_count"), F.min("mz").alias("low_mz"), F.max("mz").alias("high_mz"), base.alias("_b"), F.sum("intensity").alias("tot_ion_current"))
    return rows.select(*keys, "peaks_count", "low_mz", "high_mz", (-F.col("_b.neg_mz")).alias("base_peak_mz"), F.col("_b.intensity").alias("base_peak_intensity"), "tot_ion_current")


def pseudo_precursor(points: DataFrame, keys: list[str], centre: str | None = None) -> DataFrame:
    """(keys.., prec_mz, prec_intensity): the strongest MS1 point. Without one, if ``centre`` names a column: the window's centre and an intensity of
    300, each with a small offset that depends on the keys only."""
    best = F.max(F.when(F.col("level") == 1, F.struct("intensity", (-F.col("mz")).alias("neg_mz"))))
    extra = [F.first(centre).alias("_centre")] if centre else []
    rows = points.groupBy(*keys).agg(best.alias("_b"), *extra)
    mz, intensity = -F.col("_b.neg_mz"), F.col("_b.intensity")
    if centre:
        jitter = F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) / 1_000_000
        mz, intensity = F.coalesce(mz, F.col("_centre") + 0.1 * jitter), F.coalesce(intensity, 300 + jitter)
    return rows.select(*keys, mz.alias("prec_mz"), intensity.alias("prec_intensity"))


def peak_lists(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., peaks): peaks in order of m/z; a spectrum is bounded by what one scan holds."""
    return points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))


def charge_variants(spectra: DataFrame, title: str = "title", charges: tuple[int, ...] = (2, 3)) -> DataFrame:
    """The whole set at each charge: title and ``scans`` become the scan number in the title, the same at every charge."""
    number = title_scan(F.col(title))
    return spectra.withColumn(title, number).withColumn("scans", F.col(title)).withColumn("charge", F.explode(F.array(*map(F.lit, charges))))


def sequencer_headers(spectra: DataFrame, order: list[str], sequence: str = "PEPTIDE", first: int = 10) -> DataFrame:
    """What one of the sequencers asks for: ``rtinseconds``, the place of a spectrum in order from ``first`` on, and a placeholder ``seq``."""
    return ordinals(spectra, order, "_place").withColumn("rtinseconds", F.col("_place") + first).withColumn("seq", F.lit(sequence)).drop("_place")


def ordinals(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name``: 0-based place of every row in the order of columns. Ranges of the order are numbered each in its task, and what comes before a range is a
    sum over one number per range; no task holds more than a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = boundary(ranged.select("*", F.monotonically_increasing_id().alias("_id")).withColumn("_part", F.shiftright("_id", 33)), "ordinals")
    sums = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_id", "_before")
