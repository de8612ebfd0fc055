"""Index of models and spectra, peak counts, the choice of best models, abundances, and scan reconstruction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.functions.scalars import label_level, label_mz
from stratascan.operators.slices import SLICE


def model_index(swaths: DataFrame, rt_windows: DataFrame, min_comp: int, max_comp: int) -> DataFrame:
    """(swath, rt_window, ncomp, model_id): all combinations, numbered in row-major order.

    The number follows from the ranks on the three axes, so the product itself is neither sorted nor gathered; the distinct swaths and windows,
    some hundreds each, are.
    """
    s = swaths.select("swath").distinct().withColumn("_s", F.row_number().over(W.orderBy("swath")) - 1)
    w = rt_windows.select("rt_window").distinct().withColumn("_w", F.row_number().over(W.orderBy("rt_window")) - 1)
    n_w = w.agg(F.count(F.lit(1)).alias("_nw"))
    grid = s.join(n_w).join(w).withColumn("ncomp", F.explode(F.sequence(F.lit(min_comp), F.lit(max_comp))))
    number = (F.col("_s") * F.col("_nw") + F.col("_w")) * (max_comp - min_comp + 1) + F.col("ncomp") - min_comp
    return grid.select("swath", "rt_window", "ncomp", number.cast("long").alias("model_id"))


def spectrum_index(index: DataFrame, min_comp: int, max_comp: int) -> DataFrame:
    """One row per component of each model, with a dense number ``scan`` over all of them in model order."""
    span = sum(range(min_comp, max_comp + 1))
    block = F.floor(F.col("model_id") / (max_comp - min_comp + 1)) * span
    before = F.expr(f"(ncomp * (ncomp - 1) - {min_comp * (min_comp - 1)}) div 2")
    rows = index.withColumn("spectrum_num", F.explode(F.sequence(F.lit(0), F.col("ncomp") - 1)))
    return rows.withColumn("scan", (block + before + F.col("spectrum_num")).cast("long"))


def model_path(root: Column, swath: Column, window: Column, ncomp: Column) -> Column:
    """Where other programs expect a model's file."""
    return F.format_string("%s/swath_lower_adjusted=%.2f/rt_window=%.1f/parafac_model_F%d.pt", root, swath / 100, window.cast("double"), ncomp)


def widths_up_to(width: float) -> np.ndarray:
    """Whole wavelet widths below twice the expected peak width, at least one."""
    return np.arange(1, max(2, int(np.ceil(2 * width))))


def _wavelet(points: int, a: float) -> np.ndarray:
    t = np.arange(points) - (points - 1) / 2
    u = (t / a) ** 2
    return 2 / (np.sqrt(3 * a) * np.pi**0.25) * (1 - u) * np.exp(-u / 2)


def _transform(profiles: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """(profiles, scales, places): convolutions with the wavelet of each scale, all profiles at once, tap by tap."""
    n, size = profiles.shape
    out = np.zeros((n, len(widths), size))
    for row, a in enumerate(widths):
        kernel = _wavelet(min(10 * int(a), size), float(a))
        before = len(kernel) - 1 - (len(kernel) - 1) // 2
        wide = np.pad(profiles, ((0, 0), (before, len(kernel) - 1 - before)))
        for tap, weight in enumerate(kernel):
            out[:, row] += wide[:, tap : tap + size] * weight
    return out


class _Ridges:
    """Lines of maxima over scales, from the widest down, of many profiles at once. A line takes the nearest maximum within reach that no older line took, and ends after gaps in more than one scale.
    Lines of a profile are numbered in the order they begin."""

    def __init__(self, profiles: int) -> None:
        self.count = np.zeros(profiles, int)
        self.row, self.column, self.length, self.gap = (np.zeros((profiles, 0), int) for _ in range(4))

    def scale(self, row: int, maxima: np.ndarray, reach: int) -> None:
        free, size = maxima.copy(), maxima.shape[1]
        for line in range(self.row.shape[1]):
            live = np.flatnonzero((line < self.count) & (self.gap[:, line] <= 1))
            last, taken = self.column[live, line], np.full(len(live), -1)
            for d in range(reach + 1):
                for at in (last - d, last + d) if d else (last,):
                    ok = (taken < 0) & (at >= 0) & (at < size)
                    ok[ok] = free[live[ok], at[ok]]
                    taken[ok] = at[ok]
            has = taken >= 0
            on = live[has]
            free[on, taken[has]] = False
            self.row[on, line], self.column[on, line], self.gap[on, line] = row, taken[has], 0
            self.length[on, line] += 1
            self.gap[live[~has], line] += 1
        of, column = np.nonzero(free)  # the rest begin lines, in order of place
        new = free.sum(axis=1)
        line = self.count[of] + np.arange(len(of)) - np.repeat(np.cumsum(new) - new, new)
        self.count += new
        grow = max(0, int(self.count.max(initial=0)) - self.row.shape[1])
        self.row, self.column, self.length, self.gap = (np.pad(x, ((0, 0), (0, grow))) for x in (self.row, self.column, self.length, self.gap))
        self.row[of, line], self.column[of, line], self.length[of, line] = row, column, 1


def count_peaks_of(width: float, profiles: np.ndarray, floor: float = 0.1, snr: float = 1.0) -> np.ndarray:
    """Peaks of profiles of equal length, by ridge lines of their wavelet transforms (Du, Kibbe and Lin, 2006); values up to a tenth of a profile's maximum count as zero."""
    x = np.asarray(profiles, float)
    out = np.zeros(len(x), int)
    fine = np.flatnonzero(np.isfinite(x).all(axis=1) & (x.max(axis=1, initial=-np.inf) > 0))
    if not len(fine):
        return out
    x = x[fine]
    pad = np.pad(np.where(x <= floor * x.max(axis=1, keepdims=True), 0.0, x), ((0, 0), (1, 1)))
    widths = widths_up_to(width)
    cwt = _transform(pad, widths)
    left, right = np.pad(cwt, ((0, 0), (0, 0), (1, 0)))[:, :, :-1], np.pad(cwt, ((0, 0), (0, 0), (0, 1)))[:, :, 1:]
    maxima = (cwt > left) & (cwt >= right) & (cwt > 0)
    ridges = _Ridges(len(x))
    for row in range(len(widths) - 1, -1, -1):
        ridges.scale(row, maxima[:, row], max(1, int(widths[row]) // 4 + 1))
    # noise about a place: a low percentile of the finest scale in a window of a twentieth of the profile
    size = pad.shape[1]
    half, odd = divmod(int(np.ceil(size / 20)), 2)
    noise = np.stack([np.percentile(cwt[:, 0, max(c - half, 0) : min(c + half + odd, size)], 10, axis=1) for c in range(size)], axis=1)
    about = np.maximum(pad, np.maximum(np.pad(pad, ((0, 0), (1, 0)))[:, :-1], np.pad(pad, ((0, 0), (0, 1)))[:, 1:]))
    of, line = np.nonzero(ridges.length >= max(1, int(np.ceil(len(widths) / 4))))
    row, column = ridges.row[of, line], ridges.column[of, line]
    good = (np.abs(cwt[of, row, column]) >= snr * np.abs(noise[of, column])) & (about[of, column] > 0)
    found = np.zeros(pad.shape, bool)
    found[of[good], column[good]] = True
    out[fine] = found.sum(axis=1)
    return out


def count_peaks(width: float, profile: np.ndarray, floor: float = 0.1, snr: float = 1.0) -> int:
    """Peaks of one profile; see :func:`count_peaks_of`."""
    return int(count_peaks_of(width, np.asarray(profile, float)[None, :], floor, snr)[0])


#: Values of profiles that are looked at together.
PROFILE_VALUES = 200_000


def peak_counts(time_mode: DataFrame, fwhm_sec: float, window_sec: float, keys: list[str]) -> DataFrame:
    """(keys.., comp, npeaks) of rows (keys.., idx, comp, value): one profile per component, in order of time."""

    @F.pandas_udf("int")
    def counted(profiles: pd.Series) -> pd.Series:
        sizes, out = profiles.map(len), pd.Series(0, profiles.index)
        for size, own in profiles.groupby(sizes):
            step = max(1, PROFILE_VALUES // max(1, size))
            for at in range(0, len(own) if size else 0, step):
                part = own.iloc[at : at + step]
                out[part.index] = count_peaks_of(size * fwhm_sec / window_sec, np.stack(part.to_list()))
        return out

    lines = time_mode.groupBy(*keys, "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda r: r["value"]).alias("profile"))
    return lines.select(*keys, "comp", counted("profile").alias("npeaks"))


def unimodal_fraction(counts: DataFrame) -> DataFrame:
    """(model_id, unimodal_fraction); models without a component of one peak are left out."""
    one = F.count_if(F.col("npeaks") == 1)
    return counts.groupBy("model_id").agg((one / F.count(F.lit(1))).alias("unimodal_fraction")).where("unimodal_fraction > 0")


def best_models(counts: DataFrame, index: DataFrame) -> DataFrame:
    """Per slice the models with the largest fraction of unimodal components; all that tie."""
    rows = unimodal_fraction(counts).join(index, "model_id")
    nth = F.rank().over(W.partitionBy(*SLICE).orderBy(F.desc("unimodal_fraction")))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def sample_modes(sample_mode: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., sample_num, comp_num, abundance, cv_sample_mode): abundances with their component's coefficient of variation."""
    comp = W.partitionBy(*keys, "comp")
    cv = F.stddev_pop("value").over(comp) / F.avg("value").over(comp)
    return sample_mode.select(*keys, F.col("idx").alias("sample_num"), F.col("comp").alias("comp_num"), F.col("value").alias("abundance"), cv.alias("cv_sample_mode"))


def spectra_abundance(modes: DataFrame, spectra: DataFrame) -> DataFrame:
    """(scan, sample_num, abundance)."""
    s = spectra.select("model_id", F.col("spectrum_num").alias("comp_num"), "scan")
    return modes.join(s, ["model_id", "comp_num"]).select("scan", "sample_num", "abundance")


def params_of_best(index: DataFrame, best: DataFrame) -> DataFrame:
    """Index rows of the best models; a best model that the index lacks keeps a row with nulls."""
    return index.join(best.select("model_id").distinct(), "model_id", "right")


def rsq_or_default(models: DataFrame, measures: DataFrame, default: float = 0.5) -> DataFrame:
    """Models with their measured R2, ``default`` where there is none."""
    return models.join(measures.select(*SLICE, "ncomp", "rsq"), [*SLICE, "ncomp"], "left").withColumn("rsq", F.coalesce("rsq", F.lit(default)))


def reconstruct_scan(factors: DataFrame, coo: DataFrame, unimodal: DataFrame, rsq: DataFrame, sample: int | DataFrame) -> DataFrame:
    """(slice, ncomp, j, k, intensity): the unimodal components of a model for one sample, scaled so that its largest cell equals
    the measured value there times R2. ``unimodal`` has (slice, ncomp, comp), ``rsq`` (slice, ncomp, rsq); ``sample`` is the sample's
    tensor row, in all slices or as (slice, i). Without a measured value at its largest cell a model is left out."""
    if isinstance(sample, int):
        sample = coo.select(*SLICE).distinct().withColumn("i", F.lit(sample))
    model = [*SLICE, "ncomp"]
    chosen = factors.join(unimodal.select(*model, "comp"), [*model, "comp"])
    side = lambda m, axis, name: chosen.where(F.col("mode") == m).select(*model, "comp", F.col("idx").alias(axis), F.col("value").alias(name))
    own = side(0, "i", "_a").join(sample.select(*SLICE, "i"), [*SLICE, "i"], "left_semi").drop("i")
    cells = own.join(side(1, "j", "_b"), [*model, "comp"]).join(side(2, "k", "_c"), [*model, "comp"])
    fit = cells.groupBy(*model, "j", "k").agg(F.sum(F.col("_a") * F.col("_b") * F.col("_c")).alias("fit"))
    # the first largest cell in row-major order
    peak = fit.groupBy(*model).agg(F.max(F.struct("fit", (-F.col("j")).alias("nj"), (-F.col("k")).alias("nk"))).alias("m"))
    peak = peak.select(*model, F.col("m.fit").alias("top"), (-F.col("m.nj")).alias("j"), (-F.col("m.nk")).alias("k"))
    raw = coo.join(sample.select(*SLICE, "i"), [*SLICE, "i"], "left_semi").select(*SLICE, "j", "k", F.col("v").alias("raw"))
    scale = peak.join(raw, [*SLICE, "j", "k"]).join(rsq.select(*model, "rsq"), model).select(*model, (F.col("raw") * F.col("rsq") / F.col("top")).alias("scale"))
    return fit.join(scale, model).select(*model, "j", "k", (F.col("fit") * F.col("scale")).alias("intensity"))


def unimodal_components(counts: DataFrame) -> DataFrame:
    """(model_id, comp) of the components of one peak; a model without any has no row."""
    return counts.where("npeaks = 1").select("model_id", "comp")


def sample_row(coo: DataFrame, scan_num: int) -> DataFrame:
    """(slice, i): the tensor row of the file that is the ``scan_num``-th by name among a slice's files, from 0; a slice with fewer has none."""
    files = coo.select(*SLICE, "file", "i").distinct()
    nth = F.row_number().over(W.partitionBy(*SLICE).orderBy("file")) - 1
    return files.withColumn("_nth", nth).where(F.col("_nth") == scan_num).select(*SLICE, "i")


def reconstructed_map(factors: DataFrame, coo: DataFrame, counts: DataFrame, rsq: DataFrame, scan_num: int) -> DataFrame:
    """(model_id, cycle, intensity, mz, level): the map of one scan file from the unimodal components of models.

    ``factors`` has the factors of these models with their model_id, ``counts`` (model_id, comp, npeaks), ``rsq`` (slice, ncomp, rsq). A model without unimodal
    components, or whose slice lacks the file, is left out. Cells get their m/z by their position on the slice's mass axis.
    """
    model = [*SLICE, "ncomp"]
    named = factors.select(*model, "model_id").distinct()
    unimodal = named.join(unimodal_components(counts), "model_id")
    cells = reconstruct_scan(factors.drop("model_id", "rsq", "iterations"), coo, unimodal, rsq, sample_row(coo, scan_num))
    masses = coo.select(*SLICE, "k", F.col("start").alias("mz"), "level").distinct()
    rows = cells.join(masses, [*SLICE, "k"]).join(named, model)
    return rows.select("model_id", F.col("j").alias("cycle"), "intensity", "mz", "level")


def model_scans(spectra: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a spectrum index that belong to models given as (swath_start in m/z, rt_window, ncomp)."""
    keys = wanted.select(F.bround(F.col("swath_start") * 100).cast("int").alias("swath"), "rt_window", "ncomp")
    return spectra.join(keys, [*SLICE, "ncomp"], "left_semi")


def with_mz_index(mass_mode: DataFrame, axis: DataFrame) -> DataFrame:
    """Rows (slice, idx, ..) of mass modes with mz and level from the labels (slice, idx, label) of their axis; a label of another form is an error."""
    good = F.col("label").rlike(r"^[0-9.]+_ms[0-9]+$")
    label = F.when(good, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("no m/z label: "), F.coalesce("label", F.lit("null")))).cast("string"))
    rows = mass_mode.join(axis.select(*SLICE, "idx", label.alias("label")), [*SLICE, "idx"])
    return rows.withColumn("mz", label_mz(F.col("label")).cast("float")).withColumn("level", label_level(F.col("label")).cast("tinyint")).drop("label")
