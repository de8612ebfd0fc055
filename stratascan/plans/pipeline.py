"""The whole run as one graph of DataFrames: slices, tensors, models, choice, abundances, spectra.

Tables are written only where several later steps read them: the tensors, the factors and the choice of models.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratascan.config import Config
from stratascan.operators import block_cp, models, slices, spectra, tensors, windows
from stratascan.operators.slices import SLICE
from stratascan.plans.boundary import boundary


@dataclass(frozen=True)
class Result:
    slices: DataFrame
    coo: DataFrame
    factors: DataFrame
    measures: DataFrame
    index: DataFrame
    spectrum_index: DataFrame
    peak_counts: DataFrame
    best: DataFrame
    abundances: DataFrame
    spectra: DataFrame
    scan_map: DataFrame


def dense_sizes(cells: DataFrame) -> DataFrame:
    """(slice, size): cells of the dense tensor."""
    axis = [(F.max(a) + 1).cast("long") for a in "ijk"]
    return cells.groupBy(*SLICE).agg((axis[0] * axis[1] * axis[2]).alias("size"))


def fitted(cells: DataFrame, config: Config, done: DataFrame | None = None) -> DataFrame:
    """Factors of every slice for every number of components, a written table: slices up to ``parafac_large_cells`` each in tasks, larger ones in blocks, which begin at random. ``done`` has
    factors of an earlier run; models in it are not fitted again, and their factors are taken over."""
    low, high = config.parafac_min_comp, config.parafac_max_comp
    skip = None if done is None else done.select(*SLICE, "ncomp").distinct()
    sizes = boundary(dense_sizes(cells), "sizes")
    large = sizes.where(F.col("size") > config.parafac_large_cells).select(*SLICE)
    small = cells.join(large, SLICE, "left_anti")
    out = tensors.decompose(small, low, high, config.parafac_max_iter, config.parafac_tolerance, config.parafac_init, config.parafac_seed, skip)
    if not large.isEmpty():
        cells = boundary(cells.join(large, SLICE, "left_semi"), "large-cells")
        for ncomp in range(low, high + 1):
            out = out.unionByName(block_cp.decompose_large(cells, ncomp, config.parafac_max_iter, config.parafac_tolerance, config.parafac_seed, done=skip))
    return boundary(out if done is None else out.unionByName(done.select(out.columns)), "factors")


def run(scan: DataFrame, config: Config, scan_num: int = 0, done: DataFrame | None = None) -> Result:
    """All steps over a scan map of any number of samples and slices; ``scan_num`` is the file, by name from 0, whose map the best models reconstruct. ``done`` has factors of an
    earlier run over the same scan map, which this one takes up."""
    cut = windows.assign_slices(windows.filter_level_intensity(scan, config.min_scan_intensity), config.window_size_sec)
    coo = boundary(slices.tensorize(cut, config.mass_tol_ppm, config.min_points, config.last_cycle_sec, config.align_cycles), "coo")
    cells = boundary(slices.impute_sparse(slices.worth_decomposing(coo)), "cells")
    low, high = config.parafac_min_comp, config.parafac_max_comp
    factors = fitted(cells, config, done)

    index = models.model_index(coo.select("swath"), coo.select("rt_window"), low, high)
    spectrum_index = models.spectrum_index(index, low, high)
    numbered = factors.join(index, [*SLICE, "ncomp"])
    counts = boundary(models.peak_counts(tensors.mode_of(numbered, 1), config.avg_peak_fwhm_sec, config.window_size_sec, ["model_id"]), "peak-counts")
    best = models.best_models(counts, index)

    chosen = numbered.join(best.select("model_id"), "model_id", "left_semi")
    abundances = models.spectra_abundance(models.sample_modes(tensors.mode_of(chosen, 0), ["model_id"]), spectrum_index)
    masses = coo.select(*SLICE, F.col("k").alias("idx"), "level", F.col("start").alias("mz")).distinct()
    peaks = tensors.mode_of(chosen, 2).join(masses, [*SLICE, "idx"]).withColumnRenamed("value", "intensity").where("intensity > 0")
    peaks = peaks.join(spectrum_index.select("model_id", F.col("spectrum_num").alias("comp"), "scan"), ["model_id", "comp"])
    out = spectra.drop_lower_bins(peaks.select("scan", *SLICE, "level", "mz", "intensity"), ["scan"], config.intensity_lower_percentage_cutoff)
    measures = tensors.measures(factors)
    rsq = models.rsq_or_default(best.select(*SLICE, "ncomp"), measures)
    rebuilt = models.reconstructed_map(chosen, coo, counts, rsq, scan_num)
    return Result(cut, coo, factors, measures, index, spectrum_index, counts, best, abundances, out, rebuilt)
