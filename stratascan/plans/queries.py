"""One query per operator over the driver's tables, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.config import Config
from stratascan.functions import encoding, peptides, scalars
from stratascan.operators import block_cp, models, slices, spectra, tensors, windows
from stratascan.plans import views
from stratascan.plans.boundary import boundary
from stratascan.plans.views import LAST_CYCLE_SEC, MIN_POINTS, PPM, RANK, SCAN_SQL, WINDOW_SEC, scan_map

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- windows

ADJ_BY_FILE = """d AS (SELECT DISTINCT file, w_start, w_end FROM scan),
n AS (SELECT *, lead(w_start) OVER (PARTITION BY file ORDER BY w_start, w_end) AS nxt FROM d),
e AS (SELECT file, w_start, unnest([nxt, w_end]) AS edge FROM n),
u AS (SELECT file, w_start, round_even(avg(edge), 2) AS upper FROM e GROUP BY file, w_start),
adj AS (SELECT file, w_start, upper, coalesce(lag(upper) OVER (PARTITION BY file ORDER BY w_start), w_start) AS lower FROM u)"""
ADJ = ADJ_BY_FILE.replace("DISTINCT file,", "DISTINCT 0 AS file,")
SLICES = """sl AS (SELECT s.*, CAST(round_even(lower * 100, 0) AS INTEGER) AS swath, CAST(floor(rt / 259200.0) AS INTEGER) AS rt_window FROM scan s JOIN adj a ON s.w_start = a.w_start)"""
CYCLES = f"""f1 AS (SELECT *, CASE WHEN level = 1 AND row_number() OVER (PARTITION BY swath, rt_window, file, level, rt ORDER BY mz) = 1 THEN 1 ELSE 0 END AS fresh FROM sl),
f2 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY swath, rt_window, file ORDER BY rt RANGE UNBOUNDED PRECEDING) - 1 AS INTEGER) AS cycle,
  max(CASE WHEN level = 1 THEN rt END) OVER (PARTITION BY swath, rt_window, file) AS last_ms1 FROM f1),
f3 AS (SELECT *, min(CASE WHEN last_ms1 IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY swath, rt_window) AS whole FROM f2),
cyc AS (SELECT * FROM f3 WHERE cycle >= 0 AND rt < last_ms1 + {LAST_CYCLE_SEC} AND whole = 1)"""
BOTH = """lv AS (SELECT swath, rt_window FROM cyc GROUP BY ALL HAVING count(DISTINCT level) = 2), cb AS (SELECT cyc.* FROM cyc JOIN lv USING (swath, rt_window))"""
PARTS = f"""dm AS (SELECT DISTINCT swath, rt_window, level, mz FROM cb),
pt AS (SELECT swath, rt_window, level, min(mz) AS start FROM dm GROUP BY ALL UNION ALL
  SELECT p.swath, p.rt_window, p.level, min(d.mz) FROM pt p JOIN dm d ON d.swath = p.swath AND d.rt_window = p.rt_window AND d.level = p.level AND d.mz - p.start > p.start * {PPM} / 1e6
  GROUP BY p.swath, p.rt_window, p.level, p.start)"""
SUMS = """pa AS (SELECT c.*, p.start FROM cb c ASOF JOIN pt p ON c.swath = p.swath AND c.rt_window = p.rt_window AND c.level = p.level AND c.mz >= p.start),
sums AS (SELECT swath, rt_window, file, cycle, level, start, sum(intensity) AS intensity FROM pa GROUP BY ALL)"""
FREQ = f"""fr AS (SELECT swath, rt_window, level, start FROM (SELECT swath, rt_window, level, start, file, count(DISTINCT cycle) AS n FROM sums GROUP BY ALL) GROUP BY ALL HAVING max(n) >= {MIN_POINTS}),
fq AS (SELECT sums.* FROM sums JOIN fr USING (swath, rt_window, level, start))"""
COO = """coo AS (SELECT swath, rt_window, file, cycle, level, start, CAST(dense_rank() OVER (PARTITION BY swath, rt_window ORDER BY file) - 1 AS INTEGER) AS i,
  CAST(dense_rank() OVER (PARTITION BY swath, rt_window, file ORDER BY cycle) - 1 AS INTEGER) AS j, CAST(dense_rank() OVER (PARTITION BY swath, rt_window ORDER BY level, start) - 1 AS INTEGER) AS k, intensity AS v FROM fq)"""
TO_COO = (SCAN_SQL, ADJ, SLICES, CYCLES, BOTH, PARTS, SUMS, FREQ, COO)


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_slices(scan_map(spark, sf_dir), WINDOW_SEC)


def tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.tensorize(sliced(spark, sf_dir), PPM, MIN_POINTS, LAST_CYCLE_SEC)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and summed intensity per slice, sample and cycle."""
    binned = slices.bin_cycles(sliced(spark, sf_dir), LAST_CYCLE_SEC)
    return binned.groupBy("swath", "rt_window", "file", "cycle").agg(F.count(F.lit(1)).alias("points"), F.sum("intensity").alias("intensity"))


@query(with_(SCAN_SQL, ADJ_BY_FILE) + "SELECT file, w_start AS start, lower AS swath_lower_adjusted, upper AS swath_upper_adjusted FROM adj")
def q01_adjust_windows(spark, sf_dir):
    return windows.adjust_windows(windows.distinct_windows(scan_map(spark, sf_dir), ("file",)), ("file",))


_OVERLAPPING = "SELECT DISTINCT w_start AS s, w_end AS e FROM scan"


@query(with_(SCAN_SQL, ADJ) + "SELECT spectrum_index, scan.file, lower AS swath_lower_adjusted FROM scan JOIN adj ON prec_mz >= lower AND prec_mz < upper")
def q02_interval_join(spark, sf_dir):
    scan = scan_map(spark, sf_dir)
    adjusted = windows.adjust_windows(windows.distinct_windows(scan)).select(F.col("swath_lower_adjusted").alias("start"), F.col("swath_upper_adjusted").alias("end"))
    out = windows.interval_join(scan, adjusted, "prec_mz", 100.0)
    return out.select("spectrum_index", "file", F.col("start").alias("swath_lower_adjusted"))


@query(with_(SCAN_SQL, f"win AS ({_OVERLAPPING})", "m AS (SELECT spectrum_index, s, e, row_number() OVER (PARTITION BY spectrum_index ORDER BY s, e) AS nth FROM scan JOIN win ON prec_mz >= s AND prec_mz < e)") + "SELECT spectrum_index, s AS start, e AS \"end\" FROM m WHERE nth = 1")
def q03_overlap_first_match(spark, sf_dir):
    scan = scan_map(spark, sf_dir)
    return windows.interval_join(scan, windows.distinct_windows(scan), "prec_mz", 100.0).select("spectrum_index", "start", "end")


@query(with_(SCAN_SQL) + "SELECT spectrum_index, level, intensity, CASE WHEN level = 1 THEN mz ELSE prec_mz END AS prec_mz FROM scan WHERE NOT (level = 2 AND intensity < 20)")
def q04_level_filter(spark, sf_dir):
    return windows.filter_level_intensity(scan_map(spark, sf_dir), 20.0).select("spectrum_index", F.col("level").cast("int").alias("level"), "intensity", "prec_mz")


@query(with_(SCAN_SQL) + "SELECT spectrum_index, level FROM scan WHERE (level = 1 AND mz BETWEEN 120 AND 180) OR (level = 2 AND prec_mz BETWEEN 120 AND 180)")
def q05_swath_between(spark, sf_dir):
    return windows.restrict_to_swath(scan_map(spark, sf_dir), 120.0, 180.0).select("spectrum_index", F.col("level").cast("int").alias("level"))


@query(with_(SCAN_SQL, "m AS (SELECT max(rt) AS top FROM scan)", "r AS (SELECT least(CAST(floor(rt / 259200.0) AS INTEGER), greatest(CAST(ceil(top / 259200.0) AS INTEGER) - 1, 0)) AS rt_window FROM scan, m)", "a AS (SELECT CAST(unnest(range(greatest(CAST(ceil(top / 259200.0) AS BIGINT), 1))) AS INTEGER) AS rt_window FROM m)") + "SELECT rt_window, count(r.rt_window) AS points FROM a LEFT JOIN r USING (rt_window) GROUP BY rt_window")
def q06_rt_windows(spark, sf_dir):
    scan = scan_map(spark, sf_dir)
    top = scan.agg(F.max("rt").alias("max_rt"))
    points = scan.join(top).select(windows.rt_window(F.col("rt"), WINDOW_SEC, F.col("max_rt")).alias("rt_window")).groupBy("rt_window").agg(F.count(F.lit(1)).alias("points"))
    return windows.rt_windows(top, WINDOW_SEC).join(points, "rt_window", "left").select("rt_window", F.coalesce("points", F.lit(0).cast("long")).alias("points"))


# --- slices to tensors


@query(with_(SCAN_SQL, ADJ, SLICES, CYCLES) + "SELECT swath, rt_window, file, cycle, count(*) AS points, sum(intensity) AS intensity FROM cyc GROUP BY ALL")
def q07_cycle_binning(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(with_(SCAN_SQL, ADJ, SLICES, CYCLES, BOTH, PARTS) + "SELECT swath, rt_window, level, round(start, 6) AS start FROM pt")
def q08_mz_partitions(spark, sf_dir):
    rows = boundary(slices.bin_cycles(sliced(spark, sf_dir), LAST_CYCLE_SEC), "cycles")
    out = slices.mz_partitions(rows, PPM, both_levels=True)
    return out.select("swath", "rt_window", F.col("level").cast("int").alias("level"), F.round("start", 6).alias("start"))


def _sums(spark, sf_dir):
    return slices.partition_sums(sliced(spark, sf_dir), PPM, LAST_CYCLE_SEC)


@query(with_(SCAN_SQL, ADJ, SLICES, CYCLES, BOTH, PARTS, SUMS) + "SELECT swath, rt_window, file, cycle, level, round(start, 6) AS start, intensity FROM sums")
def q09_partition_sum(spark, sf_dir):
    return _sums(spark, sf_dir).select("swath", "rt_window", "file", "cycle", F.col("level").cast("int").alias("level"), F.round("start", 6).alias("start"), "intensity")


@query(with_(SCAN_SQL, ADJ, SLICES, CYCLES, BOTH, PARTS, SUMS, FREQ) + "SELECT swath, rt_window, level, round(start, 6) AS start, count(*) AS n FROM fq GROUP BY ALL")
def q10_frequent_partitions(spark, sf_dir):
    out = slices.frequent_partitions(_sums(spark, sf_dir), MIN_POINTS)
    return out.groupBy("swath", "rt_window", F.col("level").cast("int").alias("level"), F.round("start", 6).alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(*TO_COO) + "SELECT swath, rt_window, i, j, k, v FROM coo")
def q11_tensor_coo(spark, sf_dir):
    return tensor(spark, sf_dir).select("swath", "rt_window", "i", "j", "k", "v")


@query(with_(*TO_COO) + "SELECT swath, rt_window, i, j, " + ", ".join(f"sum(CASE WHEN k = {k} THEN v END) AS k{k}" for k in range(4)) + " FROM coo GROUP BY ALL")
def q12_tensor_pivot(spark, sf_dir):
    """Columns for a caller's list of m/z ordinals, here those its SQL names; q56 has all."""
    out = slices.pivot_slice(tensor(spark, sf_dir), [0, 1, 2, 3])
    return out.select("swath", "rt_window", "i", "j", *[F.col(str(k)).alias(f"k{k}") for k in range(4)])


@query(with_(*TO_COO) + "SELECT swath, rt_window, i, j, list(k ORDER BY k) AS ks, list(round(v, 5) ORDER BY k) AS vs FROM coo GROUP BY ALL")
def q56_tensor_wide(spark, sf_dir):
    """Every ordinal of a slice; q12 has the four that its SQL names."""
    return slices.wide_slice(tensor(spark, sf_dir)).withColumn("vs", F.transform("vs", lambda v: F.round(v, 5)))


_T = slices.TAPS


_IMPUTED = (*TO_COO, """gi AS (SELECT DISTINCT swath, rt_window, i FROM coo)""", """gj AS (SELECT DISTINCT swath, rt_window, j FROM coo)""", """gk AS (SELECT DISTINCT swath, rt_window, k FROM coo)""",
    """g AS (SELECT gi.swath, gi.rt_window, gi.i, gj.j, gk.k, coo.v FROM gi JOIN gj USING (swath, rt_window) JOIN gk USING (swath, rt_window) LEFT JOIN coo ON coo.swath = gi.swath AND coo.rt_window = gi.rt_window AND coo.i = gi.i AND coo.j = gj.j AND coo.k = gk.k)""",
    f"""im AS (SELECT swath, rt_window, i, j, k, coalesce(v, coalesce(lag(v, 2) OVER l, 0) * {_T[0]!r}::DOUBLE + coalesce(lag(v) OVER l, 0) * {_T[1]!r}::DOUBLE + coalesce(lead(v) OVER l, 0) * {_T[3]!r}::DOUBLE + coalesce(lead(v, 2) OVER l, 0) * {_T[4]!r}::DOUBLE) AS v
    FROM g WINDOW l AS (PARTITION BY swath, rt_window, i, k ORDER BY j))""")  # fmt: skip


@query(with_(*_IMPUTED) + "SELECT swath, rt_window, i, j, k, round(greatest(v, 0), 5) AS v FROM im")
def q13_impute_gaussian(spark, sf_dir):
    return slices.impute(boundary(tensor(spark, sf_dir), "coo")).select("swath", "rt_window", "i", "j", "k", F.round("v", 5).alias("v"))


@query(with_(*_IMPUTED) + "SELECT swath, rt_window, i, j, k, round(v, 5) AS v FROM im WHERE v > 0")
def q87_impute_sparse(spark, sf_dir):
    """What is not 0 of q13, from the observed cells alone."""
    return slices.impute_sparse(boundary(tensor(spark, sf_dir), "coo")).where("v > 0").select("swath", "rt_window", "i", "j", "k", F.round("v", 5).alias("v"))


@query(with_(*TO_COO) + "SELECT swath, rt_window, i, j, k, round(v / sqrt(avg(v * v) OVER (PARTITION BY swath, rt_window, k)), 6) AS v FROM coo")
def q27_rms_scale(spark, sf_dir):
    return slices.rms_scale(tensor(spark, sf_dir)).select("swath", "rt_window", "i", "j", "k", F.round("v", 6).alias("v"))


# --- spectra: an order's line items are a spectrum, return flag R the first level

SPEC_SQL = "pk AS (SELECT l_orderkey AS scan, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS level, l_extendedprice / 100 AS mz, l_quantity AS intensity FROM lineitem)"


def order_spectra(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("scan"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("level"), (F.col("l_extendedprice") / 100).alias("mz"), F.col("l_quantity").alias("intensity"))


@query(with_(SPEC_SQL, "b AS (SELECT *, min(CASE WHEN level = 2 THEN intensity END) OVER (PARTITION BY scan) AS lo, max(CASE WHEN level = 2 THEN intensity END) OVER (PARTITION BY scan) AS hi FROM pk)") + "SELECT scan, level, round(mz, 6) AS mz, intensity FROM b WHERE level = 1 OR intensity > lo + (hi - lo) * 10 / 100")
def q14_hist_cutoff(spark, sf_dir):
    return spectra.drop_lower_bins(order_spectra(spark, sf_dir), ["scan"], 10).select("scan", "level", F.round("mz", 6).alias("mz"), "intensity")


@query(with_(SPEC_SQL) + "SELECT scan, count(*) AS peaks_count, round(min(mz), 6) AS low_mz, round(max(mz), 6) AS high_mz, round(-max((intensity, -mz))[2], 6) AS base_peak_mz, max(intensity) AS base_peak_intensity, sum(intensity) AS tot_ion_current FROM pk GROUP BY scan")
def q15_spectrum_summary(spark, sf_dir):
    out = spectra.summary(order_spectra(spark, sf_dir), ["scan"])
    return out.select("scan", "peaks_count", *[F.round(c, 6).alias(c) for c in ("low_mz", "high_mz", "base_peak_mz")], "base_peak_intensity", "tot_ion_current")


@query(with_(SPEC_SQL) + "SELECT scan, round(-(max((intensity, -mz)) FILTER (level = 1))[2], 6) AS prec_mz, (max((intensity, -mz)) FILTER (level = 1))[1] AS prec_intensity FROM pk GROUP BY scan")
def q16_pseudo_precursor(spark, sf_dir):
    return spectra.pseudo_precursor(order_spectra(spark, sf_dir), ["scan"]).select("scan", F.round("prec_mz", 6).alias("prec_mz"), "prec_intensity")


# --- models: swaths are suppliers' nations, windows order months

INDEX_SQL = """sw AS (SELECT DISTINCT s_nationkey AS swath FROM supplier), rw AS (SELECT DISTINCT CAST(extract(month FROM o_orderdate) AS INTEGER) AS rt_window FROM orders),
ix AS (SELECT swath, rt_window, CAST(ncomp AS INTEGER) AS ncomp, row_number() OVER (ORDER BY swath, rt_window, ncomp) - 1 AS model_id FROM sw, rw, unnest(range(2, 5)) AS u(ncomp)),
sx AS (SELECT *, row_number() OVER (ORDER BY model_id, spectrum_num) - 1 AS scan FROM (SELECT *, CAST(unnest(range(ncomp)) AS INTEGER) AS spectrum_num FROM ix))"""


def _index(spark, sf_dir):
    swaths = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("swath"))
    months = read(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("rt_window"))
    return models.model_index(swaths, months, 2, 4)


@query(with_(INDEX_SQL) + "SELECT swath, rt_window, ncomp, model_id FROM ix")
def q17_model_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query(with_(INDEX_SQL) + "SELECT swath, rt_window, ncomp, model_id, spectrum_num, scan FROM sx")
def q18_spectrum_index(spark, sf_dir):
    return models.spectrum_index(_index(spark, sf_dir), 2, 4)


# orders are models of their customers' slices, line items components, the line number's rest the number of peaks
COUNTS_SQL = "pc AS (SELECT l_orderkey AS model_id, CAST(l_linenumber AS INTEGER) AS comp, CAST(1 + l_partkey % 3 AS INTEGER) AS npeaks FROM lineitem), mi AS (SELECT o_orderkey AS model_id, CAST(o_custkey % 100 AS INTEGER) AS swath, CAST(o_custkey // 100 AS INTEGER) AS rt_window FROM orders), uf AS (SELECT model_id, count(*) FILTER (npeaks = 1) / count(*) AS unimodal_fraction FROM pc GROUP BY model_id HAVING count(*) FILTER (npeaks = 1) > 0)"


def _counts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("model_id"), F.col("l_linenumber").alias("comp"), (1 + F.col("l_partkey") % 3).cast("int").alias("npeaks"))


def _models(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("model_id"), (F.col("o_custkey") % 100).cast("int").alias("swath"), F.floor(F.col("o_custkey") / 100).cast("int").alias("rt_window"))


@query(with_(COUNTS_SQL) + "SELECT model_id, round(unimodal_fraction, 6) AS unimodal_fraction FROM uf")
def q19_unimodal_fraction(spark, sf_dir):
    return models.unimodal_fraction(_counts(spark, sf_dir)).select("model_id", F.round("unimodal_fraction", 6).alias("unimodal_fraction"))


@query(with_(COUNTS_SQL, "rk AS (SELECT *, rank() OVER (PARTITION BY swath, rt_window ORDER BY unimodal_fraction DESC) AS nth FROM uf JOIN mi USING (model_id))") + "SELECT model_id, swath, rt_window, round(unimodal_fraction, 6) AS unimodal_fraction FROM rk WHERE nth = 1")
def q20_best_with_ties(spark, sf_dir):
    out = models.best_models(_counts(spark, sf_dir), _models(spark, sf_dir))
    return out.select("model_id", "swath", "rt_window", F.round("unimodal_fraction", 6).alias("unimodal_fraction"))


MODES_SQL = "sm AS (SELECT l_orderkey AS model_id, CAST(l_suppkey % 5 AS INTEGER) AS idx, CAST(l_linenumber - 1 AS INTEGER) AS comp, l_extendedprice AS value FROM lineitem), sc AS (SELECT *, stddev_pop(value) OVER (PARTITION BY idx, comp) / avg(value) OVER (PARTITION BY idx, comp) AS cv FROM sm)"


def _sample_mode(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("model_id"), (F.col("l_suppkey") % 5).cast("int").alias("idx"), (F.col("l_linenumber") - 1).alias("comp"), F.col("l_extendedprice").alias("value"))


@query(with_("sm AS (SELECT l_suppkey AS model_id, CAST(l_orderkey AS INTEGER) AS idx, CAST(l_linenumber AS INTEGER) AS comp, l_quantity AS value FROM lineitem)") + "SELECT model_id, idx AS sample_num, comp AS comp_num, value AS abundance, round(stddev_pop(value) OVER (PARTITION BY model_id, comp) / avg(value) OVER (PARTITION BY model_id, comp), 6) AS cv_sample_mode FROM sm")
def q21_sample_mode_cv(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("model_id"), F.col("l_orderkey").cast("int").alias("idx"), F.col("l_linenumber").alias("comp"), F.col("l_quantity").alias("value"))
    return models.sample_modes(rows, ["model_id"]).withColumn("cv_sample_mode", F.round("cv_sample_mode", 6))


@query(with_(INDEX_SQL, "sm AS (SELECT l_orderkey % 900 AS model_id, CAST(l_suppkey % 5 AS INTEGER) AS sample_num, CAST(l_linenumber - 1 AS INTEGER) AS comp_num, l_extendedprice AS abundance FROM lineitem)") + "SELECT scan, sample_num, abundance FROM sm JOIN sx ON sm.model_id = sx.model_id AND sm.comp_num = sx.spectrum_num")
def q22_spectra_abundance(spark, sf_dir):
    modes = _sample_mode(spark, sf_dir).select((F.col("model_id") % 900).alias("model_id"), F.col("idx").alias("sample_num"), F.col("comp").alias("comp_num"), F.col("value").alias("abundance"))
    return models.spectra_abundance(modes, models.spectrum_index(_index(spark, sf_dir), 2, 4))


@query(with_(INDEX_SQL, "best AS (SELECT DISTINCT o_custkey AS model_id FROM orders)") + "SELECT best.model_id, swath, rt_window, ncomp FROM ix RIGHT JOIN best ON ix.model_id = best.model_id")
def q23_right_join_models(spark, sf_dir):
    best = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model_id"))
    return models.params_of_best(_index(spark, sf_dir), best).select("model_id", "swath", "rt_window", "ncomp")


# --- tensor algebra

FACTORS_SQL = (views.CELLS_SQL, views.factor_sql("fa", "i"), views.factor_sql("fb", "j"), views.factor_sql("fc", "k"))
FIT_SQL = "fit AS (SELECT cells.*, sum(fa.value * fb.value * fc.value) AS fit FROM cells JOIN fa ON fa.swath = cells.swath AND fa.rt_window = cells.rt_window AND fa.idx = i JOIN fb ON fb.swath = cells.swath AND fb.rt_window = cells.rt_window AND fb.idx = j AND fb.comp = fa.comp JOIN fc ON fc.swath = cells.swath AND fc.rt_window = cells.rt_window AND fc.idx = k AND fc.comp = fa.comp GROUP BY ALL)"
_GRAM_SQL = "g{0} AS (SELECT x.swath, x.rt_window, x.comp AS r, y.comp AS s, sum(x.value * y.value) AS value FROM f{0} x JOIN f{0} y ON x.swath = y.swath AND x.rt_window = y.rt_window AND x.idx = y.idx GROUP BY ALL)"


def _factors(spark, sf_dir, cells=None):
    cells = boundary(views.cells(spark, sf_dir), "cells") if cells is None else cells
    return tuple(views.factor(spark, sf_dir, axis, cells) for axis in "ijk")


def _tensor_and_factors(spark, sf_dir):
    cells = boundary(views.cells(spark, sf_dir), "cells")
    return cells, *_factors(spark, sf_dir, cells)


_SLICE = tuple(slices.SLICE)


@query(with_(*FACTORS_SQL) + "SELECT cells.swath, cells.rt_window, i, fb.comp, round(sum(v * fb.value * fc.value), 4) AS value FROM cells JOIN fb ON fb.swath = cells.swath AND fb.rt_window = cells.rt_window AND fb.idx = j JOIN fc ON fc.swath = cells.swath AND fc.rt_window = cells.rt_window AND fc.idx = k AND fc.comp = fb.comp GROUP BY ALL")
def q24_mttkrp(spark, sf_dir):
    cells, _, b, c = _tensor_and_factors(spark, sf_dir)
    return tensors.mttkrp(cells, b, c, "i", "j", "k", _SLICE).withColumn("value", F.round("value", 4))


@query(with_(*FACTORS_SQL, _GRAM_SQL.format("b"), _GRAM_SQL.format("c")) + "SELECT swath, rt_window, r, s, round(gb.value * gc.value, 7) AS value FROM gb JOIN gc USING (swath, rt_window, r, s)")
def q25_gram_hadamard(spark, sf_dir):
    _, b, c = _factors(spark, sf_dir)
    return tensors.hadamard(tensors.gram(b, _SLICE), tensors.gram(c, _SLICE), _SLICE).withColumn("value", F.round("value", 7))


@query(with_(*FACTORS_SQL, FIT_SQL) + "SELECT swath, rt_window, i, j, k, round(fit, 8) AS fit, round(1 - sum((v - fit) * (v - fit)) OVER (PARTITION BY swath, rt_window) / sum(v * v) OVER (PARTITION BY swath, rt_window), 7) AS rsq FROM fit")
def q26_kruskal_reconstruct(spark, sf_dir):
    """The fit of every observed cell, and R2 over the observed cells; q88 has R2 of whole tensors."""
    blocks = boundary(tensors.in_blocks(views.cells(spark, sf_dir, by_slice=True), _SLICE), "blocks")
    factors = [views.factor_vectors(spark, sf_dir, axis, tensors.places(blocks, axis, _SLICE)) for axis in "ijk"]
    fitted = boundary(tensors.fitted_blocks(blocks, *factors, _SLICE), "fitted")
    rsq = tensors.r_squared(tensors.out_of_blocks(fitted, _SLICE), _SLICE)
    return tensors.out_of_blocks(fitted.join(rsq, list(_SLICE)), (*_SLICE, "rsq")).select(*_SLICE, "i", "j", "k", F.round("fit", 8).alias("fit"), F.round("rsq", 7).alias("rsq"))


_GRID = "gr AS (SELECT i.swath, i.rt_window, i.idx AS i, j.idx AS j, k.idx AS k FROM (SELECT DISTINCT swath, rt_window, idx FROM fa) i JOIN (SELECT DISTINCT swath, rt_window, idx FROM fb) j USING (swath, rt_window) JOIN (SELECT DISTINCT swath, rt_window, idx FROM fc) k USING (swath, rt_window)), full_cells AS (SELECT gr.*, coalesce(v, 0) AS v FROM gr LEFT JOIN cells USING (swath, rt_window, i, j, k))"


@query(with_(*FACTORS_SQL, _GRID, FIT_SQL.replace("cells", "full_cells")) + "SELECT swath, rt_window, round(1 - sum((v - fit) * (v - fit)) / sum(v * v), 7) AS rsq FROM fit GROUP BY ALL")
def q88_whole_tensor_rsq(spark, sf_dir):
    """R2 over all cells of a slice's axes, those that are not there as 0; the SQL builds the grid, the operator doesn't."""
    return tensors.whole_r_squared(*_tensor_and_factors(spark, sf_dir), _SLICE).withColumn("rsq", F.round("rsq", 7))


def rounds_sql(n: int) -> tuple[list[str], list[str]]:
    """(CTEs, names of the last factors) of n rounds of updates from fa, fb and fc."""
    own, parts = ["fa", "fb", "fc"], []
    near = lambda x, y: f"{x}.swath = {y}.swath AND {x}.rt_window = {y}.rt_window"
    for n_round in range(n):
        for m in range(3):
            p, q = (x for x in range(3) if x != m)
            f, x, y, t = own[m], own[p], own[q], f"{n_round}{m}"
            parts.append(f"p{t} AS MATERIALIZED (SELECT c.swath, c.rt_window, c.{'ijk'[m]} AS idx, x.comp, sum(v * x.value * y.value) AS product FROM cells c JOIN {x} x ON {near('c', 'x')} AND x.idx = c.{'ijk'[p]} JOIN {y} y ON {near('c', 'y')} AND y.idx = c.{'ijk'[q]} AND y.comp = x.comp GROUP BY ALL)")
            gram = lambda z: f"(SELECT a.swath, a.rt_window, a.comp AS r, b.comp AS s, sum(a.value * b.value) AS value FROM {z} a JOIN {z} b ON {near('a', 'b')} AND a.idx = b.idx GROUP BY ALL)"
            parts.append(f"g{t} AS MATERIALIZED (SELECT gx.swath, gx.rt_window, gx.r, gx.s, gx.value * gy.value AS value FROM {gram(x)} gx JOIN {gram(y)} gy USING (swath, rt_window, r, s))")
            parts.append(f"b{t} AS MATERIALIZED (SELECT o.swath, o.rt_window, o.idx, g.r AS comp, sum(o.value * g.value) AS below FROM {f} o JOIN g{t} g ON {near('o', 'g')} AND g.s = o.comp GROUP BY ALL)")
            parts.append(f"f{t} AS MATERIALIZED (SELECT o.swath, o.rt_window, o.idx, o.comp, o.value * greatest(coalesce(product, 0), {tensors.FLOOR!r}::DOUBLE) / greatest(below, {tensors.FLOOR!r}::DOUBLE) AS value FROM {f} o LEFT JOIN p{t} USING (swath, rt_window, idx, comp) JOIN b{t} USING (swath, rt_window, idx, comp))")
            own[m] = f"f{t}"
    return parts, own


_ROUNDS, _LAST = rounds_sql(3)


@query(with_(*FACTORS_SQL, *_ROUNDS) + " UNION ALL ".join(f"SELECT swath, rt_window, {m} AS mode, idx, comp, round(value, 5) AS value FROM {f}" for m, f in enumerate(_LAST)))
def q89_decompose_rounds(spark, sf_dir):
    """Three rounds in blocks, from given factors."""
    cells, *factors = _tensor_and_factors(spark, sf_dir)
    start = boundary(scalars.aligned([f.withColumn("mode", F.lit(m)) for m, f in enumerate(factors)]), "start")
    out = block_cp.decompose_large(cells, RANK, max_iter=3, tol=0.0, start=start)
    return out.select("swath", "rt_window", "mode", "idx", "comp", F.round("value", 5).alias("value"))


@query(with_(views.CELLS_SQL) + "SELECT swath, rt_window, i, round(sqrt(sum(v * v)), 6) AS norm FROM cells GROUP BY ALL")
def q51_frobenius(spark, sf_dir):
    return tensors.frobenius(views.cells(spark, sf_dir), (*_SLICE, "i")).withColumn("norm", F.round("norm", 6))


# --- scalar functions


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-5 OR abs(l_discount - 0.07) <= 1e-5")
def q28_tolerance_semi(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where(scalars.is_close_to_any(F.col("l_discount"), [0.05, 0.07])).select("l_orderkey", "l_linenumber")


@query("WITH p AS (SELECT DISTINCT p_retailprice AS b FROM part), m AS (SELECT c_custkey, b, row_number() OVER (PARTITION BY c_custkey ORDER BY b) AS nth FROM customer JOIN p ON abs(abs(c_acctbal) - b) <= 0.5 + 1e-5 * abs(b)) SELECT c_custkey, b FROM m WHERE nth = 1")
def q29_isclose_join(spark, sf_dir):
    left = read(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("a"))
    right = read(spark, sf_dir, "part").select(F.col("p_retailprice").alias("b")).distinct()
    return windows.tolerance_join(left, right, "a", "b", atol=0.5, width=10.0).select("c_custkey", "b")


@query("SELECT o_orderkey AS idx FROM orders ORDER BY abs(o_totalprice - 100000), o_orderkey LIMIT 1")
def q30_nearest(spark, sf_dir):
    return scalars.nearest_index(read(spark, sf_dir, "orders").withColumn("idx", F.col("o_orderkey")), "o_totalprice", "idx", 100000.0)


@query(with_(SCAN_SQL) + "SELECT file, level, round_even(mz, 0) AS mz, sum(intensity) AS intensity FROM scan GROUP BY ALL")
def q31_round_sum(spark, sf_dir):
    rows = scan_map(spark, sf_dir).withColumn("level", F.col("level").cast("int"))
    return scalars.rounded_sum(rows, ["file", "level"], decimals=0)


@query(with_(SCAN_SQL) + "SELECT file, level, round_even(rt / 86400, 0) AS rt, round(avg(intensity), 6) AS intensity FROM scan GROUP BY ALL")
def q32_round_avg(spark, sf_dir):
    rows = scan_map(spark, sf_dir).withColumn("level", F.col("level").cast("int")).withColumn("rt", F.col("rt") / 86400)
    return scalars.rounded_mean(rows, ["file", "level"], decimals=0).withColumn("intensity", F.round("intensity", 6))


@query(with_(SCAN_SQL, "t AS (SELECT file, count(DISTINCT rt) AS time_points FROM scan GROUP BY file)") + "SELECT file, time_points, file = (SELECT file FROM t ORDER BY time_points DESC, file LIMIT 1) AS most FROM t")
def q33_distinct_points(spark, sf_dir):
    scan = scan_map(spark, sf_dir)
    top = scalars.file_with_most_time_points(scan).select("file", F.lit(True).alias("most"))
    return scalars.time_points(scan).join(top, "file", "left").withColumn("most", F.coalesce("most", F.lit(False)))


@query(with_(SCAN_SQL, "l AS (SELECT spectrum_index, mz, level, printf('%.4f_ms%d', mz, level) AS label FROM scan)") + "SELECT spectrum_index, label, CAST(split_part(label, '_ms', 1) AS DOUBLE) AS mz, CAST(split_part(label, '_ms', 2) AS INTEGER) AS level FROM l")
def q34_label_codec(spark, sf_dir):
    rows = scan_map(spark, sf_dir).select("spectrum_index", scalars.mz_label(F.col("mz"), F.col("level")).alias("label"))
    return rows.select("spectrum_index", "label", scalars.label_mz(F.col("label")).alias("mz"), scalars.label_level(F.col("label")).alias("level"))


@query(r"SELECT doc_id, md5(replace(replace(text, ',', ''), 'mod', '')) AS cleaned, md5(regexp_replace(concat('PEP(', source, ')TI(', lang, ')DE', doc_id), '\(.+\)', '')) AS plain FROM documents")
def q35_seq_cleanup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    cleaned = scalars.without_mod(scalars.without_commas(F.col("text")))
    marked = F.concat(F.lit("PEP("), F.coalesce("source", F.lit("")), F.lit(")TI("), F.coalesce("lang", F.lit("")), F.lit(")DE"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.md5(cleaned.cast("binary")).alias("cleaned"), F.md5(scalars.without_ptm(marked).cast("binary")).alias("plain"))


@query("SELECT CAST(ceil(0.05 * median(length(text)) * (SELECT count(*) FROM pages)) AS INTEGER) AS evalue FROM documents")
def q36_evalue_threshold(spark, sf_dir):
    n = read(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("n"))
    return peptides.evalue_threshold(read(spark, sf_dir, "documents"), "text", n)


@query(r"""WITH s AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS q FROM part),
c AS (SELECT p_partkey, q, i, i = 1 OR (substr(q, i - 1, 1) IN ('K', 'R') AND substr(q, i, 1) <> 'P') AS cut, substr(q, i, 1) AS r FROM s, unnest(range(1, length(q) + 1)) AS u(i)),
g AS (SELECT p_partkey, i, r, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS f FROM c),
h AS (SELECT p_partkey, f, string_agg(r, '' ORDER BY i) AS x FROM g GROUP BY ALL),
k AS (SELECT p_partkey, f, concat(CASE WHEN length(x) > 5 THEN left(x, length(x) - 5) ELSE '' END, CASE WHEN length(x) >= 3 THEN right(x, 3) ELSE x END, substr(x, greatest(length(x) - 4, 1), greatest(least(length(x) - 3, 2), 0))) AS y FROM h)
SELECT s.p_partkey, coalesce(string_agg(y, '' ORDER BY f), '') AS decoy FROM s LEFT JOIN k USING (p_partkey) GROUP BY s.p_partkey""")
def q37_digest_rotate(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z]", "").alias("q"))
    return peptides.mutate_sequences(parts, "q", "rotate").select("p_partkey", F.col("q").alias("decoy"))


_DECOYS = f"""s AS (SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z]', '', 'g') AS raw, upper(raw) AS q FROM part),
c AS (SELECT p_partkey, raw, i, i = 1 OR (substr(q, i - 1, 1) IN ('K', 'R') AND substr(q, i, 1) <> 'P') AS cut, substr(q, i, 1) AS r FROM s, unnest(range(1, length(q) + 1)) AS u(i)),
g AS (SELECT p_partkey, raw, i, r, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS f FROM c),
h0 AS (SELECT p_partkey, f, string_agg(r, '' ORDER BY i) AS x, any_value(raw) AS raw FROM g GROUP BY p_partkey, f), h AS (SELECT p_partkey, f, x, length(x) AS n, concat(md5(raw), ':42:', CAST(f - 1 AS BIGINT)) AS k FROM h0),
pl AS (SELECT 'random' AS mode, p_partkey, f, k, p FROM (SELECT *, unnest(range(n - 1)) AS p FROM h) QUALIFY row_number() OVER (PARTITION BY p_partkey, f ORDER BY md5(concat(k, ':pick:', p)), p) <= floor((n - 1) * 0.5)
  UNION ALL SELECT 'random_center', p_partkey, f, k, unnest(range(greatest(n // 2 - 3, 0), least(n // 2 + 3, n))) FROM h UNION ALL SELECT 'random_end', p_partkey, f, k, unnest(range(greatest(n - 5, 0), n)) FROM h),
od AS (SELECT mode, p_partkey, f, p, a, row_number() OVER (PARTITION BY mode, p_partkey, f, a ORDER BY p) AS i, row_number() OVER (PARTITION BY mode, p_partkey, f, a ORDER BY md5(concat(k, ':order:', a, ':', p)), p) AS j, count(*) OVER (PARTITION BY mode, p_partkey, f, a) AS n FROM pl, unnest(range({peptides.DRAWS})) AS t(a)),
av AS (SELECT mode, p_partkey, f, a, bool_or(i <> j OR mode <> 'random') AS good FROM od GROUP BY mode, p_partkey, f, a),
ch AS (SELECT mode, p_partkey, f, min(a) FILTER (good) AS a FROM av GROUP BY ALL),
mv AS (SELECT od.mode, od.p_partkey, od.f, p, i, CASE WHEN ch.a IS NOT NULL THEN j WHEN n = 1 THEN 1 WHEN i = 1 THEN n ELSE i - 1 END AS j FROM od JOIN ch USING (mode, p_partkey, f) WHERE od.a = coalesce(ch.a, 0)),
so AS (SELECT t.mode, t.p_partkey, t.f, t.p AS place, f0.p AS source FROM mv t JOIN mv f0 ON f0.mode = t.mode AND f0.p_partkey = t.p_partkey AND f0.f = t.f AND f0.i = t.j),
al AS (SELECT mode, p_partkey, f, x, unnest(range(n)) AS place FROM h, unnest(['random', 'random_center', 'random_end']) AS m(mode)),
dk AS (SELECT mode, p_partkey, string_agg(substr(x, CAST(coalesce(source, place) + 1 AS INTEGER), 1), '' ORDER BY f, place) AS decoy FROM al LEFT JOIN so USING (mode, p_partkey, f, place) GROUP BY ALL)"""


@query(with_(_DECOYS) + "SELECT mode, s.p_partkey, coalesce(decoy, '') AS decoy FROM s CROSS JOIN unnest(['random', 'random_center', 'random_end']) AS m(mode) LEFT JOIN dk USING (mode, p_partkey)")
def q91_random_decoys(spark, sf_dir):
    """Names of parts as sequences, in the three random modes."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", "[^A-Za-z]", "").alias("q"))
    return scalars.aligned([peptides.mutate_sequences(parts, "q", m).select(F.lit(m).alias("mode"), "p_partkey", F.col("q").alias("decoy")) for m in ("random", "random_center", "random_end")])


_MASS = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in peptides.RESIDUES.items())


@query(f"""WITH s AS (SELECT p_partkey, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS q FROM part), m(r, w) AS (VALUES {_MASS}),
c AS (SELECT p_partkey, length(q) AS n, i, coalesce(w, 0) AS w FROM (SELECT p_partkey, q, unnest(range(1, length(q) + 1)) AS i FROM s WHERE length(q) >= 3) LEFT JOIN m ON m.r = substr(q, CAST(i AS INTEGER), 1)),
l AS (SELECT DISTINCT p_partkey, n, unnest(range(1, n - 1)) AS length FROM c), io(ion, extra) AS (VALUES ('b', 0::DOUBLE), ('y', {peptides.WATER!r}::DOUBLE))
SELECT l.p_partkey, ion, CAST(l.length AS INTEGER) AS length, round(sum(w) + any_value(extra) + {peptides.PROTON!r}, 5) AS mz FROM l JOIN io ON true JOIN c ON c.p_partkey = l.p_partkey AND CASE WHEN ion = 'b' THEN i <= l.length ELSE i > l.n - l.length END GROUP BY ALL""")
def q38_fragments(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("q"))
    return peptides.fragments(parts, "q").select("p_partkey", "ion", "length", F.round("mz", 5).alias("mz"))


@query("SELECT o_orderkey, CAST(c AS INTEGER) AS charge, CAST(o_orderkey AS VARCHAR) AS scans, CAST(o_orderkey AS VARCHAR) AS title, 10 + row_number() OVER (PARTITION BY c ORDER BY o_orderkey) - 1 AS rtinseconds, 'PEPTIDE' AS seq FROM orders, unnest([2, 3]) AS u(c)")
def q39_charge_union(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("controllerType=0 scan="), F.col("o_orderkey").cast("string"), F.lit("_f2")).alias("title"))
    return spectra.charge_variants(spectra.sequencer_headers(orders, ["o_orderkey"])).select("o_orderkey", "charge", "scans", "title", "rtinseconds", "seq")


@query("SELECT s_nationkey AS nationkey, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q40_union_by_name(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"))
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return scalars.aligned([s, c])


@query(with_(SCAN_SQL) + "SELECT file, rt, intensity FROM scan WHERE level = 2 AND abs(mz - 120) <= 5 AND rt BETWEEN 0 AND 1e6")
def q41_xic(spark, sf_dir):
    return scalars.chromatograms(scan_map(spark, sf_dir), 120.0, 2, (0.0, 1e6), rtol=0.0, atol=5.0).select("file", "rt", "intensity")


@query("SELECT CAST(o_custkey % 100 AS INTEGER) AS swath, CAST(o_custkey // 100 AS INTEGER) AS rt_window, CAST(o_orderkey AS INTEGER) AS ncomp, coalesce(l_discount, 0.5) AS rsq FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 5")
def q42_rsq_default(spark, sf_dir):
    m = _models(spark, sf_dir).withColumn("ncomp", F.col("model_id").cast("int"))
    five = read(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("model_id"), F.col("l_discount").alias("rsq"))
    measured = m.join(five, "model_id").select("swath", "rt_window", "ncomp", "rsq")
    return models.rsq_or_default(m, measured).select("swath", "rt_window", "ncomp", "rsq")


def scan_fit_sql(own: str) -> str:
    """Scaled cells of one sample: ``own`` selects its row (swath, rt_window, i0) in each slice. Components 0 to 2 are the unimodal ones."""
    return f"""own AS ({own}), fs AS (SELECT fa.swath, fa.rt_window, fb.idx AS j, fc.idx AS k, sum(fa.value * fb.value * fc.value) AS fit FROM fa JOIN own ON own.swath = fa.swath AND own.rt_window = fa.rt_window AND own.i0 = fa.idx
  JOIN fb ON fb.swath = fa.swath AND fb.rt_window = fa.rt_window AND fb.comp = fa.comp JOIN fc ON fc.swath = fa.swath AND fc.rt_window = fa.rt_window AND fc.comp = fa.comp WHERE fa.comp < 3 GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY swath, rt_window ORDER BY fit DESC, j, k) AS nth FROM fs),
sc AS (SELECT pk.swath, pk.rt_window, v * 0.5 / fit AS scale FROM pk JOIN own ON own.swath = pk.swath AND own.rt_window = pk.rt_window JOIN cells c ON c.swath = pk.swath AND c.rt_window = pk.rt_window AND c.i = own.i0 AND c.j = pk.j AND c.k = pk.k WHERE nth = 1)"""


@query(with_(*FACTORS_SQL, scan_fit_sql("SELECT DISTINCT swath, rt_window, 0 AS i0 FROM cells")) + "SELECT fs.swath, fs.rt_window, j, k, round(fit * scale, 5) AS intensity FROM fs JOIN sc USING (swath, rt_window)")
def q43_scan_reconstruct(spark, sf_dir):
    cells, *factors = _tensor_and_factors(spark, sf_dir)
    factors = boundary(scalars.aligned([f.withColumn("ncomp", F.lit(RANK)).withColumn("mode", F.lit(m)) for m, f in enumerate(factors)]), "factors")
    model = factors.select(*_SLICE, "ncomp").distinct()
    chosen = factors.where("mode = 0 AND comp < 3").select(*_SLICE, "ncomp", "comp").distinct()
    out = models.reconstruct_scan(factors, cells, chosen, model.withColumn("rsq", F.lit(0.5)), 0)
    return out.select(*_SLICE, "j", "k", F.round("intensity", 5).alias("intensity"))


@query("SELECT min(TRY_CAST(p_size AS DOUBLE)) AS cutoff FROM part")
def q44_min_cutoff(spark, sf_dir):
    return peptides.min_probability(read(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("string")), "size")


@query(r"""SELECT item_id, md5(concat('>', item_id, chr(10), text)) AS record FROM benchmark""")
def q45_fasta_lines(spark, sf_dir):
    from stratascan.sources.scans import fasta_text

    records = fasta_text(read(spark, sf_dir, "benchmark"), "item_id", "text")
    return records.select(F.regexp_extract("value", r"^>(\d+)", 1).cast("long").alias("item_id"), F.md5(F.col("value").cast("binary")).alias("record"))


def _dense(spark, sf_dir):
    coo = boundary(tensor(spark, sf_dir), "coo")
    return boundary(slices.impute_sparse(slices.worth_decomposing(coo)), "cells")


@query()
def q46_parafac(spark, sf_dir):
    """R2 and rounds of the models of every slice; the factors are random up to scale, so they are not compared."""
    c = Config()
    factors = tensors.decompose(_dense(spark, sf_dir), c.parafac_min_comp, c.parafac_max_comp, c.parafac_max_iter, c.parafac_tolerance, c.parafac_init, c.parafac_seed)
    return tensors.measures(factors).withColumn("rsq", F.round("rsq", 6))


@query()
def q47_peak_count(spark, sf_dir):
    """Peaks of every vector read as a profile over time."""
    e = read(spark, sf_dir, "embeddings")
    line = e.select("vec_id", F.lit(0).alias("comp"), F.posexplode("embedding").alias("idx", "x")).select("vec_id", "comp", "idx", F.abs("x").cast("double").alias("value"))
    return models.peak_counts(line, 4.0, 64.0, ["vec_id"])


@query("SELECT p_partkey AS part, 0 AS comp, CAST(p_size % 5 AS INTEGER) AS npeaks FROM part")
def q93_isolated_peaks(spark, sf_dir):
    """Profiles of as many triangles of different heights as a part's size says, apart from each other."""
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("idx"))
    value = sum(F.when(F.col("n") > k, F.greatest(F.lit(0), 5 - F.abs(F.col("idx") - 10 - 16 * k)) * (1 + k % 3)).otherwise(0) for k in range(4))
    lines = rows.select(F.col("p_partkey").alias("part"), F.lit(0).alias("comp"), "idx", value.cast("double").alias("value"))
    return models.peak_counts(lines, 4.0, 80.0, ["part"])


@query()
def q48_peaks_base64(spark, sf_dir):
    """Every order's spectrum as encoded peaks."""
    lists = spectra.peak_lists(order_spectra(spark, sf_dir), ["scan"])
    return lists.select("scan", encoding.peaks_to_base64(F.transform("peaks", lambda p: p["mz"]), F.transform("peaks", lambda p: p["intensity"])).alias("encoded"))


@query("SELECT page_id, CAST(round_even((page_id % 700 + 0.25::DOUBLE) * 100, 0) AS INTEGER) AS swath, CAST(page_id % 13 AS INTEGER) AS rt_window FROM pages")
def q49_path_keys(spark, sf_dir):
    path = models.model_path(F.col("url"), ((F.col("page_id") % 700 + 0.25) * 100), F.col("page_id") % 13, F.lit(4))
    swath, window = scalars.path_keys(F.regexp_extract(path, r"(/swath_lower_adjusted=.*)$", 1))
    return read(spark, sf_dir, "pages").select("page_id", swath.alias("swath"), window.alias("rt_window"))


@query(r"""SELECT url AS file, page_id, regexp_extract(concat(url, '_Q', 1 + page_id % 3, '_x.tsv'), '_Q[0-9]*([0-9])', 1) AS quality FROM pages UNION ALL SELECT source, doc_id, regexp_extract(concat(source, '_Q', 1 + doc_id % 3, '_x.tsv'), '_Q[0-9]*([0-9])', 1) FROM documents""")
def q50_psm_collate(spark, sf_dir):
    def rows(name, file, key):
        path = F.concat(F.coalesce(file, F.lit("")), F.lit("_Q"), (1 + F.col(key) % 3).cast("string"), F.lit("_x.tsv"))
        return read(spark, sf_dir, name).select(F.col(file).alias("file"), F.col(key).alias("page_id"), scalars.quality_digit(path).alias("quality"))

    return scalars.aligned([rows("pages", "url", "page_id"), rows("documents", "source", "doc_id")])


@query(with_(SCAN_SQL, ADJ, SLICES, CYCLES) + ", sp AS (SELECT DISTINCT swath, rt_window, file, spectrum_index FROM sl), kc AS (SELECT DISTINCT swath, rt_window, file, spectrum_index FROM cyc) SELECT sp.swath, sp.rt_window, sp.file, count(*) AS spectra, count(*) - count(kc.spectrum_index) AS dropped FROM sp LEFT JOIN kc USING (swath, rt_window, file, spectrum_index) GROUP BY ALL")
def q52_dropped_spectra(spark, sf_dir):
    return slices.dropped_spectra(sliced(spark, sf_dir), LAST_CYCLE_SEC)


@query(with_(SPEC_SQL, "h AS (SELECT level, intensity, min(intensity) OVER (PARTITION BY level) AS lo, max(intensity) OVER (PARTITION BY level) AS hi FROM pk)") + "SELECT level, CAST(CASE WHEN hi > lo THEN least(floor((intensity - lo) / (hi - lo) * 100), 99) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM h GROUP BY ALL")
def q53_histogram(spark, sf_dir):
    return spectra.histogram(order_spectra(spark, sf_dir), ["level"])


@query(with_(SCAN_SQL, ADJ) + "SELECT spectrum_index, lower AS swath_lower_adjusted, upper AS swath_upper_adjusted FROM scan LEFT JOIN adj ON adj.w_start = scan.w_start AND scan.w_start < 500")
def q54_left_join_adjusted(spark, sf_dir):
    scan = scan_map(spark, sf_dir)
    adjusted = windows.adjust_windows(windows.distinct_windows(scan)).where("start < 500")
    return windows.with_adjusted(scan, adjusted).select("spectrum_index", "swath_lower_adjusted", "swath_upper_adjusted")


@query("SELECT c_custkey, printf('%.2f', c_acctbal) AS key, round(c_acctbal * 40 / 1e6, 10) AS tolerance, round(c_acctbal * 2 + 1, 4) AS unscaled FROM customer")
def q55_keys_and_tolerances(spark, sf_dir):
    x = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", scalars.text_key(x).alias("key"), F.round(scalars.ppm_tolerance(x), 10).alias("tolerance"), F.round(scalars.undo_min_max(x, F.lit(1.0), F.lit(3.0)), 4).alias("unscaled"))
