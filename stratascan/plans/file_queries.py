"""Queries over files: the driver's tables are written by a sink, read back by the source, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from stratascan import schemas
from stratascan.functions import encoding, scalars
from stratascan.operators import models, slices, spectra, tensors, windows
from stratascan.plans import views
from stratascan.plans.boundary import boundary, shared_path
from stratascan.plans.queries import (
    ADJ, COUNTS_SQL, CYCLES, INDEX_SQL, FACTORS_SQL, SLICES, SPEC_SQL, TO_COO, _counts, _factors, _index, _tensor_and_factors, order_spectra, query, read, scan_fit_sql, sliced, tensor, with_,
)
from stratascan.plans.views import LAST_CYCLE_SEC, RANK, SCAN_SQL, WINDOW_SEC, scan_map
from stratascan.sources import scans, tables
from stratascan.streaming import cycles

_OLD, _NEW = "swath_lower_adjusted", "swath_upper_adjusted"


def int_level(df):
    return df.withColumn("level", F.col("level").cast("int"))


# --- scan maps, windows, slices


@query(with_(SCAN_SQL) + "SELECT file, spectrum_index, level, round(rt, 5) AS rt, round(mz, 8) AS mz, intensity, round(prec_mz, 8) AS prec_mz, w_start, w_end FROM scan")
def q57_scan_map_csv(spark, sf_dir):
    path = shared_path(spark, "maps")
    tables.write_scan_map(scan_map(spark, sf_dir), path)
    out = int_level(tables.scan_map_csv(spark, path)).withColumn("rt", F.round("rt", 5))
    out = out.withColumn("mz", F.round("mz", 8)).withColumn("prec_mz", F.round("prec_mz", 8))
    return out.withColumnRenamed("prec_isolation_window_start", "w_start").withColumnRenamed("prec_isolation_window_end", "w_end")


@query(with_(SCAN_SQL, ADJ) + "SELECT 'isolation' AS kind, w_start AS start, w_end AS \"end\" FROM d UNION ALL SELECT k, lower, upper FROM adj, unnest(['map', 'intervals']) AS u(k)")
def q58_window_files(spark, sf_dir):
    """Isolation windows without a header, adjusted intervals with one, and those of the adjusted map."""
    scan = scan_map(spark, sf_dir)
    isolation, maps, intervals = (shared_path(spark, n) for n in ("isolation", "adjusted-map", "intervals"))
    tables.write_windows(windows.distinct_windows(scan), isolation)
    tables.write_adjusted(windows.with_adjusted(scan, windows.adjust_windows(windows.distinct_windows(scan))), maps, intervals)
    listed = windows.swath_list(spark.read.parquet(maps)).select(F.lit("map").alias("kind"), F.col(_OLD).alias("start"), F.col(_NEW).alias("end"))
    own = tables.windows_csv(spark, isolation).select(F.lit("isolation").alias("kind"), "start", "end")
    return own.unionByName(listed).unionByName(tables.windows_csv(spark, intervals).select(F.lit("intervals").alias("kind"), "start", "end"))


@query(with_(SCAN_SQL, ADJ, SLICES) + "SELECT swath, rt_window, file, CAST(dense_rank() OVER (PARTITION BY swath, rt_window ORDER BY file) - 1 AS INTEGER) AS sample_no, count(*) AS points, sum(intensity) AS intensity FROM sl GROUP BY swath, rt_window, file")
def q59_slice_files(spark, sf_dir):
    path = shared_path(spark, "slices")
    tables.write_slices(sliced(spark, sf_dir), path)
    rows = slices.sample_numbers(tables.read_slices(spark, path))
    return rows.groupBy("swath", "rt_window", "file", "sample_no").agg(F.count(F.lit(1)).alias("points"), F.sum("intensity").alias("intensity"))


@query(with_(SCAN_SQL, ADJ, SLICES) + "SELECT swath, rt_window, count(*) AS points, 1 AS first FROM sl GROUP BY ALL")
def q60_slice_results(spark, sf_dir):
    """A table of results per slice under its key folders, listed by ending and read with the keys of the paths."""
    path = shared_path(spark, "results")
    rows = sliced(spark, sf_dir).groupBy("swath", "rt_window").agg(F.count(F.lit(1)).alias("points"))
    keyed = rows.select("points", scalars.text_key(F.col("swath") / 100).alias(_OLD), F.format_string("%.1f", F.col("rt_window").cast("double")).alias("rt_window"))
    keyed.write.partitionBy(_OLD, "rt_window").option("header", True).csv(path)
    files = tables.files_with_extension(spark, path, "part.csv")
    swath, window = scalars.path_keys(F.col("path"))
    by_slice = files.groupBy(swath.alias("swath"), window.alias("rt_window")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("files"))
    one = tables.first_file(files).withColumn("first", F.lit(1))
    total = tables.slice_results(spark, path, "points long").groupBy("swath", "rt_window").agg(F.sum("points").alias("points"))
    return total.join(by_slice, ["swath", "rt_window"]).join(one.select("first")).select("swath", "rt_window", "points", "first")


@query(with_(SCAN_SQL, ADJ, SLICES, "lk AS (SELECT DISTINCT file, swath FROM sl WHERE intensity > 90)") + "SELECT sl.file, spectrum_index, sl.swath FROM sl JOIN lk ON lk.file = sl.file AND lk.swath = (SELECT min(swath) FROM lk)")
def q61_swath_lookup(spark, sf_dir):
    """Points of the files that a lookup table names for the lowest swath."""
    cut = boundary(sliced(spark, sf_dir), "slices")
    lookup = cut.where("intensity > 90").select("file", "swath").distinct()
    lowest = lookup.agg(F.min("swath").alias("s")).first()["s"]
    return tables.swaths_by_lookup(spark, cut, lookup, lowest).select("file", "spectrum_index", "swath")


@query(with_(SCAN_SQL, ADJ, SLICES, CYCLES) + "SELECT swath, rt_window, file, cycle, count(*) AS points, sum(intensity) AS intensity FROM cyc GROUP BY ALL")
def q90_stream_cycles(spark, sf_dir):
    """The points arrive by time in three runs of a stream, each of which takes up the open cycles of the one before."""
    source, out, checkpoint = (shared_path(spark, n) for n in ("stream-in", "stream-out", "stream-checkpoint"))
    cut = boundary(sliced(spark, sf_dir).select("swath", "rt_window", "file", "level", "rt", "intensity"), "slices")
    top = cut.agg(F.max("rt").alias("rt")).first()["rt"] or 0.0
    for n in range(3):
        own = cut.where((F.col("rt") >= top * n / 3) & ((F.col("rt") < top * (n + 1) / 3) | F.lit(n == 2)))
        if n == 2:  # behind all windows: closes the last cycles
            marker = spark.range(1).select(*[F.lit(None).cast(t).alias(c) if c != "rt" else F.lit(10 * top + 10 * WINDOW_SEC).alias("rt") for c, t in cut.dtypes])
            own = own.unionByName(marker)
        own.write.mode("append").parquet(source)
        cycles.stream_cycles(spark.readStream.schema(cut.schema).parquet(source), out, checkpoint, WINDOW_SEC, LAST_CYCLE_SEC).awaitTermination()
    return cycles.whole_slices(spark.read.schema(cycles.OUT).parquet(out))


# --- results of other programs: parts are peptides


_PEPTIDE = "concat('PEP(', p_size, ')T(O)', upper(left(p_brand, 3)))"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS scan, regexp_replace({_PEPTIDE}, '\\(.+\\)', '') AS sequence, p_retailprice AS score FROM part")
def q62_novor_results(spark, sf_dir):
    """Comma-separated results with comments and blanks about the values."""
    path = shared_path(spark, "novor")
    peptide = F.concat(F.lit("PEP("), F.col("p_size").cast("string"), F.lit(")T(O)"), F.upper(F.substring("p_brand", 1, 3)))
    line = F.concat_ws(", ", F.lit(" 1"), "p_partkey", F.lit("1.5"), F.lit("400"), F.lit("2"), F.lit("799"), F.lit("0"), F.lit("0"), "p_retailprice", peptide, F.lit("1-2"))
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("# id, scanNum, RT\n"), line).alias("value"))
    scans.write_text(rows, path)
    return tables.sequencing_results(spark, [path], "novor")


@query("SELECT CAST(p_partkey AS VARCHAR) AS scan, upper(replace(replace(replace(p_name, ' ', ','), ',', ''), 'mod', '')) AS sequence, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS score FROM part WHERE p_size % 5 <> 0")
def q63_deepnovo_results(spark, sf_dir):
    """Tab-separated results; those without a sequence are left out, scores that are no numbers are null."""
    path = shared_path(spark, "deepnovo")
    rows = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("scan"), F.when(F.col("p_size") % 5 != 0, F.upper(F.replace("p_name", F.lit(" "), F.lit(",")))).alias("output_seq"),
        F.when(F.col("p_size") % 7 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string")).alias("output_score"),
    )
    tables.write_csv(rows, path, sep="\t")
    return tables.sequencing_results(spark, [path], "deepnovo")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS qseqid, CAST(l_partkey AS VARCHAR) AS sseqid, l_discount AS pident, CAST(l_linenumber AS INTEGER) AS length, l_tax AS evalue, l_quantity AS bitscore FROM lineitem")
def q64_blast_hits(spark, sf_dir):
    path = shared_path(spark, "blast")
    zero = F.lit(0)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount", "l_linenumber", *[zero.alias(f"z{i}") for i in range(6)], "l_tax", "l_quantity")
    rows.write.option("sep", "\t").csv(path)
    return tables.blast_hits(spark, path).select("qseqid", "sseqid", "pident", "length", "evalue", "bitscore")


@query("SELECT doc_id AS scan, source, CAST(1 + doc_id % 3 AS VARCHAR) AS quality, n_chars * 0.5::DOUBLE AS score FROM documents")
def q65_psm_tables(spark, sf_dir):
    """Identifications of three runs, whose quality is in the name of their folder."""
    base = shared_path(spark, "psm")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("scan"), "source", (F.col("n_chars") * 0.5).alias("score"))
    paths = [f"{base}/run_Q{q}_x.tsv" for q in (1, 2, 3)]
    for q, path in enumerate(paths, 1):
        tables.write_csv(docs.where(1 + F.col("scan") % 3 == q), path, sep="\t")
    return tables.psm_tables(spark, *paths, schema="scan long, source string, score double").drop("file")


@query("SELECT count(*) AS n FROM benchmark")
def q66_fasta_count(spark, sf_dir):
    path = shared_path(spark, "fasta")
    scans.write_text(scans.fasta_text(read(spark, sf_dir, "benchmark").withColumn("one_line", F.regexp_replace("text", r"\s", " ")), "item_id", "one_line"), path)
    return scans.fasta_records(spark, path)


# --- spectra: orders with a precursor

_WITH_PREC = "pp AS (SELECT scan, (max((intensity, -mz)) FILTER (level = 1)) AS b FROM pk GROUP BY scan HAVING count(*) FILTER (level = 1) > 0), ms AS (SELECT scan, count(*) AS n, sum(intensity) AS total FROM pk WHERE level = 2 GROUP BY scan)"


def _order_records(spark, sf_dir):
    points = order_spectra(spark, sf_dir)
    precursor = spectra.pseudo_precursor(points, ["scan"]).where("prec_mz IS NOT NULL")
    return spectra.peak_lists(points.where("level = 2"), ["scan"]).join(precursor, "scan")


@query(with_(SPEC_SQL, _WITH_PREC) + "SELECT CAST(scan AS VARCHAR) AS scan, round(-b[2], 4) AS pepmass, n, total FROM pp JOIN ms USING (scan)")
def q67_mgf_files(spark, sf_dir):
    path = shared_path(spark, "mgf")
    scans.write_text(scans.mgf_text(_order_records(spark, sf_dir)), path)
    total = F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["intensity"])
    return scans.read_mgf(spark, path).select(scalars.title_scan(F.col("title")).alias("scan"), F.round("pepmass", 4).alias("pepmass"), F.size("peaks").cast("long").alias("n"), total.alias("total"))


@query(with_(SPEC_SQL, _WITH_PREC) + "SELECT scan AS num, 2 AS level, round(-b[2], 4) AS prec_mz, b[1] AS prec_intensity, n, total FROM pp JOIN ms USING (scan)")
def q68_mzxml_files(spark, sf_dir):
    path = shared_path(spark, "mzxml")
    scans.write_mzxml(scans.mzxml_scans(order_spectra(spark, sf_dir)), path)
    total = F.aggregate("peaks", F.lit(0.0), lambda s, p: s + p["intensity"])
    out = scans.read_mzxml(spark, path)
    return out.select("num", "level", F.round("prec_mz", 4).alias("prec_mz"), "prec_intensity", F.size("peaks").cast("long").alias("n"), total.alias("total"))


@query(with_(SPEC_SQL) + "SELECT scan, list(intensity ORDER BY mz, intensity) AS intensities FROM pk GROUP BY scan")
def q69_peaks_in_order(spark, sf_dir):
    """Peaks by m/z, through base64 and back."""
    lists = spectra.peak_lists(order_spectra(spark, sf_dir), ["scan"])
    coded = lists.withColumn("coded", encoding.peaks_to_base64(F.transform("peaks", lambda p: p["mz"]), F.transform("peaks", lambda p: p["intensity"])))
    return coded.select("scan", F.transform(encoding.base64_to_peaks("coded"), lambda p: p["intensity"]).alias("intensities"))


_MZML_SQL = """sp AS (SELECT * FROM scan WHERE spectrum_index % 17 <> 0 AND spectrum_index % 19 <> 0 AND NOT (level = 2 AND intensity < 20)),
win AS (SELECT DISTINCT w_start AS s, w_end AS e FROM scan WHERE level = 2 AND spectrum_index % 17 <> 0 AND spectrum_index % 19 <> 0)"""


def _mzml(spark, sf_dir) -> str:
    """Every event as a spectrum of one peak in mzML; some lack the time or the m/z array. Times are in seconds, but for a name that says minutes."""
    rows = scan_map(spark, sf_dir)
    array = lambda accession, c: F.concat(F.lit(f'<binaryDataArray><cvParam accession="{accession}"/><binary>'), encoding.doubles_to_base64(F.array(c)), F.lit("</binary></binaryDataArray>"))
    param = lambda accession, c: F.concat(F.lit(f'<cvParam accession="{accession}" value="'), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit('"/>'))
    offsets = param(scans.LOWER_OFFSET, F.col("prec_mz") - F.col("prec_isolation_window_start")), param(scans.UPPER_OFFSET, F.col("prec_isolation_window_end") - F.col("prec_mz"))
    precursor = F.concat(
        F.lit("<precursorList><precursor><isolationWindow>"), param(scans.ISOLATION_TARGET, "prec_mz"), *offsets,
        F.lit("</isolationWindow><selectedIonList><selectedIon>"), param(scans.SELECTED_MZ, "prec_mz"), F.lit("</selectedIon></selectedIonList></precursor></precursorList>"),
    )
    time = F.concat(F.lit("<scanList><scan>"), param(scans.SCAN_TIME, "rt"), F.lit("</scan></scanList>"))
    text = F.concat(
        F.lit('<spectrum index="'), F.col("spectrum_index").cast("string"), F.lit('">'), param(scans.MS_LEVEL, "level"), F.when(F.col("spectrum_index") % 17 == 0, "").otherwise(time),
        F.when(F.col("level") == 2, precursor).otherwise(""), F.lit("<binaryDataArrayList>"), F.when(F.col("spectrum_index") % 19 == 0, "").otherwise(array(scans.MZ_ARRAY, "mz")), array(scans.INTENSITY_ARRAY, "intensity"),
        F.lit(f'</binaryDataArrayList><userParam unitAccession="{scans.MINUTE}" unitName="minute"/></spectrum>'),
    )
    path = shared_path(spark, "mzml")
    rows.select(text.alias("value"), "file").write.partitionBy("file").text(path)
    return path


@query(with_(SCAN_SQL, _MZML_SQL, "m AS (SELECT *, row_number() OVER (PARTITION BY file, spectrum_index ORDER BY s, e) AS nth FROM sp JOIN win ON prec_mz >= s AND prec_mz < e)")
    + "SELECT file, spectrum_index, level, CAST(floor(round_even(rt, 4)) AS BIGINT) AS rt, round(mz, 8) AS mz, intensity, s AS start, e AS \"end\" FROM m WHERE nth = 1")
def q70_mzml_scan_map(spark, sf_dir):
    out = int_level(scans.read_mzml(spark, _mzml(spark, sf_dir), min_intensity=20.0, bin_width=100.0))
    return out.select("file", "spectrum_index", "level", F.floor("rt").alias("rt"), F.round("mz", 8).alias("mz"), "intensity", F.col("prec_isolation_window_start").alias("start"), F.col("prec_isolation_window_end").alias("end"))


@query(with_(SCAN_SQL, _MZML_SQL) + "SELECT s AS start, e AS \"end\" FROM win")
def q71_mzml_windows(spark, sf_dir):
    return scans.mzml_windows(scans.read_mzml_spectra(spark, _mzml(spark, sf_dir)))


@query(with_(SCAN_SQL) + "SELECT file, count(*) AS processed, count(*) FILTER (spectrum_index % 17 = 0 OR spectrum_index % 19 = 0) AS problematic, 'minute' AS unit FROM scan GROUP BY file")
def q72_mzml_problems(spark, sf_dir):
    path = _mzml(spark, sf_dir)
    return scans.spectrum_problems(spark, path).join(scans.time_unit(spark, path))


@query(with_(SCAN_SQL, _MZML_SQL, "m AS (SELECT DISTINCT file, spectrum_index FROM sp JOIN win ON prec_mz >= s AND prec_mz < e)") + "SELECT count(*) AS processed, count(*) FILTER (spectrum_index % 17 = 0 OR spectrum_index % 19 = 0) AS problematic, (SELECT count(*) FROM m) AS points FROM scan")
def q92_counts_in_passing(spark, sf_dir):
    """Spectra processed and problematic, counted while the points are written, and the points."""
    counts, path = Observation(), shared_path(spark, "points")
    scans.read_mzml(spark, _mzml(spark, sf_dir), min_intensity=20.0, bin_width=100.0, counts=counts).write.parquet(path)
    seen = counts.get
    points = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("points"))
    return points.select(*[F.lit(seen[c]).cast("long").alias(c) for c in ("processed", "problematic")], "points")


# --- tables of models


_INDEX = "swath, rt_window, ncomp, model_id, spectrum_num, scan"


@query(with_(INDEX_SQL) + f"SELECT kind, {_INDEX} FROM sx, unnest(['parquet', 'csv', 'tsv']) AS u(kind)")
def q73_index_files(spark, sf_dir):
    rows = boundary(models.spectrum_index(_index(spark, sf_dir), 2, 4), "spectrum-index")
    base = shared_path(spark, "index")
    tables.write_index(rows, f"{base}/index.parquet")
    tables.write_csv(rows, f"{base}/index.csv")
    tables.write_csv(rows, f"{base}/index.tsv", sep="\t")
    parts = [tables.read_index(spark, f"{base}/index.{k}", schemas.SPECTRUM_INDEX).select(F.lit(k).alias("kind"), *_INDEX.split(", ")) for k in ("parquet", "csv", "tsv")]
    return scalars.aligned(parts)


@query("SELECT CAST(l_suppkey AS INTEGER) AS swath, CAST(l_linenumber AS INTEGER) AS rt_window, CAST(l_quantity AS INTEGER) AS ncomp, l_discount AS rsq, CAST(l_orderkey AS INTEGER) AS iterations FROM lineitem")
def q74_measures_log(spark, sf_dir):
    """A log that two runs append to."""
    path = shared_path(spark, "measures")
    rows = read(spark, sf_dir, "lineitem").select(*[F.col(c).cast("int").alias(n) for c, n in (("l_suppkey", "swath"), ("l_linenumber", "rt_window"), ("l_quantity", "ncomp"))], F.col("l_discount").alias("rsq"), F.col("l_orderkey").cast("int").alias("iterations"))
    tables.append_measures(rows.where("swath % 2 = 0"), path)
    tables.append_measures(rows.where("swath % 2 = 1"), path)
    return spark.read.schema(schemas.MEASURES).parquet(path)


@query("SELECT k AS kind, c_custkey, c_name, c_acctbal, c_mktsegment FROM customer, unnest(['gzip', 'tsv']) AS u(k)")
def q75_csv_variants(spark, sf_dir):
    base, kept = shared_path(spark, "csv"), ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    rows = read(spark, sf_dir, "customer").select(*kept)
    tables.write_csv(rows, f"{base}/gzip.csv", compression="gzip")
    tables.write_csv(rows, f"{base}/plain.tsv", sep="\t")
    schema = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
    return tables.read_index(spark, f"{base}/gzip.csv", schema).select(F.lit("gzip").alias("kind"), *kept).unionByName(tables.read_index(spark, f"{base}/plain.tsv", schema).select(F.lit("tsv").alias("kind"), *kept))


@query(with_(*TO_COO, "tr AS (SELECT swath, rt_window FROM coo GROUP BY ALL HAVING max(i) >= 1 AND max(j) >= 2 AND max(k) >= 2)") + "SELECT swath, rt_window, i, j, k, round(v, 5) AS v FROM coo JOIN tr USING (swath, rt_window)")
def q76_tensor_files(spark, sf_dir):
    """Tensors written by slice; those that are no trivial ones are read back."""
    path = shared_path(spark, "tensors")
    tensor(spark, sf_dir).repartition("swath", "rt_window").write.partitionBy("swath", "rt_window").parquet(path)
    return slices.worth_decomposing(tables.read_slices(spark, path)).select("swath", "rt_window", "i", "j", "k", F.round("v", 5).alias("v"))


@query(with_(*FACTORS_SQL) + "SELECT mode, swath, rt_window, idx, comp, round(value, 8) AS value FROM (SELECT 0 AS mode, * FROM fa UNION ALL SELECT 1, * FROM fb UNION ALL SELECT 2, * FROM fc)")
def q77_model_files(spark, sf_dir):
    """Factors as one table, loaded mode by mode."""
    path = shared_path(spark, "factors")
    tagged = scalars.aligned([f.withColumn("mode", F.lit(m)).withColumn("rsq", F.lit(1.0)).withColumn("iterations", F.lit(3)) for m, f in enumerate(_factors(spark, sf_dir))])
    tagged.write.parquet(path)
    loaded = [tensors.mode_of(spark.read.parquet(path), m).withColumn("mode", F.lit(m)) for m in range(3)]
    return scalars.aligned(loaded).withColumn("value", F.round("value", 8))


# --- operators on tensors and models


@query(with_(*TO_COO) + "SELECT DISTINCT swath, rt_window, k, CAST(row_number() OVER (PARTITION BY swath, rt_window ORDER BY CASE WHEN level = 2 THEN start * 100 ELSE start END, k) AS INTEGER) AS place FROM (SELECT DISTINCT swath, rt_window, k, level, start FROM coo)")
def q78_label_order(spark, sf_dir):
    """Places of a slice's labels in the order that sorts level 2 behind level 1."""
    from pyspark.sql.window import Window as W

    _, _, k = slices.axes(tensor(spark, sf_dir))
    place = F.row_number().over(W.partitionBy("swath", "rt_window").orderBy(scalars.label_sort_value(F.col("start"), F.col("level")), "k"))
    return k.select("swath", "rt_window", "k", place.alias("place"))


@query(with_(*TO_COO) + "SELECT swath, rt_window, k, count(*) AS cells FROM coo WHERE level = 2 GROUP BY ALL")
def q79_ms2_only(spark, sf_dir):
    """The fibres of level 2, which keep their positions."""
    coo = boundary(tensor(spark, sf_dir), "coo")
    cells = slices.without_ms1(coo).groupBy("swath", "rt_window", "k").agg(F.count(F.lit(1)).alias("cells"))
    return cells.join(slices.mz_index_of_level(coo, 2), ["swath", "rt_window", "k"])


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat_ws(':', o_orderkey, '42')), o_orderkey LIMIT 100")
def q80_seeded_sample(spark, sf_dir):
    """A hundred rows without replacement, as the operator's purpose is."""
    return scalars.seeded_sample(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query(with_(COUNTS_SQL) + "SELECT model_id, comp FROM pc WHERE npeaks = 1")
def q81_unimodal_components(spark, sf_dir):
    return models.unimodal_components(_counts(spark, sf_dir).withColumn("comp", F.col("comp").cast("int")))


@query(with_(INDEX_SQL, "wanted AS (SELECT DISTINCT CAST(s_nationkey AS INTEGER) AS swath, 1 + s_nationkey % 12 AS rt_window, 2 + s_nationkey % 3 AS ncomp FROM supplier)") + f"SELECT {_INDEX} FROM sx JOIN wanted USING (swath, rt_window, ncomp)")
def q82_model_scans(spark, sf_dir):
    wanted = read(spark, sf_dir, "supplier").select((F.col("s_nationkey") / 100).alias("swath_start"), (1 + F.col("s_nationkey") % 12).alias("rt_window"), (2 + F.col("s_nationkey") % 3).alias("ncomp"))
    return models.model_scans(models.spectrum_index(_index(spark, sf_dir), 2, 4), wanted).select(*_INDEX.split(", "))


@query(with_(*FACTORS_SQL, scan_fit_sql("SELECT swath, rt_window, max(i) AS i0 FROM cells GROUP BY ALL"))
    + "SELECT CAST(fs.swath AS BIGINT) * 10000 + fs.rt_window AS model_id, j AS cycle, round(fit * scale, 5) AS intensity, 100 + k / 4 AS mz, 1 + k % 2 AS level FROM fs JOIN sc USING (swath, rt_window)")
def q83_reconstructed_map(spark, sf_dir):
    """The maps of every slice's first file by name, which is its last quarter: tensor row, unimodal components, R2 and m/z axis are looked up."""
    cells, *factors = _tensor_and_factors(spark, sf_dir)
    model_id = F.col("swath").cast("long") * 10000 + F.col("rt_window")
    tagged = [f.select("swath", "rt_window", F.lit(RANK).alias("ncomp"), model_id.alias("model_id"), F.lit(m).alias("mode"), "idx", "comp", "value", F.lit(0.5).alias("rsq"), F.lit(3).alias("iterations")) for m, f in enumerate(factors)]
    factors = boundary(scalars.aligned(tagged), "factors")
    coo = cells.withColumn("file", F.concat(F.lit("s"), (9 - F.col("i")).cast("string")))
    coo = coo.withColumn("start", 100 + F.col("k") / 4).withColumn("level", 1 + F.col("k") % 2)
    counts = factors.select("model_id", "comp").distinct().withColumn("npeaks", F.when(F.col("comp") < 3, 1).otherwise(2))
    rsq = models.rsq_or_default(factors.select("swath", "rt_window", "ncomp").distinct(), tensors.measures(factors).where("false"))
    return models.reconstructed_map(factors, coo, counts, rsq, 0).withColumn("intensity", F.round("intensity", 5))


@query(with_(SPEC_SQL) + "SELECT scan, level, intensity FROM pk WHERE intensity >= 25")
def q84_at_least(spark, sf_dir):
    return spectra.at_least(order_spectra(spark, sf_dir), 25.0).select("scan", "level", "intensity")


_AXIS = "SELECT l_suppkey AS swath, l_linenumber AS rt_window, CAST(l_partkey AS INTEGER) AS idx, max(l_quantity) AS weight, CAST(1 + l_partkey % 2 AS INTEGER) AS level FROM lineitem GROUP BY ALL"


def _mass_modes(spark, sf_dir):
    """Mass modes of suppliers' slices, with the axis they belong to."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("swath"), F.col("l_linenumber").alias("rt_window"), F.col("l_partkey").cast("int").alias("idx"), "l_orderkey", "l_quantity", "l_discount")
    axis = rows.groupBy("swath", "rt_window", "idx").agg(F.max("l_quantity").alias("weight")).withColumn("level", (1 + F.col("idx") % 2).cast("int"))
    modes = rows.select("swath", "rt_window", "idx", F.col("l_orderkey").alias("comp"), F.col("l_discount").alias("value"))
    return modes, axis


@query(f"WITH ax AS ({_AXIS}) SELECT l_suppkey AS swath, l_linenumber AS rt_window, idx, l_orderkey AS comp, level, round(l_discount * weight * CASE WHEN level = 1 THEN 1000 ELSE 1 END, 6) AS value FROM lineitem JOIN ax ON ax.swath = l_suppkey AND ax.rt_window = l_linenumber AND ax.idx = l_partkey")
def q85_postscale(spark, sf_dir):
    modes, axis = _mass_modes(spark, sf_dir)
    return tensors.postscale(modes, axis.withColumnRenamed("idx", "k")).withColumn("value", F.round("value", 6))


@query(f"WITH ax AS ({_AXIS}) SELECT l_suppkey AS swath, l_linenumber AS rt_window, idx, l_orderkey AS comp, l_discount AS value, CAST(100 + idx AS DOUBLE) AS mz, level FROM lineitem JOIN ax ON ax.swath = l_suppkey AND ax.rt_window = l_linenumber AND ax.idx = l_partkey")
def q86_mass_mode_index(spark, sf_dir):
    modes, axis = _mass_modes(spark, sf_dir)
    labels = axis.withColumn("label", scalars.mz_label((100 + F.col("idx")).cast("double"), F.col("level"))).drop("level")
    return int_level(models.with_mz_index(modes, labels)).withColumn("mz", F.col("mz").cast("double"))
