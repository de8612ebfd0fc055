"""Scan files: mzML and mzXML read element by element, spectra as text for other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.functions.encoding import base64_to_peaks, decode_binary, peaks_to_base64
from stratascan.operators.spectra import ordinals, peak_lists, pseudo_precursor, summary
from stratascan.operators.windows import interval_join
from stratascan.plans.boundary import boundary
from stratascan.sources.tables import file_stem

_CV = "array<struct<_accession:string,_value:string,_unitAccession:string>>"
_MZML = (
    f"_index long, cvParam {_CV}, scanList struct<scan:array<struct<cvParam:{_CV}>>>, "
    f"precursorList struct<precursor:array<struct<isolationWindow:struct<cvParam:{_CV}>,selectedIonList:struct<selectedIon:array<struct<cvParam:{_CV}>>>>>>, "
    f"binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{_CV},binary:string>>>"
)

# Accessions of the controlled vocabulary.
MS_LEVEL, SCAN_TIME, MINUTE, SELECTED_MZ = "MS:1000511", "MS:1000016", "UO:0000031", "MS:1000744"
ISOLATION_TARGET, LOWER_OFFSET, UPPER_OFFSET = "MS:1000827", "MS:1000828", "MS:1000829"
MZ_ARRAY, INTENSITY_ARRAY, BITS_32, ZLIB = "MS:1000514", "MS:1000515", "MS:1000521", "MS:1000574"


def _cv(params, accession: str, field: str = "_value") -> Column:
    """Value of the first parameter with an accession."""
    return F.try_element_at(F.filter(params, lambda p: p["_accession"] == accession), F.lit(1))[field]


def _has(params, accession: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_accession"] == accession), F.lit(False))


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """(file, e): every element with a tag, cut out of the text at its end, so that a file of any size is read by many tasks. Elements of the tag are not nested."""
    rows = spark.read.option("lineSep", f"</{tag}>").text(path).select(file_stem(F.col("_metadata.file_path")).alias("file"), F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)$", 1).alias("x"))
    return rows.where("x <> ''").select("file", F.from_xml(F.concat("x", F.lit(f"</{tag}>")), schema).alias("e"))


def _raw_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Every spectrum as it stands, m and i its arrays still encoded."""
    rows = _elements(spark, path, "spectrum", _MZML).select("file", "e.*")
    scan = F.col("scanList.scan")[0]["cvParam"]
    precursor = F.col("precursorList.precursor")[0]
    window = precursor["isolationWindow"]["cvParam"]
    arrays = F.col("binaryDataArrayList.binaryDataArray")
    pick = lambda accession: F.try_element_at(F.filter(arrays, lambda a: _has(a["cvParam"], accession)), F.lit(1))
    selected = _cv(precursor["selectedIonList"]["selectedIon"][0]["cvParam"], SELECTED_MZ).cast("double")
    time = _cv(scan, SCAN_TIME).cast("double") * F.when(_cv(scan, SCAN_TIME, "_unitAccession") == MINUTE, 60.0).otherwise(1.0)
    return rows.select(
        "file", F.col("_index").cast("int").alias("spectrum_index"), _cv(F.col("cvParam"), MS_LEVEL).cast("tinyint").alias("level"), time.alias("rt"),
        selected.alias("prec_mz"), F.coalesce(_cv(window, ISOLATION_TARGET).cast("double"), selected).alias("target"), _cv(window, LOWER_OFFSET).cast("double").alias("lower_offset"),
        _cv(window, UPPER_OFFSET).cast("double").alias("upper_offset"), pick(MZ_ARRAY).alias("m"), pick(INTENSITY_ARRAY).alias("i"),
    )


def read_mzml_spectra(spark: SparkSession, path: str) -> DataFrame:
    """One row per spectrum: file, spectrum_index, level, rt in seconds, prec_mz, isolation offsets, and the arrays mz and intensity.

    Spectra without a scan time, MS2 spectra without a precursor, spectra without an m/z array and those of other levels are left out.
    """
    return _decoded(_whole(_raw_spectra(spark, path)))


def _whole(spectra: DataFrame) -> DataFrame:
    return spectra.where("rt IS NOT NULL AND m IS NOT NULL AND level IN (1, 2) AND (level = 1 OR prec_mz IS NOT NULL)")


def _decoded(spectra: DataFrame) -> DataFrame:
    decoded = lambda a: decode_binary(a["binary"], F.when(_has(a["cvParam"], BITS_32), 32).otherwise(64), _has(a["cvParam"], ZLIB))
    return spectra.withColumn("mz", decoded(F.col("m"))).withColumn("intensity", decoded(F.col("i"))).drop("m", "i")


def spectrum_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, processed, problematic): spectra, and what they lack of level, scan time and m/z array; the array of one without a time is not looked for."""
    return _raw_spectra(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("processed"), F.sum(_lacks()).alias("problematic"))


def _lacks() -> Column:
    return F.col("level").isNull().cast("int") + F.when(F.col("rt").isNull(), 1).otherwise(F.col("m").isNull().cast("int"))


def mzml_windows(spectra: DataFrame) -> DataFrame:
    """(start, end): distinct isolation windows of the MS2 spectra; those without both offsets are left out."""
    rows = spectra.where("level = 2 AND lower_offset IS NOT NULL AND upper_offset IS NOT NULL")
    return rows.select((F.col("target") - F.col("lower_offset")).alias("start"), (F.col("target") + F.col("upper_offset")).alias("end")).distinct()


def read_mzml(spark: SparkSession, path: str, windows: DataFrame | None = None, min_intensity: float = 0.0, bin_width: float = 25.0, counts: Observation | None = None) -> DataFrame:
    """The scan map of mzML files: a row per peak with its isolation window. Weak MS2 peaks and peaks outside all windows are left out.

    Files are parsed once: their spectra are written, still encoded, as windows and points are both taken from them. ``counts`` gets the numbers of processed and problematic spectra of all
    files in passing.
    """
    raw = _raw_spectra(spark, path)
    if counts is not None:
        raw = raw.observe(counts, F.count(F.lit(1)).alias("processed"), F.coalesce(F.sum(_lacks()), F.lit(0)).alias("problematic"))
    raw = boundary(_whole(raw), "spectra")
    windows = mzml_windows(raw) if windows is None else windows
    spectra = _decoded(raw)
    points = spectra.select("file", "spectrum_index", "level", F.bround("rt", 4).alias("rt"), "prec_mz", F.inline(F.arrays_zip("mz", "intensity")))
    points = points.withColumn("mz", F.bround("mz", 10)).withColumn("intensity", F.bround("intensity", 8))
    points = points.where(~((F.col("level") == 2) & (F.col("intensity") < min_intensity)))
    points = points.withColumn("prec_mz", F.when(F.col("level") == 1, F.col("mz")).otherwise(F.col("prec_mz")))
    found = interval_join(points, windows, "prec_mz", bin_width)
    return found.select(
        "file", "spectrum_index", "level", "rt", "mz", "intensity", "prec_mz", F.col("start").alias("prec_isolation_window_start"), F.col("end").alias("prec_isolation_window_end")
    )


def time_unit(spark: SparkSession, path: str) -> DataFrame:
    """(unit): the name of the unit where a file uses that of minutes; no row otherwise."""
    name = F.regexp_extract("value", MINUTE + r'" unitName="(\w+)"', 1)
    return spark.read.text(path).select(name.alias("unit")).where("unit <> ''").limit(1)


def read_mzxml(spark: SparkSession, path: str) -> DataFrame:
    """(num, level, prec_mz, prec_intensity, peaks) of the scans in mzXML files."""
    schema = "_num long, _msLevel int, precursorMz struct<_VALUE:double,_precursorIntensity:double>, peaks struct<_VALUE:string>"
    rows = _elements(spark, path, "scan", schema).select("e.*")
    return rows.select(F.col("_num").alias("num"), F.col("_msLevel").alias("level"), F.col("precursorMz._VALUE").alias("prec_mz"), F.col("precursorMz._precursorIntensity").alias("prec_intensity"), base64_to_peaks(F.trim("peaks._VALUE")).alias("peaks"))


# Elements of the mzXML format, what stands before and after the scans, and a line of its index.
MZXML_SCAN = (
    '  <scan num="%d" msLevel="2" peaksCount="%d" lowMz="%.10g" highMz="%.10g" basePeakMz="%.10g" basePeakIntensity="%.8g" totIonCurrent="%.8g">\n'
    '    <precursorMz precursorIntensity="%.8g">%.10g</precursorMz>\n'
    '    <peaks precision="32" byteOrder="network" contentType="m/z-int">%s</peaks>\n  </scan>\n'
)
MZXML_HEAD = '<?xml version="1.0" encoding="ISO-8859-1"?>\n<mzXML xmlns="http://sashimi.sourceforge.net/schema_revision/mzXML_3.2">\n<msRun scanCount="{n}">\n'
MZXML_END, MZXML_INDEX, MZXML_OFFSET, MZXML_TAIL = "</msRun>\n", '<index name="scan">\n', '  <offset id="%d">%d</offset>\n', "</index>\n<indexOffset>{at}</indexOffset>\n</mzXML>\n"


def mzxml_scans(points: DataFrame, centre: str | None = None) -> DataFrame:
    """(scan, xml): the MS2 peaks of each spectrum (scan, level, mz, intensity[, centre]) as a scan element, in order of m/z."""
    ms2 = points.where("level = 2")
    peaks = peak_lists(ms2, ["scan"]).withColumn("encoded", peaks_to_base64(F.transform("peaks", lambda p: p["mz"]), F.transform("peaks", lambda p: p["intensity"]))).drop("peaks")
    rows = peaks.join(summary(ms2, ["scan"]), "scan").join(pseudo_precursor(points, ["scan"], centre).where("prec_mz IS NOT NULL"), "scan")
    xml = F.format_string(MZXML_SCAN, "scan", "peaks_count", "low_mz", "high_mz", "base_peak_mz", "base_peak_intensity", "tot_ion_current", "prec_intensity", "prec_mz", "encoded")
    return rows.select("scan", xml.alias("xml"))


def mzxml_text(scans: DataFrame) -> DataFrame:
    """(section, scan, value) of an indexed mzXML document: its head, the scan elements, the index with the byte offset of each, and its end. In the order of section
    and scan the values follow each other without a gap. Offsets are running sums of lengths, range by range, so no task holds the document."""
    numbered = ordinals(scans.select("scan", "xml"), ["scan"], "nth")
    sized = boundary(numbered.withColumn("size", F.octet_length("xml")), "mzxml-scans")
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    head = MZXML_HEAD.format(n=total["n"])
    stretch = F.floor(F.col("nth") / 10_000)  # scans of a stretch are summed up in one task, stretches by one number each
    sums = sized.groupBy(stretch.alias("stretch")).agg(F.sum("size").alias("bytes"))
    before = sums.select("stretch", (F.sum("bytes").over(W.orderBy("stretch")) - F.col("bytes")).alias("before"))
    within = F.sum("size").over(W.partitionBy("stretch").orderBy("nth")) - F.col("size")
    placed = sized.withColumn("stretch", stretch).withColumn("within", within).join(before, "stretch")
    offset = F.col("before") + F.col("within") + len(head.encode()) + 2  # the element starts after its indent
    at = len(head.encode()) + total["bytes"] + len(MZXML_END)
    ends = [(0, head), (2, MZXML_END + MZXML_INDEX), (4, MZXML_TAIL.format(at=at))]
    fixed = scans.sparkSession.createDataFrame([(s, None, v) for s, v in ends], "section int, scan long, value string")
    elements = sized.select(F.lit(1).alias("section"), F.col("scan").cast("long").alias("scan"), F.col("xml").alias("value"))
    index = placed.select(F.lit(3).alias("section"), F.col("scan").cast("long").alias("scan"), F.format_string(MZXML_OFFSET, "scan", offset).alias("value"))
    return fixed.unionByName(elements).unionByName(index)


def write_mzxml(scans: DataFrame, path: str) -> None:
    """One indexed mzXML document as a folder of parts; put together in the order of their names they are the file that other programs read."""
    ordered = mzxml_text(scans).orderBy("section", "scan")
    ordered.select(F.regexp_replace("value", r"\n$", "")).write.mode("overwrite").text(path)  # the sink ends each with a line end again


def mgf_text(spectra: DataFrame) -> DataFrame:
    """(scan, value): one MGF record per spectrum (scan, prec_mz, prec_intensity, peaks), and charge, rtinseconds and seq where there are such columns."""
    line = F.transform("peaks", lambda p: F.format_string("%.10g %.8g", p["mz"], p["intensity"]))
    extra = [F.concat(F.lit(f"{c.upper()}="), F.col(c).cast("string")) for c in ("scans", "charge", "rtinseconds", "seq") if c in spectra.columns]
    head = [F.lit("BEGIN IONS"), F.format_string("TITLE=scan=%d", "scan"), F.format_string("PEPMASS=%.10g %.8g", "prec_mz", "prec_intensity"), *extra]
    return spectra.select("scan", F.concat_ws("\n", *head, line, F.lit("END IONS")).alias("value"))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(title, pepmass, charge, scans, rtinseconds, seq, peaks): headers in any order, a missing SEQ is empty, spectra without peaks are left out."""
    rows = spark.read.option("lineSep", "END IONS").text(path).where(F.col("value").contains("BEGIN IONS"))
    lines = F.filter(F.transform(F.split(F.split_part("value", F.lit("BEGIN IONS"), F.lit(2)), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(lines.alias("lines"))
    headers = F.map_from_entries(F.transform(F.filter("lines", lambda x: x.contains("=")), lambda x: F.struct(F.upper(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.substr(x, F.locate("=", x) + 1).alias("v"))))
    numbers = F.transform(F.filter("lines", lambda x: x.rlike("^[0-9]")), lambda x: F.split(x, r"\s+"))
    peaks = F.transform(numbers, lambda x: F.struct(x[0].cast("double").alias("mz"), x[1].cast("double").alias("intensity")))
    rows = rows.select(headers.alias("h"), peaks.alias("peaks")).where(F.size("peaks") > 0)
    of = lambda k: F.try_element_at("h", F.lit(k))
    return rows.select(
        of("TITLE").alias("title"), F.split(of("PEPMASS"), " ")[0].cast("double").alias("pepmass"), of("CHARGE").alias("charge"), of("SCANS").alias("scans"),
        of("RTINSECONDS").try_cast("double").alias("rtinseconds"), F.coalesce(of("SEQ"), F.lit("")).alias("seq"), "peaks",
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence) of FASTA records; wrapped lines are joined."""
    rows = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    text = F.regexp_replace("value", r"^>", "")
    return rows.select(F.trim(F.split_part(text, F.lit("\n"), F.lit(1))).alias("header"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"[\s>]", "").alias("sequence"))


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(n): number of records."""
    return spark.read.text(path).where(F.col("value").startswith(">")).agg(F.count(F.lit(1)).alias("n"))


def fasta_text(rows: DataFrame, header: str, sequence: str) -> DataFrame:
    return rows.select(F.concat(F.lit(">"), F.col(header).cast("string"), F.lit("\n"), F.col(sequence)).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """Values as text lines, in as many files as there are partitions."""
    rows.select("value").write.mode("overwrite").text(path)
