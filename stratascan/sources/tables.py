"""Readers and writers of tabular data: scan maps, windows, slices, results, indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan import schemas
from stratascan.functions.scalars import path_keys, quality_digit


def scan_map_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan maps with a header, all samples and all parts of them in one scan; ``file`` is the folder ``file=..`` that a map's parts are in, or else the name of
    the file without its ending."""
    schema = schemas.SCAN_MAP.removeprefix("file string, ")
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(list(paths))
    return rows.withColumn("file", file_stem(F.col("_metadata.file_path")))


def write_scan_map(scan: DataFrame, path: str) -> None:
    """A folder ``file=..`` of CSV parts per sample; a failed write leaves no part behind."""
    columns = [c.split()[0] for c in schemas.SCAN_MAP.split(", ")]
    scan.select(*columns).write.mode("overwrite").partitionBy("file").option("header", True).csv(path)


def file_stem(path):
    folder, name = F.regexp_extract(path, r"/file=([^/]+)/[^/]*$", 1), F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.when(folder != "", folder).otherwise(name)


def first_file(paths: DataFrame) -> DataFrame:
    """(path): the least of a table of paths, where any one would do."""
    return paths.agg(F.min("path").alias("path"))


def windows_csv(spark: SparkSession, path: str) -> DataFrame:
    """Isolation windows with or without a header: rows whose first two fields are no numbers are left out."""
    rows = spark.read.schema("a string, b string").csv(path)
    return rows.select(F.col("a").try_cast("double").alias("start"), F.col("b").try_cast("double").alias("end")).na.drop()


def write_windows(windows: DataFrame, path: str) -> None:
    """Distinct windows in order, without header; a small table, so one file."""
    windows.select("start", "end").distinct().orderBy("start", "end").coalesce(1).write.mode("overwrite").csv(path)


def write_slices(slices: DataFrame, path: str) -> None:
    """Partitioned by slice; a slice's rows meet in one task and so in one file, unless they are many."""
    slices.repartition("swath", "rt_window").write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("swath", "rt_window").parquet(path)


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """Slice keys come from the folders, so filters on them prune."""
    return spark.read.parquet(path)


def write_adjusted(adjusted_map: DataFrame, map_path: str, intervals_path: str) -> None:
    """The adjusted map and its distinct bounds in order."""
    adjusted_map.write.mode("overwrite").parquet(map_path)
    bounds = adjusted_map.select("swath_lower_adjusted", "swath_upper_adjusted").na.drop().distinct()
    bounds.orderBy("swath_lower_adjusted").coalesce(1).write.mode("overwrite").option("header", True).csv(intervals_path)


def files_with_extension(spark: SparkSession, directory: str, extension: str) -> DataFrame:
    """(path) of the files that end in the last component of ``extension``."""
    last = extension.rpartition(".")[2]
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{last}").option("recursiveFileLookup", True).load(directory)
    return rows.select("path")


def slice_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result tables written per slice under ``key=value`` folders; missing and empty ones are skipped, keys are taken from the path."""
    rows = spark.read.schema(schema).option("header", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).csv(path)
    swath, window = path_keys(F.col("_metadata.file_path"))
    return rows.withColumn("swath", swath).withColumn("rt_window", window)


def psm_tables(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    """Tab-separated identifications of many runs with ``file`` and ``quality``; unreadable files are skipped."""
    reader = spark.read.option("sep", "\t").option("header", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    reader = reader.schema(schema) if schema else reader
    rows = reader.csv(list(paths))
    return rows.withColumn("file", F.col("_metadata.file_path")).withColumn("quality", quality_digit(F.col("_metadata.file_path")))


def sequencing_results(spark: SparkSession, paths: list[str], sequencer: str) -> DataFrame:
    """(scan, sequence, score) of either program's results, cleaned; files that can't be read are skipped."""
    from stratascan.functions.scalars import without_commas, without_mod, without_ptm

    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    if sequencer == "deepnovo":
        rows = reader.schema(schemas.DEEPNOVO).option("sep", "\t").option("header", True).csv(paths)
        sequence = without_mod(without_commas(F.col("output_seq")))
        return rows.where("output_seq IS NOT NULL").select("scan", sequence.alias("sequence"), F.col("output_score").try_cast("double").alias("score"))
    if sequencer == "novor":
        rows = reader.schema(schemas.NOVOR).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(paths)
        return rows.select("scan", without_ptm(F.col("peptide")).alias("sequence"), F.col("score").try_cast("double").alias("score"))
    raise ValueError(f"sequencer: {sequencer}")


def blast_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BLAST).option("sep", "\t").csv(path)


def swaths_by_lookup(spark: SparkSession, maps: DataFrame, lookup: DataFrame, swath: int) -> DataFrame:
    """Points of the files that a lookup table (file, swath) names for one swath."""
    return maps.join(lookup.where(F.col("swath") == swath).select("file").distinct(), "file", "left_semi")


def append_measures(measures: DataFrame, path: str) -> None:
    measures.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",", compression: str = "none") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", sep).option("compression", compression).csv(path)


def read_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By the ending of the path: csv and tsv with a header, otherwise Parquet. Columns are those of ``schema``, so reading takes one pass."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema)
    if ending in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if ending == "tsv" else ",").csv(path)
    return reader.parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)
