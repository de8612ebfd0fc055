"""The driver's tables seen as the engine's inputs: events as a scan map, embeddings as factor matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_SEC = 259200.0
LAST_CYCLE_SEC = 21600.0
PPM = 20000.0
MIN_POINTS = 2

#: DuckDB's form of :func:`scan_map`.
SCAN_SQL = """scan AS (SELECT concat('s', user_id % 3) AS file, CAST(event_id AS INTEGER) AS spectrum_index, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS level,
  (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS rt, 100 + value AS mz, CAST(props->>'$.k' AS DOUBLE) AS intensity,
  CASE WHEN event_type = 'view' THEN 100 + value ELSE CAST(100 + event_id * 7 % 500 AS DOUBLE) END AS prec_mz,
  floor(CASE WHEN event_type = 'view' THEN 100 + value ELSE CAST(100 + event_id * 7 % 500 AS DOUBLE) END / 100) * 100 AS w_start,
  floor(CASE WHEN event_type = 'view' THEN 100 + value ELSE CAST(100 + event_id * 7 % 500 AS DOUBLE) END / 100) * 100 + 104 AS w_end FROM events)"""


def scan_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: views are MS1, other events MS2 with a precursor derived from their id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    rows = e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("file"), F.col("event_id").cast("int").alias("spectrum_index"),
        F.when(F.col("event_type") == "view", 1).otherwise(2).cast("tinyint").alias("level"), (micros / 1e6).alias("rt"), (100 + F.col("value")).alias("mz"),
        F.get_json_object("props", "$.k").cast("double").alias("intensity"), F.col("event_id").alias("id"),
    )
    rows = rows.withColumn("prec_mz", F.when(F.col("level") == 1, F.col("mz")).otherwise((100 + F.col("id") * 7 % 500).cast("double"))).drop("id")
    start = F.floor(F.col("prec_mz") / 100).cast("double") * 100
    return rows.withColumn("prec_isolation_window_start", start).withColumn("prec_isolation_window_end", start + 104)


#: Components of a model.
RANK = 4
#: How far apart the three factors of a model lie in the table of vectors.
SHIFT = {"i": 0, "j": 101, "k": 211}


def cells(spark: SparkSession, sf_dir: str, by_slice: bool = False) -> DataFrame:
    """(swath, rt_window, i, j, k, v): a supplier's line items of a year are a slice, with the axes quarter, line number and discount; quantities are summed up. With ``by_slice`` line
    items are dealt by their slice, so that a later step by slice doesn't move the cells again."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = F.col("l_suppkey").alias("swath"), F.year("l_shipdate").alias("rt_window"), (F.quarter("l_shipdate") - 1).alias("i"), (F.col("l_linenumber") - 1).alias("j"), F.round(F.col("l_discount") * 100).alias("k")
    rows = rows.select(*[k.cast("int") for k in keys], "l_quantity").toDF("swath", "rt_window", "i", "j", "k", "q")
    rows = rows.repartition("swath", "rt_window") if by_slice else rows
    return rows.groupBy("swath", "rt_window", "i", "j", "k").agg(F.sum("q").alias("v"))


CELLS_SQL = """cells AS (SELECT CAST(l_suppkey AS INTEGER) AS swath, CAST(extract(year FROM l_shipdate) AS INTEGER) AS rt_window, CAST(extract(quarter FROM l_shipdate) - 1 AS INTEGER) AS i,
  CAST(l_linenumber - 1 AS INTEGER) AS j, CAST(round(l_discount * 100) AS INTEGER) AS k, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"""


def factor(spark: SparkSession, sf_dir: str, axis: str, places_of: DataFrame) -> DataFrame:
    """(swath, rt_window, idx, comp, value): the components of :func:`factor_vectors`, a row each."""
    rows = factor_vectors(spark, sf_dir, axis, places_of)
    return rows.select("swath", "rt_window", "idx", F.posexplode("vector.value").alias("comp", "value"))


def factor_vectors(spark: SparkSession, sf_dir: str, axis: str, places_of: DataFrame) -> DataFrame:
    """(swath, rt_window, idx, vector): a vector for every place on an axis of every slice of cells ``places_of``; each component is the mean size of a quarter of it."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    width = F.floor(F.size("embedding") / RANK).cast("int")
    comps = F.sequence(F.lit(0), F.lit(RANK - 1))
    quarter = lambda comp: F.slice(F.col("embedding").cast("array<double>"), comp * width + 1, width)
    values = F.transform(comps, lambda comp: F.aggregate(quarter(comp), F.lit(0.0), lambda s, x: s + F.abs(x)) / width)
    parts = e.select("vec_id", F.struct(comps.alias("comp"), values.alias("value")).alias("vector"))
    n = e.count()
    places = places_of.select("swath", "rt_window", F.col(axis).alias("idx")).distinct()
    places = places.withColumn("vec_id", (F.col("swath").cast("long") * 31 + F.col("rt_window") * 7 + F.col("idx") + SHIFT[axis]) % F.lit(n))
    return places.join(parts, "vec_id").select("swath", "rt_window", "idx", "vector")


def factor_sql(name: str, axis: str) -> str:
    w = f"len(embedding) // {RANK}"
    return f"""{name} AS (SELECT swath, rt_window, idx, CAST(c AS INTEGER) AS comp, list_sum(list_transform(embedding[c * ({w}) + 1 : (c + 1) * ({w})], lambda x: abs(CAST(x AS DOUBLE)))) / ({w}) AS value
  FROM (SELECT DISTINCT swath, rt_window, {axis} AS idx FROM cells) JOIN embeddings ON vec_id = (CAST(swath AS BIGINT) * 31 + rt_window * 7 + idx + {SHIFT[axis]}) % (SELECT count(*) FROM embeddings), unnest(range({RANK})) AS u(c))"""
