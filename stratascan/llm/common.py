"""Helpers shared by the training-data operators.

Intermediate tables are written to the folder in ``spark.checkpoint.dir``, which every executor and the
driver can reach, through Spark's own writers; lineage is cut there, so a lost executor costs only its tasks.

A lazy result needs the tables it was made from, so they stay until they are released: those made inside :func:`owner` when the same owner
starts anew, all others by :func:`release`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.plans.boundary import shared_folder

#: Intermediate tables by owner; those of no owner are under "".
_INTERMEDIATE: dict[str, list[str]] = {}
_OWNERS: list[str] = [""]

#: Rows in one Arrow batch handed to Python; small, because a document may hold megabytes.
BATCH_ROWS = 500

WORD_GAP = r"[\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small enough that some very long documents fit in one. It is a setting of the session, which plans read when they run, so it stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table of the present owner."""
    path = lasting_path(spark, name)
    _INTERMEDIATE.setdefault(_OWNERS[-1], []).append(path)
    return path


def release(spark: SparkSession, name: str = "") -> None:
    """Delete the intermediate tables of an owner. Only for callers that have written out all that was made from them."""
    for path in _INTERMEDIATE.pop(name, []):
        drop_path(spark, path)


@contextmanager
def owner(spark: SparkSession, name: str) -> Iterator[None]:
    """Intermediate tables made inside belong to ``name``; those it made before are deleted first, tables of others stay."""
    release(spark, name)
    _OWNERS.append(name)
    try:
        yield
    finally:
        _OWNERS.pop()


def lasting_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: a plan boundary that survives lost executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_blobs(blobs: DataFrame, column: str, path: str, tail: bytes) -> None:
    """Write each value of a binary column as one file, followed by ``tail``.

    Works on any file system that Spark can write to: the text sink copies the bytes of a string unchanged,
    ends each record with the line separator, and starts a new file after every record.
    """
    (
        blobs.select(F.col(column).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", tail.decode("latin-1"))
        .text(path)
    )


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that :func:`write_blobs` wrote."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def salted_join(left: DataFrame, right: DataFrame, key: str, size: str, rows_per_salt: int, spread: Column) -> DataFrame:
    """Inner join of many rows to one row per key, no key in one task.

    ``left`` carries the number of its rows with that key in column ``size``; every ``rows_per_salt`` of them
    get another copy of the row in ``right``, which must have a column ``size`` too.
    """
    salts = lambda: F.ceil(F.col(size) / F.lit(rows_per_salt)).cast("int")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), salts()).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts() - 1))).drop(size)
    return left.join(right, [key, "_salt"]).drop("_salt")


class WordHash(dict):
    """64-bit hash of a word, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes, order-dependent."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    return mix64(h)


def chunks(rows: Iterable, size: int):
    """Lists of up to ``size`` rows."""
    part: list = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def join_repeated(rows: DataFrame, keyed: DataFrame, key: str, spread: list[str], how: str = "left", per_task: int = 2000, hot_keys: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """Join rows to ``keyed``, which has one row per key and in ``n`` the number of rows with it. With several rows per key in ``keyed``, ``counts`` has key and n.

    A key with more than ``1 / hot_keys`` of those rows is hot, so there are at most ``hot_keys`` of them: their names
    are broadcast and their rows dealt by ``spread`` to as many tasks as they need. What has ``n`` must be a written table.
    """
    counts = keyed if counts is None else counts
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("n") > max(per_task, total // hot_keys)).select(key, F.ceil(F.col("n") / per_task).cast("int").alias("_salts"))
    rows = rows.join(F.broadcast(hot), key, "left")
    rows = rows.withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), "_salts")).cast("int")).drop("_salts")
    keyed = keyed.join(F.broadcast(hot), key, "left")
    keyed = keyed.withColumn("_salt", F.explode(F.when(F.col("_salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_salts") - 1)))).drop("_salts")
    return rows.join(keyed, [key, "_salt"], how).drop("_salt")
