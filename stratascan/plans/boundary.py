"""Plan boundaries: tables that several later steps read are written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_PATHS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of our own only where none is set and driver and tasks share a machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
    if not _OWN:
        _OWN.append(f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")
    return _OWN[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def boundary(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the tables that ``df`` was read from, where a boundary wrote them and no later plan reads them."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for path in [p for p in _PATHS if p.rpartition("/")[2] == folder.rpartition("/")[2]]:
            _PATHS.remove(path)
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what boundaries inside wrote. What is returned from inside must have been written elsewhere or consumed."""
    before = len(_PATHS)
    try:
        yield
    finally:
        while len(_PATHS) > before:
            path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
