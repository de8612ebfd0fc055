import os

import numpy as np
from pyspark.sql import functions as F

from stratascan.llm import common


def test_hot_keys_are_dealt_and_joined_once(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("r"))
    keyed = common.materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low")), "t")
    got = common.join_repeated(rows.unionByName(spark.createDataFrame([("none", -1)], "k string, r long")), keyed, "k", ["r"], per_task=100, hot_keys=10)
    assert got.count() == 6001 and got.where("low IS NULL").count() == 1 and got.where("k = 'hot' AND low = 0").count() == 5000
    spread = got.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_salted_join(spark):
    left = spark.range(1000).select((F.col("id") % 2).alias("k"), "id").withColumn("n", F.lit(500))
    right = spark.createDataFrame([(0, "a", 500), (1, "b", 500), (2, "c", 1)], "k long, x string, n int")
    got = common.salted_join(left, right, "k", "n", 50, F.col("id"))
    assert got.count() == 1000 and got.where("(k = 0 AND x = 'a') OR (k = 1 AND x = 'b')").count() == 1000


def test_blobs_are_files_of_their_own(spark, tmp_path):
    data = [bytes(range(256)) * n for n in (1, 3)] + [b""]
    tail = bytes([0, 255, 10, 143])
    path = str(tmp_path / "blobs")
    common.write_blobs(spark.createDataFrame([(bytearray(d),) for d in data], "c binary").coalesce(1), "c", path, tail)
    assert sorted(bytes(r.content) for r in common.read_blobs(spark, path).collect()) == sorted(d + tail for d in data)


def test_release_deletes_intermediate_tables(spark):
    kept = common.materialize(spark.range(3), "kept", common.lasting_path(spark, "kept"))
    gone = common.materialize(spark.range(3), "gone")
    (file,) = {os.path.dirname(f.removeprefix("file://")) for f in gone.inputFiles()}
    common.release(spark)
    assert not os.path.exists(file) and kept.count() == 3


def test_words_and_hashes():
    assert common.lower_words("Aé\x0bB\x1cc d".encode()) == ["aé".encode(), b"b\x1cc", "d".encode()]
    assert common.lower_words(None) == [] == common.lower_words(b" \t")
    words = common.WordHash().of([b"a", b"b", b"a", b"b", b"c"])
    two = common.window_hash(words, 2)
    assert two[0] == two[2] != two[1] and len(common.window_hash(words, 6)) == 0
    assert len(np.unique(common.mix64(np.arange(1000, dtype=np.uint64)))) == 1000
