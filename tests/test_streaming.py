import random
from datetime import datetime, timedelta

from stratascan.operators import slices
from stratascan.streaming import cycles, rt_windows


def test_windows_of_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=20 * i), "a", 1 + i % 2, float(i), 20.0 * i) for i in range(12)]
    source = spark.createDataFrame(rows, "ts timestamp, file string, level int, intensity double, rt double")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = rt_windows.windowed_points(stream, 60, 600).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("windows").collect()
    assert sum(r.points for r in got) == 12 and len({r.start for r in got}) == 4
    for _ in range(2):  # a second run finds nothing new
        rt_windows.append_slices(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), 60.0).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 12 and {r.rt_window for r in out.select("rt_window").distinct().collect()} == {0, 1, 2, 3}


def test_cycles_of_a_stream_in_several_runs(spark, tmp_path):
    """Each run takes up the open cycles of the one before; the marker at the end closes the last ones."""
    rng = random.Random(1)
    schema = "swath int, rt_window int, file string, spectrum_index int, level tinyint, rt double, mz double, intensity double"
    rows = []
    for n in range(900):
        rt = rng.randrange(1200) / 4
        rows.append((1 + n % 2, int(rt // 60), rng.choice("ab"), n, 1 if rng.random() < 0.2 else 2, rt, 100.0 + n, 1.0))
    rows = [r for r in rows if not (r[0] == 2 and r[1] == 3 and r[2] == "b" and r[4] == 1)]  # a file without MS1 in one slice
    df = spark.createDataFrame(rows, schema)
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    for lo, hi in ((0, 40), (40, 41.5), (41.5, 200), (200, 1000)):
        df.where((df.rt >= lo) & (df.rt < hi)).repartition(3).write.mode("append").parquet(source)
        cycles.stream_cycles(spark.readStream.schema(schema).parquet(source), out, checkpoint, 60.0, 3.0).awaitTermination()
    spark.createDataFrame([(None, None, None, None, None, 1e6, None, None)], schema).write.mode("append").parquet(source)
    cycles.stream_cycles(spark.readStream.schema(schema).parquet(source), out, checkpoint, 60.0, 3.0).awaitTermination()
    got = cycles.whole_slices(spark.read.parquet(out)).collect()
    binned = slices.bin_cycles(df, 3.0).groupBy("swath", "rt_window", "file", "cycle").count().collect()
    assert sorted((r.swath, r.rt_window, r.file, r.cycle, r.points) for r in got) == sorted(tuple(r) for r in binned) and len(got) > 50
    assert spark.read.parquet(out).where("cycle = -1").count() == 1
