import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratascan.config import Config
from stratascan.operators import block_cp, models, mz_walk, slices, spectra, tensors, windows
from stratascan.plans import pipeline, queries
from stratascan.plans.boundary import boundary, released

POINT = "swath int, rt_window int, file string, spectrum_index int, level tinyint, rt double, mz double, intensity double"


def points(spark, rows):
    """Of (file, level, rt, mz, intensity) in one slice."""
    return spark.createDataFrame([(1, 0, f, n, lv, float(rt), float(mz), float(i)) for n, (f, lv, rt, mz, i) in enumerate(rows)], POINT)


def test_adjusted_windows_meet(spark):
    w = spark.createDataFrame([(400.0, 425.0), (424.0, 450.0), (449.0, 475.0)], "start double, end double")
    got = [(r.swath_lower_adjusted, r.swath_upper_adjusted) for r in windows.adjust_windows(w).orderBy("start").collect()]
    assert got == [(400.0, 424.5), (424.5, 449.5), (449.5, 475.0)]


def test_interval_join_takes_the_first_window(spark):
    w = spark.createDataFrame([(400.0, 425.0), (424.0, 450.0)], "start double, end double")
    p = spark.createDataFrame([(x,) for x in (399.9, 400.0, 424.5, 425.0, 450.0)], "mz double")
    for width in (1.0, 7.0, 100.0):
        got = {r.mz: r.start for r in windows.interval_join(p, w, "mz", width).collect()}
        assert got == {400.0: 400.0, 424.5: 400.0, 425.0: 424.0}


def test_interval_join_equals_a_scan_of_windows(spark):
    rng = random.Random(1)
    ws = [(a, a + rng.randrange(1, 60)) for a in (rng.randrange(0, 500) for _ in range(40))]
    ps = [rng.randrange(0, 5600) / 10 for _ in range(300)]
    w = spark.createDataFrame([(float(a), float(b)) for a, b in ws], "start double, end double")
    p = spark.createDataFrame(list(enumerate(ps)), "n int, x double")
    got = {r.n: (r.start, r.end) for r in windows.interval_join(p, w, "x", 13.0).collect()}
    want = {n: min((a, b) for a, b in ws if a <= x < b) for n, x in enumerate(ps) if any(a <= x < b for a, b in ws)}
    assert got == want


def test_rt_windows_close_the_last(spark):
    rows = spark.createDataFrame([(0.0,), (59.9,), (60.0,), (120.0,)], "rt double")
    assert [r[0] for r in rows.select(windows.rt_window(F.col("rt"), 60.0, 120.0)).collect()] == [0, 0, 1, 1]


def test_cycles_are_half_open(spark):
    rows = [(1, 1.0), (2, 1.0), (2, 1.2), (1, 2.0), (2, 2.05), (2, 2.09), (2, 2.1), (2, 0.5)]
    got = slices.bin_cycles(points(spark, [("a", lv, rt, 100 + n, 1) for n, (lv, rt) in enumerate(rows)])).collect()
    assert {r.spectrum_index: r.cycle for r in got} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_cycles_equal_a_search_in_ms1_times(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice((1, 2, 2)), rng.randrange(100) / 10, rng.random() * 100, 1) for _ in range(400)]
    got = {r.spectrum_index: r.cycle for r in slices.bin_cycles(points(spark, rows), 0.5).collect()}
    want = {}
    for n, (f, _, rt, _, _) in enumerate(rows):
        times = sorted({r[2] for r in rows if r[0] == f and r[1] == 1})
        at = np.searchsorted(times, rt, "right") - 1
        if at >= 0 and rt < times[-1] + 0.5:
            want[n] = at
    assert got == want


def test_a_file_without_ms1_drops_its_slice(spark):
    assert slices.bin_cycles(points(spark, [("a", 1, 1, 10, 1), ("b", 2, 1, 10, 1)])).count() == 0


def naive_starts(values, ppm):
    starts = []
    for x in sorted(set(values)):
        if not starts or x - starts[-1] > starts[-1] * ppm / 1e6:
            starts.append(x)
    return starts


def test_partitions_anchor_at_their_start():
    assert mz_walk.starts_of(np.array([100.0, 100.003, 100.0045, 100.008, 100.009]), 40.0).tolist() == [100.0, 100.0045, 100.009]
    rng = random.Random(3)
    for ppm in (0.5, 40, 20000):
        values = sorted({round(100 + rng.random() * 3, 4) for _ in range(900)})
        assert mz_walk.starts_of(np.array(values), ppm).tolist() == naive_starts(values, ppm)


@pytest.mark.parametrize("ppm, spread", [(500.0, 1.0), (500.0, 200.0), (20000.0, 3.0), (2.0, 1.0)])
def test_points_get_the_start_of_their_partition(spark, ppm, spread):
    """From one stretch over all tasks to gaps nearly everywhere."""
    rng = random.Random(4)
    rows = [("a", rng.choice((1, 2)), 1, round(100 + spread * rng.random(), 4), 1) for _ in range(4000)]
    got = slices.walked(points(spark, rows), ppm).collect()
    assert sorted(r.spectrum_index for r in got) == list(range(len(rows)))
    assert sorted(map(tuple, slices.mz_partitions(points(spark, rows), ppm).collect())) == sorted({(r.swath, r.rt_window, r.level, r.start) for r in got})
    for level in (1, 2):
        starts = naive_starts([r[3] for r in rows if r[1] == level], ppm)
        assert sorted({r.start for r in got if r.level == level}) == starts
        for r in (r for r in got if r.level == level):
            assert r.start == starts[np.searchsorted(starts, r.mz, "right") - 1]


def test_one_stretch_over_many_tasks(spark):
    """Values without a gap, and groups of values a little less than the tolerance apart, in ranges of different sizes."""
    rng = random.Random(5)
    dense = [100 + i * 1e-4 for i in range(3000)] + [100.5]
    cells = [200 * (1 + 90e-6) ** i + rng.choice((0, 1e-3, 2e-3)) for i in range(2000)]
    for values in (cells, dense + cells):
        p = points(spark, [("a", 1, 1, v, 1) for v in values for _ in range(1 + int(v) % 2)])
        before = spark.conf.get("spark.sql.shuffle.partitions")
        for n in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(r.start for r in slices.mz_partitions(p, 100.0).collect()) == naive_starts(values, 100.0)
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exits_of_a_gapless_range():
    rng = np.random.default_rng(6)
    for ppm in (300.0, 3000.0, 1e6):
        v = np.unique(np.round(100 + rng.random(400), 4))
        edges, exits = mz_walk.steps(v, ppm)
        for start in np.append(v[0] - rng.random(100) * v[0] * ppm / 1e6, v[0] - 1e-6):
            at = mz_walk.beyond(edges, start, ppm)
            assert (exits[at] if at < len(exits) else start) == mz_walk.starts_of(v, ppm, start)[-1]


def test_a_slice_of_millions_of_values(spark):
    """Against a walk over all values at once; a task holds a range."""
    rows = spark.range(3_000_000).select(F.lit(1).alias("swath"), F.lit(0).alias("rt_window"), F.lit(1).cast("tinyint").alias("level"), (F.lit(400.0) + F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 31)).alias("mz"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    rows = boundary(rows, "values")
    got = slices.mz_partitions(rows, 0.5).toPandas()["start"].to_numpy()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    values = np.unique(rows.select("mz").toPandas()["mz"].to_numpy())
    assert len(values) > 2_900_000
    np.testing.assert_array_equal(np.sort(got), mz_walk.starts_of(values, 0.5))


def test_frequent_partitions_stay_in_all_files(spark):
    rows = [(1, 0, "s0", c, 1, 10.0, 1.0) for c in range(4)] + [(1, 0, "s1", c, 1, 10.0, 1.0) for c in range(5)] + [(1, 0, f, c, 1, 20.0, 1.0) for f in ("s0", "s1") for c in range(4)]
    sums = spark.createDataFrame(rows, "swath int, rt_window int, file string, cycle int, level int, start double, intensity double")
    got = slices.frequent_partitions(sums, 5).collect()
    assert {(r.file, r.start) for r in got} == {("s0", 10.0), ("s1", 10.0)} and len(got) == 9


def test_time_axis_is_compacted_unless_aligned(spark):
    sums = spark.createDataFrame([(1, 0, "s0", c, 1, 10.0, 1.0) for c in (0, 3, 7)], "swath int, rt_window int, file string, cycle int, level int, start double, intensity double")
    assert sorted(r.j for r in slices.to_coo(sums).collect()) == [0, 1, 2]
    assert sorted(r.j for r in slices.to_coo(sums, align_cycles=True).collect()) == [0, 3, 7]


def test_tensor_of_two_samples(spark):
    rows = [("1", 1, 1.01, 10, 100), ("1", 2, 1.02, 20, 200), ("1", 1, 3.02, 30, 300), ("1", 2, 3.03, 30, 333), ("2", 1, 2.01, 11, 400), ("2", 2, 2.06, 22, 500), ("2", 1, 2.07, 22, 800), ("2", 2, 2.08, 33, 600)]
    coo = slices.tensorize(points(spark, rows), 40.0, min_points=1)
    labels = [(r.level, r.start) for r in coo.select("level", "start", "k").distinct().orderBy("k").collect()]
    assert labels == [(1, 10.0), (1, 11.0), (1, 22.0), (1, 30.0), (2, 20.0), (2, 22.0), (2, 30.0), (2, 33.0)]
    assert coo.agg(F.sum("v")).first()[0] == sum(r[4] for r in rows)


def test_imputation_fills_from_neighbours(spark):
    rows = [(1, 0, "a", j, 1, 5.0, 0, j, 0, v) for j, v in ((1, 10.0), (4, 20.0))] + [(1, 0, "a", j, 1, 6.0, 0, j, 1, 1.0) for j in range(5)]
    coo = spark.createDataFrame(rows, "swath int, rt_window int, file string, cycle int, level int, start double, i int, j int, k int, v double")
    got = [r.v for r in slices.impute(coo).where("k = 0").orderBy("j").collect()]
    assert got == pytest.approx([1.06450772, 10, 1.06978502, 2.13165409, 20], abs=1e-7)


def test_lower_bins_are_dropped_strictly(spark):
    rows = spark.createDataFrame([(1, 2, float(i)) for i in range(101)] + [(1, 1, 0.0)], "scan int, level int, intensity double")
    assert spectra.drop_lower_bins(rows, ["scan"], 1).where("level = 2").agg(F.min("intensity")).first()[0] == 2.0
    assert spectra.drop_lower_bins(rows, ["scan"], 0).count() == 101


def test_precursor_from_the_window_where_no_ms1_point_is(spark):
    rows = spark.createDataFrame([(1, 2, 200.0, 5.0, 412.5), (1, 2, 300.0, 6.0, 412.5), (2, 1, 400.0, 9.0, 437.5), (2, 1, 390.0, 9.0, 437.5), (2, 2, 100.0, 1.0, 437.5)], "scan int, level int, mz double, intensity double, centre double")
    first, again = ({r.scan: (r.prec_mz, r.prec_intensity) for r in spectra.pseudo_precursor(d, ["scan"], "centre").collect()} for d in (rows, rows.repartition(4)))
    assert first == again and first[2] == (390.0, 9.0)  # of equal points the lowest m/z
    assert 412.5 <= first[1][0] < 412.6 and 300 <= first[1][1] < 301
    assert {r.scan: r.prec_mz for r in spectra.pseudo_precursor(rows, ["scan"]).collect()} == {1: None, 2: 390.0}


def test_histogram_counts_every_point_once(spark):
    rng = random.Random(3)
    rows = [(k, rng.uniform(-5, 5)) for k in (1, 2) for _ in range(300)] + [(3, 7.0), (3, 7.0)]
    got = {}
    for r in spectra.histogram(spark.createDataFrame(rows, "k int, intensity double"), ["k"], bins=10).collect():
        got[r.k, r.bin] = r.n
    for k in (1, 2):
        counts = np.histogram([x for key, x in rows if key == k], bins=10)[0]
        assert [got.get((k, b), 0) for b in range(10)] == counts.tolist()
    assert {b: n for (k, b), n in got.items() if k == 3} == {0: 2}


def test_spectrum_index_is_dense(spark):
    index = models.model_index(spark.createDataFrame([(0,), (1,)], "swath int"), spark.createDataFrame([(0,), (1,)], "rt_window int"), 1, 2)
    got = sorted(tuple(r) for r in models.spectrum_index(index, 1, 2).select("scan", "model_id", "spectrum_num", "swath", "rt_window", "ncomp").collect())
    want, scan = [], 0
    for m, (s, w, n) in enumerate((s, w, n) for s in (0, 1) for w in (0, 1) for n in (1, 2)):
        for c in range(n):
            want.append((scan, m, c, s, w, n))
            scan += 1
    assert got == want and [g[0] for g in got if g[1] == 7] == [10, 11]


def test_best_models_keep_ties(spark):
    counts = [(m, c, n) for m, peaks in {0: [1, 1, 2], 1: [1, 2], 2: [2, 3], 3: [1, 1, 3]}.items() for c, n in enumerate(peaks)]
    c = spark.createDataFrame(counts, "model_id long, comp int, npeaks int")
    index = spark.createDataFrame([(0, 0, 2, m) for m in range(4)], "swath int, rt_window int, ncomp int, model_id long")
    assert {r.model_id: round(r.unimodal_fraction, 4) for r in models.unimodal_fraction(c).collect()} == {0: 0.6667, 1: 0.5, 3: 0.6667}
    assert {r.model_id for r in models.best_models(c, index).collect()} == {0, 3}


def test_coefficient_of_variation(spark):
    rows = spark.createDataFrame([(1, i, 0, float(i + 1)) for i in range(3)], "model_id int, idx int, comp int, value double")
    assert models.sample_modes(rows, ["model_id"]).first().cv_sample_mode == pytest.approx(0.40824829)


def low_rank(shape, rank, seed=0):
    rng = np.random.default_rng(seed)
    return np.einsum("ir,jr,kr->ijk", *[rng.random((n, rank)) for n in shape])


def test_decomposition_recovers_low_rank():
    x = low_rank((6, 8, 5), 2)
    for init in ("random", "svd"):
        factors, errors = tensors.nonnegative_cp(x, 2, 2000, 1e-9, init)
        assert [f.shape for f in factors] == [(6, 2), (8, 2), (5, 2)]
        assert 1 - errors[-1] ** 2 > 0.9999 and all(a >= b - 1e-9 for a, b in zip(errors[:-1], errors[1:], strict=True))
        assert np.abs(np.einsum("ir,jr,kr->ijk", *factors) - x).max() < 0.05 and min(f.min() for f in factors) >= 0


@pytest.mark.parametrize("shape", [(70, 4, 5), (3, 70, 6), (4, 5, 70), (1, 2, 1)])
def test_models_of_many_sizes_at_once(shape, monkeypatch):
    """Each is what plain updates over the whole tensor give, with the rounds that it takes by itself."""
    monkeypatch.setattr(tensors, "STRETCH", 16)
    x, ranks = np.random.default_rng(5).random(shape) * (np.random.default_rng(6).random(shape) < 0.7), [1, 3, 2]
    for rank, seed, (factors, errors) in zip(ranks, (7, 8, 9), tensors.nonnegative_cps(x, ranks, 60, 1e-3, "random", [7, 8, 9]), strict=True):
        rng = np.random.default_rng(seed)
        plain, norms = [rng.random((n, rank)) for n in shape], []
        while len(norms) < 60 and (len(norms) < 3 or abs(norms[-2] - norms[-1]) >= 1e-3):
            for mode in range(3):
                a, b = (plain[m] for m in range(3) if m != mode)
                columns = np.einsum("pr,qr->pqr", a, b).reshape(-1, rank)
                top = np.moveaxis(x, mode, 0).reshape(shape[mode], -1) @ columns
                plain[mode] = plain[mode] * np.maximum(top, 1e-11) / np.maximum(plain[mode] @ (columns.T @ columns), 1e-11)
            norms.append(np.linalg.norm(np.einsum("ir,jr,kr->ijk", *plain) - x) / np.linalg.norm(x))
        assert errors == pytest.approx(norms, abs=1e-7)
        assert all(np.allclose(got, want) for got, want in zip(factors, plain, strict=True))


def test_decomposition_is_dealt_over_tasks(spark):
    """Few slices with much work each don't meet in the few tasks that the session has for rows."""
    x = low_rank((2, 3, 4), 2, 4)
    dense = spark.createDataFrame([(s, 0, *map(int, at), float(v)) for s in range(6) for at, v in np.ndenumerate(x)], "swath int, rt_window int, i int, j int, k int, v double")
    got = tensors.decompose(dense, 1, 4, 3).select(F.spark_partition_id().alias("task"), "swath", "ncomp").distinct().collect()
    assert len(got) == 24 and len({r.task for r in got}) >= 16
    assert max(sum(r.task == t for r in got) for t in {r.task for r in got}) <= 3


def test_decompose_frames_and_skip_done(spark):
    x = low_rank((3, 4, 5), 2, 1)
    rows = [(s, 0, *map(int, c), float(v * s)) for s in (1, 2) for c, v in np.ndenumerate(x)]
    dense = spark.createDataFrame([(s, w, i, j, k, v) for s, w, i, j, k, v in ((r[0], r[1], *r[2:5], r[5]) for r in [(a, b, *c, d) for a, b, *c, d in rows])], "swath int, rt_window int, i int, j int, k int, v double")
    done = spark.createDataFrame([(1, 0, 1)], "swath int, rt_window int, ncomp int")
    got = tensors.measures(tensors.decompose(dense, 1, 2, 800, 1e-9, done=done)).collect()
    assert {(r.swath, r.ncomp) for r in got} == {(1, 2), (2, 1), (2, 2)}
    assert all(r.rsq > 0.999 for r in got if r.ncomp == 2)


def frame_of(spark, matrix):
    return spark.createDataFrame([(int(i), int(c), float(v)) for (i, c), v in np.ndenumerate(matrix)], "idx int, comp int, value double")


def test_relational_algebra_equals_numpy(spark):
    rng = np.random.default_rng(5)
    a, b, c, x = rng.random((3, 2)), rng.random((4, 2)), rng.random((5, 2)), rng.random((3, 4, 5))
    cells = spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(x)], "i int, j int, k int, v double")
    fa, fb, fc = (frame_of(spark, m) for m in (a, b, c))
    got = {(r.i, r.comp): r.value for r in tensors.mttkrp(cells, fb, fc, "i", "j", "k").collect()}
    want = np.einsum("ijk,jr,kr->ir", x, b, c)
    assert got == pytest.approx({(i, r): want[i, r] for i in range(3) for r in range(2)})
    got = {(r.r, r.s): r.value for r in tensors.hadamard(tensors.gram(fb), tensors.gram(fc)).collect()}
    want = (b.T @ b) * (c.T @ c)
    assert got == pytest.approx({(i, j): want[i, j] for i in range(2) for j in range(2)})
    fitted = tensors.reconstruct(cells, fa, fb, fc)
    fit = np.einsum("ir,jr,kr->ijk", a, b, c)
    assert {(r.i, r.j, r.k): r.fit for r in fitted.collect()} == pytest.approx({at: v for at, v in np.ndenumerate(fit)})
    assert tensors.r_squared(fitted).first().rsq == pytest.approx(1 - ((x - fit) ** 2).sum() / (x**2).sum())


def shuffled_records(spark):
    """Records that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_reconstruction_moves_cells_once(spark):
    """Cells go through shuffles packed in blocks, not once for each component and axis."""
    rng = np.random.default_rng(8)
    a, b, c = rng.random((3, 8)), rng.random((90, 8)), rng.random((70, 8))
    cells = [(i, j, k, float(i + j + k)) for i in range(3) for j in range(90) for k in range(70) if (i + j + k) % 4]
    factors = [boundary(tensors.vectors(frame_of(spark, m)), "vectors") for m in (a, b, c)]
    blocks = boundary(tensors.in_blocks(spark.createDataFrame(cells, "i int, j int, k int, v double")), "blocks")
    before = shuffled_records(spark)
    fitted = tensors.out_of_blocks(boundary(tensors.fitted_blocks(blocks, *factors), "fitted"))
    assert shuffled_records(spark) - before < len(cells) / 4
    fit = np.einsum("ir,jr,kr->ijk", a, b, c)
    assert {(r.i, r.j, r.k, r.v): r.fit for r in fitted.collect()} == pytest.approx({x: fit[x[:3]] for x in cells})


def test_reconstruction_of_incomplete_factors(spark):
    """As joins by component: those that all three places have count, null is left out of the sum, and a cell without a common one falls away."""
    f = lambda rows: spark.createDataFrame(rows, "idx int, comp int, value double")
    a = f([(0, 0, 2.0), (0, 1, 3.0), (1, 2, 5.0), (2, 0, None), (3, 0, 1.0)])
    b, c = f([(0, 1, 5.0), (0, 0, 7.0)]), f([(0, 0, 1.0), (0, 1, None), (70, 1, 11.0)])
    cells = spark.createDataFrame([(i, 0, k, None if k else 1.0) for i in range(5) for k in (0, 70)] + [(3, 0, 0, 1.0), (None, 0, 0, 1.0), (3, 9, 0, 1.0)], "i int, j int, k int, v double")
    got = sorted(((r.i, r.k, r.fit) for r in tensors.reconstruct(cells, a, b, c).collect()), key=str)
    assert got == [(0, 0, 14.0), (0, 70, 165.0), (2, 0, None), (3, 0, 7.0), (3, 0, 7.0)]


def test_reconstructed_scan_meets_the_measured_maximum(spark):
    rng = np.random.default_rng(6)
    a, b, c, x = rng.random((2, 2)), rng.random((4, 2)), rng.random((5, 2)), rng.random((2, 4, 5))
    rows = [(1, 0, 2, mode, int(i), int(r), float(v)) for mode, m in enumerate((a, b, c)) for (i, r), v in np.ndenumerate(m)]
    factors = spark.createDataFrame(rows, "swath int, rt_window int, ncomp int, mode int, idx int, comp int, value double")
    coo = spark.createDataFrame([(1, 0, *map(int, at), float(v)) for at, v in np.ndenumerate(x)], "swath int, rt_window int, i int, j int, k int, v double")
    one = spark.createDataFrame([(1, 0, 2, 1)], "swath int, rt_window int, ncomp int, comp int")
    rsq = spark.createDataFrame([(1, 0, 2, 0.8)], "swath int, rt_window int, ncomp int, rsq double")
    got = {(r.j, r.k): r.intensity for r in models.reconstruct_scan(factors, coo, one, rsq, 1).collect()}
    fit = np.outer(b[:, 1], c[:, 1]) * a[1, 1]
    top = np.unravel_index(fit.argmax(), fit.shape)
    assert got == pytest.approx({at: v * x[1][top] * 0.8 / fit[top] for at, v in np.ndenumerate(fit)})


@pytest.mark.parametrize("centres", [(30,), (20, 60), (15, 45, 80), ()])
def test_peaks_of_gaussians(centres):
    t = np.arange(100)
    assert models.count_peaks(10.0, sum((math.pi * np.exp(-0.5 * ((t - c) / 4) ** 2) for c in centres), np.zeros(100))) == len(centres)


def test_charge_variants_and_headers(spark):
    rows = spark.createDataFrame([("x scan=7_a", 2), ("x scan=5_b", 1), ("scan=6", 3)], "title string, at int").repartition(3)
    got = sorted((r.scans, r.charge, r.title, r.rtinseconds, r.seq) for r in spectra.charge_variants(spectra.sequencer_headers(rows, ["at"])).collect())
    assert got == sorted((n, c, n, t, "PEPTIDE") for n, t in (("5", 10), ("7", 11), ("6", 12)) for c in (2, 3))


def test_ordinals_over_ranges(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x", "id % 3 AS y").repartition(5)
    assert sorted((r.x, r.n) for r in spectra.ordinals(rows, ["x"], "n").collect()) == [(i, i) for i in range(1000)]
    assert spectra.ordinals(rows.where("false"), ["x"], "n").count() == 0
    tied = [r.n for r in spectra.ordinals(rows.select("y"), ["y"], "n").orderBy("n").collect()]
    assert tied == list(range(1000))


@pytest.mark.parametrize("edge", [64, 2])
def test_large_slices_are_decomposed_in_blocks(spark, monkeypatch, edge):
    """The loop over blocks equals the kernel from the same start, slice by slice, with rounds of their own."""
    monkeypatch.setattr(block_cp, "EDGE", edge)
    rng = np.random.default_rng(8)
    tensors_of = {(1, 0): low_rank((3, 4, 5), 2, 1), (2, 1): low_rank((2, 5, 3), 2, 2)}
    rows = [(s, w, *map(int, at), float(v)) for (s, w), x in tensors_of.items() for at, v in np.ndenumerate(x)]
    cells = spark.createDataFrame(rows, "swath int, rt_window int, i int, j int, k int, v double")
    start = {key: [rng.random((n, 2)) for n in x.shape] for key, x in tensors_of.items()}
    begun = spark.createDataFrame([(s, w, m, int(i), int(r), float(v)) for (s, w), fs in start.items() for m, f in enumerate(fs) for (i, r), v in np.ndenumerate(f)], "swath int, rt_window int, mode int, idx int, comp int, value double")
    got = block_cp.decompose_large(cells, 2, max_iter=4, tol=1e-3, start=begun).collect()
    for (s, w), x in tensors_of.items():
        factors, errors = [f.copy() for f in start[s, w]], []
        for _ in range(4):
            for mode, path in enumerate(("ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr")):
                a, b = (factors[m] for m in range(3) if m != mode)
                factors[mode] = factors[mode] * np.maximum(np.einsum(path, x, a, b), 1e-11) / np.maximum(factors[mode] @ ((a.T @ a) * (b.T @ b)), 1e-11)
            errors.append(np.linalg.norm(np.einsum("ir,jr,kr->ijk", *factors) - x) / np.linalg.norm(x))
            if len(errors) > 2 and abs(errors[-2] - errors[-1]) < 1e-3:
                break
        own = [r for r in got if (r.swath, r.rt_window) == (s, w)]
        assert {r.iterations for r in own} == {len(errors)} and own[0].rsq == pytest.approx(1 - errors[-1] ** 2, abs=1e-9)
        assert {(r.mode, r.idx, r.comp): r.value for r in own} == pytest.approx({(m, i, r): v for m, f in enumerate(factors) for (i, r), v in np.ndenumerate(f)}, rel=1e-6)
    drawn = block_cp.decompose_large(cells.where("swath = 1"), 3, max_iter=1)
    assert drawn.count() == (3 + 4 + 5) * 3 and drawn.where("value < 0").count() == 0


@pytest.mark.parametrize("edge", [2, 64])
def test_blocks_return_the_places_of_their_start(spark, monkeypatch, edge):
    """Places that the start lacks, between others and after them, have no rows and count as 0, as nulls do."""
    monkeypatch.setattr(block_cp, "EDGE", edge)
    rng = np.random.default_rng(11)
    x, places = rng.random((3, 5, 6)), [[0, 1, 2], [0, 3], [1, 2, 4]]
    factors = [np.zeros((n, 2)) for n in x.shape]
    for f, own in zip(factors, places, strict=True):
        f[own] = rng.random((len(own), 2)) + 0.1
    factors[2][4, 1] = x[1, 3, 2] = 0.0  # null in the tables
    value = lambda v: float(v) if v else None
    cells = spark.createDataFrame([(1, 0, *map(int, at), value(v)) for at, v in np.ndenumerate(x)], "swath int, rt_window int, i int, j int, k int, v double")
    rows = [(1, 0, m, i, r, value(factors[m][i, r])) for m, own in enumerate(places) for i in own for r in range(2)]
    begun = spark.createDataFrame(rows, "swath int, rt_window int, mode int, idx int, comp int, value double")
    got = {(r.mode, r.idx, r.comp): r.value for r in block_cp.decompose_large(cells, 2, max_iter=1, start=begun).collect()}
    for mode, path in enumerate(("ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr")):
        a, b = (factors[m] for m in range(3) if m != mode)
        factors[mode] = factors[mode] * np.maximum(np.einsum(path, x, a, b), 1e-11) / np.maximum(factors[mode] @ ((a.T @ a) * (b.T @ b)), 1e-11)
    assert got.pop((2, 4, 1)) is None
    assert got == pytest.approx({(m, i, r): factors[m][i, r] for m, own in enumerate(places) for i in own for r in range(2) if (m, i, r) != (2, 4, 1)}, rel=1e-9)


def test_blocks_and_tasks_fit_the_same_models(spark, monkeypatch):
    """From the same random start, with rows of cells that are not there, and without models that are done."""
    monkeypatch.setattr(block_cp, "EDGE", 3)
    cells = []
    for s, shape in ((1, (3, 7, 5)), (2, (4, 4, 8))):
        x = low_rank(shape, 2, s)
        cells += [(s, 0, *map(int, at), float(v)) for at, v in np.ndenumerate(x) if v > np.quantile(x, 0.3) or min(at) == 0]
    cells = spark.createDataFrame(cells, "swath int, rt_window int, i int, j int, k int, v double")
    small = Config(parafac_min_comp=2, parafac_max_comp=2, parafac_max_iter=4, parafac_tolerance=1e-2)
    large = Config(parafac_min_comp=2, parafac_max_comp=2, parafac_max_iter=4, parafac_tolerance=1e-2, parafac_large_cells=110)
    by = lambda df: {tuple(r)[:6]: (r.value, r.rsq, r.iterations) for r in df.collect()}
    assert {r.swath: r["size"] for r in pipeline.dense_sizes(cells).collect()} == {1: 105, 2: 128}
    want = by(pipeline.fitted(cells, small))
    got = by(pipeline.fitted(cells, large))
    assert len(want) == (3 + 7 + 5 + 4 + 4 + 8) * 2 and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-7, abs=1e-9)
    earlier = pipeline.fitted(cells.where("swath = 2"), large).withColumn("value", F.lit(7.0))
    resumed = by(pipeline.fitted(cells, large, earlier))
    assert resumed.keys() == want.keys() and all(v[0] == 7.0 if k[0] == 2 else v == got[k] for k, v in resumed.items())


def test_sparse_imputation_equals_the_dense_grid(spark):
    rng = random.Random(9)
    rows = {(s, i, j, k): rng.choice([0.0, -1.0, rng.random(), 5.0]) for s in (1, 2) for i in range(3) for j in range(0, 24, s + 1) for k in range(4) if rng.random() < 0.2}
    coo = spark.createDataFrame([(s, 0, f"f{i}", j, 1, 5.0 + k, i, j, k, v) for (s, i, j, k), v in rows.items()], "swath int, rt_window int, file string, cycle int, level int, start double, i int, j int, k int, v double")
    by = lambda df: {(r.swath, r.i, r.j, r.k): r.v for r in df.collect()}
    whole, sparse = by(slices.impute(coo)), by(slices.impute_sparse(coo))
    assert {k: v for k, v in sparse.items() if v > 0} == pytest.approx({k: v for k, v in whole.items() if v > 0})
    assert rows.keys() <= sparse.keys() and len(sparse) <= 5 * len(rows)


def test_whole_r_squared_counts_cells_that_are_not_there(spark):
    rng = np.random.default_rng(10)
    x, factors = rng.random((3, 4, 5)) * (rng.random((3, 4, 5)) < 0.4), [rng.random((n, 2)) for n in (3, 4, 5)]
    cells = spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(x) if v], "i int, j int, k int, v double")
    tables = [spark.createDataFrame([(int(i), int(r), float(v)) for (i, r), v in np.ndenumerate(f)], "idx int, comp int, value double") for f in factors]
    want = 1 - ((x - np.einsum("ir,jr,kr->ijk", *factors)) ** 2).sum() / (x**2).sum()
    assert tensors.whole_r_squared(cells, *tables).first().rsq == pytest.approx(want)


def plain_peaks(width, profile, floor=0.1):
    """Peaks of one profile, scale by scale and line by line."""
    x = np.asarray(profile, float)
    if not len(x) or not np.isfinite(x).all() or x.max() <= 0:
        return 0
    pad = np.pad(np.where(x <= floor * x.max(), 0.0, x), 1)
    widths = models.widths_up_to(width)
    cwt = np.array([np.convolve(pad, models._wavelet(min(10 * int(a), len(pad)), float(a))[::-1], mode="same") for a in widths])
    near = lambda r, c: cwt[r, c] if 0 <= c < len(pad) else 0.0
    lines = []
    for row in range(len(widths) - 1, -1, -1):
        columns = [c for c in range(len(pad)) if cwt[row, c] > near(row, c - 1) and cwt[row, c] >= near(row, c + 1) and cwt[row, c] > 0]
        for line in (x for x in lines if x["gap"] <= 1):
            reach = max(1, int(widths[row]) // 4 + 1)
            own = min(((abs(c - line["at"][1]), c) for c in columns if abs(c - line["at"][1]) <= reach), default=None)
            if own:
                columns.remove(own[1])
                line.update(at=(row, own[1]), gap=0, n=line["n"] + 1)
            else:
                line["gap"] += 1
        lines += [{"at": (row, c), "gap": 0, "n": 1} for c in columns]
    half, odd = divmod(int(np.ceil(len(pad) / 20)), 2)
    found = set()
    for line in lines:
        row, c = line["at"]
        noise = np.percentile(cwt[0][max(c - half, 0) : min(c + half + odd, len(pad))], 10)
        if line["n"] >= max(1, int(np.ceil(len(widths) / 4))) and abs(cwt[row, c]) >= abs(noise) and pad[max(0, c - 1) : c + 2].max() > 0:
            found.add(c)
    return len(found)


def test_peaks_of_many_profiles_at_once():
    rng = np.random.default_rng(12)
    total = 0
    for size, width in ((1, 1.0), (2, 3.0), (7, 1.4), (30, 3.0), (64, 4.0), (64, 9.5), (150, 12.0)):
        t = np.arange(size)
        rows = [sum((rng.random() * np.exp(-(((t - rng.random() * size) / (1 + 3 * rng.random())) ** 2)) for _ in range(rng.integers(1, 6))), 0.05 * rng.random(size) * (n % 3)) for n in range(60)]
        rows = np.array([*rows, np.zeros(size), np.full(size, np.nan), -np.ones(size), rng.random(size)])
        got = models.count_peaks_of(width, rows)
        want = [plain_peaks(width, r) for r in rows]
        assert got.tolist() == want
        assert [models.count_peaks(width, r) for r in rows[:5]] == want[:5]
        total += sum(want)
    assert total > 500


def test_peaks_of_a_noisy_profile_by_the_noise_about_them():
    """A small peak in a quiet stretch counts, whatever the noise elsewhere is."""
    t = np.arange(200)
    rng = np.random.default_rng(0)
    x = np.exp(-0.5 * ((t - 50) / 4) ** 2) + 0.35 * np.exp(-0.5 * ((t - 150) / 4) ** 2) + np.where(t < 100, 0.02 * rng.random(200), 0)
    assert models.count_peaks(10.0, x) == 2


def test_map_of_a_file_by_name(spark):
    rng = np.random.default_rng(9)
    a, b, c, x = rng.random((2, 2)), rng.random((3, 2)), rng.random((2, 2)), rng.random((2, 3, 2))
    rows = [(1, 0, 2, 7, mode, int(i), int(r), float(v), 0.9, 5) for mode, m in enumerate((a, b, c)) for (i, r), v in np.ndenumerate(m)]
    factors = spark.createDataFrame(rows, "swath int, rt_window int, ncomp int, model_id int, mode int, idx int, comp int, value double, rsq double, iterations int")
    files = {0: "zeta", 1: "alpha"}  # rows of the tensor need not be in the order of names
    coo = spark.createDataFrame([(1, 0, files[i], int(i), int(j), int(k), float(v), 100.5 + k, 1 + k) for (i, j, k), v in np.ndenumerate(x)], "swath int, rt_window int, file string, i int, j int, k int, v double, start double, level int")
    counts = spark.createDataFrame([(7, 0, 2), (7, 1, 1)], "model_id int, comp int, npeaks int")
    rsq = spark.createDataFrame([(1, 0, 2, 0.8)], "swath int, rt_window int, ncomp int, rsq double")
    fit = np.outer(b[:, 1], c[:, 1]) * a[1, 1]
    top = np.unravel_index(fit.argmax(), fit.shape)
    got = {(r.cycle, r.mz, r.level): r.intensity for r in models.reconstructed_map(factors, coo, counts, rsq, 0).collect()}
    assert got == pytest.approx({(j, 100.5 + k, 1 + k): v * x[1][top] * 0.8 / fit[top] for (j, k), v in np.ndenumerate(fit)})
    assert models.reconstructed_map(factors, coo, counts, rsq, 2).count() == 0
    assert models.reconstructed_map(factors, coo, counts.where("npeaks = 2"), rsq, 0).count() == 0


def test_labels_of_another_form_are_an_error(spark):
    mode = spark.createDataFrame([(1, 0, 0, 1.5)], "swath int, rt_window int, idx int, value double")
    axis = lambda label: spark.createDataFrame([(1, 0, 0, label)], "swath int, rt_window int, idx int, label string")
    assert [(r.mz, r.level) for r in models.with_mz_index(mode, axis("100.5_ms2")).collect()] == [(100.5, 2)]
    with pytest.raises(Exception, match="no m/z label"):
        models.with_mz_index(mode, axis("100.5")).collect()


def test_boundaries_are_released(spark, tmp_path):
    with released(spark):
        path = boundary(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_registered_decomposition_has_the_production_values(spark, monkeypatch):
    """q46 equals plain multiplicative updates with every number of components and as many rounds as Config allows."""
    x, config = low_rank((3, 4, 5), 3, 4), Config()
    dense = spark.createDataFrame([(7, 1, *map(int, at), float(v)) for at, v in np.ndenumerate(x)], "swath int, rt_window int, i int, j int, k int, v double")
    monkeypatch.setattr(queries, "_dense", lambda *_: dense)
    got = {r.ncomp: r for r in queries.q46_parafac(spark, "").collect()}
    assert set(got) == set(range(config.parafac_min_comp, config.parafac_max_comp + 1)) == set(range(2, 21))
    assert max(r.iterations for r in got.values()) > 60
    for rank in (2, 3, 20):
        rng = np.random.default_rng(zlib.crc32(f"7/1/{rank}/{config.parafac_seed}".encode()))
        factors, errors = [rng.random((n, rank)) for n in x.shape], []
        while len(errors) < config.parafac_max_iter and (len(errors) < 3 or abs(errors[-2] - errors[-1]) >= config.parafac_tolerance):
            for mode in range(3):
                a, b = (factors[m] for m in range(3) if m != mode)
                khatri_rao = np.array([[a[p, r] * b[q, r] for r in range(rank)] for p in range(len(a)) for q in range(len(b))])
                top = np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1) @ khatri_rao
                factors[mode] = factors[mode] * np.maximum(top, 1e-11) / np.maximum(factors[mode] @ (khatri_rao.T @ khatri_rao), 1e-11)
            errors.append(np.linalg.norm(np.einsum("ir,jr,kr->ijk", *factors) - x) / np.linalg.norm(x))
        assert abs(got[rank].rsq - (1 - errors[-1] ** 2)) < 1e-5, rank


def test_wide_slice_has_every_ordinal(spark):
    cells = [(1, 0, i, j, k, float(100 * i + 10 * j + k)) for i in range(2) for j in range(2) for k in range(40) if (i + j + k) % 3]
    got = slices.wide_slice(spark.createDataFrame(cells, "swath int, rt_window int, i int, j int, k int, v double")).collect()
    assert len(got) == 4 and sorted((r.swath, r.rt_window, r.i, r.j, k, v) for r in got for k, v in zip(r.ks, r.vs, strict=True)) == cells
    assert all(r.ks == sorted(r.ks) for r in got)
