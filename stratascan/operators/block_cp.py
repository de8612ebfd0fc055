"""Non-negative decomposition of slices too large for a task, in blocks.

The cells of a slice are laid out once in blocks of (i, j, k). A factor is a row per block of its places. In each mode every block of cells meets the two blocks of factors
that it needs, as small arrays; tasks add up the products of their blocks before they are shuffled, and each block of the mode is updated from the sum, its own values and
the Gram matrices, which factor rows carry for themselves and a slice's are added up. So a mode is one pass over the cells, written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratascan.operators.slices import SLICE
from stratascan.operators.tensors import FLOOR, MODEL, own_seed
from stratascan.plans.boundary import boundary, drop

#: Places on an axis that a block holds.
EDGE = 64
#: Sums of blocks that a task holds before it hands them on.
HELD = 500
AXES = "ijk"
_FACTOR = "swath int, rt_window int, mode int, b int, f array<double>, g array<double>, cross double"


def blocks_of(cells: DataFrame) -> DataFrame:
    """(slice, bi, bj, bk, i, j, k, v): a block's cells as arrays, places from the block's beginning; a cell comes once."""
    within = [F.pmod(a, F.lit(EDGE)).cast("int").alias(a) for a in AXES]
    rows = cells.select(*SLICE, *[F.floor(F.col(a) / EDGE).cast("int").alias(f"b{a}") for a in AXES], F.struct(*within, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")).alias("c"))
    held = rows.groupBy(*SLICE, "bi", "bj", "bk").agg(F.collect_list("c").alias("c"))
    return boundary(held.select(*SLICE, "bi", "bj", "bk", *[F.col("c")[x].alias(x) for x in (*AXES, "v")]), "block-cells")


def _factor_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (swath, rt_window, mode, b, matrix, cross)."""
    ints = [pa.array([int(r[c]) for r in rows], pa.int32()) for c in range(4)]
    longs = pa.list_(pa.float64())
    f, g = [r[4].ravel() for r in rows], [(r[4].T @ r[4]).ravel() for r in rows]
    return pa.RecordBatch.from_arrays([*ints, pa.array(f, longs), pa.array(g, longs), pa.array([float(r[5]) for r in rows], pa.float64())], ["swath", "rt_window", "mode", "b", "f", "g", "cross"])


def drawn(cells: DataFrame, ncomp: int, seed: int) -> DataFrame:
    """The factors that :func:`stratascan.operators.tensors.decompose` begins with, each block drawn by itself."""
    sizes = cells.groupBy(*SLICE).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])
    parts = [sizes.select("*", F.lit(m).alias("mode"), F.explode(F.sequence(F.lit(0), F.floor((F.col(f"n{a}") - 1) / EDGE).cast("int"))).alias("b")) for m, a in enumerate(AXES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = [r[f"n{a}"] for a in AXES]
                draws = np.random.PCG64(own_seed(r["swath"], r["rt_window"], ncomp, seed))
                draws.advance((sum(n[: r["mode"]]) + r["b"] * EDGE) * ncomp)
                x = np.random.Generator(draws).random((min(EDGE, n[r["mode"]] - r["b"] * EDGE), ncomp))
                yield _factor_rows([(r["swath"], r["rt_window"], r["mode"], r["b"], x, 0.0)])

    return parts[0].unionByName(parts[1]).unionByName(parts[2]).mapInArrow(run, _FACTOR)


def from_table(start: DataFrame, ncomp: int) -> DataFrame:
    """Factors (slice, mode, idx, comp, value) as blocks; values that are not there, or null, are 0 and stay 0."""
    rows = start.groupBy(*SLICE, "mode", F.floor(F.col("idx") / EDGE).cast("int").alias("b")).agg(F.collect_list(F.struct("idx", "comp", "value")).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = np.zeros((max(c["idx"] for c in r["c"]) % EDGE + 1, ncomp))
                for c in r["c"]:
                    x[c["idx"] % EDGE, c["comp"]] = 0.0 if c["value"] is None else c["value"]
                yield _factor_rows([(r["swath"], r["rt_window"], r["mode"], r["b"], x, 0.0)])

    return rows.mapInArrow(run, _FACTOR)


def products(blocks: DataFrame, factors: DataFrame, mode: int, ncomp: int) -> DataFrame:
    """(slice, b, m): sums over blocks of cells times the two other factors, by block of the mode; a row per task and block."""
    p, q = (m for m in range(3) if m != mode)
    sent = blocks.select(*SLICE, "bi", "bj", "bk")
    for side, m in (("fp", p), ("fq", q)):
        sent = sent.join(factors.where(F.col("mode") == m).select(*SLICE, F.col("b").alias(f"b{AXES[m]}"), F.col("f").alias(side)), [*SLICE, f"b{AXES[m]}"])
    rows = blocks.join(sent, [*SLICE, "bi", "bj", "bk"]).select(*SLICE, F.col(f"b{AXES[mode]}").alias("b"), F.col(AXES[mode]).alias("own"), F.col(AXES[p]).alias("p"), F.col(AXES[q]).alias("q"), "v", "fp", "fq")

    def at_places(f: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of a block of factors; one that ends before a place has 0 there."""
        f = f.reshape(-1, ncomp)
        return np.where((at < len(f))[:, None], f[np.minimum(at, len(f) - 1)], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            keys = [pa.array([k[c] for k in held], pa.int32()) for c in range(3)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([m.ravel() for m in held.values()], pa.list_(pa.float64()))], ["swath", "rt_window", "b", "m"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*SLICE, "b")), strict=True))
            for n, key in enumerate(keys):
                own, at_p, at_q, v, fp, fq = (batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in ("own", "p", "q", "v", "fp", "fq"))
                terms = v[:, None] * at_places(fp, at_p) * at_places(fq, at_q)
                total = held.setdefault(key, np.zeros((EDGE, ncomp)))
                for r in range(ncomp):
                    total[:, r] += np.bincount(own, terms[:, r], EDGE)
            if len(held) > HELD:
                yield sums()
                held.clear()
        if held:
            yield sums()

    return rows.mapInArrow(run, "swath int, rt_window int, b int, m array<double>")


def grams(factors: DataFrame) -> DataFrame:
    """(slice, mode, gram) of whole slices."""
    sums = factors.select(*SLICE, "mode", F.posexplode("g").alias("at", "x")).groupBy(*SLICE, "mode", "at").agg(F.sum("x").alias("x"))
    return sums.groupBy(*SLICE, "mode").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("gram"))


def updated(blocks: DataFrame, factors: DataFrame, mode: int, ncomp: int) -> DataFrame:
    """The factors with one mode made anew; ``cross`` is its inner product with the sums."""
    p, q = (m for m in range(3) if m != mode)
    whole = grams(factors.where(F.col("mode") != mode))
    other = {m: whole.where(F.col("mode") == m).select(*SLICE, F.col("gram").alias(f"gram{m}")) for m in (p, q)}
    own = factors.where(F.col("mode") == mode).join(other[p], SLICE).join(other[q], SLICE).select(*SLICE, "b", "f", F.zip_with(f"gram{p}", f"gram{q}", lambda x, y: x * y).alias("gram"))
    key = [*SLICE, "b"]
    zero = F.array_repeat(F.lit(0.0), EDGE * ncomp)
    total = F.aggregate(F.collect_list("m"), zero, lambda s, m: F.zip_with(s, m, lambda x, y: x + y))
    rows = own.join(products(blocks, factors, mode, ncomp).groupBy(*key).agg(total.alias("m")), key, "left").select(*key, "f", "gram", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, (swath, window, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in key), strict=True)):
                f, gram = (batch.column(c)[n].values.to_numpy(zero_copy_only=False).reshape(-1, ncomp) for c in ("f", "gram"))
                m = batch.column("m")[n].values  # none where the block has no cells
                m = np.zeros_like(f) if m is None else m.to_numpy(zero_copy_only=False).reshape(EDGE, ncomp)[: len(f)]
                f = f * (np.maximum(m, FLOOR) / np.maximum(f @ gram, FLOOR))
                out.append((swath, window, mode, b, f, (m * f).sum()))
            yield _factor_rows(out)

    new = rows.mapInArrow(run, _FACTOR)
    return factors.where(F.col("mode") != mode).unionByName(new)


def errors_of(factors: DataFrame, norms: DataFrame) -> DataFrame:
    """(slice, error): relative, after the last mode."""
    cross = factors.where("mode = 2").groupBy(*SLICE).agg(F.sum("cross").alias("cross"))
    size = grams(factors).groupBy(*SLICE).agg(F.collect_list("gram").alias("g"))
    zero = F.lit(0.0)
    total = F.aggregate(F.zip_with(F.zip_with(F.col("g")[0], F.col("g")[1], lambda x, y: x * y), F.col("g")[2], lambda x, y: x * y), zero, lambda s, x: s + x)
    left = F.greatest(F.col("norm2") - 2 * F.col("cross") + F.col("size"), zero)
    rows = norms.join(cross, SLICE).join(size.select(*SLICE, total.alias("size")), SLICE)
    return rows.select(*SLICE, F.when(F.col("norm2") > 0, F.sqrt(left / F.col("norm2"))).otherwise(0.0).alias("error"))


def decompose_large(cells: DataFrame, ncomp: int, max_iter: int = 2000, tol: float = 1e-7, seed: int = 123, start: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """What :func:`stratascan.operators.tensors.decompose` returns for one number of components, of slices of any size and from the same random start. Slices go through the same
    rounds; one whose error has settled takes no part in those that follow. Cells that are not there count as 0. ``start`` (slice, mode, idx, comp, value) are other factors to
    begin with, whose rows are the rows of the result; a null among them counts as 0 and stays null. ``done`` (slice, ncomp) names models to skip.
    """
    spark = cells.sparkSession
    if done is not None:
        cells = cells.join(done.where(F.col("ncomp") == ncomp).select(*SLICE).distinct(), SLICE, "left_anti")
    blocks = blocks_of(cells)
    norms = boundary(cells.groupBy(*SLICE).agg(F.sum(F.col("v") * F.col("v")).alias("norm2")), "block-norms")
    factors = boundary(drawn(cells, ncomp, seed) if start is None else from_table(start, ncomp).join(norms.select(*SLICE), SLICE, "left_semi"), "block-factors")
    before = norms.select(*SLICE, F.lit(None).cast("double").alias("error"))
    settled: list[DataFrame] = []
    for n in range(1, max_iter + 1):
        for mode in range(3):
            old, factors = factors, boundary(updated(blocks, factors, mode, ncomp), "block-factors")
            drop(old)
        now = errors_of(factors, norms).join(before.withColumnRenamed("error", "was"), SLICE)
        still = F.lit(n == max_iter) | (F.lit(n > 2) & F.coalesce(F.abs(F.col("was") - F.col("error")) < tol, F.lit(False)))
        now = boundary(now.select(*SLICE, "error", still.alias("settled")), "block-errors")
        counts = now.groupBy("settled").count().collect()  # two numbers
        if any(r["settled"] for r in counts):
            ended = now.where("settled").select(*SLICE, (1 - F.col("error") * F.col("error")).alias("rsq"), F.lit(n).alias("iterations"))
            settled.append(boundary(factors.join(ended, SLICE).drop("g", "cross"), "block-models"))
            factors = factors.join(now.where("NOT settled").select(*SLICE), SLICE, "left_semi")
            factors = boundary(factors, "block-factors")
        before = now.where("NOT settled").select(*SLICE, "error")
        if not any(not r["settled"] for r in counts):
            break
    schema = ", ".join(f"{c} {'double' if c in ('value', 'rsq') else 'int'}" for c in MODEL)
    if not settled:
        return spark.createDataFrame([], schema)
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    values = rows.select(*SLICE, "mode", "b", "rsq", "iterations", F.posexplode("f").alias("at", "value"))
    idx, comp = F.col("b") * EDGE + F.floor(F.col("at") / ncomp), F.pmod("at", F.lit(ncomp))
    values = values.select(*SLICE, F.lit(ncomp).alias("ncomp"), "mode", idx.cast("int").alias("idx"), comp.cast("int").alias("comp"), "value", "rsq", "iterations")
    if start is None:
        return values.select(*MODEL)
    place = [*SLICE, "mode", "idx", "comp"]  # a block also holds the places between those of the start
    held = values.join(start.select(*place, F.col("value").isNotNull().alias("_held")), place)
    return held.withColumn("value", F.when(F.col("_held"), F.col("value"))).select(*MODEL)
