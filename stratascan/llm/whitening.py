"""Embedding whitening with distributed block matrices.

A component c of a vector becomes the whole number x = floor(1024 * c) + 100000. All vectors are the list that is fitted. They are numbered, centred and laid out as
blocks of rows of a ``BlockMatrix``. Its transpose times itself is the scatter, added up over many tasks, one square block in the end; its eigenvectors are
found on the driver, and a second block product with the whitening matrix projects all rows. The covariance of what comes out is a block product too.

With n vectors and sums S, n * x - S is a whole number, exact in 64 bits as its places beyond wrap round; one division centres it. ``deviation``, the sum
of its squares, is exact, and null where it doesn't fit 64 bits.

The driver holds matrices of the vector's length squared, and the places of the blocks, one for ``BLOCK_BYTES`` of rows. A component whose variance is
nothing but rounding can't be scaled: its ``whitened`` is null, and it takes no part in ``identity_error``, which is null if no component does; ``explained`` is null where
no component has variance. Vectors that are null or hold null or non-finite entries are dropped, and so are those of another length than the most common one (the shorter of equally common
ones), empty vectors, and those with an entry beyond ``LARGEST``. Ids may be null or repeat; each row is a vector. An empty table gives an empty result. Only vec_id
and embedding are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.llm.common import materialize, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of a larger size don't fit the whole numbers.
LARGEST = float(1 << 30)
BLOCK_BYTES = 1 << 20
#: Blocks whose products one task adds up.
BLOCKS_A_TASK = 8


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    c = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST)) & (F.size(c) > 0)
    x = F.transform(c, lambda e: F.floor(e * SCALE) + SHIFT)
    rows = vectors.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return rows.join(F.broadcast(common), F.size("x") == F.col("d")).drop("d")


def numbered(rows: DataFrame) -> DataFrame:
    """``index``: rows from 0 without a gap, in no special order; a written table."""
    marked = materialize(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "white-rows")
    sums = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per task that wrote
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(before), "_part").withColumn("index", F.col("_before") + within).drop("_id", "_part", "_before")


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, sums by dimension) of rows (x); tasks add up what they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([matrix(b.column(0)).sum(axis=0)], pa.list_(pa.int64()))], ["n", "sums"])

    parts = rows.select("x").mapInArrow(run, "n long, sums array<long>")
    total = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).orderBy("i").collect()
    return (total[0]["n"], [int(r["s"]) for r in total]) if total else (0, [])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S. Products may wrap round, differences then wrap back."""
    wrapped = np.array([s & (2**64 - 1) for s in total], np.uint64)
    return (x.view(np.uint64) * np.uint64(n) - wrapped).view(np.int64)


def deviations(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row, None where one doesn't fit."""
    rough = (y.astype(np.float64) ** 2).sum(axis=1)
    return [s if r < 9e18 else exact if r < 9.5e18 and (exact := sum(int(v) ** 2 for v in row)) < 2**63 else None for r, s, row in zip(rough.tolist(), (y * y).sum(axis=1).tolist(), y, strict=True)]


def centred(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """(index, vec_id, deviation, y): y the vectors less their mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = scaled(matrix(b.column("x")), n, total)
                yield pa.RecordBatch.from_arrays([b.column("index"), b.column("vec_id"), pa.array(deviations(y), pa.int64()), pa.array(list(y / n), pa.list_(pa.float64()))], ["index", "vec_id", "deviation", "y"])

    return rows.select("index", "vec_id", "x").mapInArrow(run, "index long, vec_id long, deviation long, y array<double>")


def as_blocks(rows: DataFrame, column: str, n: int, width: int) -> BlockMatrix:
    """Rows (index, column) as blocks of about ``BLOCK_BYTES``, each of the whole width."""
    height = max(1, BLOCK_BYTES // (8 * width))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(column).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(height, width)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times itself. Its single block is a sum over all blocks of rows, so the products are split along them."""
    splits = -(-blocks.numRowBlocks // BLOCKS_A_TASK)
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def rows_of(blocks: BlockMatrix, column: str) -> DataFrame:
    """(index, column) of a block matrix, as arrays."""
    rows = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias(column))


class Whitening(NamedTuple):
    """What is fitted: number and sums of the vectors, eigenvalues from the largest on, their eigenvectors as columns, and the trace."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Which components have a variance beyond rounding."""
        return self.values > max(len(self.total), 1) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def weights(self) -> np.ndarray:
        """The whitening matrix: a column per component, 0 where it is not usable."""
        scale = np.where(self.usable, 1 / np.sqrt(np.where(self.usable, self.values, 1.0)), 0.0)
        return self.vectors * scale


def fit(blocks: BlockMatrix, n: int, total: list[int], components: int = COMPONENTS) -> Whitening:
    """The components of the largest variance."""
    v = scatter(blocks) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    return Whitening(n, total, values[::-1][:components], vectors[:, ::-1][:, :components], float(np.trace(v)))


def identity_error(rows: DataFrame, column: str, fitted: Whitening) -> float | None:
    """Largest entry of the covariance of whitened rows less the identity."""
    usable = np.flatnonzero(fitted.usable)
    if not len(usable):
        return None
    means = rows.select([F.avg(F.col(column)[int(i)]).alias(f"m{i}") for i in usable]).first()
    rest = rows.select("index", F.array(*[F.col(column)[int(i)] - means[f"m{i}"] for i in usable]).alias("y"))
    cov = scatter(as_blocks(rest, "y", fitted.n, len(usable))) / fitted.n
    return float(np.abs(cov - np.eye(len(usable))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(index, vec_id, deviation, white) of every vector that takes part, a written table, and what was fitted; None without any vector."""
    spark = vectors.sparkSession
    rows = numbered(whole_numbers(vectors))
    n, total = sums(rows)
    if not n:
        return spark.createDataFrame([], "index long, vec_id long, deviation long, white array<double>"), None
    width = len(total)
    held = materialize(centred(rows, n, total), "white-centred")
    blocks = as_blocks(held, "y", n, width)
    fitted = fit(blocks, n, total, components)
    weights = fitted.weights()
    local = spark.sparkContext.parallelize([((0, 0), Matrices.dense(width, weights.shape[1], weights.ravel(order="F").tolist()))], 1)
    white = rows_of(blocks.multiply(BlockMatrix(local, width, weights.shape[1], width, weights.shape[1])), "white")
    return materialize(held.select("index", "vec_id", "deviation").join(white, "index"), "white-projected"), fitted


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first components, whitened."""
    rows, fitted = whiten(table(spark, sf_dir, "embeddings"))
    if fitted is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = [float(e) / fitted.trace if fitted.trace > 0 else None for e in fitted.values]
    usable = [bool(u) for u in fitted.usable]
    own = rows.select("vec_id", "deviation", F.posexplode("white").alias("i", "w"))
    constant = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")[F.col("i")]
    return own.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", F.when(constant(usable, "boolean"), F.col("w")).alias("whitened"),
        constant(shares, "double").alias("explained"), F.lit(identity_error(rows, "white", fitted)).cast("double").alias("identity_error"),
    )
