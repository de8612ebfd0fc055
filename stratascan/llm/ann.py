"""Approximate nearest neighbours by inner product: a hash-prefix forest.

A vector x becomes (x / M, sqrt(1 - |x / M|^2)), M the largest norm, so that the largest inner product with a query is the
smallest angle. Each of ``TREES`` trees gives a vector a string of 32 bits, the signs of random projections, and holds the rows in a
sorted array of these strings. A query descends in every tree to the longest prefix that it shares with another row's string; its own row is
left out. From the longest of these it ascends in all trees at once, one bit and within a bit one tree at a time, taking in the rows that share the
shorter prefix, until it has met enough rows. So every query stops at a prefix of its own. The rows met, and those equal to the query,
are scored exactly, on the original vectors in double precision.

How many rows are enough is measured, not guessed: for at most ``PROBES`` queries the true neighbours are found by brute force over all rows,
and so is how many rows the ascent meets before each of them; the number kept is the one that reaches ``RECALL`` of them. Random vectors
have neighbours that are hardly nearer than other rows, so that a large part of the rows is scored; where neighbours are near it is a few.

The index is cut into shards of ``SHARD_ROWS`` rows with a forest each. A query asks every shard for its part of the number and the best of
all shards are its result. A shard's rows come to its task first, and its forest is built once; then all queries pass by, some at a time, so no task holds more than a shard.

Equal vectors are one row of the index, with their smallest ids, as many as a result can hold. Vectors that are null, zero or hold null or
non-finite components take no part, nor do null ids or vectors of another length than the most common one. A repeated id with the same
vector is one row; with different vectors each is a query, and results are the best of both. Equal scores go by vec_id. An empty table gives an
empty result. Only vec_id and embedding are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.llm.common import materialize, shuffle_partitions, table

TREES = 128
BITS = 32
NEAREST = 20
#: Queries whose neighbours are found by brute force, to set how many rows a query meets.
PROBES = 64
RECALL = 0.95
SHARD_ROWS = 16384
SEED = 17
#: Rows hashed at a time.
_STEP = 2048


class Forest:
    """Sorted hash strings of one shard, and the planes they are made with."""

    def __init__(self, dim: int, seed: int = SEED, trees: int = TREES) -> None:
        self.trees = trees
        self.planes = np.random.default_rng(seed).standard_normal((dim + 1, trees * BITS)).astype(np.float32)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) of unsigned 32-bit strings, first bit highest."""
        out = np.empty((len(x), self.trees), np.uint32)
        for at in range(0, len(x), _STEP):
            part = x[at : at + _STEP].astype(np.float32)
            signs = (part @ self.planes > 0).reshape(len(part), self.trees, BITS)
            out[at : at + _STEP] = np.packbits(signs, axis=2).view(">u4")[:, :, 0]
        return out

    def build(self, x: np.ndarray) -> None:
        """One sorted array of strings per tree, and the rows they stand for."""
        labels = self.strings(x)
        self.order = np.empty((self.trees, len(x)), np.int32)
        self.sorted = np.empty((self.trees, len(x)), np.uint32)
        for t in range(self.trees):
            self.order[t] = np.argsort(labels[:, t], kind="stable")
            self.sorted[t] = labels[self.order[t], t]

    def descend(self, q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Length of the longest prefix that each query (rows of strings) shares with a string of any tree; ``own`` is the query's row here, or -1."""
        best = np.zeros(len(q), np.int64)
        n = self.sorted.shape[1]
        for t, held in enumerate(self.sorted):
            lo, hi = np.searchsorted(held, q[:, t], "left"), np.searchsorted(held, q[:, t], "right")
            equal = hi - lo - (own >= 0) > 0
            best = np.maximum(best, np.where(equal, BITS, 0))
            for near, there in ((lo - 1, lo > 0), (hi, hi < n)):
                best = np.maximum(best, np.where(there, shared_bits(held[np.clip(near, 0, n - 1)] ^ q[:, t]), 0))
        return best

    def edges(self, q: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees) first and last position of the strings that share ``level`` bits with each query's."""
        shift = np.uint32(BITS - level)
        low = (q >> shift) << shift if level else np.zeros_like(q)
        high = low | np.uint32((1 << (BITS - level)) - 1)
        lo, hi = np.empty(q.shape, np.int64), np.empty(q.shape, np.int64)
        for t, held in enumerate(self.sorted):
            lo[:, t], hi[:, t] = np.searchsorted(held, low[:, t], "left"), np.searchsorted(held, high[:, t], "right")
        return lo, hi

    def candidates(self, q: np.ndarray, own: np.ndarray, want: int) -> Iterator[np.ndarray]:
        """For each query the rows met on the way up from its longest prefix until they are ``want``, its own row not counted but among them."""
        n = self.sorted.shape[1]
        level = self.descend(q, own)
        want = min(want, n)
        before: list = [None] * len(q)
        after: list[list] = [[] for _ in range(len(q))]
        # strings in the prefixes of all trees are at least as many as rows, so until they are enough a level is taken whole
        live = np.arange(len(q))
        for at in range(int(level.max(initial=0)), -1, -1):
            on = live[level[live] >= at]
            if not len(on):
                continue
            lo, hi = self.edges(q[on], at)
            strings = (hi - lo).sum(axis=1) - self.trees * (own[on] >= 0)
            for j, i in enumerate(on):
                if strings[j] >= want:
                    after[i].append((at, lo[j], hi[j]))
                else:
                    before[i] = (lo[j], hi[j])
            live = np.setdiff1d(live, on[strings >= 4 * want])
        for i in range(len(q)):
            found = np.zeros(n, bool)
            if own[i] >= 0:
                found[own[i]] = True
            if before[i]:
                for order, a, b in zip(self.order, *before[i], strict=True):
                    found[order[a:b]] = True
            short = want + (own[i] >= 0)
            enough = any(self._take(found, lo, hi, short) for _, lo, hi in after[i])
            at = after[i][-1][0] if after[i] else 0
            while not enough and at:  # the trees hold the same rows
                at -= 1
                (lo,), (hi,) = self.edges(q[i : i + 1], at)
                enough = self._take(found, lo, hi, short)
            yield np.flatnonzero(found)

    def _take(self, found: np.ndarray, first: np.ndarray, last: np.ndarray, short: int) -> bool:
        """Take in one tree after the other; whether there are enough rows then."""
        for order, a, b in zip(self.order, first, last, strict=True):
            found[order[a:b]] = True
            if np.count_nonzero(found) >= short:
                return True
        return False


def shared_bits(differing: np.ndarray) -> np.ndarray:
    """Leading bits in which two strings agree, from their exclusive or."""
    return np.where(differing == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(differing, 0.5)))).astype(np.int64)


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows scaled to the unit ball and lifted onto the sphere above it."""
    y = x / norm
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))])


def aim(q: np.ndarray) -> np.ndarray:
    """Queries as unit vectors of one dimension more."""
    return np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, best first, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def likely(scores: np.ndarray, k: int, scale: float) -> np.ndarray:
    """Positions that may be among the k best, given scores that rounding has changed by far less than 1e-9 of ``scale``."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9 * scale)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, summed in the same order whatever the rows are."""
    return (x * q).sum(axis=1)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part; v has double components, no negative zeros."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return rows.join(F.broadcast(common), F.size("v") == F.col("d")).drop("d")


class Shard:
    """Rows of a shard as they come, and their forest from the first question on."""

    def __init__(self, dim: int, norm: float) -> None:
        self.dim, self.norm, self.parts, self.ids, self.forest = dim, norm, [], [], None

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append(_matrix(rows.column("v")))
        self.ids += rows.column("ids").to_pylist()

    @property
    def size(self) -> int:
        return len(self.ids)

    def nearest(self, asking: list[int], q: np.ndarray, k: int, want: int) -> list[tuple[int, int, float]]:
        """(query, vec_id, score) of the best found for each query, scored on the original vectors."""
        if not self.ids:
            return []
        if self.forest is None:
            self.x, self.parts = np.concatenate(self.parts), []
            self.forest = Forest(self.dim)
            self.forest.build(lift(self.x, self.norm))
            self.first = np.array([i[0] for i in self.ids])
            self.place = {row.tobytes(): i for i, row in enumerate(self.x)}
        out = []
        own = np.array([self.place.get(row.tobytes(), -1) for row in q])
        for query_id, vector, met in zip(asking, q, self.forest.candidates(self.forest.strings(aim(q)), own, want), strict=True):
            met = met[likely(self.x[met] @ vector, k + 1, self.norm * np.linalg.norm(vector))]
            scores = exact_scores(vector, self.x[met])
            near = [(-scores[b], i) for b in top(self.first[met], scores, k + 1) for i in self.ids[met[b]] if i != query_id]
            out += [(query_id, i, -s) for s, i in sorted(near)[:k]]
        return out


class Index(NamedTuple):
    """Distinct vectors (v, ids), their number, largest norm and length, and how many of them a query meets."""

    rows: DataFrame
    n: int
    norm: float
    dim: int
    meets: int


def index_of(rows: DataFrame, queries: DataFrame, k: int = NEAREST, recall: float = RECALL) -> Index | None:
    """The index of valid vectors, fitted for queries among them; None without any."""
    # of equal vectors the k + 1 smallest ids can be in a result, the query's own not counted
    ranked = rows.dropDuplicates(["vec_id", "v"]).withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    index = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-index")
    facts = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"), F.max(F.size("v")).alias("dim")).first()
    if not facts["n"]:
        return None
    n, norm, dim = int(facts["n"]), float(facts["norm"]), int(facts["dim"])
    return Index(index, n, norm, dim, min(n, max(4 * k, _meets(queries, index, norm, dim, k, recall))))


def search(vectors: DataFrame, every: int = 20, k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each vector whose id is divisible by ``every``."""
    rows = valid(vectors)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    found = index_of(rows, queries, k, recall)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, n, norm, dim, meets = found
    shards = max(1, -(-n // SHARD_ROWS))
    left = index.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).alias("shard"), F.lit(0).alias("asks"), "ids", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"), F.array("vec_id").alias("ids"), "v")

    def answers(shard: Shard, asked: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(asked)
        found = shard.nearest([i[0] for i in part.column("ids").to_pylist()], _matrix(part.column("v")), k, -(-meets * shard.size // n))
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, asked = None, None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("shard", "asks")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if own != keys[0, i]:
                    if asked:
                        yield answers(shard, asked)
                    shard, own, asked = Shard(dim, norm), keys[0, i], []
                if keys[1, i] == 0:
                    shard.add(b.slice(i, j - i))
                else:
                    asked.append(b.slice(i, j - i))
                    if sum(map(len, asked)) >= _STEP:
                        yield answers(shard, asked)
                        asked = []
        if asked:
            yield answers(shard, asked)

    rows = left.unionByName(right).repartition(max(shards, shuffle_partitions(vectors.sparkSession)), "shard").sortWithinPartitions("shard", "asks")
    best = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranks = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _meets(queries: DataFrame, index: DataFrame, norm: float, dim: int, k: int, recall: float) -> int:
    """How many rows of the index a query meets, its own not counted, before it has met ``recall`` of its true neighbours, by a sample of the queries."""
    probes = queries.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(PROBES).collect()
    if not probes:
        return 0
    q = np.array([p["v"] for p in probes], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            scores = x @ q.T
            at = [(i, j) for i in range(len(q)) for j in np.argsort(-scores[:, i])[: k + 1]]
            own = np.array([j for _, j in at], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([float(scores[j, i]) for i, j in at]), b.column("v").take(pa.array(own))], ["probe", "score", "v"])

    best = index.select("v").mapInArrow(nearest, "probe int, score double, v array<double>")
    nth = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "v"))
    rows = best.withColumn("nth", nth).where(F.col("nth") <= k + 1).collect()  # at most PROBES * (k + 1)
    rows = [r for r in rows if not np.array_equal(r["v"], q[r["probe"]])]
    if not rows:
        return 0
    of = np.array([r["probe"] for r in rows])
    forest = Forest(dim)
    own = forest.strings(aim(q))
    theirs = forest.strings(lift(np.array([r["v"] for r in rows], np.float64), norm))
    # the order of the ascent: the smaller the exclusive or in the best tree, the longer the prefix and the sooner the row is met
    met = [np.sort((own[of[of == i]] ^ theirs[of == i]).min(axis=1)) for i in range(len(q))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_forest = Forest(dim)
        for b in batches:
            x = _matrix(b.column("v"))
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                strings = own_forest.strings(lift(part, norm))
                out = []
                for i, edge in enumerate(met):
                    others = ~(part == q[i]).all(axis=1)
                    out += [(i, j, int(c)) for j, c in enumerate(np.searchsorted(np.sort((strings[others] ^ own[i]).min(axis=1)), edge, "right")) if c]
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["probe", "nth", "n"])

    ranks = index.select("v").mapInArrow(count, "probe int, nth int, n long").groupBy("probe", "nth").agg(F.sum("n").alias("n")).collect()  # at most PROBES * (k + 1)
    return int(np.quantile([r["n"] for r in ranks], recall, method="higher"))


def met_share(vectors: DataFrame, every: int = 20, k: int = NEAREST, recall: float = RECALL) -> float:
    """Share of the distinct vectors that :func:`search` scores for a query."""
    rows = valid(vectors)
    found = index_of(rows, rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"]), k, recall)
    return found.meets / found.n if found else 0.0


def op6_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"))
