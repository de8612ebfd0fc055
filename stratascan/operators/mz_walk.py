"""Greedy m/z partitions in one ordered pass over the points, whatever the size of a slice.

A partition opens at a value and takes what lies within its tolerance; the first value beyond opens the next. Points are put in order by ranges of (slice, level, m/z),
and each task walks its range, carrying only the open partition from batch to batch. Where two neighbours lie further apart than the tolerance of the
lower one, a partition opens at the upper one whatever came before, so all rows of a range behind its first such gap are right at once. Those before it, the head, hang
on the partition that is open where the range begins.

What a range without any gap makes of the partition it is entered with is a step function of few steps, which is found for all such ranges side by side.
Put together in the order of the ranges, a row each, these tell where every range is entered, and the heads are walked again side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.plans.boundary import boundary

KEY = ["swath", "rt_window", "level"]


def following(v: np.ndarray, ppm: float) -> np.ndarray:
    """For each of ascending distinct values the position of the first value beyond its tolerance."""
    room = v * ppm / 1e6
    at = np.searchsorted(v, v + room, "right")
    own = np.arange(len(v))
    while (off := (at < len(v)) & ~(v[np.minimum(at, len(v) - 1)] - v > room)).any():  # sums and differences round differently
        at[off] += 1
    while (off := (at - 1 > own) & (v[at - 1] - v > room)).any():
        at[off] -= 1
    return at


def beyond(v: np.ndarray, start: float, ppm: float) -> int:
    """Position of the first of ascending values that is beyond the tolerance of an open partition."""
    room = start * ppm / 1e6
    at = int(np.searchsorted(v, start + room, "right"))
    while at < len(v) and not v[at] - start > room:
        at += 1
    while at and v[at - 1] - start > room:
        at -= 1
    return at


def starts_of(v: np.ndarray, ppm: float, start: float | None = None) -> np.ndarray:
    """Starts of the partitions of ascending distinct values, the open one first if there is one."""
    out = [] if start is None else [start]
    at = 0 if start is None else beyond(v, start, ppm)
    if at < len(v):
        next_at, at, taken = following(v[at:], ppm).tolist(), 0, v[at:]
        found = []
        while at < len(taken):
            found.append(at)
            at = next_at[at]
        out += taken[found].tolist()
    return np.array(out, float)


class Walk:
    """Starts of points that come in order of key and m/z, batch by batch."""

    def __init__(self, ppm: float, key: tuple | None = None, start: float | None = None) -> None:
        self.ppm, self.key, self.start, self.last = ppm, key, start, None
        self.head = True

    def batch(self, keys: list[np.ndarray], mz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each point, whether it is in the head)."""
        start, head = np.empty(len(mz)), np.zeros(len(mz), bool)
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *new], [*new, len(mz)], strict=True):
            start[a:b], head[a:b] = self._run(tuple(int(k[a]) for k in keys), mz[a:b])
        return start, head

    def _run(self, key: tuple, mz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.key is not None and key != self.key:
            self.start = self.last = None
            self.head = False
        self.key = key
        v = mz[np.append(True, mz[1:] != mz[:-1])]
        starts = starts_of(v, self.ppm, self.start)
        head = np.full(len(mz), self.head)
        if self.head:
            line = v if self.last is None else np.append(self.last, v)
            gaps = np.flatnonzero(np.diff(line) > line[:-1] * self.ppm / 1e6)
            if len(gaps):
                head = mz < line[gaps[0] + 1]
                self.head = False
        self.start, self.last = starts[-1], v[-1]
        return starts[np.searchsorted(starts, mz, "right") - 1], head


def _arrays(b: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [b.column(c).to_numpy(zero_copy_only=False) for c in names]


def _with(b: pa.RecordBatch, names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, columns)], [*b.schema.names, *names])


def _ranges(points: DataFrame, ppm: float) -> DataFrame:
    """Points with ``start`` as if each range were entered anew, ``_part``, its number, and ``_head``; a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, part = Walk(ppm), TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                start, head = walk.batch(_arrays(b, KEY), *_arrays(b, ["mz"]))
                yield _with(b, ["start", "_part", "_head"], [start, np.full(b.num_rows, part, np.int32), head])

    rows = points.where("mz IS NOT NULL")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *KEY, "mz").sortWithinPartitions(*KEY, "mz")
    return boundary(ordered.mapInArrow(run, _schema(points) + ", start double, _part int, _head boolean"), "mz-ranges")


def _schema(points: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in points.dtypes)


def _by_range(heads: DataFrame, n: int) -> DataFrame:
    return heads.repartition(n, "_part").sortWithinPartitions("_part", "mz")


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of a batch that belong to one range."""
    (part,) = _arrays(b, ["_part"])
    edges = np.append(np.append(0, np.flatnonzero(np.diff(part)) + 1), len(part))
    for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if e > a:
            yield int(part[a]), b.slice(a, e - a)


def steps(v: np.ndarray, ppm: float) -> tuple[np.ndarray, np.ndarray]:
    """(edges, exits) of a gapless range of ascending distinct values: entered with an open partition that the first edge beyond its tolerance ends, it is left with that
    edge's exit as the open one; with no edge beyond, the one it was entered with stays open. Only values within the first one's tolerance, and the next, can be edges."""
    nxt = following(v, ppm).tolist()
    exits = list(range(len(v)))
    for i in range(len(v) - 1, -1, -1):
        if nxt[i] < len(v):
            exits[i] = exits[nxt[i]]
    reach = np.array(exits[: min(nxt[0] + 1, len(v))])
    ends = np.append(np.flatnonzero(np.diff(reach)), len(reach) - 1)
    return v[ends], v[reach[ends]]


def _steps(heads: DataFrame, ppm: float, n: int) -> DataFrame:
    """(_part, edges, exits) of gapless ranges; a task holds the distinct values of one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        own = None

        def step() -> pa.RecordBatch:
            edges, exits = steps(np.unique(np.concatenate(held)), ppm)
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([edges]), pa.array([exits])], ["_part", "edges", "exits"])

        for b in batches:
            for part, piece in _pieces(b):
                if held and part != own:
                    yield step()
                    held = []
                own = part
                held.append(np.unique(*_arrays(piece, ["mz"])))
        if held:
            yield step()

    return _by_range(heads.select("_part", "mz"), n).mapInArrow(run, "_part int, edges array<double>, exits array<double>")


def _entries(marked: DataFrame, ppm: float, n: int) -> DataFrame:
    """(_part, entry) of the ranges that are entered with an open partition: its start. Ranges are taken in order, a row each, in one task."""
    point = F.struct(*KEY, "mz")
    ends = marked.groupBy("_part").agg(F.min(point).alias("first"), F.max(F.struct(point.alias("p"), "start")).alias("last"), F.bool_and("_head").alias("gapless"))
    before = F.lag("last").over(W.orderBy("_part"))  # a row per range
    same = F.lit(True)
    for k in KEY:
        same = same & (F.col(f"before.p.{k}") == F.col(f"first.{k}"))
    near = ~(F.col("first.mz") - F.col("before.p.mz") > F.col("before.p.mz") * ppm / 1e6)
    ends = boundary(ends.withColumn("before", before).withColumn("linked", F.coalesce(same & near, F.lit(False))), "mz-ends")
    through = ends.where("linked AND gapless").select("_part")
    found = _steps(marked.join(F.broadcast(through), "_part", "left_semi"), ppm, n)
    rows = ends.join(found, "_part", "left").select("_part", "linked", "gapless", F.col("last.start").alias("left"), "edges", "exits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for b in batches:
            parts, entries = [], []
            for r in b.to_pylist():
                if r["linked"]:
                    parts.append(r["_part"]), entries.append(open_)
                if r["linked"] and r["gapless"]:
                    at = beyond(np.array(r["edges"]), open_, ppm)
                    open_ = r["exits"][at] if at < len(r["exits"]) else open_
                else:
                    open_ = r["left"]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(entries, pa.float64())], ["_part", "entry"])

    return boundary(rows.repartition(1).sortWithinPartitions("_part").mapInArrow(run, "_part int, entry double"), "mz-entries")


def walked(points: DataFrame, ppm: float) -> DataFrame:
    """Points (swath, rt_window, level, mz, ..) with ``start``, that of their partition in their slice and level; points without an m/z are left out."""
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, marked = points.columns, _ranges(points, ppm)
    entries = _entries(marked, ppm, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, own = None, None
        for b in batches:
            for part, piece in _pieces(b):
                if part != own:
                    walk, own = Walk(ppm, tuple(int(k[0]) for k in _arrays(piece, KEY)), float(piece.column("entry")[0].as_py())), part
                start, _ = walk.batch(_arrays(piece, KEY), *_arrays(piece, ["mz"]))
                yield _with(piece.select(names), ["start"], [start])

    # a row per range, so it is small
    sides = marked.join(F.broadcast(entries), "_part", "left")
    right = sides.where("entry IS NULL OR NOT _head").select(*points.columns, "start")
    heads = _by_range(sides.where("entry IS NOT NULL AND _head").select(*points.columns, "_part", "entry"), n)
    return right.unionByName(heads.mapInArrow(run, _schema(points) + ", start double"))
