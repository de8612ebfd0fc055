"""Near-duplicate documents: banded MinHash candidates, odd sketches to verify them, full sets to confirm.

Words lie between ASCII white space, A-Z lower-cased; a document's set holds its distinct runs of five words, or the
whole sequence if it has fewer; without words the set is empty and linked with nothing. Two documents are linked if
100 * |intersection| >= threshold * |union|; components are what links reach. op5 takes 85, the pipeline's stage 80.

Documents with equal sets are one class, and only its smallest doc_id goes on. A class falls into 36 bands of
seven MinHash samples each, at 80 into 46 of six (a pair at the threshold shares none with probability below 1e-6). First
each class is paired with one hub, the smallest class that it shares a bucket with, which connects most groups with no more
pairs than classes. Only in buckets that still hold several components is each component compared with each other, in
chunks, inside the tasks: of the links found there those that connect components are emitted, so none that matters is lost. A pair goes on if its odd
sketches (the samples folded into a bitmap of parities) allow the threshold, and is confirmed on full sets.

A null text has no words. A null doc_id can't be named: its row is returned with a null component, kept. Rows with the
same doc_id and equal sets are one document; if their sets differ, an id is still one vertex, so it joins all that is linked with one of them. Very long texts are read
whole; their sets travel as one value of eight bytes a shingle. An empty table gives an empty result. Only doc_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.llm.common import WordHash, join_repeated, lower_words, materialize, mix64, salted_join, shuffle_partitions, table, tune, window_hash

NGRAM = 5
#: Least similarity, in hundredths.
THRESHOLD = 85
BANDS, ROWS = 36, 7
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SEED = 5
#: Members of a bucket in one chunk.
CHUNK = 500


class Links(NamedTuple):
    """What links two documents: least similarity in hundredths, and the bands that find it."""

    threshold: int = THRESHOLD
    bands: int = BANDS
    rows: int = ROWS


OP5 = Links()
#: The pipeline's stage takes a similarity of 0.8 or more; a pair at 0.8 shares no band with probability below 1e-6.
STAGE = Links(80, 46, 6)


def shingles(text: bytes | None, words: WordHash) -> np.ndarray:
    """Distinct hashes of the runs of five words, ascending."""
    found = words.of(lower_words(text))
    if len(found) == 0:
        return found
    return np.unique(window_hash(found, min(NGRAM, len(found))))


class Sketcher:
    """MinHash samples, their bands, and the odd sketch."""

    def __init__(self, seed: int = SEED, bands: int = BANDS, rows: int = ROWS) -> None:
        rng = np.random.default_rng(seed)
        self.shape, n = (bands, rows), bands * rows
        self.mul = rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 2**32, n, np.uint32)
        self.slot = rng.integers(0, 2**63, n, np.uint64)
        self.band = rng.integers(0, 2**63, bands, np.uint64)

    def samples(self, found: np.ndarray) -> np.ndarray:
        small = (found >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(small), 1024):
            np.minimum(out, (np.multiply.outer(self.mul, small[at : at + 1024]) + self.add[:, None]).min(axis=1), out=out)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        h, rows = self.band.copy(), samples.reshape(self.shape).astype(np.uint64)
        for i in range(self.shape[1]):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        return h.view(np.int64)

    def odd(self, samples: np.ndarray) -> np.ndarray:
        """Bit b is the parity of the number of samples that hash to it."""
        bits = mix64(self.slot ^ samples.astype(np.uint64)) % np.uint64(SKETCH_BITS)
        parity = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
        return np.packbits(parity).view(np.int64)


def most_odd_bits(threshold: int = THRESHOLD, samples: int = SAMPLES) -> int:
    """Differing bits of two odd sketches that a pair at the threshold exceeds with a chance of about 1e-7 at most."""
    p = 1 - threshold / 100
    differing = samples * p + 5.2 * math.sqrt(samples * p * (1 - p))
    z = SKETCH_BITS / 2 * (1 - math.exp(-4 * differing / SKETCH_BITS))
    return math.ceil(z + 4 * math.sqrt(SKETCH_BITS) / 2 * 0.6)


SIGNATURE = "doc_id long, n_shingles long, set_hash string, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, links: Links = OP5) -> DataFrame:
    """One row per row of ``docs``: set size, a 128-bit hash of the set, bands and odd sketch (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, sketcher = WordHash(), Sketcher(bands=links.bands, rows=links.rows)
        for b in batches:
            n, hashes, bands, sketches = [], [], [], []
            for text in b.column(1).to_pylist():
                found = shingles(text, words)
                n.append(len(found))
                if len(found) == 0:
                    hashes.append(None), bands.append(None), sketches.append(None)
                    continue
                hashes.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                samples = sketcher.samples(found)
                bands.append(sketcher.bands(samples))
                sketches.append(sketcher.odd(samples))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(bands, longs), pa.array(sketches, longs)], ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SIGNATURE)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents whose id is in ``wanted`` (rep); the sets as bytes, a row per id and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, words).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["rep", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.join(wanted, "rep", "left_semi").mapInArrow(run, "rep long, shingles binary").distinct()


def linked(pairs: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the pairs (a, b, sa, sb) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(p), len(q)) < threshold * max(len(p), len(q)):
                    continue
                both = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * both >= threshold * (len(p) + len(q) - both):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def smallest_reachable(edges: DataFrame, name: str) -> DataFrame:
    """(v, label) of every vertex of the edges (a, b): the smallest vertex it is connected with.

    Labels fall to the smallest label among neighbours, then to the label of their label, until none changes.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "v"), f"{name}-labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.v == near.a).select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("jumped"))
        # a label is a vertex too, and the label it had before is at most its own
        lower = low.join(jump, "low").select("v", "label", F.least("low", "jumped").alias("lower"))
        lower = materialize(lower, f"{name}-labels")
        changed = lower.where("lower < label").limit(1).count()
        labels = lower.select("v", F.col("lower").alias("label"))
        if not changed:
            return labels


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int, most: int, name: str) -> DataFrame:
    """The pairs (a, b), b the hub, that sketches allow and full sets confirm; hubs of many are dealt to many tasks."""
    words = SKETCH_BITS // 64
    pairs = materialize(pairs, f"{name}-pairs")
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, f"{name}-hubs")
    pairs = join_repeated(pairs, counts, "b", ["a"], "inner")

    def of(side: str, t: DataFrame, column: str, short: str) -> DataFrame:
        return t.select(F.col("rep").alias(side), F.col(column).alias(short))

    hubs = of("b", sketches, "sketch", "kb").join(counts, "b")
    close = salted_join(pairs.join(of("a", sketches, "sketch", "ka"), "a"), hubs, "b", "n", 500, F.col("a"))
    differing = sum((F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(1, words)), F.bit_count(F.col("ka")[0].bitwiseXOR(F.col("kb")[0])))
    close = materialize(close.where(differing <= most).select("a", "b", "n"), f"{name}-close")
    full = of("b", sets, "shingles", "sb").join(close.groupBy("b").agg(F.first("n").alias("n")), "b")
    return materialize(linked(salted_join(close.join(of("a", sets, "shingles", "sa"), "a"), full, "b", "n", 100, F.col("a")), threshold), f"{name}-links")


def _by_bucket(rows: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run`` (key, table) to the rows (bucket, rep, label, n, top, n_top) of each bucket, n its members and n_top those of its most common label, top.

    A bucket of many members is cut into chunks by a hash of the member, and each pair of chunks is a group, so that every two members of different labels meet in
    one and no group is large; ``chunk`` is a member's own. The most common label has chunks of its own, which don't meet each other: one large component and a few
    other members move each row of the component about once.
    """
    common = F.col("label") == F.col("top")
    others, tops = (F.ceil(n / CHUNK).cast("int") for n in (F.col("n") - F.col("n_top"), F.col("n_top")))
    at = F.xxhash64("rep")
    rows = rows.withColumn("chunk", F.when(common, others + F.pmod(at, tops).cast("int")).otherwise(F.pmod(at, others).cast("int")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(common, others).otherwise(others + tops) - 1)))
    rows = rows.withColumn("lo", F.least("chunk", "_other")).withColumn("hi", F.greatest("chunk", "_other")).drop("_other")
    key = ["bucket", "lo", "hi"]
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *key).sortWithinPartitions(*key)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in key), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and keys[i] != last:
                    yield run(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(i, j - i))
                last = keys[i]
        if held:
            yield run(pa.Table.from_batches(held))

    return rows.mapInArrow(grouped, schema)


def _crossing(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, own chunks, members to compare with all others): the most common label's members need not be compared with each other."""
    label, chunk = group.column("label").to_numpy(), group.column("chunk").to_numpy()
    names, counts = np.unique(label, return_counts=True)
    return label, chunk, np.flatnonzero(label != names[counts.argmax()])


def _others(i: int, label: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which members to compare with the i-th: of another label, and of the other chunk where two chunks meet."""
    other = label != label[i]
    return other & (chunk != chunk[i]) if chunk.min() != chunk.max() else other


_MEMBER = ["bucket", "rep", "label", "n", "top", "n_top"]


def _links_within(live: DataFrame, sketches: DataFrame, sets: DataFrame, threshold: int, most: int) -> DataFrame:
    """(a, b): links between members (bucket, rep, label, n, top, n_top) of a bucket that have different labels. Pairs are formed inside tasks only: those
    whose odd sketches are close tell which members' sets are fetched, and of the links those that connect labels are returned."""

    def close(group: pa.Table) -> pa.RecordBatch:
        label, chunk, some = _crossing(group)
        bits = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(label), -1)
        keep = np.zeros(len(label), bool)
        for i in some:
            near = _others(i, label, chunk) & (np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= most)
            if near.any():
                keep |= near
                keep[i] = True
        out = group.select(_MEMBER)
        return out.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else _nothing(out.schema)

    def link(group: pa.Table) -> pa.RecordBatch:
        label, chunk, some = _crossing(group)
        rep, own = group.column("rep").to_numpy(), [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        size = np.array([len(x) for x in own])
        flat, member = np.concatenate(own), np.repeat(np.arange(len(own)), size)
        order = np.argsort(flat, kind="stable")
        flat, member = flat[order], member[order]  # members by shingle
        joined, a, b = {}, [], []

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for i in some:
            lo, hi = np.searchsorted(flat, own[i], "left"), np.searchsorted(flat, own[i], "right")
            n = hi - lo
            both = np.bincount(member[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(own))
            for j in np.flatnonzero(_others(i, label, chunk) & (100 * both >= threshold * (size + size[i] - both))):
                p, q = root(int(label[i])), root(int(label[j]))
                if p != q:
                    joined[max(p, q)] = min(p, q)
                    a.append(int(rep[i])), b.append(int(rep[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    flagged = _by_bucket(live.join(sketches, "rep").select(*_MEMBER, "sketch"), close, "bucket long, rep long, label long, n long, top long, n_top long")
    flagged = materialize(flagged.dropDuplicates(["bucket", "rep"]), "near-flagged")
    full = flagged.join(sets, "rep").select(*_MEMBER, "shingles")
    return materialize(_by_bucket(full, link, "a long, b long").distinct(), "near-within")


def _nothing(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


def components(docs: DataFrame, links: Links = OP5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    tune(docs.sparkSession)
    threshold = links.threshold
    most = most_odd_bits() if links == OP5 else most_odd_bits(threshold, links.bands * links.rows)
    sig = materialize(signatures(docs, links), "near-signatures")
    named = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-classes")

    reps = classes.select("rep", "set_hash")
    own = named.select(F.col("doc_id").alias("rep"), "set_hash", "bands", "sketch").join(reps, ["rep", "set_hash"]).dropDuplicates(["rep", "set_hash"])
    own = materialize(own.select("rep", "bands", "sketch"), "near-own")
    sketches = own.select("rep", "sketch")
    banded = own.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(buckets, "near-buckets")
    members = materialize(join_repeated(banded, buckets, "bucket", ["rep"], "inner").select("bucket", "rep", "hub"), "near-members")
    sets = materialize(shingle_sets(docs, members.select("rep").distinct()), "near-sets")

    # first each document with one hub, the smallest of all its buckets': most groups are connected by that
    star = members.where("rep > hub").groupBy("rep").agg(F.min("hub").alias("hub"))
    found = _confirmed(star.select(F.col("rep").alias("a"), F.col("hub").alias("b")), sketches, sets, threshold, most, "near-0")
    labels = smallest_reachable(found, "near-0")

    # then, in buckets that still hold several components, each component with each other
    live = members.join(labels, members.rep == labels.v, "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
    several = live.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    several = several.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    several = materialize(several.select("bucket", "n", F.col("most.label").alias("top"), F.col("most.n").alias("n_top")), "near-several")
    live = materialize(join_repeated(live, several, "bucket", ["rep"], "inner"), "near-live")
    fresh = _links_within(live, sketches, sets, threshold, most)
    if not fresh.isEmpty():
        labels = smallest_reachable(materialize(found.unionByName(fresh), "near-links"), "near-1")

    labelled = classes.join(labels, classes.rep == labels.v, "left").select("set_hash", F.coalesce("label", "rep").alias("component_id"), "n")
    labelled = materialize(labelled, "near-labelled")
    rows = sig.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    alone = F.coalesce("set_hash", F.concat(F.lit("none:"), F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string"))))
    out = join_repeated(rows.withColumn("set_hash", alone), labelled, "set_hash", ["doc_id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, links: Links = OP5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with its columns; rows without id stay."""
    drop = components(docs, links).where("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.select(F.struct("*").alias("_doc"), docs["doc_id"].cast("long").alias("_drop")).join(drop, "_drop", "left_anti").select("_doc.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id that links reach."""
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
