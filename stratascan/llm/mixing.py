"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Words are counted per document (null text: 0). Sources in code-point order, null last, weigh 5, 2, 1 repeating;
together they get as many words as the corpus has, no source more than ``MAX_REPEATS`` times its own size, the
excess going to the others by weight.

Each source's documents stand in an order fixed by a digest of their ids; the source's words, repeated as often
as needed, are cut into blocks of ``block_words``. The numbers of blocks are split exactly among output shards:
a binary tree over the shards draws, at each node, how many blocks of every source go left, without
replacement. Sources are drawn in two steps, first for groups of ``GROUP`` of them, then within a group, so that a task
holds one group whatever the number of sources. A node's draw depends only on the seed and its place, so every task can walk from the root
to its own shards. Shards then take disjoint runs of the permuted blocks and shuffle them locally. A document is in the block
where its copy begins; only what is in a dealt block is taken, and documents are written shard by shard in shuffled order.

A row is a document, also if it repeats; null ids and empty texts are rows of size 0 or more like any other. Null ids stand by a digest of
their text, equal digests by doc_id, then size; rows that agree in all of these are alike. Very long texts are counted whole and, as a document's copy is
in one block, taken whole but for the one at the target. An empty table gives an empty result. Only doc_id, source and text are read, so other
columns may have any names. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.llm.common import materialize, shuffle_partitions, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
SHARD_BLOCKS = 256
SEED = 11
#: Sources whose numbers of blocks travel together.
GROUP = 65_536
#: Shards that one row of work walks to.
WALK = 64
#: Documents of one source are dealt into this many runs of their order, so that no task sorts a whole source.
RUNS = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place_in_order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, source_no, target) of (source, source_size): one row per source, so a small table."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeats)
    # raise the words per weight until they add up: sources reach their caps in the order of cap by weight
    by_cap = W.orderBy(F.col("cap") / F.col("w"), "source_no")
    everything = W.partitionBy()
    ranked = (
        ranked.withColumn("left_words", F.sum("source_size").over(everything) - F.sum("cap").over(by_cap) + F.col("cap"))
        .withColumn("left_w", F.sum("w").over(everything) - F.sum("w").over(by_cap) + F.col("w"))
        .withColumn("at", F.row_number().over(by_cap))
        .withColumn("free", F.col("left_words") * F.col("w") <= F.col("cap") * F.col("left_w"))
    )
    first = F.min(F.when(F.col("free"), F.struct("at", "left_words", "left_w"))).over(everything)
    ranked = ranked.withColumn("first", first)
    share = (F.col("first.left_words") * F.col("w")).cast("double") / F.col("first.left_w")
    target = F.when(F.col("at") < F.col("first.at"), F.col("cap").cast("double")).otherwise(share)
    return ranked.select("source", "source_size", "source_no", target.alias("target"))


def draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among n balls drawn without replacement."""
    total = int(colours.sum())
    if total < 10**9:  # what the library draws exactly
        return rng.multivariate_hypergeometric(colours, n, method="marginals")
    out = np.zeros_like(colours)
    for i, good in enumerate(colours.tolist()):
        out[i] = draw_one(rng, good, total - good, n)
        total, n = total - good, n - int(out[i])
    return out


def draw_one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Balls of one colour among n, by inversion over 12 standard deviations around the mode, beyond which lies less than rounding."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 2 + int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))))
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    log_p = np.concatenate([[0.0], np.cumsum(np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1))])
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def walk(groups: np.ndarray, group: int, blocks: np.ndarray, shards: int, lo: int, hi: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first block, number of blocks) of the sources of one group in the shards lo to hi - 1, drawn on the way down the tree; ``groups`` has the blocks of every group."""
    total = int(groups.sum())
    todo = [(0, shards, groups, blocks, np.zeros_like(blocks))]
    while todo:
        at, to, whole, own, first = todo.pop()
        if to - at == 1:
            yield at, first, own
            continue
        mid = (at + to) // 2
        n_left = total * mid // shards - total * at // shards
        left_whole = draw(np.random.default_rng([seed, at, to]), whole, n_left)
        left = draw(np.random.default_rng([seed, at, to, group]), own, int(left_whole[group]))
        if mid < hi:
            todo.append((mid, to, whole - left_whole, own - left, first + left))
        if lo < mid:
            todo.append((at, mid, left_whole, left, first))


def deal_blocks(sources: DataFrame, shards: int, block_words: int, seed: int) -> DataFrame:
    """(source_no, block, shard): every block of every source, in exactly one shard.

    A row of work is a group of sources and a run of shards. One number per group of sources goes to every task.
    """
    some = sources.select(F.col("source_no").cast("long").alias("source_no"), F.ceil(F.round("target") / block_words).cast("long").alias("blocks")).where("blocks > 0")
    grouped = some.groupBy(F.floor(F.col("source_no") / GROUP).alias("g")).agg(F.array_sort(F.collect_list(F.struct("source_no", "blocks"))).alias("own"))
    grouped = materialize(grouped.withColumn("total", F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])), "mix-groups")
    rows = grouped.select("g", "total").orderBy("g").collect()
    place = {r["g"]: i for i, r in enumerate(rows)}
    totals = np.array([r["total"] for r in rows], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, at, own in zip(b.column("g").to_pylist(), b.column("at").to_pylist(), b.column("own"), strict=True):
                numbers, blocks = (own.values.field(c).to_numpy() for c in ("source_no", "blocks"))
                for shard, first, n in walk(totals, place[g], blocks, shards, at, min(shards, at + WALK), seed):
                    of = np.repeat(numbers, n)
                    block = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(block), pa.array(np.full(len(of), shard))], ["source_no", "block", "shard"])

    work = grouped.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"), F.lit(WALK).cast("long"))).alias("at"), "own")
    return work.repartition(shuffle_partitions(sources.sparkSession), "g", "at").mapInArrow(run, "source_no long, block long, shard long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and copy taken: the document's columns in ``keep`` as a struct ``doc``, source_size, target, copy
    (from 0), words taken of it, and the shard, block and place where they go; untaken documents have one row without a copy. With
    ``keep`` documents without words have no row. Nothing is taken of a copy whose block no shard was dealt.
    """
    u = place_in_order(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))), seed)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), u.alias("u"),
        F.conv(F.substring(u, 1, 4), 16, 10).cast("long").alias("h"), *([F.struct(*[docs[c] for c in keep]).alias("doc")] if keep else []),
    )
    # where a document without words stands makes no difference, so those are dealt out as they come
    rows = rows.withColumn("run", F.when(F.col("size") > 0, F.floor(F.col("h") * RUNS / 65536)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(RUNS))).cast("int"))
    if not keep:
        rows = materialize(rows, "mix-sizes")
    sums = materialize(rows.groupBy("source", "run").agg(F.sum("size").alias("words")), "mix-runs")
    sources = materialize(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights), "mix-sources")
    if keep:
        rows = rows.where("size > 0")
    runs = sums.withColumn("before_run", F.sum("words").over(W.partitionBy("source").orderBy("run")) - F.col("words")).drop("words")
    runs = runs.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source")).select("r.source", "run", "before_run", "source_no", "source_size", "target")
    within = W.partitionBy("source_no", "run").orderBy("u", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.alias("d").join(runs.alias("r"), F.expr("d.source <=> r.source AND d.run = r.run")).drop(F.col("r.source"), F.col("r.run"))
    rows = rows.withColumn("row_no", F.row_number().over(within)).withColumn("before", F.col("before_run") + F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))

    # the whole rounds of a source, and of one more round the words up to its target
    take = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(take / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("int")
    rest = take - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long")
    copies = F.transform(F.sequence(F.lit(0), rounds), lambda c: F.struct(c.alias("copy"), F.when(c < rounds, F.col("size")).otherwise(part).alias("words")))
    rows = rows.withColumn("taken", F.filter(copies, lambda c: c["words"] > 0)).drop("u", "h", "before_run")
    rows = rows.withColumn("piece", F.explode_outer("taken")).select("*", "piece.copy", "piece.words").drop("piece", "taken")
    rows = rows.withColumn("block", F.floor((F.col("copy") * F.col("source_size") + F.col("before")) / block_words))

    n_blocks = sources.agg(F.coalesce(F.sum(F.ceil(F.round("target") / block_words)), F.lit(0)).alias("n")).first()["n"]
    blocks = deal_blocks(sources, max(1, -(-int(n_blocks) // shard_blocks)), block_words, seed)
    # documents that are not taken have no block: numbers below 0, which no block has, keep them from meeting in one task
    spread = -1 - F.pmod(F.xxhash64("run", "row_no"), F.lit(1 << 40))
    rows = rows.withColumn("block", F.coalesce("block", spread)).join(blocks, ["source_no", "block"], "left")
    rows = rows.withColumn("words", F.when(F.col("shard").isNotNull(), F.col("words")))
    local = F.xxhash64("shard", "source_no", "doc_id", "run", "row_no", "copy", F.lit(seed))
    return rows.withColumn("place", F.when(F.col("shard").isNotNull(), local)).select(
        "doc_id", *(["doc"] if keep else []), "source", "size", "source_no", "run", "row_no", "source_size", "target", "copy", "words", "block", "shard", "place"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a document taken n times is there n times, one taken in part is cut
    after the words taken, its white space unchanged. Rows are in order of shard and, in a shard, of place; a large shard may take several partitions."""
    rows = mix(docs, keep=tuple(docs.columns), **options).where("words > 0")
    order = ["shard", "place", "source_no", "run", "row_no", "copy"]
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    whole = F.col("words") >= F.col("size")
    n = F.col("words").cast("int")  # the text up to the end of its n-th word, as it stands
    first_words = F.array_join(F.slice(F.split(F.col("doc.text").cast("string"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", n + 1), 1, n), "")
    cut = F.when(whole, F.col("doc.text")).otherwise(first_words)
    return rows.select(*[cut.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def dealt(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, taken, shards) of every document: where the draws put each copy that the mix takes, as (shard, block, place, copy, words) in order."""
    pieces = mix(docs, **options)
    piece = F.when(F.col("shard").isNotNull() & (F.col("words") > 0), F.struct("shard", "block", "place", "copy", "words"))
    out = pieces.groupBy("source_no", "run", "row_no").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.array_sort(F.collect_list(piece)).alias("shards"))
    taken = F.aggregate("shards", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return out.select("doc_id", "source", "size", taken.alias("taken"), "shards")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, repeats counted."""
    pieces = mix(table(spark, sf_dir, "documents"))
    key = ["source_no", "run", "row_no"]
    out = pieces.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.coalesce(F.sum("words"), F.lit(0)).alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat(doc_id, ':11')) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][no % 3 + 1] AS BIGINT) AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER b AS nth, sum(source_size) OVER () - sum(cap) OVER b + cap AS left_words, sum(w) OVER () - sum(w) OVER b + w AS left_w
      FROM w WINDOW b AS (ORDER BY cap / w, no)),
f AS (SELECT nth AS f_nth, left_words AS f_words, left_w AS f_w FROM o WHERE left_words * w <= cap * left_w ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN nth < f_nth THEN CAST(cap AS DOUBLE) ELSE CAST(f_words * w AS DOUBLE) / CAST(f_w AS DOUBLE) END AS target FROM o, f),
r AS (SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS take,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS rounds FROM r)
SELECT doc_id, size, source_size, target, CAST(rounds * size + greatest(0, least(size, take - rounds * source_size - before)) AS BIGINT) AS taken FROM k
"""
