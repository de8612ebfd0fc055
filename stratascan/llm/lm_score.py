"""Stupid-backoff language-model scores, with counts from the whole corpus.

For a word w after words u v: S(w | u v) = c(u v w) / c(u v) if c(u v w) is at least ``least``, else 0.4 * S(w | v);
S(w | v) = c(v w) / c(v) if c(v w) is at least ``least``, else 0.4 * c(w) / N. The first word of a document has no context,
the second one word. A document's score is the sum of the logarithms. A document's own n-grams are counted too, so every run occurs once at
least; with ``least`` at 2 a run that no other place has counts as unseen.

:func:`score_rows` is the method as relations: a row per n-gram, a count table partitioned by the n-gram's hash, joined to the exploded
n-grams of every document, summed per document. Its rows take many times the room of the corpus. :func:`score_corpus` does the same with
packed rows. Documents come in blocks of consecutive rows of a file, cut by bytes. A block's n-grams are exploded and reduced to distinct
hashes with counts, cut by ranges of the hash, and each range is sent to its partition as one row: the count tables are partitioned by hash.
There the blocks' counts are added up, and each block gets the totals of its own n-grams back, in the order it
sent them. A second join brings a block's totals and texts together; n-grams are looked up and summed per document.

Words lie between ASCII white space, A-Z lower-cased. Null and empty texts have no words and a null mean. Null ids are
scored. Repeated rows count as often as they occur. A very long text is a block of its own. An empty table gives an empty result. Only doc_id and
text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.llm.common import WORD_GAP, WordHash, join_repeated, lower_words, materialize, table, tune, window_hash

ORDER = 3
BACKOFF = 0.4
#: Counts below this are as none, for runs of two words and more.
LEAST = 2
#: Bytes of text after which a block is closed.
BLOCK_BYTES = 16 << 20
#: The key whose count is the number of all words.
TOTAL = np.uint64(1)


def ngrams(words: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2, ... ``ORDER`` words; the length is part of the hash."""
    return [window_hash(words, n) for n in range(1, ORDER + 1)]


def pack_sorted(keys: np.ndarray, base: int) -> bytes:
    """Ascending distinct keys as byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(base))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(data: bytes, base: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, : data[0]] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


def pack_counts(counts: np.ndarray) -> bytes:
    kind = "<u4" if not len(counts) or int(counts.max()) < 2**32 else "<u8"
    data = counts.astype(kind)
    planes = np.ascontiguousarray(data.view(np.uint8).reshape(len(data), -1).T)
    return kind[2:].encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    width = int(data[:1])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def distinct_counts(hashed: list[np.ndarray], counted: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct n-grams of all orders of documents given as word hashes, ascending, and how often each occurs; the key of the total is
    the first and occurs once. One array is filled, sorted in place and cut down, as a block has millions of them."""
    keys = np.empty(1 + sum(max(0, len(h) - n) for h in hashed for n in range(ORDER)), np.uint64)
    keys[0], at = TOTAL, 1
    for h in hashed:
        for g in ngrams(h):
            keys[at : at + len(g)] = g
            at += len(g)
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    return keys, np.diff(np.flatnonzero(new), append=len(new)) if counted else None


def located(docs: DataFrame) -> DataFrame:
    """(file, row, doc_id, text) of a frame that reads files; any other is written to files first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialize(docs.select("doc_id", "text"), "score-docs")
    return docs.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch, bool]]:
    """(file, first row of the block, some rows of it, whether it ends there). Blocks depend on the rows of a task alone, so every pass over them finds the same."""
    held = None
    size, lo, last = 0, 0, ("", -1)
    for b in batches:
        files, rows = b.column("file").to_pylist(), b.column("row").to_pylist()
        lengths = pc.binary_length(b.column("text")).to_pylist()
        start = 0
        for i, here in enumerate(zip(files, rows, strict=True)):
            if here != (last[0], last[1] + 1) or size >= BLOCK_BYTES:
                if held is not None:
                    yield *held, i == start
                    held = None
                if i > start:
                    yield files[i - 1], lo, b.slice(start, i - start), True
                start, size, lo = i, 0, rows[i]
            size += lengths[i]
            last = here
        if len(b):
            if held is not None:
                yield *held, False
            held = (files[-1], lo, b.slice(start))
    if held is not None:
        yield *held, True


def requests(rows: DataFrame, bits: int) -> DataFrame:
    """(part, file, lo, rows, keys, counts): the distinct n-grams of each block, by the top bits of their hash."""

    def cut(file: str, lo: int, hashed: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = distinct_counts(hashed)
        counts[0] = sum(map(len, hashed))  # the smallest key but for 0, which no n-gram has in practice
        edges = np.concatenate([[0], np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)]]) if bits else np.array([0, len(keys)])
        own = [p for p in range(1 << bits) if edges[p] < edges[p + 1]]
        sent = [pack_sorted(keys[edges[p] : edges[p + 1]], p << (64 - bits) if bits else 0) for p in own]
        n = len(own)
        columns = [pa.array(own, pa.int64()), pa.array([file] * n), pa.array([lo] * n, pa.int64()), pa.array([len(hashed)] * n, pa.int64()), pa.array(sent, pa.binary()), pa.array([pack_counts(counts[edges[p] : edges[p + 1]]) for p in own], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "file", "lo", "rows", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashed = WordHash(), []
        for file, lo, some, ends in blocks_of(batches):
            hashed += [words.of(lower_words(t)) for t in some.column("text").to_pylist()]
            if ends:
                yield cut(file, lo, hashed)
                hashed = []

    return rows.mapInArrow(run, "part long, file string, lo long, rows long, keys binary, counts binary")


def totals(asked: DataFrame, bits: int) -> DataFrame:
    """(file, lo, rows, part, counts): the corpus counts of the n-grams asked for, in the order asked."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        asked = [unpack_sorted(k, part << (64 - bits) if bits else 0) for k in rows.column("keys").to_pylist()]
        every = np.concatenate(asked)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(new) - 1
        counts = np.concatenate([unpack_counts(c) for c in rows.column("counts").to_pylist()])
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        found = np.empty(len(every), np.int64)
        found[order] = sums[group]
        edges = np.cumsum([0, *map(len, asked)])
        back = [pack_counts(found[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return rows.select(["file", "lo", "rows", "part"]).append_column("counts", pa.array(back, pa.binary()))

    return asked.groupBy("part").applyInArrow(run, "file string, lo long, rows long, part long, counts binary")


def pack_texts(rows: DataFrame) -> DataFrame:
    """(file, lo, docs): rows of a block as compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, lo, some, _ in blocks_of(batches):
            part = pa.Table.from_batches([some]).select(["row", "doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([lo], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["file", "lo", "docs"])

    return rows.mapInArrow(run, "file string, lo long, docs binary")


def look_up(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Counts of n-grams in any order; looked up in ascending order, so that the table is read from one end to the other, some at a time."""
    found = np.empty(len(asked), np.float64)
    for at in range(0, len(asked), step):
        part = asked[at : at + step]
        order = np.argsort(part)
        found[at : at + step][order] = counts[np.searchsorted(keys, part[order])]
    return found


def log_score(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, total: int, least: int = LEAST) -> float:
    """Sum of log S over the words of a document, from the counts of its runs of one, two and three words."""
    s = c1 / total
    if len(s) > 1:
        s[1:] = np.where(c2 >= least, c2 / c1[:-1], BACKOFF * s[1:])
    if len(s) > 2:
        s[2:] = np.where(c3 >= least, c3 / c2[:-1], BACKOFF * s[2:])
    return float(np.log(s).sum())


def score_corpus(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, log_score) of every row, by the counts of all of them."""
    tune(docs.sparkSession)
    rows = located(docs)
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = max(3, (2 * -(-size // BLOCK_BYTES) - 1).bit_length())  # a partition holds about as many n-grams as half a block, however many blocks

    def run(texts: pa.Table, back: pa.Table) -> pa.Table:
        own = pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in texts.column("docs").to_pylist()]).sort_by("row")
        if own.num_rows != back.column("rows")[0].as_py():
            raise ValueError("a block's texts and counts differ in their rows")
        words = WordHash()
        hashed = [words.of(lower_words(t)) for t in own.column("text").to_pylist()]
        keys, _ = distinct_counts(hashed, counted=False)
        counts = np.concatenate([unpack_counts(c) for _, c in sorted(zip(back.column("part").to_pylist(), back.column("counts").to_pylist(), strict=True))])
        total = int(counts[0])
        found, sizes = [], np.array([len(h) for h in hashed])
        for n in range(1, ORDER + 1):
            flat = look_up(keys, counts, np.concatenate([window_hash(h, n) for h in hashed]))
            found.append(np.split(flat, np.cumsum(np.maximum(sizes - n + 1, 0))[:-1]))
        scores = [log_score(*c, total, least) for c in zip(*found, strict=True)]
        return pa.Table.from_arrays([own.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_words", "log_score"])

    back = totals(requests(rows, bits), bits)
    key = ["file", "lo"]
    return pack_texts(rows).groupBy(*key).cogroup(back.groupBy(*key)).applyInArrow(run, "doc_id long, n_words long, log_score double")


def score_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """What :func:`score_corpus` returns, with a row per n-gram from end to end: for corpora that may take about fifty times their room in shuffles."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")), "score-words")
    at = rows.select("row", "words", F.posexplode("words").alias("i", "w"))
    before = lambda n: F.try_element_at("words", F.when(F.col("i") >= n, F.col("i") + 1 - n))
    grams = at.select("row", "i", F.xxhash64("w").alias("h1"), F.when(F.col("i") >= 1, F.xxhash64(before(1), "w")).alias("h2"), F.when(F.col("i") >= 2, F.xxhash64(before(2), before(1), "w")).alias("h3"))
    asked = grams.select("row", "i", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"h{n}").alias("h")) for n in (1, 2, 3)])).alias("g")).select("row", "i", "g.n", "g.h").where("h IS NOT NULL")
    counts = materialize(asked.groupBy("n", "h").agg(F.count(F.lit(1)).alias("c")), "score-counts")
    total = counts.where("n = 1").agg(F.sum("c").alias("total")).first()["total"] or 1
    hot = counts.select(F.concat_ws(":", "n", "h").alias("gram"), "c").withColumn("n", F.col("c"))
    found = join_repeated(asked.select("row", "i", F.col("n").alias("order"), F.concat_ws(":", "n", "h").alias("gram")), hot, "gram", ["row", "i"], "inner")
    c = found.groupBy("row", "i").agg(*[F.max(F.when(F.col("order") == n, F.col("c"))).alias(f"c{n}") for n in (1, 2, 3)])
    own = W.partitionBy("row").orderBy("i")
    c = c.withColumn("v", F.lag("c1").over(own)).withColumn("uv", F.lag("c2").over(own))
    low = F.when(F.col("i") == 0, F.lit(1.0)).otherwise(F.lit(BACKOFF)) * F.col("c1") / F.lit(total)
    two = F.when(F.col("c2") >= least, F.col("c2") / F.col("v")).otherwise(low)
    s = F.when(F.col("c3") >= least, F.col("c3") / F.col("uv")).otherwise(F.when(F.col("i") >= 2, BACKOFF * two).otherwise(two))
    sums = c.groupBy("row").agg(F.sum(F.log(s)).alias("log_score"))
    return rows.join(sums, "row", "left").select("doc_id", F.size("words").cast("long").alias("n_words"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))


def op10_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and mean score by word of every document."""
    out = score_corpus(table(spark, sf_dir, "documents"))
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), mean.alias("mean_log_score"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, unnest(l) AS w3, unnest(range(1, len(l) + 1)) AS i FROM (
         SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents)),
g AS (SELECT *, lag(w3) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w3 AS a, count(*) AS c FROM g GROUP BY ALL),
c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS z, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
s AS (SELECT g.doc_id, CASE WHEN t.c >= 2 THEN t.c / uv.c WHEN b.c >= 2 THEN CASE WHEN g.w1 IS NULL THEN 1 ELSE 0.4::DOUBLE END * (b.c / v.c)
             ELSE CASE WHEN g.w2 IS NULL THEN 1 WHEN g.w1 IS NULL THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * 0.4::DOUBLE END * (w.c / (SELECT count(*) FROM g)) END AS s
      FROM g JOIN c1 w ON w.a = g.w3 LEFT JOIN c1 v ON v.a = g.w2 LEFT JOIN c2 b ON b.a = g.w2 AND b.b = g.w3
      LEFT JOIN c2 uv ON uv.a = g.w1 AND uv.b = g.w2 LEFT JOIN c3 t ON t.a = g.w1 AND t.b = g.w2 AND t.z = g.w3),
r AS (SELECT doc_id, count(*) AS n, sum(ln(s)) AS l FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, round(coalesce(l, 0), 3) AS log_score, round(l / n, 6) AS mean_log_score FROM documents LEFT JOIN r USING (doc_id)
"""
