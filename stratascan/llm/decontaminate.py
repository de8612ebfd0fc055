"""Benchmark decontamination: a prefix-filtered set join of documents with the windows of benchmark items.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is ``size`` consecutive words of an item; an item of fewer, but not
none, is one window. Its set are its shingles, runs of up to ``SHINGLE`` words with their places. The shingles of all windows are counted over all
documents and put in order of rarity. A document that holds a window holds all its shingles, so it is enough to join on the window's necessary prefix, its
rarest one (with ``missing`` shingles allowed to differ, its rarest ``missing + 1``). A document sends only shingles that are in some prefix, with the
words about them. A pair goes on if the window lies within the document (length), at the place that the shingle's place in the window
gives (position); then the window's words are compared with those of the item-sized stretch of the document.

Which shingles are in a window, or in a prefix, tasks learn from a bitmap of two bits a shingle. It has at most ``FILTER_BITS`` bits, so with very many
items it lets more through, and the join leaves them out. Shingles that are in very many documents are dealt to many tasks.

A null text has no words, nor has an empty one: such a document is hit by nothing and such an item has no window. Texts are read whole, however long. Rows are
documents, also if an id repeats or is null. Items with one id are one item; an item without an id hits, but can't be named, so it isn't counted. Equal
windows of an item are one. An empty table on either side gives documents without hits. Only doc_id and text, item_id and text are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.llm.common import WordHash, join_repeated, materialize, table, tune, window_hash

WINDOW = 10
SHINGLE = 3
FILTER_BITS = 1 << 27
#: Distinct shingles after which a task hands on its counts.
COUNTED = 200_000

#: Letters in lower case, digits and bytes beyond ASCII as they are, blanks for all else.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_CANDIDATE = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("near", pa.list_(pa.string()))]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def shingles(hashed: np.ndarray, length: int) -> np.ndarray:
    """64-bit tokens of the runs of ``length`` words; the length is part of the hash."""
    return window_hash(hashed, length).view(np.int64)


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, words, tokens): the distinct windows of every item and the tokens of their shingles, in order of place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            for item, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                n = min(size, len(words))
                if not n:
                    continue
                tokens = shingles(known.of(words), min(SHINGLE, n))
                each = n - min(SHINGLE, n) + 1
                for at in range(0, len(words) - n + 1, 1000):  # a batch at a time, however long the item is
                    places = range(at, min(at + 1000, len(words) - n + 1))
                    texts = [[w.decode() for w in words[p : p + n]] for p in places]
                    columns = [pa.array([item.as_py()] * len(places), pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array([tokens[p : p + each] for p in places], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["item_id", "words", "tokens"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id string, words array<string>, tokens array<long>").distinct()


class TokenFilter:
    """Two bits a token in a bitmap whose size follows the number of tokens, up to ``FILTER_BITS``."""

    def __init__(self, tokens: DataFrame, most: int = FILTER_BITS) -> None:
        """``tokens`` has distinct (token)."""
        spark = tokens.sparkSession
        n = tokens.count()
        self.bits = min(most, 1 << max(16, (64 * n).bit_length()))
        halves = tokens.select(F.explode(F.array("token", F.shiftrightunsigned("token", 32))).alias("half"))  # tokens are hashes, so their halves are two more
        slots = halves.select(F.col("half").bitwiseAND(F.lit(self.bits - 1)).alias("slot"))
        marked = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int))) AS word"))
        rows = marked.toArrow()  # at most FILTER_BITS / 64 rows
        held = np.zeros(self.bits // 64, np.int64)
        held[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
        self.held = spark.sparkContext.broadcast(held.tobytes())

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "held": self.held}

    def inside(self) -> _Inside:
        """For use in a task."""
        return _Inside(np.frombuffer(self.held.value, np.uint8), self.bits)


class _Inside:
    def __init__(self, held: np.ndarray, bits: int) -> None:
        self.held, self.mask = held, np.uint64(bits - 1)

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """Positions of the tokens that may be among those of the filter."""
        hashes = tokens.view(np.uint64)
        some = np.flatnonzero(self._bit(hashes & self.mask))
        return some[self._bit((hashes[some] >> np.uint64(32)) & self.mask)]

    def _bit(self, slot: np.ndarray) -> np.ndarray:
        return (self.held[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def item_tokens(windows: DataFrame) -> DataFrame:
    """(token, n) of all shingles of the windows, n the number of windows that hold it."""
    return windows.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(docs: DataFrame, wanted: TokenFilter, lengths: list[int]) -> DataFrame:
    """(token, n): how often shingles of the documents that pass the filter occur. Tasks add up what they read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, inside = WordHash(), wanted.inside()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                hashed = known.of(words_of(text))
                for length in lengths:
                    tokens = shingles(hashed, length)
                    tokens = tokens[inside(tokens)]
                    held.append(tokens)
                    size += len(tokens)
            if size > COUNTED:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, tokens: DataFrame, missing: int = 0) -> DataFrame:
    """(token, c, item_id, words, n_tokens, offset): the rarest ``missing + 1`` shingles of every window; of shingles as rare as each other the smaller token goes first.

    ``tokens`` is a written table (token, n, c), n the windows that hold a shingle, c how often documents do.
    """
    rows = windows.select("item_id", "words", "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    keyed = join_repeated(rows, tokens, "token", ["item_id", "words"], "inner")
    chosen = keyed.groupBy("item_id", "words", "tokens").agg(F.slice(F.array_sort(F.collect_list(F.struct("c", "token"))), 1, missing + 1).alias("prefix"))
    rows = chosen.select("item_id", "words", "tokens", F.explode("prefix").alias("p"))
    # a shingle may be at several places of its window
    at = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == F.col("p.token"))
    return rows.select("p.token", "p.c", "item_id", "words", F.size("tokens").alias("n_tokens"), F.explode(at).alias("offset"))


def candidates(docs: DataFrame, wanted: TokenFilter, lengths: list[int], size: int) -> DataFrame:
    """(row, doc_id, n_words, found): every document, with the shingles that pass the filter: token, place, and the words about it, of which ``lead`` come before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, inside = WordHash(), wanted.inside()
        for b in batches:
            sizes, found = [], []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                hashed = known.of(words)
                sizes.append(len(words))
                own = []
                for length in lengths:
                    tokens = shingles(hashed, length)
                    for at in inside(tokens).tolist():
                        first = max(0, at + length - size)
                        own.append({"token": tokens[at], "at": at, "lead": at - first, "near": [w.decode() for w in words[first : at + size]]})
                found.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(found, _CANDIDATE)], ["row", "doc_id", "n_words", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_words long, found array<struct<token:long,at:int,lead:int,near:array<string>>>")


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, missing: int = 0) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) of every document, and (row, first, length, item_id) of every place where a window of an item occurs, in words from 0; a place may come twice.

    With ``missing`` up to so many shingles of a window, but not all, may differ at their places.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    windows = materialize(item_windows(items, size), "decon-windows")
    lengths = sorted(r["k"] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect())  # at most SHINGLE numbers
    tokens = materialize(item_tokens(windows), "decon-tokens")
    counts = corpus_counts(rows, TokenFilter(tokens), lengths).withColumnRenamed("n", "c")
    tokens = materialize(tokens.join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0).cast("long"))), "decon-counts")
    prefix = materialize(prefixes(windows, tokens, missing), "decon-prefix")
    keys = materialize(prefix.groupBy("token").agg(F.first("c").alias("n")), "decon-keys")
    read = materialize(candidates(rows, TokenFilter(keys), lengths, size), "decon-documents")

    found = read.select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    pairs = join_repeated(found, prefix, "token", ["row", "at"], "inner", counts=keys)
    pairs = pairs.withColumn("first", F.col("at") - F.col("offset")).withColumn("length", F.size("words"))
    pairs = pairs.where((F.col("first") >= 0) & (F.col("first") + F.col("length") <= F.col("n_words")))
    stretch = F.slice("near", F.greatest(F.col("lead") - F.col("offset") + 1, F.lit(1)), F.col("length"))
    same = stretch == F.col("words")
    if missing:
        k = F.col("length") - F.col("n_tokens") + 1
        equal = F.zip_with(stretch, F.col("words"), lambda x, y: x == y)
        whole = F.filter(F.sequence(F.lit(1), F.col("n_tokens")), lambda p: F.forall(F.slice(equal, p, k), lambda e: e))
        same = F.size(whole) >= F.greatest(F.col("n_tokens") - missing, F.lit(1))
    return read.select("row", "doc_id", "n_words"), pairs.where(same).select("row", F.col("first").cast("long").alias("first"), F.col("length").cast("long").alias("length"), "item_id")


def covered(spans: Column) -> Column:
    """How many places spans (first, length) cover together."""
    zero = F.lit(0).cast("long")
    step = lambda s, x: F.struct((s["n"] + F.greatest(zero, x["first"] + x["length"] - F.greatest(x["first"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["first"] + x["length"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("upto")), step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, missing: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): every document with the words hit, the ids of the items, as text in order, and where their windows lie."""
    read, hits = matches(docs, items, size, missing)
    own = hits.groupBy("row").agg(F.collect_set(F.struct("first", "length")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = read.join(own, "row", "left")
    none = F.array().cast("array<struct<first:bigint,length:bigint>>")
    return rows.select(
        "doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.array_sort("spans"), none).alias("spans"),
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds windows of."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(l[i : i + n - 1], ' ') AS win FROM (SELECT item_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM (SELECT *, least(10, len(l)) AS n FROM b) WHERE n > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(l[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM iw) WHERE len(l) >= n)),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN iw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
