"""Packing documents into training sequences: first-fit decreasing over a tournament tree, in randomised groups.

Documents are dealt to groups by a hash, and each group is packed on its own: whole sequences are cut off long
documents first, and what remains of each is placed, longest first, into the first sequence with room, which a
tournament tree over the free capacities finds in logarithmic time. Sequences are padded to the full length,
except those whose length is a power of two; a group's last, worst filled sequence is cut into such lengths.

Null and empty texts are documents of one token, the end id. Null ids are dealt by row. Repeated rows are
documents of their own. Of equal lengths the smaller doc_id is placed first, then the text decides, so the order of arrival makes no difference. Very long
texts are tokenised whole and cut into whole sequences. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.llm import tokenize
from stratascan.llm.common import table, tune

LENGTH = 2048
END_ID = 1
#: Documents in a group, on average, and bytes of text, whichever are reached first.
GROUP_DOCS, GROUP_BYTES = 3000, 24 << 20
SEED = 29


class Tournament:
    """Free capacity of sequences in the leaves, the larger of two in each inner node."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.size = 1 << max(0, leaves - 1).bit_length()
        self.capacity = capacity
        self.tree = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """(leaf, offset) of the first leaf with room for ``need``, which is taken."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < need:
                node += 1
        leaf, offset = node - self.size, self.capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return leaf, offset


def powers(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that hold every token of the documents once."""
    pieces, sequence, rest = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d))
    rest.sort(key=lambda r: (-r[0], r[1]))
    tree = Tournament(len(rest), capacity)
    bins: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, d in rest:
        leaf, offset = tree.place(n)
        bins.setdefault(leaf, []).append((d, lengths[d] - n, n, offset))
    filled = {leaf: sum(p[2] for p in own) for leaf, own in bins.items()}
    worst = min(filled, key=lambda leaf: (filled[leaf], -leaf), default=None)
    for leaf, own in bins.items():
        if leaf != worst or capacity - filled[leaf] < capacity // 64:
            pieces += [(d, start, n, sequence, offset) for d, start, n, offset in own]
            sequence += 1
            continue
        edges = np.cumsum([0, *powers(filled[leaf])]).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # each stretch is a sequence that needs no padding
            for d, start, n, offset in own:
                lo, hi = max(a, offset), min(b, offset + n)
                if lo < hi:
                    pieces.append((d, start + lo - offset, hi - lo, sequence, lo - a))
            sequence += 1
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, group_docs: int = GROUP_DOCS, seed: int = SEED, byte_level: bool = False) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece, its ids as little-endian bytes."""
    spark = tune(docs.sparkSession)
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-size["docs"] // group_docs), -(-size["bytes"] // GROUP_BYTES))

    def of_group(key: tuple, rows: pa.Table) -> pa.Table:
        encode = tokenize.encoder(tokenizer, byte_level).encode
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        doc_ids, ids = rows.column("doc_id").to_pylist(), []
        for b in rows.select(["text"]).to_batches(max_chunksize=200):
            ids += [np.append(x, np.uint32(end_id)).astype("<u4") for x in encode([t or "" for t in b.column(0).to_pylist()])]
        first = key[0].as_py() << 40  # a group has fewer sequences than tokens
        out = pack([len(x) for x in ids], length)
        columns = [
            pa.array([doc_ids[d] for d, *_ in out], pa.int64()), pa.array([p[1] for p in out], pa.int64()), pa.array([p[2] for p in out], pa.int64()),
            pa.array([len(ids[d]) for d, *_ in out], pa.int64()), pa.array([first + p[3] for p in out], pa.int64()), pa.array([p[4] for p in out], pa.int64()),
            pa.array([ids[d][s : s + n].tobytes() for d, s, n, _, _ in out], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    dealt = F.coalesce(F.col("doc_id"), F.monotonically_increasing_id())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64(dealt, F.lit(seed)), F.lit(groups)).cast("long"))
    return rows.groupBy("pack_group").applyInArrow(of_group, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
