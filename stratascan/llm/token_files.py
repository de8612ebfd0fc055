"""Token files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds the documents of one range of ids in ascending doc_id order (null ids last; equal ids by text).
Frame 0 is the directory: the place of the file among all, the doc_ids and the numbers of tokens. Frame i + 1 is
document i, its ids as little-endian unsigned 32-bit integers. The file ends with the seek table of the zstandard
seekable format in a skippable frame: sizes and the low 32 bits of the XXH64 of each frame's content. A reader of some
documents decompresses the directory and their frames only, and with an index of the files reads no others; any zstandard decoder reads the whole.

Null texts count as empty; every document ends with id 0, so it has at least that token. Repeated rows are documents
of their own. A very long text is one frame. An empty table writes no file and reads back empty. Only doc_id and text are read, so other columns may have
any names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stratascan.llm import tokenize
from stratascan.llm.common import materialize, read_blobs, shared_path, shuffle_partitions, table, tune, write_blobs

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
TAIL = struct.pack("<I", SEEKABLE_MAGIC)

FILE_BYTES = 8 << 20
END_ID = 0
_NO_ID = -(2**63)


def encode_file(part: int, serial: int, doc_ids: list[int | None], frames: list[bytes], entries: list[tuple[int, int, int]], lengths: list[int]) -> bytes:
    """Everything but the last four bytes, which the writer of blobs appends."""
    head = struct.pack("<QQQ", part, serial, len(doc_ids))
    head += np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    first = zstandard.ZstdCompressor(level=3).compress(head)
    entries = [(len(first), len(head), xxhash.xxh64_intdigest(head) & 0xFFFFFFFF), *entries]
    rows = b"".join(struct.pack("<III", *e) for e in entries)
    seek = struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + 9) + rows + struct.pack("<IB", len(entries), CHECKSUM_FLAG)
    return b"".join([first, *frames, seek])


class TokenFile:
    """Random access to the bytes of one token file."""

    def __init__(self, data: bytes) -> None:
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums")
        table_bytes = data[-9 - 12 * n : -9]
        if struct.unpack("<II", data[-17 - 12 * n : -9 - 12 * n]) != (SKIPPABLE_MAGIC, 12 * n + 9):
            raise ValueError("seek table frame differs")
        self.data, self.entries = data, np.frombuffer(table_bytes, "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.reader = zstandard.ZstdDecompressor()
        head = self.frame(0)
        self.part, self.serial, count = struct.unpack("<QQQ", head[:24])
        self.doc_ids = np.frombuffer(head, "<i8", count, 24)
        self.lengths = np.frombuffer(head, "<i8", count, 24 + 8 * count)

    def frame(self, i: int) -> bytes:
        raw = self.reader.decompress(self.data[self.at[i] : self.at[i + 1]], max_output_size=int(self.entries[i, 1]))
        if len(raw) != self.entries[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[i, 2]:
            raise ValueError(f"frame {i} differs from its checksum")
        return raw

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; no other document is decompressed."""
        return np.frombuffer(self.frame(i + 1), "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, byte_level: bool = True) -> None:
    """Encode every document and write token files, in ascending doc_id order over the files."""
    spark = tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = tokenize.encoder(tokenizer, byte_level).encode, zstandard.ZstdCompressor(level=1)
        part, serial = TaskContext.get().partitionId(), 0
        doc_ids, frames, entries, lengths, size = [], [], [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([encode_file(part, serial, doc_ids, frames, entries, lengths)], pa.binary())], ["content"])
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                frame = packer.compress(raw)
                doc_ids.append(doc_id)
                frames.append(frame)
                entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                lengths.append(len(raw) // 4)
                size += len(frame)
                if size >= FILE_BYTES:
                    yield out()
                    serial, size = serial + 1, 0
                    doc_ids, frames, entries, lengths = [], [], [], []
        if doc_ids:
            yield out()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    write_blobs(rows.mapInArrow(run, "content binary"), "content", path, TAIL)


def index_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, serial, tokens, first_id, last_id) of every token file, from their directories; null ids are in no range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "part", "serial", "tokens", "first_id", "last_id"], [pa.string(), *[pa.int64()] * 5]
        for b in batches:
            rows = []
            for name, f in zip(b.column("path").to_pylist(), map(TokenFile, b.column("content").to_pylist()), strict=True):
                own = f.doc_ids[f.doc_ids != _NO_ID]
                rows.append((name, f.part, f.serial, int(f.lengths.sum()), int(own.min()) if len(own) else None, int(own.max()) if len(own) else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    files = read_blobs(tune(spark), path)
    return materialize(files.mapInArrow(run, "path string, part long, serial long, tokens long, first_id long, last_id long"), "token-index")


def read_tokens(spark: SparkSession, path: str, wanted: Iterable[int] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of the doc_ids in ``wanted``; ids as little-endian bytes.

    ``start`` counts the ids of all documents before it, over all files. ``index`` is what :func:`index_tokens` returned for these files, so that a search of some
    documents reads no other files than those whose range holds one, and decompresses their frames only.
    """
    index = index_tokens(spark, path) if index is None else index
    only = None if wanted is None else np.array(sorted(set(wanted)), np.int64)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "serial", "doc_id", "within", "n_tokens", "ids"]
        for b in batches:
            for f in map(TokenFile, b.column(0).to_pylist()):
                before = np.cumsum(f.lengths) - f.lengths
                at = np.arange(len(f.doc_ids)) if only is None else np.flatnonzero(np.isin(f.doc_ids, only))
                for some in np.array_split(at, max(1, len(at) // 500)):
                    ids = [f.ids(int(i)).tobytes() for i in some]
                    doc_ids = [None if d == _NO_ID else int(d) for d in f.doc_ids[some]]
                    columns = [pa.array([f.part] * len(some), pa.int64()), pa.array([f.serial] * len(some), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(before[some], pa.int64()), pa.array(f.lengths[some], pa.int64()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    # a number per file; files are summed within their range first, so the one ordered sum is over the ranges
    parts = index.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", (F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")).alias("before_part"))
    starts = index.withColumn("before", F.sum("tokens").over(W.partitionBy("part").orderBy("serial")) - F.col("tokens")).join(parts, "part")
    starts = starts.select("part", "serial", (F.col("before") + F.col("before_part")).alias("before"))
    files = read_blobs(spark, path)
    if only is not None:
        held = index.where(F.exists(F.lit(only.tolist()), lambda i: i.between(F.col("first_id"), F.col("last_id")))) if len(only) else index.where("false")
        found = [r["path"] for r in held.select("path").collect()]  # a document is in one file, but for repeated ids
        files = spark.read.format("binaryFile").load(found) if found else files.where("false")
    rows = files.select("content").mapInArrow(decode, "part long, serial long, doc_id long, within long, n_tokens long, ids binary")
    return rows.join(starts, ["part", "serial"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from token files."""
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
