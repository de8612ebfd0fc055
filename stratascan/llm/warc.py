"""Legacy web archives to WARC, and the reading of both.

ARC files (version 1: five header fields, version 2: ten) are read by their own version block and by the lengths
that their header lines declare. Each record becomes a WARC record with an identifier, a timestamp, a type and
digests derived from it, so that a rerun makes the same ones. Of HTTP records with equal payloads the one with
the largest page_id is a response and the others are revisits; ties go by file and position.

A null URL is written as ``about:blank``, a null html as an empty payload, a null page_id as none: it comes back
null and is the smallest. Repeated rows are records of their own. A very long html is one record, in a file of its own if need be. An empty table gives an
empty result. Only page_id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratascan.llm.common import drop_path, join_repeated, materialize, read_blobs, shared_path, shuffle_partitions, table, tune, write_blobs

# Fixed values of the two ARC versions: the header fields in order.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}

#: A gzip member without content; ends every archive file.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"

#: Compressed bytes, bytes of content and records after any of which a file is closed; readers hold a file's content.
FILE_BYTES, FILE_CONTENT, FILE_RECORDS = 4 << 20, 32 << 20, 5000
#: Archives in a task that converts them.
TASK_FILES = 12
LEVEL = 1
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gunzip(data: bytes, step: int = 8192) -> bytes:
    """Content of all members of a gzip file. A member is read in steps, so what lies behind it is never copied as a whole."""
    out, at = [], 0
    while at < len(data):
        z, size = zlib.decompressobj(31), step
        while not z.eof:
            part = data[at : at + size]
            if not part:
                raise EOFError("gzip member cut short")
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
            size = min(2 * size, 1 << 20)
        while data[at : at + 1] == b"\0":  # padding between members
            at += 1
    return b"".join(out)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 stratascan\n{' '.join(FIELDS[version])}\n".encode()
    line = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"}
    return line[version].encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, body: bytes) -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    extra = f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{extra} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed ARC file: its fields by name, and ``body`` of the declared length."""
    at, fields = 0, FIELDS[1]
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        end = data.find(b"\n", at)
        if end < 0:
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        opening = line.startswith("filedesc://")
        length = int(line.rpartition(" ")[2])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"ARC record cut short: {line[:200]}")
        at = end + 1 + length
        if opening:
            first = body.split(b"\n", 1)[0].split()
            fields = FIELDS[int(first[0])]
            continue
        values = line.rsplit(" ", len(fields) - 1)  # addresses may hold blanks
        if len(values) != len(fields):
            raise ValueError(f"ARC header line has {len(values)} of {len(fields)} fields: {line[:200]}")
        yield dict(zip(fields, values, strict=True)) | {"body": body}


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, head, payload) of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + gap, payload


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(content): ARC files of the pages, version 1 and 2 in turn, a gzip member per record."""
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, parts, size, content, records = TaskContext.get().partitionId(), 0, [], 0, 0, 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary())], ["content"])
        for b in batches:
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                version, name = 1 + (part + serial) % 2, f"pages-{part:05d}-{serial:05d}.arc"
                html = html or b""
                date = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                if not parts:
                    parts, size = [member(arc_version_block(version, name, date))], 0
                mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{mark}\r\n".encode()
                parts.append(member(arc_record(version, name, size, url, date, head + html)))
                size += len(parts[-1])
                content += len(head) + len(html)
                records += 1
                if size >= FILE_BYTES or content >= FILE_CONTENT or records >= FILE_RECORDS:
                    yield out(parts)
                    parts, serial, content, records = [], serial + 1, 0, 0
        if parts:
            yield out(parts)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return rows.mapInArrow(run, "content binary")


def arc_index(files: DataFrame) -> DataFrame:
    """(file, nth, page_id, url, date, digest, sha256, bytes) of every record in ARC files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "nth", "page_id", "url", "date", "digest", "sha256", "bytes"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for i, r in enumerate(parse_arc(gunzip(content))):
                    fields, _, payload = http_parts(r["body"])
                    page_id = fields.get("x-page-id")
                    rows.append((path, i, None if page_id is None else int(page_id), r["URL"], r["Archive-date"], sha1_base32(payload), hashlib.sha256(payload).hexdigest(), len(payload)))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.mapInArrow(run, "file string, nth long, page_id long, url string, date string, digest string, sha256 string, bytes long")


# --- WARC


def record_id(url: str, date: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id}')}>"


def warc_date(arc_date: str) -> str:
    """Of 14 digits, or of fewer as early archives have them."""
    d = arc_date.ljust(14, "0") if len(arc_date) >= 8 else (arc_date + "0101")[:8].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, ident: str, date: str, content_type: str, block: bytes, more: dict[str, str]) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date} | more
    fields |= {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def convert(arc: bytes, revisits: dict[int, dict]) -> bytes:
    """One WARC file of one ARC file; ``revisits``: by position, the record that holds the same payload."""
    out = [member(warc_record("warcinfo", record_id(hashlib.sha1(arc).hexdigest(), "", None), warc_date("20200101"), "application/warc-fields", b"software: stratascan\r\nformat: WARC File Format 1.0\r\n", {}))]
    for i, r in enumerate(parse_arc(gunzip(arc))):
        url, date, block = r["URL"], r["Archive-date"], r["body"]
        is_http = block.startswith(b"HTTP/")
        fields, head, payload = http_parts(block) if is_http else ({}, b"", block)
        page_id = int(fields["x-page-id"]) if "x-page-id" in fields else None
        more = {"WARC-Target-URI": url, "WARC-IP-Address": r["IP-address"], "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
        kind = "response" if is_http else "resource"
        if first := revisits.get(i):
            kind, block = "revisit", head
            more |= {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first["url"], first["date"], first["page_id"]), "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": warc_date(first["date"])}
            if first["page_id"] is not None:
                more["X-Refers-To-Page-Id"] = str(first["page_id"])
        out.append(member(warc_record(kind, record_id(url, date, page_id), warc_date(date), "application/http; msgtype=response" if is_http else r["Content-type"], block, more)))
    return b"".join(out)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of an uncompressed WARC file; block digests are checked."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if f"sha1:{sha1_base32(block)}" != fields["warc-block-digest"]:
            raise ValueError(f"block digest differs: {fields['warc-record-id']}")
        yield fields, block
        at = end + 4 + length + 4


def convert_archives(arc_files: DataFrame, out: str, min_bytes: int = 0) -> None:
    """Write a WARC file into ``out`` for every ARC file (path, content)."""
    index = materialize(arc_index(arc_files), "arc-index")
    order = F.struct("page_id", "file", "nth", "url", "date")
    groups = index.where(F.col("bytes") >= min_bytes).groupBy("sha256").agg(F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups, "arc-groups")
    again = join_repeated(index.where(F.col("bytes") >= min_bytes).select("sha256", "file", "nth"), groups, "sha256", ["file", "nth"], "inner")
    again = again.where((F.col("file") != F.col("last.file")) | (F.col("nth") != F.col("last.nth")))
    # a file has a bounded number of records
    per_file = again.groupBy("file").agg(F.collect_list(F.struct("nth", "last.page_id", "last.url", "last.date")).alias("revisits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, revisits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([convert(content, {r["nth"]: r for r in revisits or []})], pa.binary())], ["content"])

    # the archives are dealt once, some tens of megabytes a task however many there are
    n = max(shuffle_partitions(arc_files.sparkSession), -(-arc_files.select("path").count() // TASK_FILES))
    files = arc_files.repartition(n, "path").join(per_file.withColumnRenamed("file", "path").repartition(n, "path"), "path", "left").select("content", "revisits")
    write_blobs(files.mapInArrow(run, "content binary"), "content", out, EMPTY_MEMBER)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_id, payload_bytes, payload_digest, record_type, refers_to) of the page records in WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = []
                for fields, block in parse_warc(gunzip(content)):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and digest != sha1_base32(payload):
                        raise ValueError(f"payload digest differs: {fields['warc-record-id']}")
                    n = len(payload) if fields["warc-type"] == "response" else int(http["content-length"])
                    rows.append((number(http.get("x-page-id")), fields["warc-target-uri"], fields["warc-record-id"], n, digest, fields["warc-type"], number(fields.get("x-refers-to-page-id"))))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read_blobs(spark, path).select("content").mapInArrow(run, schema)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC files, the converter, and the WARC files read back."""
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_blobs(pages_to_arc(table(spark, sf_dir, "pages")), "content", arcs, EMPTY_MEMBER)
    convert_archives(read_blobs(spark, arcs), warcs)
    drop_path(spark, arcs)
    return read_warc(spark, warcs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST(concat('0x', substr(x, CAST(i // 4 * 5 + 1 AS INT), 5)) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""
