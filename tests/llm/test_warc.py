import base64
import gzip
import hashlib

import pytest

from stratascan.llm import warc
from tests.llm.data import write

PAGE = "page_id long, url string, html string, file string, nth int"


def test_pages_through_archives(spark, tmp_path):
    htmls = ["<p>a</p>", "<p>b</p>", None, "", "<p>a</p>", "é\r\n\r\n日本", "<p>a</p>", "x" * 100_000]
    rows = [(i, None if i == 3 else f"http://h/{i} x\n", h, "f", 1) for i, h in enumerate(htmls)] + [(None, "http://h/n", "<p>a</p>", "f", 1)]
    sf_dir = write(spark, tmp_path, spark.createDataFrame(rows, PAGE), "pages")
    got = {r.page_id: tuple(r)[1:] for r in warc.op7_arc_to_warc(spark, sf_dir).collect()}
    last = {}
    for i, h in enumerate(htmls):
        last[h or ""] = i
    for i, h in [*enumerate(htmls), (None, "<p>a</p>")]:
        data = (h or "").encode()
        keep = last[h or ""] == i
        assert got[i] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if keep else "revisit", None if keep else last[h or ""])
    assert len(got) == len(rows)


def test_repeated_pages_and_none(spark, tmp_path):
    sf_dir = write(spark, tmp_path, spark.createDataFrame([(1, "http://h/", "p", "f", 1)] * 3, PAGE), "pages")
    got = warc.op7_arc_to_warc(spark, sf_dir).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]
    empty = write(spark, tmp_path / "e", spark.createDataFrame([], PAGE), "pages")
    assert warc.op7_arc_to_warc(spark, empty).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_and_declared_lengths(version):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\nworld", b"", b"1.2.3.4\n\nhttp://x 0.0.0.0 20200101000000 text/html 5\nabc"]
    data = warc.arc_version_block(version, "x.arc", "20200101000000")
    for i, b in enumerate(bodies):
        data += warc.arc_record(version, "x.arc", i, f"http://h/{i} q", "20200101000000", b)
    got = list(warc.parse_arc(data))
    assert [r["body"] for r in got] == bodies and [r["URL"] for r in got] == [f"http://h/{i}%20q" for i in range(3)]
    assert all(set(r) - {"body"} == set(warc.FIELDS[version]) for r in got)
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-10]))
    records = list(warc.parse_warc(gzip.decompress(warc.convert(gzip.compress(data), {}))))
    assert [f["warc-type"] for f, _ in records] == ["warcinfo", "response", "resource", "resource"]
    assert [b for _, b in records[1:]] == bodies and records[1][0]["warc-date"] == "2020-01-01T00:00:00Z"
    again = list(warc.parse_warc(gzip.decompress(warc.convert(gzip.compress(data), {}))))
    assert [f["warc-record-id"] for f, _ in again[1:]] == [f["warc-record-id"] for f, _ in records[1:]]


def test_members_of_any_size_are_read():
    parts = [b"", b"a", b"x" * 100_000, bytes(range(256)) * 4000, b"", b"end"]
    data = b"".join(map(gzip.compress, parts))
    assert warc.gunzip(data) == gzip.decompress(data) == b"".join(parts)
    assert warc.gunzip(data, step=7) == b"".join(parts) and warc.gunzip(b"") == b"" and warc.gunzip(data + b"\0\0") == b"".join(parts)
    with pytest.raises(EOFError):
        warc.gunzip(data[:-3])


def test_archives_are_closed_by_what_they_hold_unpacked(spark, monkeypatch):
    """Pages that pack a thousand to one: no archive holds more than the bound and a page."""
    monkeypatch.setattr(warc, "FILE_CONTENT", 3_000_000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 1_000_000, "f", 1) for i in range(20)], PAGE).coalesce(1)
    sizes = [len(warc.gunzip(bytes(r.content))) for r in warc.pages_to_arc(pages).collect()]
    assert sum(sizes) > 20_000_000 and max(sizes) < 4_100_000 and len(sizes) == 7


def test_damage_is_noticed():
    record = warc.warc_record("response", "<x>", "2020-01-01T00:00:00Z", "text/plain", b"abc", {})
    assert [b for _, b in warc.parse_warc(record)] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse_warc(record.replace(b"abc", b"abd")))
