import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from listingmill.llm import warc

PAGES = [(1, "http://a/1", "x" * 1500), (2, "http://a/2\n", "x" * 1500), (3, None, "short"), (4, "http://a/4", "short"), (5, "http://ä/5", None), (None, "http://a/n", "x" * 1500), (6, "u", "y" * 999), (7, "u", "y" * 999), (8, "u", "\r\n\r\nWARC/1.1 é" * 200), (9, "u", "x" * 1500), (9, "u", "x" * 1500)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in PAGES], "page_id long, url string, html string, digest int")


def test_round_trip(spark, pages):
    archives = warc.write_archives(pages, archive_bytes=2000)
    assert archives.agg(F.sum("records")).first()[0] == len(PAGES) and archives.count() > 1
    rows = warc.read_archives(archives).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        body = next((h or "") for i, _, h in PAGES if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), hashlib.sha1(body.encode()).hexdigest())
        if body == "x" * 1500 and r.page_id != 9:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 9, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body.encode())


def test_archive_layout(spark, pages):
    path = warc.write_archives(pages).first()["path"]
    data = open(path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    d = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    # each record is a frame of its own
    one = zstandard.ZstdDecompressor(dict_data=d).decompress(data[8 + size :])
    assert one.startswith(b"WARC/1.1\r\n") and one.count(b"WARC-Record-ID") == 1


def test_past_the_broadcast_bound(spark, pages):
    rows = lambda df: sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_digest) for r in df.collect())
    assert rows(warc.read_archives(warc.write_archives(pages, broadcast_rows=0))) == rows(warc.read_archives(warc.write_archives(pages)))


def test_dictionary_of_long_pages_only(spark):
    page = lambda i: "<p>" + "".join(f"<b>entry {i}-{k}</b> lorem ipsum dolor " for k in range(9000)) + "</p>"
    long = spark.createDataFrame([(i, "u", page(i)) for i in range(12)], "page_id long, url string, html string")
    data = warc.dictionary(long)
    assert 0 < len(data) <= warc.DICT_BYTES
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(warc.write_archives(long)).collect()}
    assert got == {i: page(i) for i in range(12)}


def test_empty(spark, pages):
    assert warc.archived(spark, pages.where(F.lit(False))).count() == 0
