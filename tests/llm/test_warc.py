from __future__ import annotations

import base64
import gzip
import hashlib

from latticework.llm import warc
from latticework.llm.common import new_path, table
from latticework.llm.queries import op9_warc


def brute(pages):
    best: dict[bytes, int] = {}
    for i, h in pages:
        best[h] = max(i, best.get(h, i))
    return sorted((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if best[h] == i else "revisit", None if best[h] == i else best[h]) for i, h in pages)


def test_query_equals_brute_force(spark, sf):
    want = brute([(r.page_id, (r.html or "").encode()) for r in table(spark, sf, "pages").collect()])
    assert sorted(map(tuple, op9_warc(spark, sf).collect())) == want


def made(spark, label, **options):
    long = "ä<p>\r\n\r\nWARC/1.0\r\n" * 20_000
    pages = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (4, "http://b/\r\nevil: 1", ""), (5, "http://b/5", long), (6, "http://b/6", long), (7, "http://c/7", long + "."), (None, "http://d", "n"), (8, "http://d", "n"), (9, "u", "r"), (9, "u", "r")]
    df = spark.createDataFrame([(*p, "extra", 5) for p in pages], "page_id long, url string, html string, payload string, record_type int")
    path = new_path(spark, label)
    warc.archive(df, path, **options)
    return path, long


def test_round_trip_and_edges(spark):
    path, long = made(spark, "warc-test")
    got = {(r.record_id, r.record_type, r.refers_to): r for r in warc.read(spark, path).collect()}
    page = lambda i: f"urn:page:{i}"
    assert set(got) == {(page(1), "revisit", page(2)), (page(2), "response", None), (page(3), "revisit", page(4)), (page(4), "response", None), (page(5), "revisit", page(6)), (page(6), "response", None), (page(7), "response", None), (None, "revisit", page(8)), (page(8), "response", None), (page(9), "response", None)}
    assert bytes(got[page(6), "response", None].payload).decode() == long and got[page(5), "revisit", page(6)].payload is None
    assert got[page(5), "revisit", page(6)].payload_bytes == len(long.encode())
    assert got[page(4), "response", None].target_uri == "http://b/ evil: 1" and got[page(3), "revisit", page(4)].target_uri is None
    assert warc.read(spark, path).count() == 11
    few, _ = made(spark, "warc-test", min_revisit_bytes=2)
    assert warc.read(spark, few).where("record_type = 'revisit'").count() == 1


def test_filters_reach_the_reader(spark):
    path, _ = made(spark, "warc-test")
    df = warc.read(spark, path, payload="skip").where("record_type = 'revisit' AND target_uri LIKE 'http://a%'")
    assert [(r.record_id, r.payload) for r in df.collect()] == [("urn:page:1", None)]
    reader = warc.WarcReader(path, "read", 10)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("EqualTo", "record_type", "response")]


def test_empty_and_foreign_archives(spark, tmp_path):
    path = new_path(spark, "warc-test")
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).collect() == []
    body = b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nhello"
    rec = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\nContent-Type: application/http;\r\n msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(info + rec)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(rec))
    got = warc.read(spark, str(tmp_path)).where("record_type = 'response'").collect()
    assert [(r.target_uri, bytes(r.payload)) for r in got] == [("http://x/", b"hello")] * 2
    assert warc.read(spark, str(tmp_path)).count() == 4
