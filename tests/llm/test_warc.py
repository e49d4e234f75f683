import base64
import gzip
import hashlib

import pytest

from tessella.llm import warc
from tessella.llm.shared import workdir
from tessella.llm.warc import CaptureIndex, archive_round_trip, build_index, capture_key, parse_record, url_key, write_archives


def wanted(rows, least=0):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= least and first[html or ""] is not None and first[html or ""] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert got(archive_round_trip(pages)) == wanted(rows)


ROWS = [
    (5, "http://a.example/x", "same"), (3, "http://b.example/y?q=1", "same"), (9, "https://A.example:8443/ü z", "same"), (1, None, None),
    (2, "http://c.example", ""), (7, "not a url\r\nX: y", "other é"), (8, "http://a.example/x", "x" * 200_000), (4, "http://[bad", "same"),
    (-6, "http://a.example/x", "neg"),
]


@pytest.mark.parametrize("least", [0, 3, 10])
def test_odd_rows(spark, least):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "page_id long, url string, html string, sha string, key string")
    assert got(archive_round_trip(pages, least)) == wanted(ROWS, least)


def test_repeated_and_idless_rows(spark):
    rows = [(1, "http://a/", "p"), (1, "http://a/", "p"), (None, "http://a/", "p"), (None, "http://b/", "alone")]
    found = got(archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert found == wanted(rows)
    assert archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_shuffled_path_and_a_payload_of_most_pages(spark, monkeypatch):
    from tessella.llm import shared

    monkeypatch.setattr(warc, "BROADCAST_IDS", -1)
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    rows = [(k, f"http://h{k}.example/", "hot" if k % 2 else f"own {k // 4}") for k in range(100)] + [(None, "http://x/", "hot"), (None, None, "hot")]
    found = archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert found.rdd.getNumPartitions() > 1 and got(found) == wanted(rows)


def test_index_has_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example/{k}", f"text {k // 2}") for k in range(60)], "page_id long, url string, html string")
    folder = workdir(spark, "warc-test")
    files = build_index(write_archives(pages, folder), folder)
    rows = files.collect()
    index = CaptureIndex([(r.first_key, r.uri) for r in rows])
    for k in range(60):
        captures = index.find(capture_key(f"http://h{k % 7}.example/{k}", k))
        headers, _ = index.read(captures[0])
        assert len(captures) == 1 and headers["warc-record-id"] == f"<urn:page:{k}>"
    assert index.find(capture_key("http://h0.example/none", 1)) == []


def test_keys_sort_by_reversed_host():
    assert url_key("https://www.b.example:8080/x?y#z") == "example,b,www:8080)/x?y"
    assert url_key("http://b.example:80") == "example,b)/"
    assert capture_key("http://a/", -5) < capture_key("http://a/", 3) < capture_key("http://a/", 20)


def test_members_stand_alone_and_damage_is_seen():
    data = gzip.compress(warc.record("http://a/", 1, b"payload", None, "1970-01-01T00:00:00Z"))
    headers, payload = parse_record(gzip.decompress(data))
    assert payload == b"payload" and headers["warc-type"] == "response"
    with pytest.raises(ValueError):
        parse_record(gzip.decompress(data).replace(b"payload", b"paylaod"))


def test_query_equals_sql(agree):
    from tessella.llm.queries import QUERIES, SQL

    agree(QUERIES["op8_warc_index"], SQL["op8_warc_index"], "/root/testdata/sf0.01")
