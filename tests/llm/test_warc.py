import gzip
from collections import defaultdict

import pytest

from calibrant.llm.common import table
from calibrant.llm.warc import base32_sha1, parse, ranges, read_warc, record, write_warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/x y\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "", None), (4, "http://b", ""), (5, "http://c", "z" * 300_000), (6, "http://d", "<P>É</P>"), (7, "http://e", "<p>é</p>"), (7, "http://e", "<p>é</p>"), (None, "http://f", "<p>é</p>"), (8, "u", "a\r\n\r\nb")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, offset int, archive string")


def test_round_trip(pages):
    index = write_warc(pages, archive_bytes=500)
    back = read_warc(index).collect()
    rows = pages.collect()
    assert len(back) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r["html"] or ""].append(r["page_id"])
    for r in back:
        html = next(x["html"] or "" for x in rows if x["page_id"] == r["page_id"])
        keep = max((i for i in groups[html] if i is not None), default=None)
        response = r["page_id"] is None or r["page_id"] == keep
        assert r["record_type"] == ("response" if response else "revisit")
        assert r["refers_to"] == (None if response else keep)
        assert r["payload"] == (html if response else None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), base32_sha1(html.encode()))


def test_archives_are_members_that_gzip_reads(pages):
    index = write_warc(pages).collect()
    for name in {r["archive"] for r in index}:
        path = name.removeprefix("file://").removeprefix("file:")
        data = gzip.open(path).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        assert data.count(b"WARC/1.1\r\n") == sum(r["archive"] == name for r in index)


def test_small_payloads_may_stay_responses(pages):
    kinds = {r["page_id"]: r["record_type"] for r in read_warc(write_warc(pages, revisit_bytes=100)).collect()}
    assert set(kinds.values()) == {"response"}


def test_ranges_and_records():
    assert ranges([(0, 10), (10, 5), (40, 5), (200, 5)], gap=30, span=100) == [(0, 45, 0, 3), (200, 205, 3, 4)]
    assert [x[:2] for x in ranges([(0, 80), (80, 80)], gap=10, span=100)] == [(0, 80), (80, 160)]
    good = record(1, "u", b"abc", base32_sha1(b"abc"), None)
    assert parse(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        parse(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        parse(good[:-3])


def test_some_records_and_none(spark, pages):
    index = write_warc(pages)
    assert [r["page_id"] for r in read_warc(index.where("page_id = 5")).collect()] == [5]
    assert read_warc(write_warc(pages.where("false"))).count() == 0


def test_all_pages(spark):
    src = table(spark, "/root/testdata/sf0.001", "pages")
    assert read_warc(write_warc(src)).where("record_type = 'response'").select("page_id", "payload").exceptAll(src.selectExpr("page_id", "coalesce(html, '')")).count() == 0
